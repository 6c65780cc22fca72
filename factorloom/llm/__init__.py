"""Operators of a training-data pipeline over documents and conversations.

Nothing else in the library imports this package. Each module states one operator; ``queries`` registers one query for each.
"""
