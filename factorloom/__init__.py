"""factorloom: cross-sectional factor analytics as lazy PySpark DataFrame operators."""
