"""DataFrame -> DataFrame operators, grouped by research stage."""
