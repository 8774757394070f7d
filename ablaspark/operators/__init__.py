"""Operators: DataFrame in, DataFrame out. Each module covers one kind of work."""
