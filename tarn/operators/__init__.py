"""Operators: DataFrame -> DataFrame, for a batch of queries at a time."""
