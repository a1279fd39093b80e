"""Operators: DataFrame in, DataFrame out; nothing is collected unless its size is bounded."""
