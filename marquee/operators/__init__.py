"""Operators: DataFrame(s) + parameters -> DataFrame."""
