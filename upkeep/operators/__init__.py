"""Operators: DataFrame(s) + parameters -> lazy DataFrame."""
