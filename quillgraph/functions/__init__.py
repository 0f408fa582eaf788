"""Column expressions and pure planning functions."""
