"""Operators for preparing training data: ten methods, their queries and the SQL that checks them."""
