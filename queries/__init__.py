"""Registered queries over the given tables, and the reference SQL they are checked against."""
