"""Queries over the benchmark tables, and the SQL they must agree with."""
