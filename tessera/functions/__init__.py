"""Scalar functions with PostgreSQL semantics, as Spark columns."""
