"""Tessera: PostgreSQL-flavoured analytics as DataFrame, SQL and Structured Streaming building blocks."""
