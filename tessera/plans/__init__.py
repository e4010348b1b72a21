"""Compilers from other query languages to Spark plans."""
