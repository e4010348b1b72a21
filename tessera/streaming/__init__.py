"""Change feeds and causal logs."""
