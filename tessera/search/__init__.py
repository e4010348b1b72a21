"""Full-text and vector search."""
