"""Column-level building blocks: text, counts, scores."""
