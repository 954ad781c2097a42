"""Column expressions: vectors, scores, text, records."""
