"""Column expressions: text, scores and vectors."""
