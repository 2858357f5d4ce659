"""Column expressions: text, scores, attribute resolution, draws."""
