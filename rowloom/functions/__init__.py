"""Column expressions: text, answers and row identity."""
