"""Column expressions: identifiers, numbers, scores, URLs."""
