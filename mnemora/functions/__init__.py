"""Column functions: text, scores, vectors, normalisation."""
