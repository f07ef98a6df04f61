"""Column functions: text, sets, vectors, statistics."""
