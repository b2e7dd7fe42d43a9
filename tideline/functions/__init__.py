"""Column expressions: positions, names, encodings."""
