"""Column expressions and NumPy helpers."""
