"""Column functions and small shared helpers."""
