"""Column expressions and small exact helpers."""
