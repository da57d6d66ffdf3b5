"""Column expressions and small analyses."""
