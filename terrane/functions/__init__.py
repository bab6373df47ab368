"""Column expressions and small per-batch helpers."""
