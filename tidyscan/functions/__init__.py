"""Column expressions and small shared aggregations."""
