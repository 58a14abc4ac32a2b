"""Column expressions over dense vectors."""
