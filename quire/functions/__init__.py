"""Column expressions over text lines."""
