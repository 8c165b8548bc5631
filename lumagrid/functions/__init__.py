"""Column expressions over images."""
