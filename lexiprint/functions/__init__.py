"""Column expressions over text and arrays."""
