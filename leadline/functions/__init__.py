"""Column expressions: geometry, bin labels, statistics."""
