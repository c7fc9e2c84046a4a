"""Column expressions, fixed value lists and order statistics."""
