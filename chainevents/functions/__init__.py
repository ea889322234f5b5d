"""Column expressions and the small byte helpers used inside decode tasks."""
