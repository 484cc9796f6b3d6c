"""Column expressions and window helpers."""
