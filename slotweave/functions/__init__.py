"""Column expressions (built-in functions only) and the few Arrow helpers."""
