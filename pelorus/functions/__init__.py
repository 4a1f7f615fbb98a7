"""Column expressions, aggregates and kernels."""
