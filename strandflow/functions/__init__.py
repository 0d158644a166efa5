"""Column expressions and numpy kernels on sequences and records."""
