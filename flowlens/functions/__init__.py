"""Column functions: time grid, scalar expressions, arrays."""
