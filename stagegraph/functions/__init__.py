"""Column functions: scalars and output names."""
