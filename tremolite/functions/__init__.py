"""Column functions: geodesy, scalars and p-values."""
