"""Column expressions: missing-value rules, text and numeric scalars, geodesy, special functions."""
