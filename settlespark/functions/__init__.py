"""Column expressions: clock arithmetic, features, guards and formatting."""
