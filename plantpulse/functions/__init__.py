"""Column expressions shared by the operators (built-in Spark functions only)."""
