"""Column expressions and small pure helpers shared by the operators."""
