"""Column expressions for text and labels."""
