"""Column functions: vectors, text, geometry."""
