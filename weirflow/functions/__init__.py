"""Column-level languages - literals, regular expressions, format strings, expressions."""
