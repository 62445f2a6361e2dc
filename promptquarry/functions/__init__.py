"""Column functions: patterns, text and identifiers."""
