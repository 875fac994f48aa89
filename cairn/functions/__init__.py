"""Column expressions, one text for each of two SQL dialects."""
