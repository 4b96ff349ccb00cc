"""Column functions: text, arrays, losses."""
