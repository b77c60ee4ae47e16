"""Results row by row."""
