"""Values and literals."""
