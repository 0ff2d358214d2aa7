"""Column functions and fixed dictionaries."""
