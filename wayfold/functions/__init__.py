"""Column functions for names, paths and text forms."""
