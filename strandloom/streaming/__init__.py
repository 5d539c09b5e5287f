"""File-arrival search."""
