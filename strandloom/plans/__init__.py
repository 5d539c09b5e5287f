"""Whole searches, and their bindings to tables."""
