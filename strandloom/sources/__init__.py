"""Sequence sources and report sinks."""
