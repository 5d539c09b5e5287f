"""Column functions over sequences, alignments and their statistics."""
