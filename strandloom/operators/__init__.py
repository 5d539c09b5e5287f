"""Index, seed, candidate, alignment, selection and routing operators."""
