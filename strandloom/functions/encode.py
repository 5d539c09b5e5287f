"""Sequence text as columns: alphabets, strands, k-mers and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC letters and the base that the seed index takes for each (fixed values).
IUPAC_LETTERS, IUPAC_BASES = "RYSWKMBDHVN", "ACGAGACAAAA"


def seed_alphabet(seq: Column) -> Column:
    """ACGT: U is T, every other letter is A."""
    return F.regexp_replace(F.translate(F.upper(seq), "U", "T"), "[^ACGT]", "A")


def align_alphabet(seq: Column) -> Column:
    """ACGTN: U is T, every other letter is N."""
    return F.regexp_replace(F.translate(F.upper(seq), "U", "T"), "[^ACGT]", "N")


def index_alphabet(seq: Column) -> Column:
    """ACGT by the fixed choice of a base for each IUPAC letter; what is left is A."""
    return F.regexp_replace(F.translate(F.upper(seq), "U" + IUPAC_LETTERS, "T" + IUPAC_BASES), "[^ACGT]", "A")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")


def kmer_code(kmer: Column) -> Column:
    """A k-mer as a base 4 number, first letter highest."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def display_id(header: Column) -> Column:
    """A header up to its first space without leading > and @."""
    return F.regexp_replace(F.substring_index(header, " ", 1), "^[>@]+", "")


def sam_id(header: Column) -> Column:
    """A header up to its first space or tab without leading > and @."""
    return F.regexp_extract(F.regexp_replace(header, "^[>@]+", ""), r"^[^ \t]*", 0)


def window_count(length: Column, seed: int, step: int) -> Column:
    return F.when(length >= seed, F.floor((length - seed + step) / step)).otherwise(F.lit(0))


def edge_length(length: Column, edges: str) -> Column:
    """Extra letters on each side: a number, or per cent of the read."""
    n = int(edges.rstrip("%"))
    return F.floor(length * n / 100).cast("int") if edges.endswith("%") else F.lit(n)


def text_sequence(text: Column) -> Column:
    """Letters of any text as bases, in turn; other characters are left out."""
    return F.translate(F.upper(F.regexp_replace(text, "[^A-Za-z]", "")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ACGTACGTACGTACGTACGTACGTAC")
