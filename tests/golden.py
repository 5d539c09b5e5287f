"""Sequences with known alignments, and what is known of them."""

from pathlib import Path


def sequences() -> dict[str, str]:
    blocks = (Path(__file__).parent / "data" / "golden_sequences.txt").read_text().split("\n\n")
    return {b.split("\n")[0]: "".join(b.split("\n")[1:]).strip() for b in blocks}


# The known results of searching these sequences.
LONG_CIGAR = "57M2I12M2D4M2I29M1D11M2I3M2D11M1I7M1D13M5D4M3D9M2D3M7D1260M"
LONG_ROW = {"pident": "93.5", "length": 1430, "mismatch": 64, "gaps": 30, "qstart": 58, "qend": 1487, "sstart": 1, "send": 1446, "bitscore": 2069}
LONG_SCORE = 2430
SHORT_SAM = {(0, 1, "101M", 202, 0), (16, 102, "101M", 202, 0)}
