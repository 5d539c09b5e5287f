"""Options of a search: one frozen value with the checks between options."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace


@dataclass(frozen=True)
class SearchConfig:
    # seeds and index
    seed: int = 18
    passes: tuple[int, ...] | None = None
    interval: int = 1
    max_pos: int = 10_000
    part_mb: float = 3072
    num_seeds: int = 2
    min_lis: int = 2
    full_search: bool = False
    # reads
    max_read_len: int = 30_000
    forward: bool = True
    reverse: bool = True
    # scores and statistics
    match: int = 2
    mismatch: int = -3
    gap_open: int = 5
    gap_ext: int = 2
    score_n: int | None = None
    evalue: float = 1.0
    gumbel: tuple[float, float] | None = None
    score_split: int = 1
    edges: str = "4"
    # what is kept
    num_alignments: int = 1
    best: bool = True
    min_id: float | None = None
    min_cov: float | None = None
    otu_map: bool = False
    de_novo: bool = False
    # reports
    fastx: bool = False
    other: bool = False
    sam: bool = False
    sam_sq: bool = False
    blast: tuple[str, ...] | None = None
    print_all_reads: bool = False
    paired: bool = False
    paired_in: bool = False
    paired_out: bool = False
    out2: bool = False
    sout: bool = False
    zip_out: int = -1

    def __post_init__(self):
        bad = []
        if self.seed % 2 or not 8 <= self.seed <= 26:
            warnings.warn(f"seed length {self.seed} must be even and from 8 to 26: 18 is used", stacklevel=2)
            object.__setattr__(self, "seed", 18)
        if self.mismatch > 0:
            bad.append("mismatch must not be positive")
        if self.gap_ext > self.gap_open:
            bad.append("gap_ext must not exceed gap_open")
        if self.evalue < 0:
            bad.append("evalue must not be negative")
        if self.num_seeds < 1:
            bad.append("num_seeds must be positive")
        if self.num_alignments < 0:
            bad.append("num_alignments must not be negative")
        if self.paired_in and self.paired_out:
            bad.append("paired_in and paired_out exclude each other")
        if self.sout and (self.paired_in or self.paired_out):
            bad.append("sout excludes paired_in and paired_out")
        if self.other and not self.fastx:
            bad.append("other needs fastx")
        if self.otu_map and not self.best:
            bad.append("otu_map needs best alignments")
        if self.print_all_reads and not (self.sam or (self.blast and "0" not in self.blast)):
            bad.append("print_all_reads needs SAM or tabular output")
        if self.blast and "0" in self.blast and len(self.blast) > 1:
            bad.append("pairwise output excludes the tabular columns")
        if set(self.blast or ()) - {"0", "1", "cigar", "qcov", "qstrand"}:
            bad.append("blast takes 0, 1, cigar, qcov and qstrand")
        for name, value in (("min_id", self.min_id), ("min_cov", self.min_cov)):
            if value is not None and not 0 <= value <= 1:
                bad.append(f"{name} must be from 0 to 1")
        if self.passes is not None and (len(self.passes) != 3 or min(self.passes) < 1):
            bad.append("passes takes three positive steps")
        edge = self.edges.rstrip("%")
        if not edge.isdecimal() or not 1 <= int(edge) <= 10:
            bad.append("edges must be from 1 to 10, or that with %")
        if not (self.forward or self.reverse):
            bad.append("at least one strand must be searched")
        if bad:
            raise ValueError("; ".join(bad))

    @property
    def kmer(self) -> int:
        """Length of the database k-mers."""
        return self.seed + 1

    @property
    def half(self) -> int:
        return self.seed // 2

    @property
    def steps(self) -> tuple[int, ...]:
        """Window steps of the passes, equal neighbours once."""
        steps = self.passes or (self.seed, self.half, 3)
        return tuple(s for k, s in enumerate(steps) if k == 0 or s != steps[k - 1])

    @property
    def ambiguous(self) -> int:
        """Score of a letter against N."""
        return self.mismatch if self.score_n is None else self.score_n

    @property
    def identity(self) -> float:
        return self.min_id if self.min_id is not None else (0.97 if self.otu_map else 0.0)

    @property
    def coverage(self) -> float:
        return self.min_cov if self.min_cov is not None else (0.97 if self.otu_map else 0.0)

    @property
    def outputs(self) -> int:
        """How many read files a sink writes."""
        return 4 if self.out2 and self.sout else 2 if self.out2 or self.sout else 1

    def zipped(self, input_zipped: bool) -> bool:
        return self.zip_out == 1 or (self.zip_out == -1 and input_zipped)

    def with_(self, **changes) -> SearchConfig:
        return replace(self, **changes)
