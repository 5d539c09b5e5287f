"""Secret scans: three base patterns, and random strings found by their token efficiency.

A run of credential characters that a byte-pair vocabulary can only spell in very
short tokens is random; words, names and paths take long tokens. Runs that are known
digests (their length and hexadecimal letters), UUIDs, numbers, or identifiers made of
words and counters are left out first. A run has ``least`` letters or more (16: shorter
ones are too few for a ratio to tell) and needs no digit; one limit holds for all. A run
of parts joined by marks is an identifier where its letters alone, part by part, are
spelled at the limit or above it; else it is measured like any.

Spans are (kind, start, end) in code points, end exclusive. Defined cases: null text is
empty and has no span; a text of any length is scanned whole; equal rows give equal
rows; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from strandloom.llm._shared import slices

#: The kinds in their order, each with its pattern, the group that is measured and its least length (fixed values).
BASE = (
    ("assign", r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A, 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 0, 20),
    ("hex", r"[0-9a-f]+", 0, 0, 24),
)
_BASE = [(kind, re.compile(p, f), g, least) for kind, p, f, g, least in BASE]
#: Hexadecimal lengths of md5, sha1, sha224, sha256, sha384 and sha512 (fixed values).
DIGEST_LENGTHS = frozenset((32, 40, 56, 64, 96, 128))
_HEX_RUN = re.compile(r"[0-9a-f]{24,}")
_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
RUN_LEAST = 16
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_NUMBER = re.compile(r"[0-9+/_=-]+")
_PART = r"(?:[A-Z]?[a-z]+[0-9]{0,4}|[A-Z]+[0-9]{0,4}|[0-9]{1,8}|[0-9]{1,2}T[0-9]{1,2}Z?)"
_NAMED = re.compile(rf"{_PART}(?:[_/.+-]+{_PART})+[_/.+-]*|[A-Z]?[a-z]{{3,}}[0-9]{{1,4}}")
#: Parts that are long enough to tell words from random letters.
_WORDS = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}")
CHARS_PER_TOKEN = 2.0


class TokenEfficiency:
    """Characters per token under a tiktoken vocabulary."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, run: str) -> float:
        return len(run) / max(1, len(self.encoding.encode_ordinary(run)))


def is_known(run: str, efficiency: TokenEfficiency, limit: float) -> bool:
    """A digest, UUID, number or identifier, which is no secret for being hard to spell."""
    bare = run.strip("=+/_-")
    if (_HEX.fullmatch(bare) and len(bare) in DIGEST_LENGTHS) or _UUID.fullmatch(bare) or _NUMBER.fullmatch(run):
        return True
    if not _NAMED.fullmatch(run):
        return False
    parts = _WORDS.findall(run)
    letters = sum(map(len, parts))
    return letters < 4 or letters >= limit * sum(len(p) / efficiency(p) for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the base patterns; matches that are too short are dropped.

    An assignment needs one of its words and a colon or equals sign somewhere in the text,
    which is looked for first; runs of hexadecimal letters are looked for with their least
    length, which finds the same runs.
    """
    found = []
    for k, (kind, pattern, group, least) in enumerate(_BASE):
        if kind == "assign":
            if ":" not in text and "=" not in text:
                continue
            low = text.lower()
            if not ("passw" in low or "secret" in low or "token" in low or "api" in low):
                continue
        for m in (_HEX_RUN if kind == "hex" else pattern).finditer(text):
            s, e = m.span(group)
            if e - s >= least:
                found.append((m.start(), k, m.end()))
    return sorted(found)


def runs(text: str, least: int = RUN_LEAST) -> list[tuple[int, int]]:
    """(start, end) of the maximal runs of credential letters that are long enough and no part of an address."""
    out = []
    # two less than the least length, as padding counts
    for m in re.finditer(rf"[A-Za-z0-9+/_-]{{{max(1, least - 2)},}}", text):
        s, e = m.span()
        pad = e
        while pad < min(len(text), e + 2) and text[pad] == "=":
            pad += 1
        if pad == len(text) or text[pad] not in _LETTERS:
            e = pad  # the padding of base 64
        if e - s >= least and text[e : e + 1] != "@":
            out.append((s, e))
    return out


def random_spans(text: str, efficiency: TokenEfficiency, limit: float = CHARS_PER_TOKEN) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the runs whose token efficiency is below ``limit``."""
    return [(s, len(BASE), e) for s, e in runs(text) if efficiency(text[s:e]) < limit and not is_known(text[s:e], efficiency, limit)]


def _named(spans: list[tuple[int, int, int]]) -> str:
    names = [b[0] for b in BASE] + ["random"]
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)


_ready: dict[str, TokenEfficiency] = {}


def _efficiency(path: str) -> TokenEfficiency:
    if path not in _ready:
        _ready[path] = TokenEfficiency(path)
    return _ready[path]


def scan_documents(docs: DataFrame, vocabulary: str, limit: float = CHARS_PER_TOKEN) -> DataFrame:
    """One row for each document: counts of the base kinds, a digest of the base spans, all spans."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        efficiency = _efficiency(vocabulary)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                cols: list[list] = [[] for _ in range(6)]
                for text in part.column("text").to_pylist():
                    base = base_spans(text) if text else []
                    extra = random_spans(text, efficiency, limit) if text else []
                    kinds = [k for _, k, _ in base]
                    row = (*(kinds.count(k) for k in range(3)), hashlib.sha256(_named(base).encode()).hexdigest(), _named(sorted(base + extra)), len(extra))
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                kinds_of = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds_of, strict=True))], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def mask(text: str, spans: list[tuple[int, int, int]], by: str = "[SECRET]") -> str:
    """``text`` with each span, overlapping ones together, replaced by one mark."""
    out, at = [], 0
    for s, _, e in sorted(spans):
        if s >= at:
            out += [text[at:s], by]
        at = max(at, e)
    return "".join([*out, text[at:]])


def mask_documents(docs: DataFrame, vocabulary: str, limit: float = CHARS_PER_TOKEN) -> DataFrame:
    """``docs`` with all secrets in ``text`` masked; other columns as they are, null texts null."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        efficiency = _efficiency(vocabulary)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = [t and mask(t, base_spans(t) + random_spans(t, efficiency, limit)) for t in part.column("text").to_pylist()]
                k = part.schema.get_field_index("text")
                yield part.set_column(k, part.schema.field(k), pa.array(texts, part.schema.field(k).type))

    return docs.mapInArrow(scan, docs.schema)
