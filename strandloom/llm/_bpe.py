"""Token ids of whole text batches by the tokenizers library, each distinct piece encoded once.

Both vocabularies split text before merging, and no split unit runs from a
non-space character into a following white-space character. So a text may be cut
before any space that follows a non-space character and its pieces encoded apart:
the ids are those of the whole text. Pieces repeat often; each distinct one goes
through the library once for every batch or cache life.

The ids are those of the library as its file makes it: a special token's string in a text
is that token. ``special_as_text`` makes such strings ordinary text instead. A vocabulary
file whose normalizer, split or added tokens are of no known kind is left to the library,
text by text.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: White space of Unicode, as the library's patterns have it, and the split patterns of the two
#: kinds of vocabulary (fixed values).
_SPACE = "".join(map(chr, (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_TWO_SPACES = rf"[{_SPACE}] |^ "
_PIECES = re.compile(rf"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+")
#: The two kinds' normalizer and pre-tokenizer as their files state them (fixed values).
_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_BYTE_KIND = (None, _LEVEL | {"use_regex": True})
_WORD_KIND = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _WORD_SPLIT}, "behavior": "Removed", "invert": True}, _LEVEL | {"use_regex": False}]},
)
#: Pieces with characters from here on are left to the library as they are.
_LATIN_END = chr(0x250)
#: Pieces that an encoder remembers, about 200 bytes each.
CACHE_PIECES = 800_000


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: printable Latin-1 stands for itself, the rest follow from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b if b in own else next(rest)) for b in range(256)}


class PieceEncoder:
    """Encodes Arrow text arrays. ``path``: a tokenizers vocabulary file."""

    def __init__(self, path: str, end_id: int, cache: int = CACHE_PIECES, special_as_text: bool = False):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model = self.tokenizer.model
        stated = json.loads(self.tokenizer.to_str())
        kind = (stated["normalizer"], stated["pre_tokenizer"])
        self.lower = kind == _WORD_KIND
        added = stated["added_tokens"]
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) and t["content"].split() == [t["content"]] for t in added)
        self.whole = kind not in (_BYTE_KIND, _WORD_KIND) or not plain or stated["truncation"] is not None or stated["padding"] is not None
        #: finds a piece with a special token, which goes to the library
        own = [re.escape(t["content"]) for t in added if not (special_as_text and t["special"])]
        self.letters_only = not any(t["content"].isalpha() for t in added)
        self.special = re.compile("|".join(own)).search if own else (lambda piece: None)
        self.split = regex.compile(_WORD_SPLIT if self.lower else _BYTE_SPLIT).findall
        self.letters = _byte_letters()
        self.end_id, self.cache = end_id, cache
        self._forget()
        if not self.whole:
            self.marks = {m: self._unit(m) for m in ".,"}

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.ends = array("I"), array("q", [0])

    def _add(self, piece: str, ids: list[int]) -> int:
        self.ids.extend(ids)
        self.known[piece] = k = len(self.ends) - 1
        self.ends.append(len(self.ids))
        return k

    def _unit(self, unit: str) -> list[int]:
        """Ids of one split unit, merged by the library's model."""
        mapped = unit.replace(" ", "\u0120") if unit.isascii() and unit.isprintable() else unit.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(mapped)]

    def _learn(self, piece: str) -> int:
        if (not piece.isascii() and max(piece) >= _LATIN_END) or self.special(piece):
            return self._add(piece, self.tokenizer.encode(piece, add_special_tokens=False).ids)
        plain = piece
        if self.lower:
            plain = (piece if piece.isascii() else unicodedata.normalize("NFC", piece)).lower().lstrip(" ")
        if (plain[1:] if plain[:1] == " " else plain).isalpha():
            return self._add(piece, self._unit(plain))
        mark, stem = plain[-1:], plain[:-1]
        if mark in self.marks and (stem[1:] if stem[:1] == " " else stem).isalpha():
            k = self.known.get(stem)
            own = self._unit(stem) if k is None else list(self.ids[self.ends[k] : self.ends[k + 1]])
            return self._add(piece, own + self.marks[mark])
        ids: list[int] = []
        for unit in self.split(plain):
            k = self.known.get(unit)
            if k is None:
                own = self._unit(unit)
                if unit != piece:
                    self._add(unit, own)
                ids += own
            else:
                ids += self.ids[self.ends[k] : self.ends[k + 1]]
        return self._add(piece, ids)

    def _learn_all(self, keys: list[str], slots: list[int | None]) -> None:
        """Fills the empty slots; pieces of letters, and those with a full stop or comma, without a call for each step."""
        known, ends, ids = self.known, self.ends, self.ids
        tokenize, extend, closed = self.model.tokenize, ids.extend, ends.append
        lower, marks, letters, letters_only, normal = self.lower, self.marks, self.letters, self.letters_only, unicodedata.normalize
        n = len(ends) - 1
        for k, found in enumerate(slots):
            if found is not None:
                continue
            piece = keys[k]
            if letters_only:
                body = piece[1:] if piece[:1] == " " else piece
                mark = marks.get(body[-1:])
                word = body if mark is None else body[:-1]
                if word.isascii():
                    if lower:
                        word = word.lower()
                elif max(word) < _LATIN_END:
                    if lower:
                        word = normal("NFC", word).lower()
                else:
                    word = ""
                if word.isalpha():
                    if not word.isascii():
                        word = word.encode().decode("latin-1").translate(letters)
                    extend([t.id for t in tokenize(word if lower or body is piece else "\u0120" + word)])
                    if mark is not None:
                        extend(mark)
                    slots[k] = known[piece] = n
                    n += 1
                    closed(len(ids))
                    continue
            slots[k] = self._learn(piece)
            n = len(ends) - 1

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts, null as empty, each text's ids ended by ``end_id``."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self.whole:
            each = [[*self.tokenizer.encode(t, add_special_tokens=False).ids, self.end_id] for t in texts.to_pylist()]
            return np.array([i for ids in each for i in ids], np.uint32), np.cumsum([0, *map(len, each)])
        split = pc.split_pattern(texts, " ")
        sizes = np.diff(split.offsets.to_numpy()).astype(np.int64)
        flat = split.flatten()
        odd = pc.match_substring_regex(texts, _TWO_SPACES).to_numpy(zero_copy_only=False)
        if odd.any():
            flat, sizes, lead = self._apart(texts, flat, sizes, odd)
        else:
            lead = np.ones(len(flat), bool)
            lead[np.cumsum(sizes)[:-1][sizes[:-1] > 0] if len(sizes) > 1 else []] = False
            if len(lead):
                lead[0] = False
        coded = flat.dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        names = coded.dictionary.to_pylist()
        if len(self.known) > self.cache:
            self._forget()
        # each distinct piece with and without its leading space, as it occurs
        pair = index * 2 + lead
        seen = np.flatnonzero(np.bincount(pair, minlength=2 * len(names)))
        keys = [" " + names[k >> 1] if k & 1 else names[k >> 1] for k in seen.tolist()]
        slots = list(map(self.known.get, keys))
        self._learn_all(keys, slots)
        slot = np.zeros(2 * len(names), np.int64)
        slot[seen] = slots
        at = slot[pair]
        ends = np.frombuffer(self.ends, np.int64)
        starts, counts = ends[at], np.diff(ends)[at]
        del ends
        return self._gather(starts, counts, sizes)

    def _apart(self, texts, flat, sizes, odd):
        """Texts with runs of white space are cut by a pattern; their pieces hold their own spaces."""
        ends = np.cumsum(sizes)
        parts, new_sizes, lead, last = [], sizes.copy(), [], 0
        for k in np.flatnonzero(odd).tolist():
            s, e = int(ends[k] - sizes[k]), int(ends[k])
            if s > last:
                parts.append(flat.slice(last, s - last))
            own = _PIECES.findall(texts[k].as_py())
            parts.append(pa.array(own, pa.large_string()))
            new_sizes[k], last = len(own), e
        parts.append(flat.slice(last))
        flat = pa.concat_arrays([p.cast(pa.large_string()) for p in parts])
        lead = np.repeat(~odd, new_sizes)
        firsts = np.cumsum(new_sizes) - new_sizes
        lead[firsts[new_sizes > 0]] = False
        return flat, new_sizes, lead

    def _gather(self, starts: np.ndarray, counts: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        piece_end = np.concatenate(([0], np.cumsum(counts)))
        text_end = piece_end[np.cumsum(per_text)] if len(per_text) else np.zeros(0, np.int64)
        total = int(piece_end[-1])
        shift = np.repeat(starts - piece_end[:-1], counts)
        ids = np.frombuffer(self.ids, np.uint32)[np.arange(total) + shift] if total else np.zeros(0, np.uint32)
        out = np.full(total + len(per_text), self.end_id, np.uint32)
        offsets = np.concatenate(([0], text_end + np.arange(1, len(per_text) + 1))).astype(np.int64)
        place = np.ones(len(out), bool)
        place[offsets[1:] - 1] = False
        out[place] = ids
        return out, offsets


_encoders: dict[tuple, PieceEncoder] = {}


def encoder(path: str, end_id: int, cache: int = CACHE_PIECES, special_as_text: bool = False) -> PieceEncoder:
    """One encoder for each vocabulary and worker process."""
    key = (path, end_id, cache, special_as_text)
    if key not in _encoders:
        _encoders[key] = PieceEncoder(*key)
    return _encoders[key]


def vocabulary(name: str) -> str:
    """The installed public vocabulary file of this name."""
    import public_tokenizers

    return public_tokenizers.path(name)
