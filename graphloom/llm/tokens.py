"""Token ids by the tokenizers library, one library call per distinct piece of text.

A byte-level or word-level BPE never merges across its pre-tokens, and pre-tokens never cross the
cuts made here: before white space that follows a word, before the last white-space character of a
run, and after it unless it is a space (which belongs to the next word), and between a Latin letter
and ASCII punctuation other than an apostrophe.  So a text is cut there, equal pieces are encoded
once, and ids are gathered back by numpy.  A text with white space beyond
ASCII, or with the mark of a special token, is one piece.  The strings of special tokens are
ordinary text.
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa

from graphloom.llm import common as C

#: Distinct pieces that a worker remembers, and the longest piece that it remembers.
REMEMBERED, LONGEST = 700_000, 48
#: Text bytes that are encoded at a time.
SLICE_BYTES = 8 << 20

_LETTER, _PUNCT = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_PUNCT[[*b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"]] = True

_WHOLE = re.compile(rb"<\||\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")


def cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Start of every piece, in order; empty texts have none."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64)
    white = C.WHITE[raw]
    row_start = np.zeros(n + 1, dtype=bool)
    row_start[offsets] = True
    before = np.zeros(n, dtype=bool)
    before[1:] = white[:-1]
    after = np.ones(n, dtype=bool)
    after[:-1] = white[1:] | row_start[1:n]
    plain = np.zeros(n, dtype=bool)
    plain[1:] = white[:-1] & (raw[:-1] != 32)
    at = (white & ~before) | (white & ~after) | (~white & plain) | row_start[:n]
    # Letters of two bytes from U+00C0 to U+00FF count, but for the signs of multiplication and division.
    wide = (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)
    starts, ends = _LETTER[raw], _LETTER[raw]
    starts[:-1] |= wide
    ends[1:] |= wide
    punct = _PUNCT[raw]
    at[1:] |= (ends[:-1] & punct[1:]) | (punct[:-1] & starts[1:])
    data = raw.tobytes()
    if found := [m.start() for m in _WHOLE.finditer(data)]:
        for d in np.unique(np.searchsorted(offsets, found, side="right") - 1):
            at[offsets[d] + 1 : offsets[d + 1]] = False
    return np.flatnonzero(at)


class Remembering:
    """encode(raw, offsets) -> (ids, first): ids first[d]:first[d + 1] are those of row d.

    A subclass gives the cuts of texts and the ids of distinct pieces.
    """

    def cuts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def pieces_ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each piece)"""
        raise NotImplementedError

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.start, self.size = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used, self.n = np.zeros(1 << 18, np.uint32), 0, 0

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        new, total = self.n + len(sizes), self.used + len(ids)
        while new > len(self.start):
            self.start, self.size = np.append(self.start, np.zeros_like(self.start)), np.append(self.size, np.zeros_like(self.size))
        while total > len(self.flat):
            self.flat = np.append(self.flat, np.zeros_like(self.flat))
        self.size[self.n : new] = sizes
        self.start[self.n : new] = self.used + np.cumsum(sizes) - sizes
        self.flat[self.used : total] = ids
        self.n, self.used = new, total

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = self.cuts(raw, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        if self.n > REMEMBERED:
            self._forget()
        ends = np.append(starts, len(raw)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))])
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        place = np.fromiter((self.known.get(x, -1) for x in distinct), np.int64, len(distinct))
        new = np.flatnonzero(place < 0)
        kept = 0
        if len(new):
            long = np.fromiter((len(distinct[i]) > LONGEST for i in new), bool, len(new))
            for group, remember in ((new[~long], True), (new[long], False)):
                if not len(group):
                    continue
                if remember:
                    kept = len(group)
                base = self.n
                self._add(*self.pieces_ids([distinct[i] for i in group]))
                place[group] = base + np.arange(len(group))
                if remember:
                    self.known.update(zip((distinct[i] for i in group), range(base, base + kept), strict=True))
        code = place[coded.indices.to_numpy()]
        sizes = self.size[code]
        to = np.append(0, np.cumsum(sizes))
        ids = self.flat[np.repeat(self.start[code] - to[:-1], sizes) + np.arange(to[-1])]
        first = to[np.searchsorted(starts, offsets)]
        if len(new) > kept:  # long pieces are not remembered
            self.n -= len(new) - kept
            self.used = int(self.start[self.n])
        return ids, first


class PieceEncoder(Remembering):
    """A model file of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self._probe()
        self._forget()

    cuts = staticmethod(cuts)

    def _probe(self) -> None:
        """A separator that is always one id of its own: pieces are joined by it for a single call."""
        self.separator, self.mark = b"", -1
        for text in ("\n", "0"):
            ids = self.tok.encode(text, add_special_tokens=False).ids
            if len(ids) == 1:
                self.separator, self.mark = text.encode(), ids[0]
                return

    def pieces_ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        done = []
        for a in range(0, len(pieces), 8192):
            part = pieces[a : a + 8192]
            done.append(self._joined(part) or self._one_by_one(part))
        return np.concatenate([x for x, _ in done]), np.concatenate([y for _, y in done])

    def _joined(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """All pieces in one call, if none has the separator or ends in white space."""
        text = self.separator.join(pieces)
        if len(pieces) < 16 or not self.separator or text.count(self.separator) != len(pieces) - 1 or any(p[-1] <= 32 for p in pieces):
            return None
        ids = np.array(self.tok.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(ids == self.mark)
        if len(at) != len(pieces) - 1:
            return None
        return np.delete(ids, at), np.diff(np.append(np.append(-1, at), len(ids))) - 1

    def _one_by_one(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.array([p[-1] > 32 and self.separator not in p for p in pieces]) if self.separator else np.zeros(len(pieces), bool)
        if 16 <= plain.sum() < len(pieces):  # the few others are kept apart
            parts = [None] * len(pieces)
            for group in (np.flatnonzero(plain), np.flatnonzero(~plain)):
                own = [pieces[k] for k in group]
                ids, sizes = (self._joined(own) if plain[group[0]] else None) or self._one_by_one(own)
                ends = np.cumsum(sizes)
                for k, x, y in zip(group, ends - sizes, ends, strict=True):
                    parts[k] = ids[x:y]
            return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, len(parts))
        ids = [e.ids for e in self.tok.encode_batch_fast([x.decode() for x in pieces], add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter((x for y in ids for x in y), np.uint32, int(sizes.sum())), sizes


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """This worker's encoder for the file; it outlives a task."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def with_end(ids: np.ndarray, first: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same rows with one more id at each row's end."""
    return np.insert(ids, first[1:], np.uint32(end)), first + np.arange(len(first))
