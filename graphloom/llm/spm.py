"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes code points with a leading space, spaces becoming the model's word mark.  No piece
joins a word mark to a character before it, so texts are cut there and every distinct word is
merged once, all words of a slice together: symbols stand in one flat numpy array, each round finds
every word's best pair (segmented minimum over pair ranks), merges it, compacts the array, and
takes out words that have no pair left.  A round merges the leftmost best pair, and all its further
copies in the word where no better piece can begin or end with it; that is the order in which the
library merges.  Characters without a piece become byte pieces.

Defined cases: a null or empty text has begin and end ids alone and decodes to the empty string;
repeated rows are encoded each by itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm import common as C
from graphloom.llm import tokens

MARK = "▁"
_NONE = np.int32(2**31 - 1)
_CHAR = 1 << 20  # a character without a symbol is _CHAR + its code point
_WIDE = 1 << 22


class SentencePieceModel(tokens.Remembering):
    """The pieces of a BPE model file as numpy tables."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.begin, self.end, unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.byte = np.full(256, unknown, np.uint32)
        normal: dict[str, int] = {}
        text = [b""] * n
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                text[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                normal[piece] = i
                text[i] = piece.replace(MARK, " ").encode()
        if any(MARK in p.lstrip(MARK) for p in normal):
            raise ValueError("a piece has a word mark after other characters; words can't be merged apart")
        # Symbols: pieces, and single characters of pieces that are no piece themselves.
        symbol = dict(normal)
        for c in sorted({c for p in normal for c in p} - set(normal)):
            symbol[c] = n + len(symbol) - len(normal)
        self.of_char = np.full(0x110000, -1, np.int64)
        for s, i in symbol.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.char_of = {i: s for s, i in symbol.items() if i >= n}
        self.n = n
        self.n_pieces = n
        score = {p: sp.get_score(i) for p, i in normal.items()}
        rank = {x: k for k, x in enumerate(sorted(set(score.values()), reverse=True))}
        keys, ranks, ids = [], [], []
        # A rank is safe if no piece of its rank or better has one of its pieces as a proper beginning or end.
        safe = np.ones(len(rank), bool)
        for p, i in normal.items():
            r = rank[score[p]]
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                if a in symbol and b in symbol:
                    keys.append(symbol[a] * _WIDE + symbol[b])
                    ranks.append(r)
                    ids.append(i)
                for part in (a, b):
                    if part in score and rank[score[part]] >= r:
                        safe[rank[score[part]]] = False
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.ids = np.array(keys, np.int64)[order], np.array(ranks, np.int32)[order], np.array(ids, np.int64)[order]
        self.safe = np.append(safe, False)
        # "\n" joins nothing in most models, so lines are cut apart too.
        self.line_cut = "\n" not in symbol
        sizes = np.fromiter(map(len, text), np.int64, n)
        self.text, self.text_size = np.frombuffer(b"".join(text) or b"\0", np.uint8), sizes
        self.text_start = np.cumsum(sizes) - sizes
        self._forget()

    # Where texts are cut: at their start, at a space after another character, around line ends.
    def cuts(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(raw)
        if not n:
            return np.zeros(0, np.int64)
        space = raw == 32
        at = space.copy()
        at[1:] &= ~space[:-1]
        # A mark that stands in the text itself is like a space.
        at[3:] &= ~((raw[:-3] == 0xE2) & (raw[1:-2] == 0x96) & (raw[2:-1] == 0x81))
        if self.line_cut:
            line = raw == 10
            at |= line
            at[1:] |= line[:-1]
        row = np.zeros(n + 1, bool)
        row[offsets] = True
        return np.flatnonzero(at | row[:n])

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of each pair; rank _NONE where there is none."""
        key = left * _WIDE + right
        k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        there = self.keys[k] == key
        return np.where(there, self.ranks[k], _NONE), self.ids[k]

    def pieces_ids(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        joined = b"".join(pieces)
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        head = (np.frombuffer(joined, np.uint8) & 0xC0) != 0x80
        total = np.append(0, np.cumsum(head))
        ends = np.cumsum(lengths)
        sizes = total[ends] - total[ends - lengths]
        points = np.frombuffer(joined.decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        points[points == 32] = ord(MARK)
        sym = self.of_char[points]
        sym = np.where(sym < 0, _CHAR + points, sym)
        word = np.repeat(np.arange(len(pieces)), sizes)
        out_sym, out_word = self._merged(sym, word)
        order = np.argsort(out_word, kind="stable")
        sym, word = out_sym[order], out_word[order]
        return self._with_bytes(sym, word, len(pieces))

    def _merged(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, to = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            rank[:-1], to[:-1] = self._pairs(sym[:-1], sym[1:])
            rank[:-1][word[1:] != word[:-1]] = _NONE
        while len(sym):
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(np.append(first, len(sym)))
            best = np.minimum.reduceat(rank, first)
            open_ = best < _NONE
            if not open_.all():
                keep = np.repeat(open_, size)
                done.append((sym[~keep], word[~keep]))
                sym, word, rank, to = sym[keep], word[keep], rank[keep], to[keep]
                size, best = size[open_], best[open_]
                if not len(sym):
                    break
            # Positions of the best pair; of a run of overlapping ones every other; of an unsafe rank the leftmost.
            at = np.flatnonzero(rank == np.repeat(best, size))
            run = np.append(True, at[1:] != at[:-1] + 1)
            nth = np.arange(len(at)) - np.flatnonzero(run)[np.cumsum(run) - 1]
            lead = np.append(True, word[at[1:]] != word[at[:-1]])
            at = at[(nth % 2 == 0) & (lead | self.safe[rank[at]])]
            sym[at] = to[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))  # each merge before took one symbol out
            sym, word, rank, to = sym[keep], word[keep], rank[keep], to[keep]
            for p in (at, at[at > 0] - 1):
                end = p + 1 >= len(sym)
                nxt = np.minimum(p + 1, len(sym) - 1)
                r, t = self._pairs(sym[p], sym[nxt])
                rank[p] = np.where(end | (word[p] != word[nxt]), _NONE, r)
                to[p] = t
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])

    def _with_bytes(self, sym: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """Characters that are no piece become the pieces of their bytes."""
        lost = np.flatnonzero(sym >= self.n_pieces)
        if len(lost):
            kinds, which = np.unique(sym[lost], return_inverse=True)
            data = [(chr(int(k) - _CHAR) if k >= _CHAR else self.char_of[int(k)]).encode() for k in kinds]
            width = np.ones(len(sym), np.int64)
            width[lost] = np.fromiter(map(len, data), np.int64, len(data))[which]
            sym, word = np.repeat(sym, width), np.repeat(word, width)
            at = np.repeat((np.cumsum(width) - width)[lost], width[lost])
            nth = np.arange(len(at)) - np.repeat(np.cumsum(width[lost]) - width[lost], width[lost])
            sym[at + nth] = self.byte[np.frombuffer(b"".join(data[k] for k in which), np.uint8)]
        return sym.astype(np.uint32), np.bincount(word, minlength=n_words)

    def encode_rows(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of each row with begin and end."""
        full = np.flatnonzero(np.diff(offsets))
        marked = np.insert(raw, offsets[full], np.uint8(32))
        grown = np.zeros(len(offsets), np.int64)
        grown[full + 1] = 1
        ids, first = self.encode(marked, offsets + np.cumsum(grown))
        n = len(first) - 1
        out = np.insert(ids, np.stack([first[:-1], first[1:]], 1).ravel(), np.tile(np.array([self.begin, self.end], np.uint32), n))
        return out, first + 2 * np.arange(n + 1)

    def decode_rows(self, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the texts: pieces joined, the mark's space at a text's start left out."""
        size = self.text_size[ids]
        to = np.append(0, np.cumsum(size))
        raw = self.text[np.repeat(self.text_start[ids] - to[:-1], size) + np.arange(to[-1])]
        offsets = to[first]
        lead = offsets[:-1][np.diff(offsets) > 0]
        drop = lead[raw[lead] == 32]
        cut = np.zeros(len(raw) + 1, np.int64)
        cut[drop + 1] = 1
        return np.delete(raw, drop), offsets - np.cumsum(cut)[offsets]


_MODELS: dict[str, SentencePieceModel] = {}


def model(path: str) -> SentencePieceModel:
    """This worker's model; it outlives a task."""
    if path not in _MODELS:
        _MODELS.clear()
        _MODELS[path] = SentencePieceModel(path)
    return _MODELS[path]


_OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def _digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in C.slices(batches):
            ids, first = m.encode_rows(*C.utf8(b.column("text")))
            raw, offsets = m.decode_rows(ids, first)
            data, back = ids.astype("<u4"), raw.tobytes()
            yield pa.record_batch(
                [
                    b.column("doc_id"),
                    pa.array(np.diff(first)),
                    pa.array([hashlib.sha256(data[x:y]).hexdigest() for x, y in zip(first[:-1], first[1:], strict=True)]),
                    pa.array([hashlib.sha256(back[x:y]).hexdigest() for x, y in zip(offsets[:-1], offsets[1:], strict=True)]),
                ],
                schema=_OUT,
            )

    return run


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in C.slices(batches):
            ids, first = m.encode_rows(*C.utf8(b.column("text")))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "ids": pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids.astype(np.int32)))})

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every document, with begin and end ids."""
    return C.keyed_documents(docs).mapInArrow(_encoded(path), "doc_id long, ids array<int>")


def _decoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for b in batches:
            lists = b.column("ids")
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.drop_null().flatten().to_numpy(zero_copy_only=False)
            raw, offsets = m.decode_rows(flat, np.append(0, np.cumsum(size)))
            data = raw.tobytes()
            yield pa.record_batch({"doc_id": b.column("doc_id"), "text": pa.array([data[x:y].decode(errors="replace") for x, y in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())})

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows that encode() made."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoded(path), "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the ids (little-endian u32) and of the text decoded from them."""
    return C.keyed_documents(docs).mapInArrow(_digests(path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
