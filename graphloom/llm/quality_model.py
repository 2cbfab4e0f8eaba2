"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word has a fixed sparse random index vector; its context vector is the sum of the index
vectors of its neighbours in the sample.  Words are hashed to a fixed number of rows, and beside
them stands a row for the word's shape (symbols, capitals, digits, length), learned the same way, so
unseen words have a vector too.  A document is the mean and spread of its words' vectors and the
mean change from word to word, with its length.  A network with one hidden layer, trained by Adam
on the bounded sample, gives a logit; a temperature fitted on rows kept aside calibrates it.

Fitting uses the bounded sample of ``labelled`` and runs in one task of an executor; the model has a
fixed size.  Scoring is one pass without a shuffle.

Defined cases: a null or empty text pools to zeros and gets the score of that vector; without both
labels in the sample every score is the share of label 1 (0.5 without labels); repeated rows get
equal scores; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import common as C
from graphloom.llm import labelled

#: Rows for hashed words, rows for shapes, and the length of a vector.
WORDS, SHAPES, SIZE = 1 << 15, 1 << 8, 32
#: Neighbours on each side that make a context.
REACH = 2
HIDDEN, EPOCHS, RATE, DECAY = 32, 60, 3e-3, 1e-4
#: Share of the sample that is kept aside for the temperature.
ASIDE = 0.2

_KIND = np.zeros(256, np.uint8)  # 1 capital, 2 digit, 4 symbol
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[*b"#*$%&|<>!@^_=~+{}[]\\/"]] = 4


def words_and_shapes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word row, shape row, first): rows of the table for every word."""
    starts, ends, first = C.word_spans(raw, offsets)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), first
    h = C.word_hashes(raw, starts, ends)
    kind = _KIND[raw]
    total = [np.append(0, np.cumsum((kind & bit) > 0)) for bit in (1, 2, 4)]
    capitals, digits, symbols = (t[ends] - t[starts] for t in total)
    size = np.minimum(np.ceil(np.log2(ends - starts + 1)).astype(np.int64), 7)
    shape = size + 8 * np.minimum(capitals, 2) + 24 * np.minimum(symbols, 3) + 96 * (digits > 0)
    return (h & np.uint64(WORDS - 1)).astype(np.int64), WORDS + shape, first


class QualityModel:
    def __init__(self, table: np.ndarray | None, layers: tuple[np.ndarray, ...], scale: tuple[np.ndarray, np.ndarray] | None, temperature: float, share: float):
        self.table, self.layers, self.scale, self.temperature, self.share = table, layers, scale, temperature, share

    def pooled(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        words, shapes, first = words_and_shapes(raw, offsets)
        n_rows, n = len(offsets) - 1, np.diff(first)
        out = np.zeros((n_rows, 3 * SIZE + 1), np.float32)
        full = np.flatnonzero(n)
        if len(full):
            v = self.table[words] + self.table[shapes]
            step = np.abs(np.diff(v, axis=0, append=v[-1:]))
            step[first[full + 1] - 1] = 0
            start, count = first[full], n[full, None].astype(np.float32)
            mean = np.add.reduceat(v, start) / count
            out[full, :SIZE] = mean
            out[full, SIZE : 2 * SIZE] = np.sqrt(np.maximum(np.add.reduceat(v * v, start) / count - mean * mean, 0))
            out[full, 2 * SIZE : -1] = np.add.reduceat(step, start) / np.maximum(count - 1, 1)
            out[full, -1] = np.log1p(n[full])
        return out

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, d = self.layers
        return np.tanh(((x - self.scale[0]) / self.scale[1]) @ a + b) @ c + d

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Chance of label 1 of each row."""
        if self.table is None:
            return np.full(len(offsets) - 1, self.share)
        z = self.logits(self.pooled(raw, offsets)).astype(np.float64)[:, 0] / self.temperature
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _context_vectors(words: np.ndarray, shapes: np.ndarray, first: np.ndarray) -> np.ndarray:
    rng = np.random.RandomState(11)
    index = rng.choice(np.array([-1, 0, 0, 0, 1], np.float32), size=(WORDS + SHAPES, SIZE))
    table = np.zeros_like(index)
    row = C.row_of(first, len(words))
    for at in (words, shapes):
        order = np.argsort(at, kind="stable")
        for step in [s for s in range(-REACH, REACH + 1) if s]:
            near = np.clip(np.arange(len(at)) + step, 0, max(len(at) - 1, 0))
            inside = (row[near] == row) & (near == np.arange(len(at)) + step)
            for lo in range(0, len(order), 1 << 16):  # bounded slices of the sorted tokens
                part = order[lo : lo + (1 << 16)]
                around = (index[words[near[part]]] + index[shapes[near[part]]]) * inside[part, None]
                own = at[part]
                starts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                table[own[starts]] += np.add.reduceat(around, starts)
    unseen = ~table.any(axis=1)
    table[unseen] = index[unseen]
    return table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-6)


def fit(texts: list[str], labels: list[int]) -> QualityModel:
    y = np.array(labels, np.float32)
    share = float(y.mean()) if len(y) else 0.5
    if share in (0.0, 1.0) or len(y) < 10:
        return QualityModel(None, (), None, 1.0, share)
    raw, offsets = C.utf8(pa.array(texts, pa.large_string()))
    model = QualityModel(_context_vectors(*words_and_shapes(raw, offsets)), (), None, 1.0, share)
    x = np.concatenate([model.pooled(raw[offsets[a] : offsets[min(a + 256, len(y))]], offsets[a : min(a + 256, len(y)) + 1] - offsets[a]) for a in range(0, len(y), 256)])
    rng = np.random.RandomState(5)
    aside = rng.rand(len(y)) < ASIDE
    if not 0 < y[aside].mean() < 1 or not 0 < y[~aside].mean() < 1:
        aside = np.zeros(len(y), bool)
    train = ~aside
    model.scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-3
    inputs, target = (x[train] - model.scale[0]) / model.scale[1], y[train, None]
    layers = [rng.randn(x.shape[1], HIDDEN).astype(np.float32) / np.sqrt(x.shape[1]), np.zeros(HIDDEN, np.float32), rng.randn(HIDDEN, 1).astype(np.float32) / np.sqrt(HIDDEN), np.zeros(1, np.float32)]
    first, second, t = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(len(inputs)), max(1, len(inputs) // 64)):
            t += 1
            hidden = np.tanh(inputs[at] @ layers[0] + layers[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ layers[2] + layers[3], -40, 40))) - target[at]) / len(at)
            back = (error @ layers[2].T) * (1 - hidden * hidden)
            for k, g in enumerate((inputs[at].T @ back, back.sum(axis=0), hidden.T @ error, error.sum(axis=0))):
                g = g + DECAY * layers[k]
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                layers[k] -= RATE * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)
    model.layers = tuple(layers)
    if aside.any():
        z, yy = model.logits(x[aside])[:, 0].astype(np.float64), y[aside]
        loss = lambda s: np.logaddexp(0, -np.where(yy > 0, z, -z) / s).mean()
        model.temperature = float(min(np.geomspace(0.5, 20, 60), key=loss))
    # The sample has other shares of the labels than the corpus may have; no prior is applied.
    return model


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def _scored(packed: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(packed)
        for b in C.slices(batches, most=C.SLICE_BYTES // 2):
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(model.scores(*C.utf8(b.column("text"))))], schema=_OUT)

    return run


def score_quality(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; predicted is 1 from ``least`` on."""
    model = labelled.fitted(docs, labels, "quality", fit)
    rows = C.keyed_documents(docs).withColumn("held_out", labelled.held_out())
    return rows.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= least).cast("int"))


def _kept(packed: bytes, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(packed)
        for b in C.slices(batches, most=C.SLICE_BYTES // 2):
            yield b.filter(pa.array(model.scores(*C.utf8(b.column("text"))) >= least))

    return run


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows, with all their columns, that score ``least`` or more."""
    return docs.mapInArrow(_kept(labelled.fitted(docs, labels, "quality", fit), least), docs.schema)
