"""Token-id files coded by an adaptive context-mixing range coder.

Ids are cut into blocks of at most ``LANES * STEPS`` ids.  Every block starts from an empty model and
carries its own CRC-32, so it can be decoded, checked or lost alone.  Within a block the ids stand
in up to ``LANES`` runs that share one model and are coded in step, one id of each run at a time, so
numpy does the work and the model learns from all runs at once:

* order 2 and order 1 name the id that last followed the last two ids, and the last one, with the
  length of their run of successes; order 0 is the adaptive frequency of every id;
* the id that order 2 (else order 1) names is the guess.  Each order has odds that the guess is right
  (by its run of successes; order 0 by the guess's frequency), and these are mixed in the logistic
  domain with weights that are learned for each pair of runs;
* a 64-bit carry-free range coder codes "the guess is right" with the mixed probability, else the
  id by its order-0 frequency among all ids but the guess.

All arithmetic is in whole numbers, so any machine decodes what another wrote.

File: ``GLIDS2\\0\\0``, counts (documents, ids, blocks) as u64, doc_id and id count of each document
as i64; for each block its ids, bytes and CRC as u32; then the blocks' bytes: for each run its number
of 16-bit units as u32, then the units of all runs.  Files hold ids below 65536.  Documents stand in
ascending doc_id order within and across files.

Defined cases: a null or empty text has the end id alone; a null doc_id sorts first; repeated rows
are coded each by itself; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm import common as C
from graphloom.llm import tokens

#: Runs of a block that are coded in step, and the ids of a run.
LANES, STEPS = 8192, 512
#: Text bytes a file holds at most (one document at least).
FILE_TEXT = 96 << 20
MAGIC = b"GLIDS2\0\0"

_ALPHABET, _SLOTS, _RUNS = 1 << 16, 1 << 18, 16
#: What an id adds to its frequency, the total at which frequencies are halved, and the steps between updates.
_GAIN, _FULL, _EVERY = 32, 1 << 22, 8
#: Steps at the start after each of which all is learned; later, odds and weights learn from every such step.
_EARLY, _LEARN = 16, 8
_TOP, _BOT = np.uint64(1 << 48), np.uint64(1 << 40)
_ONE, _TWELVE, _SIXTEEN, _TAIL = np.uint64(1), np.uint64(12), np.uint64(16), np.uint64(32)

_X = np.arange(-2047, 2048)
_LOGISTIC = np.round(4096 / (1 + np.exp(-_X / 256.0))).clip(1, 4095).astype(np.int64)
_FAR = 1 << 15
_SQUASH = np.pad(_LOGISTIC, (_FAR - 2047, _FAR - 2047), mode="edge")  # from a logit in 256ths, from -_FAR on, to 4096ths
_STRETCH = np.searchsorted(_LOGISTIC, np.arange(4097)).clip(0, 4094) - 2047
#: The next run of successes of a prediction, by (run * 2 + right).
_NEXT = np.array([x for r in range(_RUNS) for x in ((r >> 1) if r > 4 else 1, min(r + 1, _RUNS - 1))])


class _Model:
    """The three orders and their mixer.  A table entry is id * 16 + run of successes."""

    def __init__(self, lanes: int):
        self.two_table, self.one_table = np.zeros(_SLOTS, np.int64), np.zeros(_ALPHABET, np.int64)
        # By order: how often a guess with each run was right, and was made.
        self.right, self.seen = np.full((2, _RUNS), 1 << 6), np.full((2, _RUNS), 1 << 8)
        self.weight = np.empty((3, 2 * _RUNS * _RUNS), np.int64)
        self.weight[:] = np.array([24000, 24000, 4000])[:, None]
        self.freq, self.waiting, self.step = np.ones(_ALPHABET, np.int64), [], 0
        self.one, self.two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self._settle()
        self._mix()

    def _settle(self) -> None:
        """Frequencies take in the ids of the last steps."""
        if self.waiting:
            self.freq += np.bincount(np.concatenate(self.waiting), minlength=_ALPHABET) * _GAIN
            self.waiting = []
        self.end = np.cumsum(self.freq)
        if self.end[-1] > _FULL:
            self.freq = (self.freq + 1) >> 1
            self.end = np.cumsum(self.freq)
        self.total = int(self.end[-1])
        self.scale = max(0, self.total.bit_length() - 12)

    def _mix(self) -> None:
        """What orders 2 and 1 say together, for each (run of 2, run of 1, whether they name the same id)."""
        two, one = _STRETCH.take((self.right << 12) // self.seen)
        self.said = np.stack([np.repeat(two, 2 * _RUNS), np.tile(np.stack([0 * one, one], axis=1).ravel(), _RUNS)])
        self.known = self.weight[0] * self.said[0] + self.weight[1] * self.said[1] + (_FAR << 16)

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """(guess, chance in 4096ths that it is right)."""
        self.slot = ((self.two * 40503 + self.one * 20507) >> 5) & (_SLOTS - 1)
        by_two, by_one = self.two_table.take(self.slot), self.one_table.take(self.one)
        self.run_two, self.run_one = by_two & 15, by_one & 15
        self.said_two, self.said_one = by_two >> 4, by_one >> 4
        self.guess = guess = np.where(self.run_two, self.said_two, self.said_one)
        self.kind = (self.run_two << 5) + (self.run_one << 1) + (self.said_one == guess)
        self.often = _STRETCH.take(self.freq.take(guess) >> self.scale)
        mixed = self.weight[2].take(self.kind)
        mixed *= self.often
        mixed += self.known.take(self.kind)
        mixed >>= 16
        self.chance = _SQUASH.take(mixed)
        return guess, self.chance

    def update(self, ids: np.ndarray) -> None:
        hit_two, hit_one = self.said_two == ids, self.said_one == ids
        if self.step < _EARLY or self.step % _LEARN == 0:
            self._learn(ids, hit_two, hit_one)
        entry = ids << 4
        self.two_table[self.slot] = entry | _NEXT.take((self.run_two << 1) + hit_two)
        self.one_table[self.one] = entry | _NEXT.take((self.run_one << 1) + hit_one)
        self.two, self.one = self.one, ids
        self.waiting.append(ids)
        self.step += 1
        if self.step < _EARLY or len(self.waiting) >= _EVERY:
            self._settle()

    def _learn(self, ids: np.ndarray, hit_two: np.ndarray, hit_one: np.ndarray) -> None:
        """Odds and weights follow this step's errors; all sums are of whole numbers far below 2**53, so exact."""
        error = ((self.guess == ids) << 12) - self.chance
        kinds = len(self.known)
        total = np.bincount(self.kind, error, kinds).astype(np.int64)
        self.weight[:2] += (self.said * total) >> 14
        self.weight[2] += np.bincount(self.kind, error * self.often, kinds).astype(np.int64) >> 14
        np.minimum(np.maximum(self.weight, 0, out=self.weight), 200_000, out=self.weight)
        for k, (run, hit) in enumerate(((self.run_two, hit_two), (self.run_one, hit_one))):
            both = np.bincount((run << 1) + hit, minlength=2 * _RUNS).reshape(_RUNS, 2)
            self.right[k] += both[:, 1]
            self.seen[k] += both.sum(axis=1)
        if self.seen.max() > 1 << 20:
            self.seen, self.right = (self.seen + 1) >> 1, self.right >> 1
        self._mix()


def _shift(low: np.ndarray, width: np.ndarray, emit) -> None:
    """Moves settled 16-bit units out of every run; where the width is short, it is cut at the next boundary."""
    go = np.flatnonzero(width < _TOP)  # a wider one has nothing settled
    x, w = low.take(go), width.take(go)
    go = go[(((x + w) ^ x) < _TOP) | (w < _BOT)]
    while len(go):
        x, w = low.take(go), width.take(go)
        cut = np.flatnonzero(((x + w) ^ x) >= _TOP)
        if len(cut):
            w[cut] = (~x[cut] + _ONE) & (_BOT - _ONE)
        emit(go, x)
        x <<= _SIXTEEN
        w <<= _SIXTEEN
        low[go] = x
        width[go] = w
        go = go[(((x + w) ^ x) < _TOP) | (w < _BOT)]


def encode_block(rows: np.ndarray) -> bytes:
    """The coded bytes of a block: rows (int64) has the first ids of all runs, then the second, and so on."""
    steps, lanes = rows.shape
    model = _Model(lanes)
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    units = steps * 3 + 16
    out, pos = np.zeros(lanes * units, np.uint16), np.arange(lanes) * units
    first = pos.copy()

    def emit(go: np.ndarray, x: np.ndarray) -> None:
        at = pos.take(go)
        out[at] = x >> np.uint64(48)
        at += 1
        pos[go] = at

    for ids in rows:
        guess, chance = model.predict()
        edge = width >> _TWELVE
        edge *= chance.view(np.uint64)
        miss = np.flatnonzero(guess != ids)
        own, other = ids.take(miss), guess.take(miss)
        skipped, mine = model.freq.take(other), model.freq.take(own)
        below = model.end.take(own) - mine
        below -= skipped * (own > other)
        begin = edge.take(miss)
        part = width.take(miss)
        part -= begin
        part //= (model.total - skipped).view(np.uint64)
        begin += part * below.view(np.uint64)
        low[miss] += begin
        part *= mine.view(np.uint64)
        edge[miss] = part
        width = edge
        _shift(low, width, emit)
        model.update(ids)
    every = np.arange(lanes)
    low = ((low + (np.uint64(2**32) - _ONE)) >> _TAIL) << _TAIL  # stays below low + width
    for _ in range(2):
        emit(every, low)
        low <<= _SIXTEEN
    sizes = pos - first
    used = np.arange(units)[None] < sizes[:, None]
    return sizes.astype("<u4").tobytes() + out.reshape(lanes, units)[used].astype("<u2").tobytes()


def decode_block(blob: bytes, lanes: int, steps: int) -> np.ndarray:
    """rows of encode_block."""
    sizes = np.frombuffer(blob, "<u4", lanes).astype(np.int64)
    data = np.append(np.frombuffer(blob, "<u2", -1, 4 * lanes), np.zeros(8, np.uint16)).astype(np.uint64)
    if sizes.sum() + 8 != len(data):
        raise ValueError("a block is cut short")
    model, rows = _Model(lanes), np.zeros((steps, lanes), np.int64)
    width = np.full(lanes, 2**64 - 1, np.uint64)
    low, code = np.zeros(lanes, np.uint64), np.zeros(lanes, np.uint64)
    pos = np.cumsum(sizes) - sizes

    def emit(go: np.ndarray, _: np.ndarray) -> None:
        at = pos.take(go)
        x = code.take(go)
        x <<= _SIXTEEN
        x |= data.take(at, mode="clip")  # beyond a run's end any units will do: its last value leaves room for them
        code[go] = x
        at += 1
        pos[go] = at

    every = np.arange(lanes)
    for _ in range(4):
        emit(every, low)
    for t in range(steps):
        guess, chance = model.predict()
        edge = width >> _TWELVE
        edge *= chance.view(np.uint64)
        over = code - low
        miss = np.flatnonzero(over >= edge)
        ids, other = guess.copy(), guess.take(miss)
        skipped = model.freq.take(other)
        total = (model.total - skipped).view(np.uint64)
        begin = edge.take(miss)
        part = width.take(miss)
        part -= begin
        part //= total
        value = over.take(miss)
        value -= begin
        value = np.minimum(value // np.maximum(part, _ONE), total - _ONE).view(np.int64)
        value += skipped * (value >= model.end.take(other) - skipped)
        own = np.searchsorted(model.end, value, side="right")
        mine = model.freq.take(own)
        below = model.end.take(own) - mine
        below -= skipped * (own > other)
        begin += part * below.view(np.uint64)
        low[miss] += begin
        part *= mine.view(np.uint64)
        edge[miss] = part
        width = edge
        ids[miss] = own
        _shift(low, width, emit)
        rows[t] = ids
        model.update(ids)
    return rows


def _shape(n: int) -> tuple[int, int]:
    """(steps, runs) of a block of n ids; steps * runs may be a few more than n."""
    steps = min(STEPS, n)
    return steps, -(-n // steps)


def dumps(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, block: int = LANES * STEPS) -> bytes:
    """A file of these documents; ids are all their ids in order."""
    if len(ids) and int(ids.max()) >= _ALPHABET:
        raise ValueError("ids above 65535 do not fit this format")
    index, blobs = [], []
    for part in np.array_split(ids, -(-len(ids) // block)) if len(ids) else ():
        steps, lanes = _shape(len(part))
        full = np.zeros(steps * lanes, np.int64)  # the last run is filled up with id 0
        full[: len(part)] = part
        blobs.append(encode_block(np.ascontiguousarray(full.reshape(lanes, steps).T)))
        index.append((len(part), len(blobs[-1]), zlib.crc32(part.astype("<u4").tobytes())))
    head = np.array([len(doc_ids), len(ids), len(index)], "<u8").tobytes()
    return b"".join([MAGIC, head, doc_ids.astype("<i8").tobytes(), counts.astype("<i8").tobytes(), np.array(index, "<u4").tobytes(), *blobs])


def loads(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc_ids, counts, ids) of a file; raises ValueError where a block's bytes are not those written."""
    if data[:8] != MAGIC:
        raise ValueError("not a file of ids")
    n_docs, n_ids, n_blocks = (int(x) for x in np.frombuffer(data, "<u8", 3, 8))
    at = 32
    docs, counts = np.frombuffer(data, "<i8", n_docs, at), np.frombuffer(data, "<i8", n_docs, at + 8 * n_docs)
    at += 16 * n_docs
    index = np.frombuffer(data, "<u4", 3 * n_blocks, at).reshape(-1, 3).astype(np.int64)
    at += 12 * n_blocks
    out, done = np.zeros(n_ids, np.uint16), 0
    for j, (n, size, check) in enumerate(index.tolist()):
        steps, lanes = _shape(n)
        ids = decode_block(data[at : at + size], lanes, steps).T.reshape(-1)[:n].astype(np.uint16)
        if zlib.crc32(ids.astype("<u4").tobytes()) != check:
            raise ValueError(f"block {j} fails its check")
        out[done : done + n] = ids
        at, done = at + size, done + n
    return docs, counts, out


def _write(folder: str, path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        enc, (store, root) = tokens.encoder(path), fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        held: list[tuple] = []
        size = part = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, part
            docs, counts, ids = (np.concatenate(x) for x in zip(*held, strict=True))
            name = f"{root}/{task.partitionId():06d}-{part:04d}-{task.taskAttemptId()}.glids"
            with store.open_output_stream(f"{name}.part") as f:
                f.write(dumps(docs, counts, ids))
            store.move(f"{name}.part", name)
            out = pa.record_batch({"part": [task.partitionId()], "seq": [part], "name": [name.rsplit("/", 1)[1]], "ids": [len(ids)]}, schema=_FILES)
            held, size, part = [], 0, part + 1
            return out

        for b in C.slices(batches, most=tokens.SLICE_BYTES):
            raw, offsets = C.utf8(b.column("text"))
            ids, first = tokens.with_end(*enc.encode(raw, offsets), end)
            docs = b.column("doc_id").fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            held.append((docs, np.diff(first), ids.astype(np.uint16) if not len(ids) or ids.max() < 65536 else ids))
            size += len(raw)
            if size >= FILE_TEXT:
                yield flush()
        if held:
            yield flush()

    return run


_FILES = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("name", pa.string()), ("ids", pa.int64())])
_DOCS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, base in zip(b.column("name").to_pylist(), b.column("base").to_pylist(), strict=True):
                with store.open_input_stream(f"{root}/{name}") as f:
                    docs, counts, ids = loads(f.read())
                ends = np.append(0, np.cumsum(counts))
                crcs = np.array([zlib.crc32(ids[x:y].astype("<u4").tobytes()) for x, y in zip(ends[:-1], ends[1:], strict=True)], np.int64)
                yield pa.record_batch([pa.array(docs, mask=docs == -(2**63)), pa.array(base + ends[:-1]), pa.array(counts), pa.array(crcs)], schema=_DOCS)

    return run


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end: int) -> DataFrame:
    """Codes all documents into files below folder, in doc_id order; one row per file, with the ids before it.

    The files' rows are few (one per task and FILE_TEXT of its text).
    """
    keyed = C.keyed_documents(docs).repartitionByRange(F.col("doc_id").asc()).sortWithinPartitions("doc_id")
    files = C.materialize(keyed.mapInArrow(_write(folder, tokenizer, end), "part int, seq int, name string, ids long"), "id-files")
    parts = files.groupBy("part").agg(F.sum("ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inner = F.sum("ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("ids")
    return files.withColumn("inner", inner).join(before, "part").select("name", (F.col("before") + F.col("inner")).alias("base"))


def read_ids(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""
    # A task for each file: repartition by number is not put together again at run time.
    return files.repartition(max(1, files.count())).mapInArrow(_read(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """write_ids to the shared folder, then read_ids."""
    folder = C.scratch(docs.sparkSession, "ids")
    return read_ids(write_ids(docs, folder, tokenizer, end), folder)
