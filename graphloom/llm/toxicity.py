"""Toxicity: a subsequence string-kernel support vector machine with Nystrom landmarks.

The kernel counts common subsequences of ``ORDER`` letters of two words, each discounted by
``DECAY`` per letter that it spans in either, so inserted letters and gaps cost a little instead of
everything.  It reads whole words; a word begins with ``^``; letters alone count, so symbols between
them cost nothing, and single letters set apart are read as one word.

Landmarks are pieces of the words of labelled sentences: word beginnings (with ``^``) that best tell
toxic from other documents, chosen one after another for the documents that they add - those that
tell by standing in a document, and those, shared with ordinary words, that tell only by standing in
one sentence several times - and of these, without ``^``, those that tell at any place of a word, so
that compounds count.  A sentence is, at each landmark, the largest kernel value of its words, the same
where a near value counts as all, and the logarithm of what its other distinct words add to it, each
mapped by the inverse root of the landmarks' own kernel matrix (Nystrom).  A squared-hinge machine is trained on sentences of toxic
documents that reach a landmark as often as it tells, as they are and with letters put into, taken out
of and put before every word, against sentences of other documents.  A document scores by its
``WORST`` sentences, through a logistic curve fitted on the sample.

Fitting uses the bounded sample of ``labelled`` and runs in one task of an executor.  Scoring is one
pass without a shuffle: kernels are computed once per distinct word.  A pair of word and landmark is
left out only if its kernel is zero: if they share no common subsequence of ``ORDER`` letters.

Defined cases: a null or empty text has no sentence and gets the lowest score; without both labels
in the sample, or without a telling landmark, every score is 0; repeated rows get equal scores; an
empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import pickle
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import common as C
from graphloom.llm import labelled

ORDER, DECAY = 5, 0.8
#: Landmarks at most, letters of a word beginning, documents that one must be seen in, and its share of other documents at most.
LANDMARKS, SHORTEST, LONGEST, LEAST_DOCS, IMPURE = 64, 4, 9, 4, 0.02
#: Times in one sentence at which a beginning may tell.
TIMES = (1, 2, 3)
#: Longer words are read in windows of so many letters, half a window apart; the largest value counts.
LONG_WORD = 64
#: Kernel values (as a share of a landmark's own) below this count as 0.
FAINT = 0.25
#: Sentences by which a document scores.
WORST = 3
#: A value from which on a word may count like the landmark: three letters put in at one place.
NEAR = 0.5
#: Power of the values that are added up, so that many weak ones don't make a strong one.
SHARP = 4
#: Weight of all toxic sentences together in the machine's loss; the others have the rest.
TOXIC_SHARE, RIDGE = 0.05, 1e-6
#: Distinct words whose kernel values a worker remembers.
REMEMBERED = 300_000
#: Words whose kernel values are computed at once, and pairs whose tables are held together.
WORDS_AT_ONCE, PAIRS_AT_ONCE = 20_000, 2048

_END = re.compile(r"[.!?](?=\s)|\n")
_APART = re.compile(r"(?<![^\s])(?:[^\W\d_][\s.*_-]){3,}[^\W\d_](?![^\s])")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def sentences(text: str) -> list[str]:
    return [x for x in _END.split(text) if x and not x.isspace()]


def normal(word: str) -> str:
    """Lower-case letters alone."""
    return word if word.isalpha() and word.islower() else _NOT_LETTERS.sub("", word.lower())


def kernel(s: list[str], t: list[str]) -> np.ndarray:
    """The kernel of each pair s[k], t[k]: dynamic programming over all pairs at once."""
    return kernel_codes(_codes(s), _codes(t))


def kernel_codes(a: np.ndarray, b: np.ndarray, gaps: np.ndarray | None = None) -> np.ndarray:
    """kernel() of rows of code points, filled with 0; gaps[k, i] letters of a's word were left out before its letter i.

    One step per pair of places; all pairs and all lengths of subsequences advance together, so only
    the last row of tables is kept.
    """
    la, lb, n = a.shape[1], b.shape[1], len(a)
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    missed = None if gaps is None else np.power(np.float32(DECAY), gaps.T.astype(np.float32))
    # alive[j, p]: weight of common subsequences of p + 1 letters within the first letters of a and j of b.
    alive, total = np.zeros((lb + 1, ORDER - 1, n), np.float32), np.zeros(n, np.float32)
    for i in range(la):
        same = (b == a[i]) & (a[i] > 0)
        if not same.any():
            alive *= DECAY if missed is None else missed[i] * np.float32(DECAY)
            continue
        run, before = np.zeros((ORDER - 1, n), np.float32), alive[0]
        for j in range(lb):
            match = same[j].astype(np.float32)
            match *= DECAY * DECAY
            run *= DECAY
            run[0] += match
            run[1:] += match * before[:-1]
            total += match * before[-1]
            before = alive[j + 1].copy() if missed is None else alive[j + 1] * missed[i]
            np.multiply(before, DECAY, out=alive[j + 1])
            alive[j + 1] += run
    return total.astype(np.float64)


def _codes(words: list[str]) -> np.ndarray:
    """Code points, one word a row, filled with 0."""
    width = max(map(len, words), default=1) or 1
    data = np.array(words, dtype=f"U{width}")
    return data.view(np.uint32).reshape(len(words), width)


def _only(codes: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, gaps) of the words without the letters that a landmark has not: how many were left out before each that stays."""
    keep = np.isin(codes, letters) & (codes > 0)
    at = np.cumsum(keep, axis=1) - 1
    width = max(1, int(at[:, -1].max()) + 1)
    row, column = np.nonzero(keep)
    out, place = np.zeros((len(codes), width), codes.dtype), np.full((len(codes), width + 1), -1)
    out[row, at[row, column]] = codes[row, column]
    place[row, at[row, column] + 1] = column
    return out, np.maximum(place[:, 1:] - place[:, :-1] - 1, 0)


class ToxicityModel:
    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        self.weight, self.bias, self.slope, self.shift = np.zeros(3 * len(landmarks)), 0.0, np.zeros(WORST), 0.0
        if landmarks:
            self.own = kernel(landmarks, landmarks)
            self.codes = _codes(landmarks)
            self.size = np.array([len(x) for x in landmarks])
        self._forget()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "plain", "rows")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._forget()

    room = REMEMBERED

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}  # as they stand in texts
        self.plain: dict[str, int] = {}  # their letters
        self.rows: list[np.ndarray] = [np.zeros(len(self.landmarks), np.float32)]

    def word_values(self, words: list[str]) -> np.ndarray:
        """Kernel values of normal() words at the landmarks, as a share of the landmark's own (at most 1), faint ones 0."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        if not words or not self.landmarks:
            return out
        # Windows of long words; words of like length share a table of codes.
        parts = [(k, w[a : a + LONG_WORD]) for k, word in enumerate(words) for w in (f"^{word}",) for a in range(0, max(1, len(w) - LONG_WORD // 2), LONG_WORD // 2)]
        of = np.fromiter((k for k, _ in parts), np.int64, len(parts))
        size = np.fromiter((len(w) for _, w in parts), np.int64, len(parts))
        order, whole = np.argsort(size, kind="stable"), len(parts) == len(words)
        for lo in range(0, len(order), WORDS_AT_ONCE):
            some = order[lo : lo + WORDS_AT_ONCE]
            codes = _codes([parts[k][1] for k in some])
            for p, k in self._candidates(codes):
                own = self.codes[k, : self.size[k]]
                for b in range(0, len(p), PAIRS_AT_ONCE):
                    pp = p[b : b + PAIRS_AT_ONCE]
                    letters, gaps = _only(codes[pp], own)
                    value = np.minimum(kernel_codes(letters, np.broadcast_to(own, (len(pp), len(own))), gaps) / self.own[k], 1)
                    value = np.where(value < FAINT, 0, value).astype(np.float32)
                    if whole:
                        out[of[some[pp]], k] = value
                    else:
                        np.maximum.at(out[:, k], of[some[pp]], value)
        return out

    def _candidates(self, codes: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
        """(words, landmark) of all pairs whose longest common subsequence has ORDER letters; letters count by their code modulo 64, which only adds pairs."""
        letter = (codes % 64).astype(np.int64)
        has = np.bitwise_or.reduce(np.where(codes > 0, np.uint64(1) << letter.astype(np.uint64), np.uint64(0)), axis=1)
        for k in range(len(self.landmarks)):
            own = self.codes[k, : self.size[k]]
            bit = np.uint64(1) << (own % 64).astype(np.uint64)
            # Letters that a landmark has twice count twice, so fewer different ones may do.
            kinds = np.unique(bit)
            p = np.flatnonzero(np.bitwise_count(has & np.bitwise_or.reduce(kinds)) >= ORDER - (len(own) - len(kinds)))
            if len(p):
                # One bit for each letter of the landmark; bits that turn 0 count the subsequence's length.
                at = np.zeros(65, np.uint16)
                np.bitwise_or.at(at, own % 64, np.uint16(1) << np.arange(len(own), dtype=np.uint16))
                rows = np.where(codes[p] > 0, letter[p], 64).T
                row = np.full(len(p), 0xFFFF, np.uint16)
                for column in rows:
                    match = row & at.take(column)
                    row = (row + match) | (row - match)
                common = np.bitwise_count(~row & np.uint16((1 << len(own)) - 1))
                p = p[common >= ORDER]
                if len(p):
                    yield p, k

    def row(self, words: list[bytes]) -> np.ndarray:
        """Number of each word's row of values; row 0 is all zeros."""
        if len(self.known) > self.room:
            self._forget()
        new = [w for w in words if w not in self.known]
        plain = [normal(w.decode(errors="replace")) for w in new]
        kinds = sorted({w for w in plain if w not in self.plain})
        for a in range(0, len(kinds), WORDS_AT_ONCE):
            some = kinds[a : a + WORDS_AT_ONCE]
            values = self.word_values(some)
            self.plain.update(dict.fromkeys(some, 0))
            for k in np.flatnonzero(values.any(axis=1)):
                self.plain[some[k]] = len(self.rows)
                self.rows.append(values[k].copy())  # a view would keep all values in memory
        self.known.update(zip(new, map(self.plain.__getitem__, plain), strict=True))
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    @staticmethod
    def summed(values: np.ndarray, head: np.ndarray) -> np.ndarray:
        """Of the words from each head to the next: the largest value at each landmark, the same where NEAR counts as all, and the logarithm of 1 and the sum of the others' powers."""
        most = np.maximum.reduceat(values, head)
        return np.hstack([most, np.minimum(most / NEAR, 1), np.log1p(np.maximum(np.add.reduceat(values**SHARP, head) - most**SHARP, 0))])

    def features(self, values: np.ndarray) -> np.ndarray:
        return np.hstack([part @ self.map for part in np.split(values, 3, axis=1)])

    def decide(self, values: np.ndarray) -> np.ndarray:
        return self.features(values) @ self.weight + self.bias

    def worst(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The decisions of each row's worst sentences; in place of a missing one that of no value."""
        lowest = self.decide(np.zeros((1, 3 * len(self.landmarks))))[0]
        out = np.full((len(offsets) - 1, WORST), lowest)
        starts, ends, first = C.word_spans(raw, offsets)
        if not len(starts) or not self.landmarks:
            return out
        # Words are cut with the space before the next, so the pieces tile the text and equal words are found by Arrow.
        bounds = np.append(starts, len(raw)).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
        code = self.row(pieces.dictionary.to_pylist())[pieces.indices.to_numpy()]
        # A sentence ends after . ! ? before white space, at a line's end, and at the text's end.
        stop = np.isin(raw[ends - 1], np.frombuffer(b".!?", np.uint8))
        line = np.append(0, np.cumsum(raw == 10))
        stop |= line[bounds[1:]] > line[ends]
        begin = np.append(True, stop[:-1])
        begin[first[:-1][first[:-1] < len(starts)]] = True
        sentence = np.cumsum(begin) - 1
        rows, values = [], []
        hot = np.flatnonzero(code)
        if len(hot):
            table = np.stack(self.rows)
            # A word counts once in a sentence, so that lines of one word repeated don't add up.
            hot = hot[np.sort(np.unique(sentence[hot].astype(np.int64) * len(table) + code[hot], return_index=True)[1])]
            head = np.flatnonzero(np.append(True, sentence[hot][1:] != sentence[hot][:-1]))
            for a in range(0, len(head), 1 << 12):  # the values of so many sentences at a time
                end = head[a + (1 << 12)] if a + (1 << 12) < len(head) else len(hot)
                some = hot[head[a] : end]
                values.append(self.decide(self.summed(table[code[some]], head[a : a + (1 << 12)] - head[a])))
            rows.append(C.row_of(first, len(starts))[hot[head]])
        spelt = list(self._apart(raw, starts, ends, first))
        if spelt:
            values.append(np.array([self.decide(self.summed(self.word_values([w]), np.array([0])))[0] for _, w in spelt]))
            rows.append(np.array([r for r, _ in spelt]))
        if rows:
            row, value = np.concatenate(rows), np.maximum(lowest, np.concatenate(values))
            order = np.lexsort((-value, row))
            row, value = row[order], value[order]
            heads = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            nth = np.arange(len(row)) - np.repeat(heads, np.diff(np.append(heads, len(row))))
            out[row[nth < WORST], nth[nth < WORST]] = value[nth < WORST]
        return out

    @staticmethod
    def _apart(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, str]]:
        """(row, word) of every run of single letters set apart."""
        letters = np.append(0, np.cumsum((raw & 0xC0) != 0x80))
        short = np.concatenate([[False], letters[ends] - letters[starts] <= 2, [False]])
        edge = np.flatnonzero(short[1:] != short[:-1]).reshape(-1, 2)  # runs of words of at most two characters
        for a, b in edge[edge[:, 1] - edge[:, 0] >= 4].tolist():
            text = raw[starts[a] : ends[b - 1]].tobytes().decode(errors="replace")
            for found in _APART.finditer(text):
                at = a + len(text[: found.start()].split())
                yield int(np.searchsorted(first, at, side="right")) - 1, normal(found[0])

    def scores(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if not self.landmarks:
            return np.zeros(len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(self.worst(raw, offsets) @ self.slope + self.shift, -40, 40)))


def choose_landmarks(texts: list[str], labels: list[int], most: int = LANDMARKS) -> list[tuple[str, int]]:
    """Word beginnings and how often one sentence must have them to tell: so they are in toxic documents and hardly in others.

    Each next one adds most toxic documents, and at most ``most`` are chosen for each of TIMES.
    """
    y = np.array(labels)
    number: dict[str, int] = {}
    codes, places, doc_of = array("q"), array("q"), array("q")  # a word's number and sentence; a sentence's document
    for r, text in enumerate(texts):
        for part in [*sentences(text), *_APART.findall(text)]:
            own = [normal(part)] if _APART.fullmatch(part) else [normal(w) for w in part.split()]
            codes.extend(number.setdefault(w[a : a + LONG_WORD], len(number)) for w in own for a in range(0, len(w), LONG_WORD))
            places.extend([len(doc_of)] * (len(codes) - len(places)))
            doc_of.append(r)
    if not number:
        return []
    code, place, doc_of = (np.frombuffer(x, np.int64) for x in (codes, places, doc_of))
    names = sorted(number)
    at = np.empty(len(names), np.int64)
    at[[number[w] for w in names]] = np.arange(len(names))
    code, word = at[code], np.array(names)
    found: dict[int, dict[str, frozenset]] = {times: {} for times in TIMES}
    for size in range(SHORTEST, LONGEST + 1):
        short = word.astype(f"U{size}")
        kind = np.cumsum(np.append(False, short[1:] != short[:-1]))  # equal beginnings stand together
        long = (np.char.str_len(short) == size)[code]
        pair, count = np.unique(kind[code[long]] * len(doc_of) + place[long], return_counts=True)
        first = np.flatnonzero(np.append(True, short[1:] != short[:-1]))
        for times in TIMES:
            pairs = pair[count >= times]
            both = np.unique(pairs // len(doc_of) * len(y) + doc_of[pairs % len(doc_of)])
            k, doc = both // len(y), both % len(y)
            toxic, other = (np.bincount(k[y[doc] == label], minlength=len(first)) for label in (1, 0))
            share_toxic, share_other = toxic / max(1, (y == 1).sum()), other / max(1, (y == 0).sum())
            ends = np.searchsorted(k, np.arange(len(first) + 1))
            for g in np.flatnonzero((toxic >= LEAST_DOCS) & (share_other <= IMPURE * share_toxic)):
                name = "^" + str(short[first[g]])
                if not any(name in found[fewer] for fewer in TIMES if fewer < times):
                    found[times][name] = frozenset(x for x in doc[ends[g] : ends[g + 1]].tolist() if y[x])
    chosen = [(name, times) for times in TIMES for name in _most_telling(list(found[times]), list(found[times].values()), most)]
    return chosen + _anywhere(chosen, names, code, doc_of[place], y)


def _anywhere(chosen: list[tuple[str, int]], names: list[str], code: np.ndarray, doc: np.ndarray, y: np.ndarray) -> list[tuple[str, int]]:
    """Landmarks without their ^, where words that hold them at any place tell too."""
    text, out = "\n".join(names), []
    starts = np.append(0, np.cumsum([len(x) + 1 for x in names]))
    order = np.argsort(code, kind="stable")
    ends = np.searchsorted(code[order], np.arange(len(names) + 1))
    for name, times in chosen:
        piece = name[1:]
        if times > 1 or len(piece) < ORDER or any(x.startswith(piece[:ORDER]) for x, _ in out):  # near pieces find each other's words
            continue
        words = np.unique(np.searchsorted(starts, [m.start() for m in re.finditer(re.escape(piece), text)], side="right") - 1)
        docs = np.unique(np.concatenate([doc[order[ends[w] : ends[w + 1]]] for w in words]))
        toxic, other = y[docs].sum() / max(1, y.sum()), (1 - y[docs]).sum() / max(1, (1 - y).sum())
        if other <= IMPURE * toxic:
            out.append((piece, 1))
    return out


def _most_telling(names: list[str], docs: list[frozenset], most: int) -> list[str]:
    chosen, covered, left = [], dict.fromkeys(frozenset().union(*docs), 0), list(range(len(names)))
    while left and len(chosen) < most:
        gain = {k: sum(1.0 if not covered[d] else 0.2 if covered[d] < 3 else 0.0 for d in docs[k]) for k in left}
        best = max(left, key=lambda k: (gain[k], -len(names[k]) if len(names[k]) > 7 else len(names[k]), names[k]))
        if gain[best] < 1:
            break
        # Of beginnings that tell as much, the longer one is the more specific.
        best = max((k for k in left if names[k].startswith(names[best]) and len(names[k]) <= 8 and gain[k] >= 0.97 * gain[best]), key=lambda k: (len(names[k]), names[k]), default=best)
        chosen.append(names[best])
        for d in docs[best]:
            covered[d] += 1
        left = [k for k in left if k != best and gain[k] >= 0.5 and not (names[k].startswith(names[best]) or names[best].startswith(names[k]))]
    return chosen


def _changed(text: str, how: int, rng: np.random.RandomState, tells, free: re.Pattern | None) -> str:
    """The text with every longer word that ``tells`` changed: a letter or three put in, a letter taken out, or letters put before it if it tells at any place."""
    out = []
    for w in text.split():
        if tells(w):
            k = rng.randint(1, max(2, len(w) - 1))
            more = "".join(chr(97 + x) for x in rng.randint(26, size=(1, 3, 0, 4)[how]))
            if how < 2 and len(w) >= 4:
                w = w[:k] + more + w[k:]
            elif how == 2 and len(w) >= 6:
                w = w[:k] + w[k + 1 :]
            elif how == 3 and free and free.search(normal(w)):
                w = more + w
        out.append(w)
    return " ".join(out)


def fit(texts: list[str], labels: list[int]) -> ToxicityModel:
    if len(set(labels)) < 2:
        return ToxicityModel([])
    chosen = choose_landmarks(texts, labels)
    model, times = ToxicityModel([x for x, _ in chosen]), np.array([k for _, k in chosen])
    if not model.landmarks:
        return model
    m = len(model.landmarks)
    # Nystrom: K(landmarks, landmarks) to the power -1/2, on values that are shares of the landmarks' own.
    left, right = zip(*((a, b) for a in model.landmarks for b in model.landmarks), strict=True)
    gram = kernel(list(left), list(right)).reshape(m, m) / np.sqrt(np.outer(model.own, model.own))
    values, vectors = np.linalg.eigh(gram + 1e-3 * np.eye(m))
    model.map = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    rng = np.random.RandomState(3)
    rows, target, nothing = [], [], 0
    model.room = 1 << 40  # the sample's words are all kept while fitting
    plain = [sentences(x) for x in texts]
    free = [re.escape(x) for x in model.landmarks if not x.startswith("^")]
    free = re.compile("|".join(free)) if free else None

    def learn(parts) -> np.ndarray:
        every = sorted({w.encode() for part in parts for x in part for w in x.split()})
        model.row(every)
        return np.stack(model.rows)

    table = learn(plain)

    def of(part: list[str]) -> np.ndarray:
        codes = [list(dict.fromkeys(c for w in x.split() if (c := model.known[w.encode()]))) or [0] for x in part]
        return model.summed(table[np.concatenate(codes)], np.cumsum([0, *map(len, codes[:-1])])) if codes else np.zeros((0, 3 * m), np.float32)

    toxic = []
    for part, y in zip(plain, labels, strict=True):
        value = of(part)
        if y:
            hit = np.flatnonzero((value[:, :m] ** SHARP + np.expm1(value[:, 2 * m :]) > 0.9 * times).any(axis=1))
            if len(hit):
                rows.append(value[hit])
                target.append(np.ones(len(hit)))
                toxic += [part[k] for k in hit]
        elif len(value):
            some = value[value.any(axis=1)]
            rows.append(some)
            target.append(np.zeros(len(some)))
            nothing += len(value) - len(some)
    changed = [[_changed(x, how, rng, lambda w: model.known[w.encode()], free) for x in toxic] for how in range(4)]
    table = learn(changed)
    for part in changed:
        rows.append(of(part))
        target.append(np.ones(len(part)))
    # Sentences of no value are all alike: one row stands for them.
    rows.append(np.zeros((1, 3 * m), np.float32))
    target.append(np.zeros(1))
    x, y = model.features(np.concatenate(rows)), np.concatenate(target) * 2 - 1
    copies = np.append(np.ones(len(y) - 1), nothing)
    # Squared hinge, by Newton's method.
    x1 = np.hstack([x, np.ones((len(x), 1))])
    each = copies * np.where(y > 0, TOXIC_SHARE / max(1, (y > 0).sum()), (1 - TOXIC_SHARE) / max(1, copies[y < 0].sum()))
    w, ridge = np.zeros(3 * m + 1), RIDGE * np.eye(3 * m + 1)
    ridge[-1, -1] = 1e-8
    for _ in range(20):
        inside = y * (x1 @ w) < 1
        a, g = x1[inside], each[inside]
        new = np.linalg.solve(ridge + (a * g[:, None]).T @ a, (a * g[:, None]).T @ y[inside])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    model.weight, model.bias = w[:-1], float(w[-1])
    # The logistic curve, by Newton's method with a prior that keeps it finite: on documents, and on
    # toxic sentences that stand alone, which together count as much as the toxic documents.
    worst = np.concatenate([model.worst(*C.utf8(pa.array(texts[a : a + 64], pa.large_string()))) for a in range(0, len(texts), 64)])
    alone = np.full((len(toxic), WORST), model.decide(np.zeros((1, 3 * m)))[0])
    if toxic:
        alone[:, 0] = np.maximum(alone[:, 0], model.decide(of(toxic)))
    z = np.hstack([np.concatenate([worst, alone]), np.ones((len(worst) + len(alone), 1))])
    t = np.append(np.array(labels, float), np.ones(len(alone)))
    count = np.append(np.ones(len(worst)), np.full(len(alone), sum(labels) / max(1, len(alone))))
    sure = (count * t).sum(), (count * (1 - t)).sum()
    t = np.where(t > 0, 1 - 1 / (2 + sure[0]), 1 / (2 + sure[1]))
    v = np.append(1.0, np.zeros(WORST))
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ v, -30, 30)))
        h = (z * (count * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(WORST + 1)
        v = v - np.clip(np.linalg.solve(h, z.T @ (count * (p - t)) + 1e-3 * v), -2, 2)
        v[:-1] = np.maximum(v[:-1], 0)  # worse never scores lower
    model.slope, model.shift = v[:-1], float(v[-1])
    del model.room
    model._forget()
    return model


_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])


def _scored(packed: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(packed)
        for b in C.slices(batches):
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(model.scores(*C.utf8(b.column("text"))))], schema=_OUT)

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; predicted is 1 from ``least`` on."""
    model = labelled.fitted(docs, labels, "toxic", fit)
    rows = C.keyed_documents(docs).withColumn("held_out", labelled.held_out())
    return rows.mapInArrow(_scored(model), "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= least).cast("int"))


def _kept(packed: bytes, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(packed)
        for b in C.slices(batches):
            yield b.filter(pa.array(model.scores(*C.utf8(b.column("text"))) < least))

    return run


def drop_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, that score below ``least``."""
    return docs.mapInArrow(_kept(labelled.fitted(docs, labels, "toxic", fit), least), docs.schema)
