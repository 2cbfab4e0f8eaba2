"""HTML extraction with a host suffix array.

A page is cut into blocks of visible text; each block has a zone by the tags and names around it, as a
prior: chrome (menus, headers, footers, sidebars, notices, adverts, forms, comments) goes, the main
container (article, main) stays, plain text outside of it is open.  Then repeats on the pages of one
host decide about the open blocks and about short blocks of the container:

* a plain block is boilerplate if runs of ``REPEAT`` tokens that stand on ``PAGES`` distinct pages or
  more cover most of it; what is left are the unique runs.  On a page with a container, unique plain
  text stays only if it is a paragraph (``PARAGRAPH`` tokens);
* a block of the container of at most ``SHORT`` tokens is a template's notice if it stands on
  ``BODIES`` or more different articles that make up half of the host's pages.  On a page where such
  blocks are most of the article it is a copied article instead, and all of it stays.

Repeats are found with a suffix array: the token streams of a task's pages are concatenated and sorted
by their first ``REPEAT`` tokens with rank doubling; suffixes of one host with one rank are one run.
Each task sends one row per run, group of pages and host, and the runs of all tasks are added up by host
and hash, so a repeat counts wherever on the host its pages lie.  The runs that repeat go back to the
groups of pages that have them.  A host is dealt into groups by page, so none is gathered in one task.

The scanner of tags is linear.  As in browsers, a tag or a quoted value that never ends takes the rest
of the page.

Defined cases: a null or empty html gives an empty text; a null url is host ""; repeated rows are
extracted each by itself and count as one page for repeats; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm import common as C

#: Pages in a group, about; tokens of a repeat; share of a block's tokens that repeats must cover; distinct pages that share a repeat.
GROUP, REPEAT, COVERED, PAGES = 512, 8, 0.8, 2
#: Tokens of a notice inside an article at most, and different articles that must have it; tokens of a paragraph beside an article.
SHORT, BODIES, PARAGRAPH = 25, 5, 20
#: Hosts of more than a group whose list is sent to every task; a longer list is joined by shuffle.
HOSTS_SENT = 100_000
#: Pages whose tokens are sorted at once.
SORTED_AT_ONCE = 1024

# Elements by what they mean for the text around them.
_HIDDEN = frozenset("script style noscript template head iframe object svg canvas audio video select option textarea button".split())
_RAW = frozenset("script style textarea title noscript iframe".split())
_CHROME = frozenset("nav header footer aside form menu dialog".split())
_MAIN = frozenset("article main".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split()
)
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|comment-?list|cookies?|consent|disqus|footer|header|menu|modal|nav\w*|newsletter|notice|notices|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.I,
)
_NAME = re.compile(r"/?[A-Za-z][^\s/>]*+")
_PAIR = re.compile(r"[\s/]*+(=?[^\s/>=]++|=)(?:\s*+=\s*+(?:\"([^\"]*+)(?:\"|\Z)|'([^']*+)(?:'|\Z)|([^\s\"'>][^\s>]*+)))?")
_REST = re.compile(r"[\s/]*+")
_NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_WHITE = re.compile(r"\s+")
_CLOSE = {tag: re.compile(rf"</{tag}", re.I) for tag in _RAW}

#: A block's zone.
MAIN, PLAIN, CHROME = 0, 1, 2


def attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """(attributes by lower-case name, place after the tag's >) from a place behind a tag's name; the first of equal names counts."""
    found: dict[str, str] = {}
    while True:
        at = _REST.match(page, at).end()
        if at >= len(page):
            return found, at
        if page[at] == ">":
            return found, at + 1
        pair = _PAIR.match(page, at)
        found.setdefault(pair[1].lower(), pair[2] or pair[3] or pair[4] or "")
        at = pair.end()


def hides(found: dict[str, str]) -> bool:
    """Whether a start tag's attributes hide the element: by name, aria-hidden or style."""
    return "hidden" in found or found.get("aria-hidden", "").strip().lower() == "true" or bool(_NO_DISPLAY.search(entities.unescape(found.get("style", ""))))


class _Open:
    """The open elements: what is hidden, main or chrome inside of the innermost, and where each tag was last opened."""

    def __init__(self) -> None:
        self.state = [(False, False, False)]
        self.tags: list[str] = []
        self.places: dict[str, list[int]] = {}

    def push(self, tag: str, state: tuple[bool, bool, bool]) -> None:
        self.places.setdefault(tag, []).append(len(self.tags))
        self.tags.append(tag)
        self.state.append(state)

    def close(self, tag: str) -> None:
        """Closes the last open element of this tag; a stray end tag does not close the article around it."""
        place = self.places.get(tag)
        if not place or (tag not in ("article", "main", "body", "html") and any(self.places.get(x, [-1])[-1:] > [place[-1]] for x in ("article", "main", "body"))):
            return
        at = place[-1]
        for x in self.tags[at:]:
            self.places[x].pop()
            if not self.places[x]:
                del self.places[x]
        del self.tags[at:], self.state[at + 1 :]


def blocks(page: str) -> list[tuple[str, int]]:
    """(text, zone) of every visible block in page order; spaces inside are single."""
    out: list[tuple[str, int]] = []
    text: list[str] = []
    stack = _Open()

    def flush() -> None:
        if text:
            if joined := _WHITE.sub(" ", entities.unescape("".join(text))).strip():
                _, main, chrome = stack.state[-1]
                out.append((joined, CHROME if chrome else MAIN if main else PLAIN))
            text.clear()

    at, n = 0, len(page)
    while at < n:
        tag_at = page.find("<", at)
        end = tag_at if tag_at >= 0 else n
        if end > at and not stack.state[-1][0]:
            text.append(page[at:end])
        if tag_at < 0:
            break
        if page.startswith("<!--", end):
            close = page.find("-->", end + 4)
            at = close + 3 if close >= 0 else n
            continue
        if page.startswith(("<!", "<?"), end):
            close = page.find(">", end)
            at = close + 1 if close >= 0 else n
            continue
        name = _NAME.match(page, end + 1)
        if not name:  # a lone < is text
            if not stack.state[-1][0]:
                text.append("&lt;")
            at = end + 1
            continue
        tag, (found, at) = name[0].lower(), attributes(page, name.end())
        ends, tag = tag[0] == "/", tag.lstrip("/")
        if tag not in _INLINE:
            flush()
        if ends:
            stack.close(tag)
            continue
        if tag in _VOID or (page[at - 2 : at] == "/>" and tag not in _RAW):
            continue
        if tag in ("p", "li", "tr", "td", "th", "dt", "dd") and stack.tags and stack.tags[-1] == tag:
            stack.close(tag)  # its end tag may be left out
        hidden, main, chrome = stack.state[-1]
        names = " ".join(found[x] for x in ("class", "id", "role", "aria-label") if x in found)
        hidden = hidden or tag in _HIDDEN or bool(found and hides(found))
        chrome = chrome or (tag in _CHROME and not (tag == "header" and main)) or bool(names and tag not in _MAIN and tag not in ("body", "html") and _NAMES.search(names))
        main = main or tag in _MAIN or "main" in names.lower().split()
        stack.push(tag, (hidden, main, chrome))
        if tag in _RAW and hidden:
            close = _CLOSE[tag].search(page, at)
            if not close:
                break
            at = close.start()
    flush()
    return out


def ranks(tokens: np.ndarray, stream: np.ndarray, length: int = REPEAT) -> np.ndarray:
    """For each place the rank of the suffix that begins there among all, by its first ``length`` tokens.

    Suffixes of equal rank begin with the same tokens; no suffix reaches beyond its stream.  Sorted by
    the first 2, 4, 8 ... tokens in turn.
    """
    if not len(tokens):
        return np.zeros(0, np.int64)
    total = len(tokens)
    rank = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    done = 1
    while done < length:
        step = min(done, length - done)
        key = rank * (total + 2)
        inside = stream[step:] == stream[:-step] if step < total else np.zeros(0, bool)
        key[: total - step] += np.where(inside, rank[step:] + 1, 0)
        rank = np.unique(key, return_inverse=True)[1].astype(np.int64)
        done += step
    return rank


class _Streams:
    """The token streams of some pages' blocks that repeats may decide about."""

    def __init__(self, pages: list[list[tuple[str, int]]]):
        self.place, texts, stream, last = [], [], [], None
        for p, page in enumerate(pages):
            for b, (text, zone) in enumerate(page):
                if zone == PLAIN or (zone == MAIN and text.count(" ") < SHORT):
                    # Plain blocks that follow one another are one stream; each block of an article is its own.
                    joins = last == (p, b - 1, PLAIN) and zone == PLAIN
                    stream.append(stream[-1] if joins else len(texts))
                    last = p, b, zone
                    self.place.append((p, b, zone))
                    texts.append(text)
        raw, offsets = C.utf8(pa.array(texts, pa.large_string()))
        starts, ends, self.first = C.word_spans(raw, offsets)
        self.tokens = C.word_hashes(raw, starts, ends)
        self.block = C.row_of(self.first, len(starts))
        self.stream = np.array(stream, np.int64)[self.block]
        self.page = np.array([x[0] for x in self.place], np.int64)[self.block]
        self.main = np.array([x[2] == MAIN for x in self.place], bool)[self.block]
        self._runs()

    def _runs(self) -> None:
        """begin, size, label of every run that is looked up: all of REPEAT tokens of plain streams, tiles of an article's blocks, and whole short streams."""
        n = len(self.tokens)
        heads = np.flatnonzero(np.append(True, self.stream[1:] != self.stream[:-1])) if n else np.zeros(0, np.int64)
        ends = np.append(heads[1:], n)
        of = np.repeat(np.arange(len(heads)), ends - heads)
        at = np.arange(n)
        tile = ((at - heads[of]) % REPEAT == 0) | (at + REPEAT == ends[of]) if n else np.zeros(0, bool)
        full = np.flatnonzero((at + REPEAT <= ends[of]) & (~self.main | tile)) if n else at
        short = heads[ends - heads < REPEAT]
        self.begin = np.concatenate([full, short])
        self.size = np.concatenate([np.full(len(full), REPEAT), (ends - heads)[ends - heads < REPEAT]])
        self.label = C.span_hashes(self.tokens, self.begin, self.begin + self.size).view(np.int64)
        self.rank = ranks(self.tokens, self.stream)[self.begin] * (REPEAT + 1) + self.size if n else self.begin

    def covered(self, hit: np.ndarray) -> dict[tuple[int, int], float]:
        """(page, block) -> share of its tokens that the runs in ``hit`` cover."""
        depth = np.zeros(len(self.tokens) + 1, np.int64)
        np.add.at(depth, self.begin[hit], 1)
        np.add.at(depth, self.begin[hit] + self.size[hit], -1)
        total = np.append(0, np.cumsum(np.cumsum(depth[:-1]) > 0))
        sizes = np.diff(self.first)
        share = (total[self.first[1:]] - total[self.first[:-1]]) / np.maximum(sizes, 1)
        return {(p, b): float(x) for (p, b, _), x in zip(self.place, share, strict=True)}


def keep(page: list[tuple[str, int]], repeated: dict[int, float], notice: dict[int, float]) -> str:
    """The main text of a page, from the covered shares of its plain and of its main blocks."""
    sizes = [text.count(" ") + 1 for text, _ in page]
    main = sum(n for n, (_, zone) in zip(sizes, page, strict=True) if zone == MAIN)
    gone = {b for b, (_, zone) in enumerate(page) if zone == MAIN and notice.get(b, 0) >= COVERED}
    if 2 * sum(sizes[b] for b in gone) >= main:
        gone = set()
    least = PARAGRAPH if main else 1
    return " ".join(text for b, (text, zone) in enumerate(page) if (zone == MAIN and b not in gone) or (zone == PLAIN and repeated.get(b, 0) < COVERED and sizes[b] >= least))


_RUNS_SQL = "host string, dealt int, main boolean, label long, body long"
_RUNS = pa.schema([("host", pa.string()), ("dealt", pa.int32()), ("main", pa.bool_()), ("label", pa.int64()), ("body", pa.int64())])


def _body(page: list[tuple[str, int]]) -> int:
    """A hash of the text of a page's container."""
    raw, offsets = C.utf8(pa.array(["\n".join(text for text, zone in page if zone == MAIN)], pa.large_string()))
    return int(C.word_hashes(raw, np.array([0]), np.array([len(raw)])).view(np.int64)[0]) if len(raw) else 0


def _found_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per run, group and page (plain) or article (main) that has it; of a run on many pages of the group two plain rows suffice."""
    for b in C.slices(batches, "html"):
        for a in range(0, b.num_rows, SORTED_AT_ONCE):
            part = b.slice(a, SORTED_AT_ONCE)
            pages = [blocks(x or "") for x in part.column("html").to_pylist()]
            s = _Streams(pages)
            if not len(s.begin):
                continue
            names, host = np.unique(np.array(part.column("host").to_pylist(), object), return_inverse=True)
            dealt, same = (part.column(c).to_numpy(zero_copy_only=False) for c in ("dealt", "same"))
            body = np.fromiter((_body(x) for x in pages), np.int64, len(pages))
            page, main = s.page[s.begin], s.main[s.begin]
            who = np.where(main, body[page], same[page])
            # Equal runs of a host stand together by their rank in the suffix array.
            order = np.lexsort((who, dealt[page], main, s.rank, host[page]))
            key = np.stack([host[page], s.rank, main.astype(np.int64), dealt[page].astype(np.int64)])[:, order]
            who = who[order]
            new = np.append(True, (key[:, 1:] != key[:, :-1]).any(axis=0))
            last = np.append(new[1:], True)
            other = np.append(True, who[1:] != who[:-1])
            send = new | (main[order] & other) | (~main[order] & last & other)
            pick = order[send]
            yield pa.record_batch(
                [pa.array(names[host[page[pick]]], pa.string()), pa.array(dealt[page[pick]].astype(np.int32)), pa.array(main[pick]), pa.array(s.label[pick]), pa.array(who[send])],
                schema=_RUNS,
            )


_ROWS_SQL = "host string, dealt int, kind int, page_id long, url string, texts array<string>, zones array<int>, label long, same long"
_ROWS = pa.schema(
    [("host", pa.string()), ("dealt", pa.int32()), ("kind", pa.int32()), ("page_id", pa.int64()), ("url", pa.string()), ("texts", pa.list_(pa.string())), ("zones", pa.list_(pa.int32())), ("label", pa.int64()), ("same", pa.int64())]
)
#: Kinds of rows of a group, in the order in which they come: runs that repeat, runs of notices, pages.
_REPEATED, _NOTICE, _PAGE = 0, 1, 2


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as blocks; chrome is left out but for a mark of its place."""
    for b in C.slices(batches, "html"):
        found = [[(t if z != CHROME else "", z) for t, z in blocks(x or "")] for x in b.column("html").to_pylist()]
        n = b.num_rows
        cols = {c: b.column(c) for c in ("host", "dealt", "page_id", "url", "same")}
        cols |= {"kind": pa.array(np.full(n, _PAGE, np.int32)), "texts": pa.array([[t for t, _ in f] for f in found], pa.list_(pa.string())), "zones": pa.array([[z for _, z in f] for f in found], pa.list_(pa.int32())), "label": pa.nulls(n, pa.int64())}
        yield pa.record_batch([cols[f.name].cast(f.type) for f in _ROWS], schema=_ROWS)


_OUT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])


def _texts(pages: list[list[tuple[str, int]]], repeated: np.ndarray, notice: np.ndarray) -> list[str]:
    if not len(repeated) and not len(notice):
        return [keep(page, {}, {}) for page in pages]
    s = _Streams(pages)
    main = s.main[s.begin]
    plain_share, main_share = s.covered(~main & np.isin(s.label, repeated)), s.covered(main & np.isin(s.label, notice))
    out = []
    for p, page in enumerate(pages):
        out.append(keep(page, *({b: share.get((p, b), 0.0) for b in range(len(page))} for share in (plain_share, main_share))))
    return out


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (host, dealt, kind): a group's runs are held while its pages pass."""
    key, runs = None, [np.zeros(0, np.int64)] * 2
    for b in batches:
        hosts, dealt, kinds = (b.column(c).to_pylist() for c in ("host", "dealt", "kind"))
        bounds = [0, *(k for k in range(1, len(hosts)) if (hosts[k], dealt[k], kinds[k]) != (hosts[k - 1], dealt[k - 1], kinds[k - 1])), len(hosts)]
        for x, y in zip(bounds[:-1], bounds[1:], strict=True):
            if x == y:
                continue
            if (hosts[x], dealt[x]) != key:
                key, runs = (hosts[x], dealt[x]), [np.zeros(0, np.int64)] * 2
            if kinds[x] != _PAGE:
                runs[kinds[x]] = np.append(runs[kinds[x]], b.column("label").slice(x, y - x).to_numpy(zero_copy_only=False))
                continue
            part = b.slice(x, y - x)
            pages = [list(zip(t, z, strict=True)) for t, z in zip(part.column("texts").to_pylist(), part.column("zones").to_pylist(), strict=True)]
            texts = _texts(pages, *runs)
            yield pa.record_batch([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema=_OUT)


def extract(pages: DataFrame, group: int = GROUP) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1)), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", host).withColumn("same", F.xxhash64("url", "html"))
    counts = C.materialize(rows.groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    # Only hosts with more than a group are listed; each page's group follows from its id and content.
    many = counts.where(F.col("pages") > group).select("host", F.ceil(F.col("pages") / group).cast("int").alias("groups"))
    if many.count() <= HOSTS_SENT:
        many = F.broadcast(many)
    dealt = F.when(F.col("groups").isNull(), 0).otherwise(F.pmod(F.xxhash64("page_id", "same"), F.col("groups"))).cast("int")
    rows = rows.join(many, "host", "left").withColumn("dealt", dealt).select("page_id", "url", "host", "dealt", "html", "same")
    runs = C.materialize(rows.select("host", "dealt", "html", "same").mapInArrow(_found_runs, _RUNS_SQL), "runs")
    plain = runs.where(~F.col("main")).groupBy("host", "label").agg(F.min("body").alias("lo"), F.max("body").alias("hi")).where("lo <> hi")
    articles = runs.where("main").groupBy("host", "label", "body").agg(F.lit(1).alias("one")).groupBy("host", "label").agg(F.count("*").alias("n")).where(F.col("n") >= BODIES)
    notices = articles.join(counts, "host").where("2 * n >= pages")
    verdict = plain.select("host", "label", F.lit(_REPEATED).alias("kind")).union(notices.select("host", "label", F.lit(_NOTICE)))
    where = runs.select("host", "dealt", "label", F.when(F.col("main"), _NOTICE).otherwise(_REPEATED).alias("kind")).distinct()
    back = where.join(verdict, ["host", "label", "kind"]).select("host", "dealt", "kind", F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("array<string>").alias("texts"), F.lit(None).cast("array<int>").alias("zones"), "label", F.lit(None).cast("long").alias("same"))
    together = rows.mapInArrow(_parsed, _ROWS_SQL).union(back).repartition("host", "dealt").sortWithinPartitions("host", "dealt", "kind")
    return together.drop("same").mapInArrow(_grouped, "page_id long, url string, text string, n_chars long")
