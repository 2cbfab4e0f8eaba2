"""Operators of the llm subpackage against brute force, the libraries, and planted cases."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.llm import boilerplate, idcodec, jaccard, labelled, media, packing, quality_model, quality_rules, rlz, spm, tokens, toxicity
from graphloom.llm import common as C
from graphloom.llm.components import components

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("doc", T.StringType()), T.StructField("n_chars", T.LongType())])
VOCAB = [f"w{k}" for k in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def corpus(seed=1):
    """Copies, near copies, shared passages, repeats, nulls, empty and long texts."""
    rng = random.Random(seed)
    base, passage = prose(rng, 120), prose(rng, 60)
    texts = [base, base, base + " end", passage + "\n" + prose(rng, 50), prose(rng, 30) + " " + passage, "De " * 80, None, "", "  \n\t ", "one", prose(rng, 19), prose(rng, 4000), "x" * 5000, "é ü ñ " * 30]
    for k in range(12):
        w = base.split()
        for _ in range(k // 2):
            w[rng.randrange(len(w))] = rng.choice(VOCAB)
        texts.append(" ".join(w))
    return texts


def frame(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, "en", "clash", len(t or "")) for i, t in zip(ids, texts, strict=True)], DOCS).repartition(3)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# ---- 1 substring dedup


def windows(texts, size=20):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        w = WORD.findall((t or "").encode())
        gone = [False] * len(w)
        new = set()
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            if key in seen or key in new:
                gone[s : s + size] = [True] * size
            new.add(key)
        seen |= new
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


def test_substrings_against_brute_force(spark, monkeypatch):
    texts = corpus()
    for group in (rlz.GROUP_BYTES, 1):
        monkeypatch.setattr(rlz, "GROUP_BYTES", group)
        got = by_id(rlz.dedup_substrings(frame(spark, texts)))
        assert {i: (r["n_words"], r["n_removed"], r["kept_sha256"]) for i, r in got.items()} == windows(texts)


def test_factors_are_copies_of_earlier_text(spark):
    row, lo, size, source, at = rlz.factors(*(np.array(x) for x in ([0, 0, 0, 1, 0], [5, 20, 60, 5, 44], [20, 25, 20, 20, 20], [9, 9, 9, 9, 8], [105, 120, 160, 105, 0])))
    assert list(zip(*(x.tolist() for x in (row, lo, size, source, at)), strict=True)) == [(0, 5, 40, 9, 105), (0, 44, 20, 8, 0), (0, 60, 20, 9, 160), (1, 5, 20, 9, 105)]
    rng = random.Random(41)
    one, two = prose(rng, 90), prose(rng, 70)
    got = by_id(rlz.dedup_substrings(frame(spark, [one, two, f"{prose(rng, 7)} {one} {prose(rng, 9)} {two}", prose(rng, 50)])))
    assert [got[i]["n_factors"] for i in range(4)] == [0, 0, 2, 0] and got[2]["n_removed"] == 160


def test_substrings_edges(spark):
    assert rlz.dedup_substrings(empty(spark)).count() == 0
    text = prose(random.Random(2), 30)
    twice = rlz.dedup_substrings(frame(spark, [text, text], [5, 5])).collect()
    assert [r["n_removed"] for r in twice] == [0, 0]
    left = by_id(rlz.remove_repeats(frame(spark, [text, "a\nb " + text, None])))
    assert left[1]["text"] == "a b" and left[1]["n_chars"] == 3 and left[0]["text"] == text and left[1]["doc"] == "clash" and left[2]["text"] is None
    none = rlz.dedup_substrings(frame(spark, [text, text], [None, 3])).collect()
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in none) == [(False, 30), (True, 0)]


# ---- 2 quality rules


def repeats(words):
    from collections import Counter

    tri = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    n, cov = Counter(tri), set()
    for k, t in enumerate(tri):
        if n[t] > 1:
            cov |= {k, k + 1, k + 2}
    return len(cov)


def test_quality_counts(spark):
    texts = [*corpus(), "a a a a", "a b c a b c", "x# y$ <z>", "l\nl\n \n\nl\nm", "the the\r\nof\x0b!"]
    got = by_id(quality_rules.apply_rules(frame(spark, texts)))
    for i, t in enumerate(texts):
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), repeats(w))
        assert r["base_failed"] == (len(w) < 50 or 100 * repeats(w) > 50 * len(w)) and (not r["kept"] or not r["base_failed"])
    assert quality_rules.apply_rules(empty(spark)).count() == 0


def test_quality_rules_are_native(spark):
    plan = quality_rules.apply_rules(frame(spark, ["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange hashpartitioning" not in plan


# ---- 3 Jaccard join


def groups_of(texts, k, percent):
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = []
    for t in texts:
        w = WORD.findall((t or "").encode().translate(low))
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return {i: (len(s), root[i]) for i, s in enumerate(sets)}


@pytest.mark.parametrize(("k", "percent", "stars"), [(3, 90, 2), (5, 80, 2), (3, 90, 0)])
def test_jaccard_groups(spark, monkeypatch, k, percent, stars):
    monkeypatch.setattr(jaccard, "STARS", stars)
    texts = [*corpus(3), "A b", "a B", "a b c"]
    got = by_id(jaccard.similarity_groups(frame(spark, texts), k, percent))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == groups_of(texts, k, percent)


def test_jaccard_edges(spark):
    assert jaccard.similarity_groups(empty(spark)).count() == 0


@pytest.mark.parametrize("earlier", [64, 0])
def test_jaccard_forms_each_pair_once(spark, monkeypatch, earlier):
    """Texts that share most of their rarest shingles without being linked, and two rows of one doc_id that link others."""
    words = [f"w{k}" for k in range(100)]
    texts = []
    for code in ((x, y, z, -(x + y + z) % 3) for x in range(3) for y in range(3) for z in range(3)):
        own = words.copy()
        for at, c in zip((10, 30, 50, 70), code, strict=True):
            own[at] = f"e{at}v{c}"
        texts.append(" ".join(own))
    df = frame(spark, texts)
    kind, made = type(df), []

    def counted(rows, distinct=kind.distinct):
        if rows.columns == ["a", "b"]:
            made.append((rows.count(), distinct(rows).count()))
        return distinct(rows)

    monkeypatch.setattr(kind, "distinct", counted)
    monkeypatch.setattr(jaccard, "STARS", 0)
    monkeypatch.setattr(jaccard, "EARLIER", earlier, raising=False)
    rows = jaccard.similarity_groups(df, 3, 90).collect()
    assert all(r["component_id"] == r["doc_id"] for r in rows) and len(rows) == len(texts)
    assert made and made[-1][1] > 0
    if earlier:
        assert made[-1][0] == made[-1][1]
    twice = spark.createDataFrame([(1, texts[0] + " x"), (2, texts[0] + " y"), (2, texts[4] + " y"), (3, texts[4] + " x")], "doc_id long, text string")
    assert {r["component_id"] for r in jaccard.similarity_groups(twice, 3, 90).collect()} == {1}
    kept = jaccard.one_of_each_group(frame(spark, ["a b c d e f", "A b c d e f", None, ""], [4, 2, 1, None]))
    assert sorted((r["doc_id"] is None, r["doc_id"], r["doc"]) for r in kept.collect() if r["doc_id"] is not None) == [(False, 1, "clash"), (False, 2, "clash")] and kept.count() == 3


def test_components(spark):
    rng = random.Random(4)
    chain = [(k, k + 1) for k in range(60)] + [(rng.randrange(100, 140), rng.randrange(100, 140)) for _ in range(30)] + [(7, 7)]
    edges = spark.createDataFrame(chain, "a long, b long").repartition(7)
    root = {x: x for e in chain for x in e}
    for _ in root:
        for a, b in chain:
            root[a] = root[b] = min(root[a], root[b])
    got = {r["id"]: r["component"] for r in components(edges).collect()}
    assert got == {x: r for x, r in root.items() if x != r}


# ---- 4, 7, 10 tokens

HARD = ["", "a", " lead", "trail \n", "a\n\nb", "a \n b", "▁x ▁ y", "日本語 🙂 é", "aaaaaaa", "   " * 5, "<s>", "<|endoftext|> hi", "it's. don't 's.x", "é.a à-b ×.c", "a1.b2,c3", "x" * 300 + " b", "a \n\n b", "\x00ab"]


def test_sentencepiece(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(5)
    texts = [*HARD, *[t for t in corpus(5) if t is not None], *("".join(rng.choice("abcdefgh   \n▁éß日.th") for _ in range(80)) for _ in range(200))]
    df = frame(spark, [*texts, None])
    got = by_id(spm.digests(df, path))
    for i, t in enumerate([*texts, ""]):
        ids = [lib.bos_id(), *lib.encode(t), lib.eos_id()]
        assert (got[i]["n_tokens"], got[i]["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert got[i]["decoded_sha256"] == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
    back = by_id(spm.decode(spm.encode(df.where("doc_id < 12"), path), path))
    assert all(back[i]["text"] == lib.decode(lib.encode(texts[i])) for i in range(12))
    assert spm.digests(empty(spark), path).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_pieces_are_what_the_library_gives(name):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(P.path(name))
    lib.encode_special_tokens = True
    rng = random.Random(6)
    texts = [*HARD, *[t for t in corpus(6) if t], *("".join(rng.choice("abTh ''s.,\n\t#é0 ") for _ in range(60)) for _ in range(400))]
    enc = tokens.PieceEncoder(P.path(name))
    for _ in range(2):
        ids, first = enc.encode(*C.utf8(pa.array(texts)))
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_codec():
    rng = np.random.default_rng(7)
    ids = np.concatenate([(rng.zipf(1.4, 5000) % 49000), np.zeros(300), np.arange(60000, 65536, 7)]).astype(np.uint16)
    for n in (0, 1, 1023, 1024, 1025, len(ids)):
        data = idcodec.dumps(np.array([9]), np.array([n]), ids[:n])
        docs, counts, back = idcodec.loads(data)
        assert docs.tolist() == [9] and counts.tolist() == [n] and (back == ids[:n]).all()
    broken = bytearray(data)
    broken[-100] ^= 1
    with pytest.raises(ValueError, match="fails its check"):
        idcodec.loads(bytes(broken))
    with pytest.raises(ValueError):
        idcodec.dumps(np.array([1]), np.array([1]), np.array([70000]))


def test_codec_is_below_zlib_and_order_0():
    """Words of a Zipf law with some favourite followers, and a passage that returns."""
    rng = np.random.default_rng(8)
    ids = rng.zipf(1.2, 250_000) % 3_000
    follow = np.flatnonzero(rng.random(len(ids) - 1) < 0.4) + 1
    ids[follow] = (ids[follow - 1] * 7 + 1) % 3_000
    for at in range(0, len(ids) - 400, 20_000):
        ids[at : at + 400] = ids[:400]
    share = np.bincount(ids)
    share = share[share > 0] / len(ids)
    data = idcodec.dumps(np.array([9]), np.array([len(ids)]), ids.astype(np.uint16))
    assert (idcodec.loads(data)[2] == ids).all()
    assert 8 * len(data) / len(ids) < -(share * np.log2(share)).sum() and len(data) < len(zlib.compress(ids.astype("<u2").tobytes(), 9))


def test_blocks_stand_alone():
    """Every block is coded from an empty model: the same ids give the same bytes wherever they stand, and a broken block breaks no other."""
    ids = (np.random.default_rng(9).zipf(1.4, 3000) % 5000).astype(np.uint16)
    size = len(ids)
    data = idcodec.dumps(np.array([1, 2]), np.array([size, size]), np.concatenate([ids, ids]), block=size)
    index = np.frombuffer(data, "<u4", 6, 32 + 32).reshape(2, 3)
    assert index[0].tolist() == index[1].tolist() and data[-int(index[1, 1]) :] == data[-2 * int(index[1, 1]) : -int(index[1, 1])]


def test_token_files(spark, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(idcodec, "FILE_TEXT", 2000)
    path = P.path("word_bpe_49k.json")
    lib, texts, at = Tokenizer.from_file(path), corpus(8), 0
    got = by_id(idcodec.round_trip(frame(spark, texts), path, end=2))
    for i, t in enumerate(texts):
        ids = [*lib.encode(t or "", add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert idcodec.round_trip(empty(spark), path, 2).count() == 0


def test_packing(spark):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib, texts = Tokenizer.from_file(path), corpus(9)
    ids = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 0] for i, t in enumerate(texts)}
    pieces = packing.pack(frame(spark, texts), path).collect()
    sequences, covered = {}, {}
    for r in pieces:
        own = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(own) and r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        covered.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
    for parts, total in [*((v, None) for v in sequences.values()), *((covered[i], len(x)) for i, x in ids.items())]:
        at = 0
        for start, size in sorted(parts):
            assert start == at
            at += size
        assert at == total if total is not None else at <= 1024
    assert packing.pack(empty(spark), path).count() == 0


def test_packing_of_repeated_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK_PIECES", 3)
    path, texts = P.path("byte_bpe_50k.json"), ["one two", "one two", "other " * 2000, None, "x", "x"]
    rows = packing.pack(frame(spark, texts, [7, 7, 7, 7, None, None]), path).collect()
    places = {(r["sequence_id"], r["offset"]) for r in rows}
    assert len(places) == len(rows) and sum(r["start"] == 0 for r in rows) == 6 and sum(r["doc_id"] is None for r in rows) == 2
    assert sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in rows if r["start"] == 0)


def test_token_files_of_repeated_and_null_ids(spark):
    rows = idcodec.round_trip(frame(spark, ["b", "a", "a", None], [7, 7, None, None]), P.path("word_bpe_49k.json"), end=2).collect()
    assert sorted(r["start"] for r in rows) == np.append(0, np.cumsum([r["n_tokens"] for r in sorted(rows, key=lambda r: r["start"])]))[:-1].tolist()
    assert [r["doc_id"] for r in sorted(rows, key=lambda r: r["start"])] == [None, None, 7, 7]


def test_cutting_stock_is_near_its_bound():
    lengths, need = np.unique(np.random.default_rng(1).integers(1, 33, 20000), return_counts=True)
    plan = packing.layout(lengths, need, 32)
    n = int((plan["sequence"] + -(-plan["size"] // plan["per"])).max())
    assert n <= 1.01 * (lengths * need).sum() / 32 + 2
    assert {int(x): int(plan["size"][plan["length"] == x].sum()) for x in lengths} == dict(zip(lengths.tolist(), need.tolist(), strict=True))


# ---- 5 media


def test_media(spark):
    texts = corpus(10)
    got = by_id(media.media_columns(frame(spark, texts)))
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(media.to_png(p)), hashlib.sha256(media.to_png(p)).hexdigest()) and r["width"] == 64 and r["height"] == len(p) // 64
        assert media.from_png(media.to_png(p)) == p
    assert media.media_columns(empty(spark)).count() == 0


def test_shards_are_tar_files(spark, tmp_path):
    import tarfile

    index = media.store(frame(spark, ["a", "a", "b"]).coalesce(1), f"file://{tmp_path}").collect()
    (shard,) = {r["shard"] for r in index}
    with tarfile.open(tmp_path / shard) as tar:
        assert sorted(tar.getnames()) == sorted({f"{r['digest']}.png" for r in index}) and len(tar.getnames()) == 2


# ---- 6, 8 classifiers


def labelled_corpus(seed, insult, n=160):
    rng = random.Random(seed)
    rows, labels = [], []
    for k in range(n):
        words = prose(rng, 40).split()
        toxic, bad = k % 4 == 0, k % 3 == 0
        if toxic:
            for _ in range(2):
                words[rng.randrange(40)] = rng.choice(insult)
        if bad:
            words = [w + rng.choice(["###", "$$$", "%%%"]) for w in words]
        rows.append(" ".join(words) + ".")
        labels.append(Row(doc_id=k, quality=int(not bad), toxic=int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = labelled_corpus(11, ["moronic", "scumbag", "idiot"])
    extra = ["clean text of words w1 w2", "such a mo.ronic w3 thing", "what a s c u m b a g he is", "an idxiot w5", None, ""]
    df = frame(spark, [*rows, *extra])
    got = by_id(toxicity.score_toxicity(df, spark.createDataFrame(labels)))
    held = [r for i, r in got.items() if r["held_out"] and i < len(labels)]
    assert sum(r["predicted"] == labels[r["doc_id"]].toxic for r in held) >= 0.95 * len(held)
    n = len(rows)
    assert got[n]["score"] < 0.5 <= min(got[n + 1]["score"], got[n + 2]["score"]) and got[n + 3]["score"] > got[n]["score"] and got[n + 4]["score"] == got[n + 5]["score"] < 0.5
    assert all((zlib.crc32(str(i).encode()) % 5 == 0) == r["held_out"] for i, r in got.items())
    kept = toxicity.drop_toxic(df, spark.createDataFrame(labels))
    assert kept.columns == df.columns and n + 1 not in by_id(kept) and n in by_id(kept) and by_id(kept)[n]["doc"] == "clash"


def test_toxicity_reads_whole_words():
    """Compounds, three letters put in, and a letter taken out."""
    rng = random.Random(21)
    insult = ["moronic", "disgusting", "pathetic"]
    texts = [". ".join(" ".join([*rng.choices(VOCAB, k=8), *([rng.choice(insult)] if k % 4 == 0 and j % 2 else []), *rng.choices(VOCAB, k=4)]) for j in range(6)) for k in range(400)]
    model = toxicity.fit(texts, [int(k % 4 == 0) for k in range(400)])
    bad = ["moronic", "supermoronic", "moxronic", "moxyzronic", "mo-ro-nic", "moronc", "disxyzgusting", "overlydisgustingly", "pathxyzetic", "unpathetically", "q" * 200 + "moronic", "d i s g u s t i n g"]
    good = ["w1", "motor", "path", "gusting", "x" * 300, "a b c d e f", "é è ê ü ö"]
    score = lambda words: model.scores(*C.utf8(pa.array([f"w3 w4 {w} w5 w6. w7 w8." for w in words], pa.large_string())))
    assert score(bad).min() >= 0.5 and score(good).max() < 0.5


def test_pairs_are_left_out_only_where_the_kernel_is_zero():
    rng = random.Random(22)
    words = ["".join(rng.choices("abcdeé", k=rng.randrange(1, 90))) for _ in range(300)]
    model = toxicity.ToxicityModel(["^abcde", "bcdea", "^eeabcd", "éabcdé"])
    codes = toxicity._codes(["^" + w for w in words])
    kept = {(int(p), k) for some, k in model._candidates(codes) for p in some}
    for k, mark in enumerate(model.landmarks):
        value = toxicity.kernel(["^" + w for w in words], [mark] * len(words))
        assert {p for p in range(len(words)) if value[p] > 0} == {p for p, j in kept if j == k}
        some = np.array(sorted(p for p, j in kept if j == k))
        letters, gaps = toxicity._only(codes[some], np.array([ord(x) for x in mark]))
        assert np.allclose(toxicity.kernel_codes(letters, toxicity._codes([mark] * len(some)), gaps), value[some], rtol=1e-4)


def test_sample_is_one_row_per_document(spark):
    df = frame(spark, ["b", "a", "c", "d" * 50, None], [1, 1, 2, 3, None])
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    got = {(r["doc_id"], r["text"], r["y"]) for r in labelled.sample(df, labels, "toxic").collect()}
    assert got == {x for x in ((1, "a", 1), (2, "c", 0), (3, "d" * 50, 0)) if zlib.crc32(str(x[0]).encode()) % 5}
    assert all(len(r["text"]) < 50 for r in labelled.sample(df, labels, "toxic", chars=10).collect())


def test_toxicity_of_beginnings_shared_with_ordinary_words():
    """Every ending is a word of its own, so no longer beginning tells; one such word is ordinary, two in a sentence are toxic."""
    rng = random.Random(5)
    ending = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvw") for _ in range(4))

    def text(stems):
        lines = [rng.choices(VOCAB, k=12) for _ in range(5)]
        line = rng.choice(lines)
        line[1 : 2 * len(stems) : 2] = [s + ending() for s in stems]
        return ". ".join(" ".join(x) for x in lines)

    def corpus(n):
        return [text(["achlich", "achlich"]) if k % 4 == 0 else text(["achlich"] if k % 4 == 1 else []) for k in range(n)], [int(k % 4 == 0) for k in range(n)]

    model = toxicity.fit(*corpus(800))
    texts, labels = corpus(200)
    got = model.scores(*C.utf8(pa.array(texts, pa.large_string()))) >= 0.5
    assert (got == np.array(labels)).mean() >= 0.97


def test_quality_classifier(spark):
    rows, labels = labelled_corpus(12, ["x"], n=600)
    df = frame(spark, [*rows, None, ""])
    got = by_id(quality_model.score_quality(df, spark.createDataFrame(labels)))
    held = [r for i, r in got.items() if r["held_out"] and i < len(labels)]
    assert sum(r["predicted"] == labels[r["doc_id"]].quality for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[len(rows)]["score"] == got[len(rows) + 1]["score"]
    assert quality_model.keep_good(df, spark.createDataFrame(labels)).columns == df.columns


def test_classifiers_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = frame(spark, ["a b", None])
    assert {r["score"] for r in toxicity.score_toxicity(df, none).collect()} == {0.0} and {r["score"] for r in quality_model.score_quality(df, none).collect()} == {0.5}
    assert toxicity.score_toxicity(empty(spark), none).count() == 0


def test_kernel_against_brute_force():
    from itertools import combinations

    def weights(s):
        out = {}
        for at in combinations(range(len(s)), toxicity.ORDER):
            key = "".join(s[k] for k in at)
            out[key] = out.get(key, 0) + toxicity.DECAY ** (at[-1] - at[0] + 1)
        return out

    pairs = [("^moron", "^moron"), ("^mxoron", "^moron"), ("^abcabc", "^abcab"), ("^xyz", "^moron")]
    for (a, b), got in zip(pairs, toxicity.kernel([a for a, _ in pairs], [b for _, b in pairs]), strict=True):
        x, y = weights(a), weights(b)
        assert got == pytest.approx(sum(v * y.get(k, 0) for k, v in x.items()), rel=1e-4)


# ---- 9 HTML


def test_html_hidden_only_by_its_own_attributes():
    shown = ['<a href="/hidden-gems">', '<a href=/hidden>', '<p class="overflow-hidden">', "<p title='the hidden valley'>", '<p aria-hidden="false">', '<p data-hidden="x">', '<p title="display:none">', '<p data-x="aria-hidden=true">']
    gone = ["<p hidden>", '<p HIDDEN="">', "<p class=a hidden=hidden>", '<p aria-hidden="true">', "<p aria-hidden = true>", '<p style="color:red; display : none">', "<p style=display:none>", "<p style='display:none!important'>"]
    assert [[t for t, _ in boilerplate.blocks(f"<article>{tag}words")] for tag in shown] == [["words"]] * len(shown)
    assert [boilerplate.blocks(f"<article>{tag}words") for tag in gone] == [[]] * len(gone)


def test_html(spark):
    page = "<html><head><title>T</title><script>var a='<p>';</script></head><body><nav><a>Home</a></nav><div class='ad'>buy</div><article><h1>Head &amp; <b>bold</b></h1><p>one\n two<p>three<br>four<div class='comments'>bad</div><aside>no</aside></article><footer>&copy; x</footer></body></html>"
    menu = "<div>Home About Contact Us Now Today Here There</div>"
    rows = [(1, "http://a.test/1", page), (2, "http://b.test/1", menu + "<p>only here</p>"), (3, "http://b.test/2", menu + "<p>other words</p><form>f</form>"), (4, None, None), (5, "http://a.test/2", "")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in boilerplate.extract(df).collect()}
    assert got[1]["text"] == "Head & bold one two three four" and got[1]["n_chars"] == 30
    assert (got[2]["text"], got[3]["text"], got[4]["text"], got[5]["text"]) == ("only here", "other words", "", "")
    assert boilerplate.extract(df.limit(0)).count() == 0


def test_ranks_against_brute_force():
    rng = random.Random(13)
    streams = [[rng.choice("abc") for _ in range(rng.randrange(1, 25))] for _ in range(8)]
    tokens = np.array([ord(x) for s in streams for x in s])
    stream = np.repeat(np.arange(len(streams)), [len(s) for s in streams])
    for length in (1, 2, 3, 5, 8):
        starts = [tuple(s[k : k + length]) for s in streams for k in range(len(s))]
        got = boilerplate.ranks(tokens, stream, length).tolist()
        assert all((x == y) == (i == j) for x, i in zip(starts, got, strict=True) for y, j in zip(starts, got, strict=True))


def prose_page(rng, *, before="", notice="", after="", body=None):
    body = body or "".join(f"<p>{' '.join(rng.choices(VOCAB, k=40))}</p>" for _ in range(3))
    return f"<html><body>{before}<article><h1>{' '.join(rng.choices(VOCAB, k=6))}</h1>{body}{notice}</article>{after}</body></html>", body


def words_of(html):
    return " ".join(re.sub("<[^>]*>", " ", html).split())


@pytest.mark.parametrize("group", [512, 2, 1])
def test_html_repeats_decide(spark, group):
    """Where tags alone fail: a notice inside every article, a repeated and a unique paragraph beside it; the same for any size of groups."""
    rng = random.Random(31)
    notice, promo = "<p>Sign up today and get every story in your box</p>", " ".join(rng.choices(VOCAB, k=30))
    rows, want = [], {}
    for k in range(12):
        own = " ".join(rng.choices(VOCAB, k=30))
        html, body = prose_page(rng, notice=notice, after=f"<div>{promo if k in (3, 8) else own}</div>")
        title = re.search("<h1>(.*?)</h1>", html)[1]
        want[k] = " ".join([title, words_of(body), *([own] if k not in (3, 8) else [])])
        rows.append((k, "http://a.test/x", html))
    copied = "".join(f"<p>{' '.join(rng.choices(VOCAB, k=10))}</p>" for _ in range(4))
    for k in range(20, 28):  # copies of one article of short paragraphs under other titles
        html, body = prose_page(rng, body=copied)
        want[k] = re.search("<h1>(.*?)</h1>", html)[1] + " " + words_of(body)
        rows.append((k, "http://b.test/y", html))
    html, body = prose_page(rng, before="<div>One unique menu of words that stands alone</div>")
    want[40] = words_of(html.split("</div>")[1])
    rows += [(40, "http://c.test/z", html)] * 3  # repeated rows are one page
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = boilerplate.extract(df, group=group).collect()
    assert len(got) == len(rows) and {r["page_id"]: r["text"] for r in got} == want


def test_html_broken_and_long():
    import time

    began = time.perf_counter()
    for bad in ("<a " * 350_000, "<a href='x " * 100_000, "<div>" * 200_000 + "</p>" * 200_000, "<" * 1_000_000, "<!--" * 250_000, "x " * 500_000):
        boilerplate.blocks("<article>kept</article>" + bad)
    assert time.perf_counter() - began < 60
    assert boilerplate.blocks("<article><p title=it's>Hello 1 < 2 &lt;b&gt;<p a=\"x>y\" b='>'>there") == [("Hello 1 < 2 <b>", 0), ("there", 0)]


EDGES = T.StructType([T.StructField("doc_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("text", "words", "lines", "keys", "n_words", "text_a", "block", "salt", "score"))])


def awkward(spark):
    """Nulls in any column, empty and long texts, repeated rows, ties, and columns that clash with inner names."""
    base = prose(random.Random(51), 60)
    texts = [(1, base), (1, base), (2, base), (None, "alone words"), (None, None), (3, None), (4, ""), (5, "z" * 20_000), (6, prose(random.Random(52), 3_000)), (7, "\n \t")]
    return spark.createDataFrame([(i, t, *["x"] * 8) for i, t in texts], EDGES)


def test_awkward_rows(spark):
    df, n = awkward(spark), 10
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (6, 1, 1)], "doc_id long, quality int, toxic int")
    rows = quality_rules.apply_rules(df).collect()
    assert len(rows) == n and sum(r["doc_id"] is None for r in rows) == 2 and [r["n_words"] for r in rows if r["doc_id"] == 1] == [60, 60]
    rows = jaccard.similarity_groups(df).collect()
    assert len(rows) == n and {r["component_id"] for r in rows if r["doc_id"] in (1, 2)} == {1} and {r["component_id"] for r in rows if r["doc_id"] is None} == {None}
    assert media.media_columns(df).where("doc_id is null").count() == 2 and media.media_columns(df).count() == n
    assert rlz.dedup_substrings(df).count() == n and spm.digests(df, P.path("piece_bpe_32k.model")).count() == n
    for scores in (toxicity.score_toxicity(df, labels), quality_model.score_quality(df, labels)):
        assert all(0 <= r["score"] <= 1 for r in scores.collect()) and scores.count() == n
    one = labels.where("doc_id = 1")
    assert quality_model.score_quality(df, one).count() == n and toxicity.score_toxicity(df.limit(0), one).count() == 0


def test_a_token_that_very_many_share(spark):
    """Sets that share their rarest tokens without being linked, beside a class of copies."""
    passage = prose(random.Random(61), 24)
    texts = [f"{passage} {prose(random.Random(k), 9)}" for k in range(100, 160)] + [passage] * 40
    got = by_id(jaccard.similarity_groups(frame(spark, texts), 3, 90))
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == groups_of(texts, 3, 90)


def test_pipeline_of_awkward_rows(spark, tmp_path):
    import corpus_pipeline

    rows = [(i, t, "en", None, None, "clash") for i, t in [(1, prose(random.Random(71), 80)), (1, "a b"), (2, None), (3, ""), (None, "c d"), (4, prose(random.Random(71), 80)), (5, "y" * 3000)]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string"
    for name, found in (("some", rows), ("none", [])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(found, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        packed = corpus_pipeline.run(spark, folder).collect()
        assert all(r["length"] >= 1 for r in packed) and (bool(packed) or name == "none")


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_duplicates", "substrings", "packing"]
    sf, docs = "/root/testdata/sf0.001", None
    docs = C.table(spark, sf, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = C.materialize(stage(spark, docs, sf), name)
        assert docs.columns == columns and {r["doc_id"] for r in docs.select("doc_id").collect()} <= before
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).select(F.count_distinct("doc_id")).first()[0] == docs.count()
