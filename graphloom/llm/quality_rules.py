"""Quality rules: a threshold table compiled into one Spark projection.

A rule bounds a ratio of two counts of the text, in hundredths: low * den <= 100 * num <= high * den,
in whole numbers, so no rounding decides.  The counts are built-in Spark functions; nothing runs in
Python and nothing is shuffled.  A document is kept if the base checks and every rule pass.

Defined cases: a null or empty text has no words and fails the base check; a rule whose
denominator is 0 passes; rows are judged one by one, so repeated rows get equal results; other
columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Common words of the four languages, as they stand in texts.
STOP_WORDS = tuple(
    "the be to of and that have with in is for a on it as was this by are from at an or "
    "der die und das ist von mit zu den des sich für ein eine auf als nicht auch im dem "
    "le la les de et un une est que qui dans en du pour pas sur par au il elle "
    "el los las y una es por con para del se no al lo su".split()
)


class Rule(NamedTuple):
    """low and high are hundredths of numerator / denominator; None: no bound."""

    name: str
    numerator: str
    denominator: str
    low: int | None
    high: int | None


RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 200, 1200),
    Rule("symbols_per_word", "n_symbols", "n_words", None, 10),
    Rule("stop_words_per_word", "n_stop_words", "n_words", 6, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 50),
    Rule("shouts_per_word", "n_shouts", "n_words", None, 10),
)

#: Base check: at least so many words, and at most so many hundredths of them in repeated 3-word windows.
LEAST_WORDS, MOST_REPEATED = 50, 50

_SPACE = r"[\x20\x09-\x0D]+"


def _repeat_words(words: str, keys: str) -> Column:
    """Words in 3-word windows found twice or more: sort (window, position), keep equal neighbours, add up what they cover."""
    pairs = F.array_sort(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        def twice(e: Column, i: Column) -> Column:
            return F.coalesce((i > 0) & (F.get(s, i - 1)["h"] == e["h"]), F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == e["h"], F.lit(False))

        at = F.array_sort(F.transform(F.filter(s, twice), lambda e: e["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        step = lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"), x.alias("last"))
        return F.aggregate(at, start, step, lambda acc: acc["n"].cast("long"))

    # transform over a one-element array binds the sorted pairs once.
    full = F.get(F.transform(F.array(pairs), repeated), 0)
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0).cast("long")).otherwise(full)


def counts(docs: DataFrame) -> DataFrame:
    """doc_id and every count that the base check and the rules use."""
    text = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    words = text.select(
        "doc_id", "text",
        F.array_remove(F.split("text", _SPACE), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    at = lambda k: F.get("words", k)
    windows = F.when(F.size("words") >= 3, F.transform(F.sequence(F.lit(0), F.size("words") - 3), lambda i: F.xxhash64(at(i), at(i + 1), at(i + 2)))).otherwise(F.array().cast("array<bigint>"))
    keyed = words.select("*", windows.alias("keys"))
    return keyed.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.size(F.split("text", "[#*$%&|<>]")) - 1).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words("words", "keys").alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: w.isin(*STOP_WORDS))).cast("long").alias("n_stop_words"),
        (F.size(F.split("text", "!")) - 1).cast("long").alias("n_shouts"),
    )


def passes(rule: Rule) -> Column:
    num, den = F.col(rule.numerator) * 100, F.col(rule.denominator)
    ok = F.lit(True)
    if rule.low is not None:
        ok = ok & (num >= den * rule.low)
    if rule.high is not None:
        ok = ok & (num <= den * rule.high)
    return (den == 0) | ok


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: counts, base_failed, kept, and the first rule that fails (null: none)."""
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)
    verdict = F.lit(True)
    for rule in rules:
        verdict = verdict & passes(rule)
    first = F.coalesce(*(F.when(~passes(r), F.lit(r.name)) for r in rules)) if rules else F.lit(None).cast("string")
    return counts(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & verdict).alias("kept"), first.alias("failed_rule"),
    )


def oracle(rules: tuple[Rule, ...] = RULES) -> str:
    """The same rows in DuckDB SQL."""

    def test(r: Rule) -> str:
        bounds = [f"100 * {r.numerator} >= {r.low} * {r.denominator}"] * (r.low is not None) + [f"100 * {r.numerator} <= {r.high} * {r.denominator}"] * (r.high is not None)
        return f"({r.denominator} = 0 OR ({' AND '.join(bounds) or 'TRUE'}))"

    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    case = " ".join(f"WHEN NOT {test(r)} THEN '{r.name}'" for r in rules)
    return f"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM t),
w AS (SELECT r, unnest(words) AS w, unnest(range(len(words))) AS i FROM s),
g AS (SELECT r, i, w || ' ' || lead(w, 1) OVER q || ' ' || lead(w, 2) OVER q AS k FROM w WINDOW q AS (PARTITION BY r ORDER BY i)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM g WHERE k IS NOT NULL) WHERE c > 1),
c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM d) GROUP BY r),
f AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
  len(list_filter(words, lambda x: x IN ({stop})))::BIGINT AS n_stop_words, (length(text) - length(replace(text, '!', '')))::BIGINT AS n_shouts
  FROM s LEFT JOIN c USING (r)),
b AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND {' AND '.join(map(test, rules)) or 'TRUE'} AS kept, CASE {case} END AS failed_rule FROM b"""
