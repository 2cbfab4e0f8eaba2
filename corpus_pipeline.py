"""From raw documents to packed training sequences, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; its result is
written as Parquet to the shared folder and read again as the next one's docs.  All but the last
return the columns of documents.

Defined cases: an empty table gives no rows; a null text counts as empty in every stage; rows that
share a doc_id are judged each by itself by the models and stay or go together as near duplicates; a
null doc_id is never a duplicate; further columns are carried through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphloom.llm import common as C


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    from graphloom.llm.toxicity import drop_toxic

    return drop_toxic(docs, C.table(spark, sf_dir, "labels"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    from graphloom.llm.quality_model import keep_good

    return keep_good(docs, C.table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8) stays."""
    from graphloom.llm.jaccard import one_of_each_group

    return one_of_each_group(docs, k=5, percent=80)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 20 words or more that stand earlier in the corpus are cut out of the texts."""
    from graphloom.llm.rlz import remove_repeats

    return remove_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents left, packed into sequences of 1024 ids."""
    import public_tokenizers

    from graphloom.llm.packing import pack

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), end=0)


STAGES = [("toxicity", toxicity), ("quality", quality), ("near_duplicates", near_duplicates), ("substrings", substrings), ("packing", packing)]

#: SQL cannot express the models, the tokenizer and the linear program.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents."""
    docs = C.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = C.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
