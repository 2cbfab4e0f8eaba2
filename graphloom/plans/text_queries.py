"""Queries over texts and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import scalar
from graphloom.operators import search
from graphloom.plans import projections as P
from graphloom.plans.registry import query
from graphloom.sources import files, text


@query("SELECT page_id, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref\\s*=\\s*\"([^\"]*)\"', 1)) AS href FROM pages")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.page_links(P.table(spark, sf_dir, "pages"))


@query("SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url END AS canonical, CASE WHEN page_id % 3 = 0 THEN 'noindex' END AS robots FROM pages")
def page_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages get a canonical link and a robots rule by number, in either order of attributes."""
    p = P.table(spark, sf_dir, "pages")
    link = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit('<link rel="canonical" href="'), "url", F.lit('">'))).when(F.col("page_id") % 2 == 0, F.concat(F.lit('<LINK href="'), "url", F.lit('" rel=canonical>'))).otherwise("")
    meta = F.when(F.col("page_id") % 3 == 0, "<meta content='noindex' name='robots'>").otherwise("")
    return text.page_rules(p.withColumn("html", F.concat("html", link, meta)))


@query("""SELECT page_id, (CASE WHEN regexp_matches(lower(url), '\\.(min|bundle|pack)\\.(js|ts|css)$') OR strlen(html) > 1500000 THEN TRUE ELSE len(list_filter(string_split(substr(html, 1, 8192), chr(10)), lambda x: length(x) > 5000)) > 0 END) AS generated FROM pages""")
def generated_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.table(spark, sf_dir, "pages")
    return p.select("page_id", files.is_generated(F.col("url"), F.col("html"), F.octet_length("html")).alias("generated"))


@query("""WITH c AS (SELECT item_id, unnest(string_split(text, '')) AS ch FROM benchmark), f AS (SELECT item_id, ch, count(*) AS n FROM c GROUP BY ALL), t AS (SELECT item_id, sum(n) AS total FROM f GROUP BY 1)
SELECT item_id, round(sum(-(n / total) * log2(n / total)), 4) AS bits FROM f JOIN t USING (item_id) GROUP BY item_id""")
def text_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "benchmark").select("item_id", F.round(scalar.entropy(F.col("text")), 4).alias("bits"))


@query("SELECT doc_id, ceil(length(text) / 4.0)::BIGINT AS tokens FROM documents")
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.table(spark, sf_dir, "documents").select("doc_id", search.token_estimate(F.col("text")).alias("tokens"))


@query("""WITH ids AS (SELECT DISTINCT 'Shop' || c_mktsegment || '::c' || c_custkey AS id FROM customer WHERE c_custkey % 2 = 0), refs AS (SELECT DISTINCT o_custkey AS text_id, 'Shop' || c_mktsegment || '::c' || c_custkey AS ref FROM orders JOIN customer ON c_custkey = o_custkey)
SELECT text_id, ref, ref IN (FROM ids) AS known FROM refs""")
def grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = P.table(spark, sf_dir, "customer").withColumn("id", F.concat(F.lit("Shop"), "c_mktsegment", F.lit("::c"), F.col("c_custkey").cast("string")))
    o = P.table(spark, sf_dir, "orders").select("o_custkey").distinct().join(c, F.col("o_custkey") == F.col("c_custkey"))
    texts = o.select(F.col("o_custkey").alias("text_id"), F.concat(F.lit("see "), "id", F.lit("(), again "), "id", F.lit(" and no::")).alias("text"))
    return search.grounding(texts, c.where("c_custkey % 2 = 0").select("id"))
