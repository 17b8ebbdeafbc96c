"""Candidate, definition and reference queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as t
from glossa.operators import candidates as c
from glossa.operators import definitions as d
from glossa.plans.registry import query
from glossa.plans.retrieval_queries import norm, toks
from glossa.session import table


@query("""
WITH r AS (SELECT doc_id % 50 AS doc_id, source AS section, lang AS label, doc_id AS ref FROM documents WHERE doc_id % 3 = 1), g AS (SELECT doc_id % 50 AS doc_id, source AS section, lang AS label FROM documents WHERE doc_id % 3 = 0),
o AS (SELECT doc_id, section, label, count(*) AS n_own FROM g GROUP BY ALL), a AS (SELECT doc_id, label, count(*) AS n_all FROM g GROUP BY ALL)
SELECT ref, CASE coalesce(n_own, n_all, 0) WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' ELSE 'ambiguous' END AS verdict FROM r LEFT JOIN o USING (doc_id, section, label) LEFT JOIN a USING (doc_id, label)
""")
def internal_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References resolved in their own section first, then in the whole document."""
    docs = table(spark, sf_dir, "documents")
    named = docs.select((F.col("doc_id") % 50).alias("doc_id"), F.col("source").alias("section"), F.col("lang").alias("label"), F.col("doc_id").alias("ref"))
    return c.references(named.where("ref % 3 = 1"), named.where("ref % 3 = 0").drop("ref")).select("ref", "verdict")


@query("""
SELECT p_brand AS segment_id, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size % 4 DESC, p_size > 25 DESC, p_size % 2 = 0 DESC, p_size % 7 DESC, CASE WHEN p_size % 5 > 0 THEN p_retailprice END DESC NULLS LAST,
  p_size % 3, p_size, p_partkey, lpad(p_partkey::VARCHAR, 9, '0')) AS rank FROM part
""")
def suggestion_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine-key order of candidates; parts stand for candidates of their brand."""
    size = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("segment_id"), "p_partkey", (size % 4).alias("tier"), (size > 25).alias("direct"), (size % 2 == 0).alias("anchored"), (size % 7).alias("shared_tokens"),
        F.when(size % 5 > 0, F.col("p_retailprice")).alias("score_delta"), (size % 3).alias("priority"), F.col("p_partkey").alias("start"), (F.col("p_partkey") + size).alias("end"),
        F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("rule_id"), F.col("p_name").alias("replacement"),
    )
    return c.ranked(rows).select("segment_id", "p_partkey", "rank")


@query("SELECT conv_id, greatest(count(*) - 3, 0) AS overflow FROM conversations GROUP BY 1")
def cap_overflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many turns a cap of three a conversation leaves out."""
    return c.capped(table(spark, sf_dir, "conversations"), "conv_id", 3, F.col("turn"))[1]


@query(f"SELECT {norm("c_name")} AS alias, min(term) AS term FROM (SELECT p_name || ' ' || p_size AS c_name, p_brand AS term FROM part) GROUP BY 1 HAVING count(DISTINCT term) = 1")
def unambiguous_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's name and size as an alias of its brand, where they stand for one brand only."""
    return d.ambiguous_free(table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_size").alias("alias"), F.col("p_brand").alias("term")))


@query("SELECT count(*) AS documents, count(DISTINCT lang) AS languages, list_sort(list(DISTINCT source)) AS sources FROM documents")
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.agg(F.count("*").alias("documents"), F.count_distinct("lang").alias("languages"), F.array_sort(F.collect_set("source")).alias("sources"))


@query()
def definition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every document and definition (benchmark item): the shortest window of 6 to 80 tokens that covers 70 % of the definition."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), t.tokens(F.col("text")).alias("ws"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("definition_id"), F.array_distinct(t.tokens(F.col("text"))).alias("wanted"))
    return c.covered_definitions(docs, items)


@query("""
WITH s AS (SELECT doc_id AS segment_id, strip_accents(lower(text)) AS x FROM documents),
r AS (SELECT * FROM (VALUES ('license', 'licence', ''), ('token', 'key', 'no tokens'), ('on', 'at', 'zzz')) AS r(literal, replacement, exception))
SELECT segment_id, literal AS rule_id, len(string_split(x, literal)) - 1 AS found FROM s JOIN r ON contains(x, literal) WHERE exception = '' OR NOT contains(x, exception)
""")
def rule_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of three rules' literals, of which two have exceptions."""
    segments = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("segment_id"), "text")
    rows = [("license", "license", "licence", True, []), ("token", "token", "key", True, ["no tokens"]), ("on", "on", "at", True, ["zzz"]), ("off", "the", "a", False, [])]
    rules = spark.createDataFrame(rows, "rule_id string, literal string, replacement string, active boolean, exceptions array<string>")
    return c.rule_suggestions(segments, rules).groupBy("segment_id", "rule_id").agg(F.count("*").alias("found"))
