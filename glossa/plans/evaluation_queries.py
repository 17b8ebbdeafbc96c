"""Scores, percentiles and gates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import evaluate as e
from glossa.plans.registry import query
from glossa.session import table

GUESS = "(NOT contains(text, ' | ') AND NOT contains(text, '%%%') AND NOT contains(text, '!! '))"
COUNTS = "count_if(e AND o) AS tp, count_if(NOT e AND o) AS fp, count_if(e AND NOT o) AS fn, count_if(NOT e AND NOT o) AS tn"
SCORES = "round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1"
JUDGED = f"SELECT lang, quality = 1 AS e, {GUESS} AS o FROM documents JOIN labels USING (doc_id)"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    guess = ~text.contains(" | ") & ~text.contains("%%%") & ~text.contains("!! ")
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", guess.alias("o"))
    return docs.join(table(spark, sf_dir, "labels"), "doc_id").withColumn("e", F.col("quality") == 1)


@query(f"SELECT lang, tp, fp, fn, tn, {SCORES} FROM (SELECT lang, {COUNTS} FROM ({JUDGED}) GROUP BY GROUPING SETS ((lang), ()))")
def accuracy_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plain rule against the labels, by language and over all."""
    return e.prf(judged(spark, sf_dir), F.col("e"), F.col("o"), "lang")


@query(f"""
WITH m AS (SELECT lang, tp, fp, fn, tn, {SCORES} FROM (SELECT lang, {COUNTS} FROM ({JUDGED}) GROUP BY GROUPING SETS ((lang), ())))
SELECT lang, CASE WHEN precision < 0.9 OR recall < 0.97 THEN 'fail' WHEN precision IS NULL OR recall IS NULL THEN 'insufficient' ELSE 'pass' END AS status,
  array_to_string(list_sort(list_filter([CASE WHEN precision < 0.9 THEN 'precision below 0.9' END, CASE WHEN recall < 0.97 THEN 'recall below 0.97' END,
  CASE WHEN precision IS NULL THEN 'precision not measured' END, CASE WHEN recall IS NULL THEN 'recall not measured' END], lambda x: x IS NOT NULL)), '; ') AS reasons FROM m
""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.gate(e.prf(judged(spark, sf_dir), F.col("e"), F.col("o"), "lang"), {"precision": 0.9, "recall": 0.97}).select("lang", "status", "reasons")


@query("SELECT event_type, count(value) AS n, round(sum(value::DOUBLE), 4) AS total, round(quantile_cont(value::DOUBLE, 0.5), 6) AS median, round(quantile_cont(value::DOUBLE, 0.95), 6) AS p95 FROM events GROUP BY 1")
def stage_percentiles_cont(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.stage_metrics(table(spark, sf_dir, "events"), "value", "event_type")


@query("SELECT event_type, count(value) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def stage_percentiles_disc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return e.nearest_rank(table(spark, sf_dir, "events"), "value", "event_type")


@query("""
WITH m AS (SELECT event_type, avg(CASE WHEN user_id % 2 = 0 THEN value END) AS before, avg(CASE WHEN user_id % 2 = 1 THEN value END) AS after FROM events GROUP BY 1)
SELECT event_type, round(before, 6) AS before, round(after, 6) AS after, round(after - before, 4) AS delta, round(100.0 * (after - before) / nullif(before, 0), 4) AS percent FROM m
""")
def mode_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean values of two halves of the users as before and after."""
    ev = table(spark, sf_dir, "events")
    before = ev.where("user_id % 2 = 0").groupBy("event_type").agg(F.avg("value").alias("v"))
    after = ev.where("user_id % 2 = 1").groupBy("event_type").agg(F.avg("value").alias("v"))
    out = e.deltas(before, after, "event_type", "v")
    return out.select("event_type", *[F.round(x, 6).alias(x) for x in ("before", "after")], *[F.round(x, 4).alias(x) for x in ("delta", "percent")])


@query("""
SELECT p_brand, p_type, coalesce(n, 0) AS n FROM (SELECT DISTINCT p_brand FROM part) CROSS JOIN (SELECT DISTINCT p_type FROM part)
LEFT JOIN (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2) USING (p_brand, p_type) WHERE coalesce(n, 0) <> 1
""")
def matrix_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the brand and container matrix that don't hold exactly one part."""
    return e.missing_cells(table(spark, sf_dir, "part"), "p_brand", "p_type")


@query("""
WITH a AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn FROM documents WHERE doc_id % 2 = 0),
b AS (SELECT source, lang, doc_id, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS rn FROM documents WHERE doc_id % 2 = 1)
SELECT coalesce(a.source, b.source) AS source, coalesce(a.lang, b.lang) AS lang, count(a.doc_id) AS expected, count(b.doc_id) AS observed, count_if(a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL) AS matched
FROM a FULL OUTER JOIN b ON a.source = b.source AND a.lang = b.lang AND a.rn = b.rn GROUP BY 1, 2
""")
def finding_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one matches of equal keys between two sets of findings, counted by key."""
    docs = table(spark, sf_dir, "documents").select("source", "lang", "doc_id")
    met = e.match(docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1"), ["source", "lang"], "doc_id")
    both = F.col("expected").isNotNull() & F.col("observed").isNotNull()
    return met.groupBy("source", "lang").agg(F.count("expected").alias("expected"), F.count("observed").alias("observed"), F.count_if(both).alias("matched"))


@query("""
SELECT event_type, count(*) AS n, count_if(value > 50) AS high, min(value) AS least, max(value) AS most, count(DISTINCT user_id) AS users FROM events GROUP BY 1
""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional counts of a run by kind of event."""
    return table(spark, sf_dir, "events").groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("high"), F.min("value").alias("least"), F.max("value").alias("most"), F.count_distinct("user_id").alias("users")
    )


@query("""
WITH r AS (SELECT l_returnflag AS flag, l_linestatus AS status, l_linenumber::VARCHAR AS line, l_discount > 0.05 AS e, l_tax > 0.04 AS o FROM lineitem),
u AS (SELECT 'flag' AS key, flag AS value, e, o FROM r UNION ALL SELECT 'status', status, e, o FROM r UNION ALL SELECT 'line', line, e, o FROM r UNION ALL SELECT NULL, NULL, e, o FROM r),
c AS (SELECT key, value, count_if(e AND o) AS tp, count_if(NOT e AND o) AS fp, count_if(e AND NOT o) AS fn FROM u GROUP BY 1, 2)
SELECT *, round(tp::DOUBLE / nullif(tp + fp, 0), 6) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS recall, round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 6) AS f1 FROM c
""")
def occurrence_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall by each of several groupings at once, and over all."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.col("l_linenumber").alias("line"), "l_discount", "l_tax")
    return e.prf_each(rows, F.col("l_discount") > 0.05, F.col("l_tax") > 0.04, "flag", "status", "line")


@query("""
WITH s AS (SELECT event_type, count(*) AS n, count_if(value < 20) AS failures, sum(value::DOUBLE) AS t, quantile_disc(value, 0.5)::DOUBLE AS p50, quantile_disc(value, 0.95)::DOUBLE AS p95 FROM events GROUP BY 1), b AS (SELECT t AS bt, p95 AS bp FROM s WHERE event_type = 'view')
SELECT event_type, n, failures, round(t, 4) AS total, p50, p95, round(100.0 * (t - bt) / bt, 4) AS total_percent, round(100.0 * (p95 - bp) / bp, 4) AS p95_percent FROM s, b
""")
def mode_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of events as modes: sums, percentiles and how far they lie from one of them."""
    return e.compare_modes(table(spark, sf_dir, "events"), "event_type", "value", F.col("value") < 20, "view")


STATUS = "CASE left(o_orderpriority, 1) WHEN '1' THEN 'in_force' WHEN '2' THEN 'in_force' WHEN '3' THEN 'not_in_force' ELSE 'unknown' END"


@query(f"""
WITH x AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'found' ELSE 'verified' END AS authority, CASE WHEN o_totalprice > 200000 THEN NULL ELSE o_totalprice > 60000 END AS actionable, {STATUS} AS status FROM orders)
SELECT o_orderkey, authority = 'verified' AND coalesce(actionable, false) AS usable, authority = 'verified' AND coalesce(actionable, false) AND status = 'in_force' AS verified_match FROM x
""")
def evidence_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which entries (orders) may be compared with, and which of them are in force."""
    from glossa.operators import serving as v

    authority = F.when(F.col("o_custkey") % 3 == 0, "found").otherwise("verified")
    actionable = F.when(F.col("o_totalprice") <= 200000, F.col("o_totalprice") > 60000)
    status = F.expr(STATUS)
    return table(spark, sf_dir, "orders").select("o_orderkey", v.usable(authority, actionable).alias("usable"), v.verified_match(authority, actionable, status).alias("verified_match"))


@query("SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey::VARCHAR) AS place FROM orders")
def document_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (orders) of an owner in their order: by creation, then by id as text."""
    from glossa.operators import structure

    return structure.document_order(table(spark, sf_dir, "orders"), "o_custkey", "o_orderdate", "o_orderkey").select("o_orderkey", "o_custkey", "place")
