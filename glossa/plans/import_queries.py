"""Import, refreshed findings, fixtures and gates over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import evaluate, fixtures, incremental, review
from glossa.operators import structure as s
from glossa.plans.document_queries import PARAS
from glossa.plans.registry import query
from glossa.session import Scratch, table

CONTENT = "sha256(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '[ \\t]+(\\n|$)', '\\1', 'g'), '^\\s+|\\s+$', '', 'g'))"


@query(f"""
WITH d AS (SELECT doc_id, n_chars AS created, sha256(coalesce(text, '')) AS file, {CONTENT} AS content FROM (SELECT doc_id, n_chars, CASE WHEN doc_id % 3 = 0 THEN text || ' ' ELSE text END AS text FROM documents)),
f AS (SELECT *, first_value(doc_id) OVER w AS fid, first_value(file) OVER w AS ffile FROM d WINDOW w AS (PARTITION BY content ORDER BY created, doc_id))
SELECT doc_id, CASE WHEN doc_id = fid THEN 'keep' WHEN file = ffile THEN 'file-duplicate' ELSE 'content-duplicate' END AS action, CASE WHEN doc_id <> fid THEN fid END AS of FROM f
""")
def import_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents an import keeps, and which repeat the bytes or the content of an earlier one; every third one has a blank more at its end."""
    docs = table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text")))
    return incremental.import_duplicates(docs, "doc_id", "text", "n_chars")


@query(f"""
WITH {PARAS.replace("FROM documents", "FROM edited")}, g AS (SELECT doc_id, start, regexp_split_to_array(text, '\\d+') AS gaps, regexp_extract_all(text, '\\d+') AS nums FROM paras)
SELECT doc_id, (start + list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(nums[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start, nums[i] AS original FROM g, unnest(range(1, len(nums) + 1)) AS u(i)
""".replace("WITH ", "WITH edited AS (SELECT doc_id, 'Version 2' || chr(10) || replace(text, ' the ', ' a ') AS text FROM documents), ", 1))
def refreshed_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of documents after an edit: old findings at new places, and fresh ones where paragraphs changed. The SQL finds all afresh."""
    scratch = Scratch(spark, "refresh")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    edited = docs.withColumn("text", F.concat(F.lit("Version 2\n"), F.replace(F.col("text"), F.lit(" the "), F.lit(" a "))))

    def segments(rows: DataFrame, name: str) -> DataFrame:
        p = s.paragraphs(rows, "doc_id", "text")
        return scratch.cut(p.select((F.col("doc_id") * 1_000_000 + F.col("pos")).alias("segment_id"), "doc_id", "start", "text", F.unhex(F.sha2("text", 256)).alias("digest")), name)

    def find(rows: DataFrame) -> DataFrame:
        return review.matches(rows, "segment_id", "text", r"[0-9]+").select(F.col("doc_id").alias("segment_id"), "start", "end", F.col("value").alias("original"))

    old, new = segments(docs, "old"), segments(edited, "new")
    results = scratch.cut(find(old), "results")
    found = incremental.refresh(old, new, results, find, ["doc_id", "digest"], scratch)
    return found.select(F.expr("segment_id div 1000000").alias("doc_id"), "start", "original")


KINDS = "CASE o_orderkey % 3 WHEN 0 THEN 'suggestion' WHEN 1 THEN 'preserve' ELSE 'none' END"
SAID = "CASE WHEN l_returnflag = 'N' THEN 'no-suggestion' WHEN l_discount > 0.07 THEN 'needs-review' ELSE 'suggestion' END"
NAMES = "CASE WHEN l_quantity < 25 THEN 'Borrower dan Lender' ELSE 'Borrower' END"
AFTER = f"CASE WHEN {SAID} <> 'suggestion' THEN NULL WHEN l_linestatus = 'O' THEN {NAMES} || ' sah' ELSE 'Lender' END"


@query(f"""
WITH s AS (SELECT o_orderkey AS fixture_id, {KINDS} AS kind, 'Borrower dan Lender' AS original, 'Borrower dan Lender sah' AS replacement, CASE WHEN o_orderstatus = 'F' THEN 'A' ELSE 'R' END AS category FROM orders),
r AS (SELECT l_orderkey AS fixture_id, l_linenumber * 100000 + l_suppkey * 100 + l_quantity::INT AS seq, {SAID} AS status, l_returnflag AS category, {NAMES} AS original, {AFTER} AS replacement FROM lineitem),
a AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY fixture_id ORDER BY status <> 'suggestion', seq, status, category, original, replacement NULLS FIRST) = 1),
g AS (SELECT fixture_id, bool_and(status <> 'suggestion' OR (contains(original, 'Lender') AND contains(replacement, 'Borrower') AND contains(replacement, 'Lender'))) AS preserved, bool_and(status <> 'suggestion') AS safe FROM r GROUP BY 1)
SELECT s.fixture_id, kind, a.status AS actual_status, a.original AS actual_original, a.replacement AS actual_replacement,
  coalesce(CASE kind WHEN 'suggestion' THEN a.status = 'suggestion' AND a.category = s.category AND a.original = s.original AND a.replacement = s.replacement WHEN 'preserve' THEN preserved ELSE safe END, false) AS passed
FROM s LEFT JOIN a USING (fixture_id) LEFT JOIN g USING (fixture_id)
""")
def fixture_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as fixtures of three kinds, their lines as reviews."""
    samples = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("fixture_id"), F.expr(KINDS).alias("kind"), F.lit("Borrower dan Lender").alias("original"), F.lit("Borrower dan Lender sah").alias("replacement"), F.when(F.col("o_orderstatus") == "F", "A").otherwise("R").alias("category")
    )
    seq = F.col("l_linenumber") * 100000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("int")
    reviews = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("fixture_id"), seq.alias("seq"), F.expr(SAID).alias("status"), F.col("l_returnflag").alias("category"), F.expr(NAMES).alias("original"), F.expr(AFTER).alias("replacement"))
    return fixtures.evaluate(samples, reviews)


FINDINGS = "l_orderkey AS fixture_id, l_returnflag AS key, CAST(l_linenumber * 100000 + l_suppkey * 100 + l_quantity AS INT) AS seq, l_returnflag AS original, CASE WHEN l_quantity < 49 THEN l_linestatus END AS replacement, {0} AS occurrence, CASE WHEN l_suppkey % 3 > 0 THEN l_suppkey % {1} END AS source"
EXPECTED, OBSERVED = FINDINGS.format("l_linenumber % 2", 3), FINDINGS.format("CAST(l_quantity AS INT) % 2", 2)
FIXTURES = "o_orderkey AS fixture_id, o_orderpriority AS category, o_custkey % 4 = 0 AS no_change, o_orderstatus = 'F' AS hard_negative"
RATIO = "CASE WHEN {1} > 0 THEN round({0}::DOUBLE / {1}, 6) END AS {2}"

METRICS = f"""
f AS (SELECT {FIXTURES} FROM orders), ex AS (SELECT {EXPECTED} FROM lineitem JOIN f ON f.fixture_id = l_orderkey WHERE l_discount < 0.06 AND NOT no_change), ob AS (SELECT {OBSERVED} FROM lineitem WHERE l_tax > 0.04),
en AS (SELECT *, row_number() OVER (PARTITION BY fixture_id, key ORDER BY seq) AS rn FROM ex), bn AS (SELECT *, row_number() OVER (PARTITION BY fixture_id, key ORDER BY seq) AS rn FROM ob),
p AS (SELECT coalesce(en.fixture_id, bn.fixture_id) AS fixture_id, en.rn IS NOT NULL AS had, bn.rn IS NOT NULL AS got, en.occurrence = bn.occurrence AND en.original = bn.original AND en.replacement IS NOT DISTINCT FROM bn.replacement AS exact, en.source AS es, bn.source AS os FROM en FULL JOIN bn ON en.fixture_id = bn.fixture_id AND en.key = bn.key AND en.rn = bn.rn),
x AS (SELECT fixture_id, count_if(had) AS expected, count_if(got) AS observed, count_if(had AND got) AS tp, count_if(had AND got AND exact) AS ex, count_if(had AND got AND es IS NOT NULL) AS sourced, count_if(had AND got AND es = os) AS grounded FROM p GROUP BY 1),
y AS (SELECT f.*, coalesce(expected, 0) AS expected, coalesce(observed, 0) AS observed, coalesce(tp, 0) AS tp, coalesce(ex, 0) AS ex, coalesce(sourced, 0) AS sourced, coalesce(grounded, 0) AS grounded FROM f LEFT JOIN x USING (fixture_id)),
z AS (SELECT category, sum(expected)::BIGINT AS expected, sum(observed)::BIGINT AS observed, sum(tp)::BIGINT AS tp, sum(ex) AS ex, sum(sourced) AS sourced, sum(grounded) AS grounded, count_if(no_change) AS silent, count_if(no_change AND observed = 0) AS stayed,
  count_if(no_change AND hard_negative) AS hard, count_if(no_change AND hard_negative AND observed > 0) AS hard_hit FROM y GROUP BY GROUPING SETS ((category), ())),
m AS (SELECT category, expected, observed, tp, observed - tp AS fp, expected - tp AS fn, {RATIO.format("tp", "observed", "precision")}, {RATIO.format("tp", "expected", "recall")}, CASE WHEN expected + observed > 0 THEN round(2.0::DOUBLE * tp / (expected + observed), 6) END AS f1,
  {RATIO.format("ex", "tp", "exact_span")}, {RATIO.format("stayed", "silent", "no_change_accuracy")}, {RATIO.format("hard_hit", "hard", "hard_negative_fpr")}, {RATIO.format("grounded", "sourced", "grounding")} FROM z)"""


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    cases = orders.selectExpr(*FIXTURES.split(", "))
    expected = lines.where("l_discount < 0.06").join(cases.where("NOT no_change").select(F.col("fixture_id").alias("l_orderkey")), "l_orderkey", "left_semi")

    def finding(rows: DataFrame, text: str) -> DataFrame:
        return rows.select(*map(F.expr, text.split(", ")))

    return fixtures.metrics(cases, finding(expected, EXPECTED), finding(lines.where("l_tax > 0.04"), OBSERVED))


@query(f"WITH {METRICS} SELECT * FROM m")
def quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall, exact spans, silence, hard negatives and grounding by category and in all."""
    rates = ("precision", "recall", "f1", "exact_span", "no_change_accuracy", "hard_negative_fpr", "grounding")
    return quality(spark, sf_dir).withColumns({r: F.round(r, 6) for r in rates})


@query(f"""
WITH {METRICS}, g AS (SELECT coalesce(category, 'all') AS category, CASE WHEN precision < 0.3 OR exact_span < 0.1 THEN 'fail' WHEN precision IS NULL OR exact_span IS NULL THEN 'insufficient' ELSE 'pass' END AS status FROM m),
r AS (SELECT category, CASE WHEN left(category, 1) = '4' THEN 'pass!' ELSE CASE WHEN left(category, 1) = '2' THEN 'fail' ELSE status END END AS said FROM g WHERE left(category, 1) <> '5')
SELECT g.category, CASE WHEN said IS NULL OR said NOT IN ('pass', 'fail', 'insufficient') OR said <> status THEN 2 WHEN said = 'pass' THEN 0 ELSE 1 END AS code FROM g LEFT JOIN r USING (category)
""")
def gate_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exit codes of recorded gate results against what the metrics give; some records are missing, unknown or wrong."""
    found = Scratch(spark, "gate").cut(quality(spark, sf_dir).withColumn("category", F.coalesce("category", F.lit("all"))), "metrics")
    now = evaluate.gate(found, {"precision": 0.3, "exact_span": 0.1}).select("category", "status")
    lead = F.substring("category", 1, 1)
    recorded = now.where(lead != "5").withColumn("status", F.when(lead == "4", "pass!").when(lead == "2", "fail").otherwise(F.col("status")))
    return fixtures.exit_codes(recorded, now, "category")


EVENT_KIND = "CASE event_type WHEN 'signup' THEN 'start' WHEN 'view' THEN 'result' WHEN 'click' THEN 'draft' WHEN 'error' THEN CASE WHEN value < 60 THEN 'cancel' ELSE 'failure' END ELSE CASE WHEN value < 60 THEN 'finish' ELSE 'result' END END"


@query(f"""
WITH e AS (SELECT user_id AS key, event_id AS ord, {EVENT_KIND} AS kind FROM events), r AS (SELECT *, max(CASE WHEN kind = 'start' THEN ord END) OVER (PARTITION BY key ORDER BY ord) AS run FROM e),
h AS (SELECT *, min(CASE WHEN kind IN ('cancel', 'finish') THEN ord END) OVER (PARTITION BY key, run) AS e_at FROM r WHERE run IS NOT NULL),
g AS (SELECT key, run, any_value(CASE WHEN ord = e_at THEN kind END) AS e, count_if(kind = 'result' AND (e_at IS NULL OR ord < e_at)) AS done, count_if(kind = 'failure' AND (e_at IS NULL OR ord < e_at)) AS failed,
  count_if(kind IN ('result', 'failure') AND ord > e_at) AS dropped, max(CASE WHEN kind = 'draft' THEN ord END) AS draft FROM h GROUP BY 1, 2)
SELECT key, run, CASE WHEN e = 'cancel' THEN 'cancelled' WHEN e = 'finish' THEN 'finished' WHEN run = max(run) OVER (PARTITION BY key) THEN 'open' ELSE 'superseded' END AS status, done, failed, dropped, draft, e IS DISTINCT FROM 'finish' OR failed > 0 AS partial FROM g
""")
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of events as review runs of users: what each run came to, what came too late, and its last draft."""
    from glossa.streaming import runs

    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("order"), F.expr(EVENT_KIND).alias("kind"))
    return runs.replay(events)
