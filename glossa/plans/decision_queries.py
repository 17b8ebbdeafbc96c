"""Verdict ledger, outcomes of attempts and bounded read tools over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import decisions as d
from glossa.plans.registry import query
from glossa.plans.signal_queries import SIGNALS, units
from glossa.session import Scratch, table

#: A stand-in for a reviewer, the same in both dialects: what it says of a pair, and which calls it answers badly.
SAYS = "CASE WHEN kind IN ('value', 'frequency') THEN 'conflict' WHEN (pos + other_pos) % 23 = 0 THEN 'uncertain' ELSE 'compatible' END"


def stand_in(calls: DataFrame) -> DataFrame:
    """Answers as JSON: of five documents, one's calls always cite a wrong unit, another's leave out a pair at first."""
    number = F.split("call_id", "-")[0].cast("long")
    hard, slow = number % 5 == 0, number % 5 == 1

    def one(p):
        ids = F.split(p["pair_id"], ":")
        pos, other = ids[1].cast("int"), ids[2].cast("int")
        verdict = F.when(p["kind"].isin("value", "frequency"), "conflict").when((pos + other) % 23 == 0, "uncertain").otherwise("compatible")
        return F.struct(p["pair_id"].alias("pair_id"), verdict.alias("verdict"), F.array(F.when(hard, "?").otherwise(p["first_id"]), p["second_id"]).alias("evidence_ids"))

    shown = F.when(slow & (F.col("attempt") == 1), F.slice("pairs", 2, d.PAIRS_A_CALL)).otherwise(F.col("pairs"))
    return calls.select("call_id", F.to_json(F.struct(F.transform(shown, one).alias("decisions"))).alias("answer"))


@query(f"""
WITH {SIGNALS}, p AS (SELECT q.doc_id, q.pos, q.other_pos, q.kind, least(a.text, b.text) AS t1, greatest(a.text, b.text) AS t2, lpad(q.doc_id::VARCHAR, 6, '0') || ':' || q.pos || ':' || q.other_pos AS pair_id
  FROM q JOIN u a ON a.doc_id = q.doc_id AND a.pos = q.pos JOIN u b ON b.doc_id = q.doc_id AND b.pos = q.other_pos),
pf AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY kind, t1, t2 ORDER BY doc_id, pair_id) = 1),
pc AS (SELECT *, (row_number() OVER (PARTITION BY doc_id ORDER BY pair_id) - 1) // 4 AS call, {SAYS} AS says FROM pf),
pe AS (SELECT *, bool_or(says = 'uncertain') OVER (PARTITION BY doc_id, call) AS unsure, doc_id % 5 = 0 AS hard, doc_id % 5 = 1 AS slow FROM pc)
SELECT p.doc_id, p.pair_id, p.kind, CASE WHEN hard THEN NULL ELSE says END AS verdict, CASE WHEN hard THEN 'failed' ELSE 'asked' END AS status, CASE WHEN slow OR hard THEN 2 ELSE 1 END AS attempts, CASE WHEN hard THEN 'failed' WHEN unsure THEN 'asked' ELSE 'known' END AS next_status
FROM p JOIN pe ON pe.kind = p.kind AND pe.t1 = p.t1 AND pe.t2 = p.t2
""")
def pair_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of sentences judged in fours by a plug-in, with a ledger: a second run asks only what stayed open."""
    from glossa.operators import signals as s

    scratch = Scratch(spark, "verdicts")
    texts = units(spark, sf_dir)
    found = s.unit_pairs(s.unit_facts(texts)).drop("parameter_difference")
    first, second = (texts.select("doc_id", F.col("pos").alias(p), F.col("text").alias(name)) for p, name in (("pos", "first"), ("other_pos", "second")))
    pair_id = F.concat_ws(":", F.lpad(F.col("doc_id").cast("string"), 6, "0"), "pos", "other_pos")
    unit = [F.concat_ws(":", "doc_id", p).alias(name) for p, name in (("pos", "first_id"), ("other_pos", "second_id"))]
    pairs = found.join(first, ["doc_id", "pos"]).join(second, ["doc_id", "other_pos"]).select("doc_id", pair_id.alias("pair_id"), "kind", *unit, "first", "second")
    answered, ledger = d.review_pairs(pairs, None, stand_in, scratch, name="one")
    again, _ = d.review_pairs(pairs, ledger, stand_in, scratch, name="two")
    return answered.drop("first", "second", "first_id", "second_id").join(again.select("doc_id", "pair_id", F.col("status").alias("next_status")), ["doc_id", "pair_id"])


CANDIDATES = """SELECT o_orderkey AS candidate_id, CASE WHEN o_custkey % 3 = 0 THEN 'modelOnly' ELSE 'hybrid' END AS mode,
  CASE o_orderstatus WHEN 'F' THEN 'deterministicRule' WHEN 'O' THEN 'verifiedGlossary' ELSE 'suggested' END AS tier,
  CASE left(o_orderpriority, 1) WHEN '1' THEN 'spelling' WHEN '2' THEN 'grammar' WHEN '3' THEN 'terminology' ELSE 'clarity' END AS category FROM orders"""
ATTEMPTS = """SELECT l_orderkey AS candidate_id, CAST(l_linenumber * 100000 + l_suppkey * 100 + l_quantity AS INT) AS attempt, CASE WHEN l_returnflag = 'R' THEN CASE WHEN l_linestatus = 'O' THEN 'recoverable' ELSE 'fatal' END ELSE 'valid' END AS result,
  CASE WHEN l_discount < 0.04 THEN 'reject' WHEN l_tax < 0.02 THEN 'unsure' ELSE 'accept' END AS decision, l_quantity < 45 AS same FROM lineitem"""


@query(f"""
WITH c AS ({CANDIDATES}), a AS ({ATTEMPTS}),
e AS (SELECT a.candidate_id, CASE WHEN result <> 'valid' THEN result WHEN NOT same THEN 'stranger' WHEN decision = 'reject' AND tier IN ('deterministicRule', 'verifiedGlossary') THEN 'strong-reject' ELSE decision END AS event, row_number() OVER (PARTITION BY a.candidate_id ORDER BY attempt, event) AS n FROM a JOIN c USING (candidate_id)),
x AS (SELECT c.*, e1.event AS f, e2.event AS s FROM c LEFT JOIN e e1 ON e1.candidate_id = c.candidate_id AND e1.n = 1 LEFT JOIN e e2 ON e2.candidate_id = c.candidate_id AND e2.n = 2),
y AS (SELECT *, f = 'recoverable' AS repaired, f = 'strong-reject' AND s IS NOT NULL AS challenged, CASE WHEN f IS NULL OR f IN ('fatal', 'stranger') THEN 'failed'
  WHEN f = 'recoverable' THEN CASE WHEN s IS NULL OR s IN ('recoverable', 'fatal', 'stranger') THEN 'failed' WHEN s IN ('reject', 'strong-reject') THEN 'rejected' WHEN s = 'unsure' THEN 'unsure' ELSE 'accepted' END
  WHEN f = 'strong-reject' THEN CASE s WHEN 'accept' THEN 'accepted' WHEN 'unsure' THEN 'unsure' ELSE 'rejected' END WHEN f = 'reject' THEN 'rejected' WHEN f = 'unsure' THEN 'unsure' ELSE 'accepted' END AS last FROM x),
z AS (SELECT *, last = 'failed' AND mode = 'hybrid' AND tier = 'deterministicRule' AND category <> 'terminology' AS fallback, last = 'rejected' AND mode = 'hybrid' AND tier = 'deterministicRule' AND category IN ('spelling', 'grammar') AS kept FROM y)
SELECT candidate_id, CASE WHEN coalesce(repaired, false) THEN 'repaired-' || last WHEN coalesce(challenged, false) THEN 'challenged-' || last ELSE last END AS state,
  CASE WHEN f IS NULL THEN 0 WHEN f IN ('recoverable', 'strong-reject') AND s IS NOT NULL THEN 2 ELSE 1 END AS attempts, coalesce(repaired, false) AS repaired, coalesce(challenged, false) AS challenged, fallback,
  last <> 'failed' AND NOT coalesce(repaired, false) AS first_pass, CASE WHEN fallback OR kept OR last = 'accepted' THEN 'suggestion' WHEN last = 'failed' THEN 'rejection' WHEN last = 'rejected' THEN 'none' ELSE 'needs-review' END AS status,
  CASE WHEN fallback THEN 'deterministicFallback' WHEN kept THEN 'deterministic' WHEN last = 'failed' THEN NULL WHEN repaired THEN 'repaired' ELSE 'model' END AS origin FROM z
""")
def decision_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the attempts on each candidate (an order, its lines) come to: one repair, one second look, fallbacks."""
    table(spark, sf_dir, "orders").createOrReplaceTempView("glossa_orders")
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("glossa_lineitem")
    candidates, attempts = spark.sql(CANDIDATES.replace("FROM orders", "FROM glossa_orders")), spark.sql(ATTEMPTS.replace("FROM lineitem", "FROM glossa_lineitem"))
    return d.outcomes(candidates, attempts)


TOOLS = "['search', 'definition', 'passage', 'status', 'relations', 'other']"
REQUESTS = f"""SELECT user_id AS session, event_id AS seq, {TOOLS}[1 + event_id % 6] AS tool,
  CASE WHEN event_id % 17 = 0 THEN ' ' WHEN event_id % 6 = 0 THEN (event_id * 7 % 60)::VARCHAR WHEN event_id % 6 IN (3, 4) THEN (event_id % 130)::VARCHAR ELSE (event_id * 3 % 230)::VARCHAR END AS argument, event_id % 8 AS lim FROM events"""


@query(f"""
WITH r AS ({REQUESTS}), n AS (SELECT *, trim(argument) AS arg, greatest(lim, 1) AS l, row_number() OVER (PARTITION BY session ORDER BY seq) > 4 AS over FROM r),
e AS (SELECT *, CASE WHEN over THEN 'budgetExceeded' WHEN tool = 'search' AND arg = '' THEN 'emptyQuery' WHEN tool = 'search' AND l > 5 THEN 'resultLimitExceeded' WHEN tool = 'definition' AND arg = '' THEN 'missingEntry'
  WHEN tool = 'passage' AND arg = '' THEN 'missingPassage' WHEN tool IN ('status', 'relations') AND arg = '' THEN 'missingReference' WHEN tool = 'other' THEN 'unknownTool' END AS first FROM n),
sr AS (SELECT session, seq, 'part ' || p_partkey AS payload, p_size > 5 AS authoritative, row_number() OVER (PARTITION BY session, seq ORDER BY p_retailprice DESC, p_partkey) AS rank, l FROM e JOIN part ON p_size::VARCHAR = arg WHERE tool = 'search' AND first IS NULL),
h AS (SELECT session, seq, payload, authoritative, rank FROM sr WHERE rank <= l
  UNION ALL SELECT session, seq, 'definition ' || p_name, p_size > 5, 0 FROM e JOIN part ON p_partkey::VARCHAR = arg WHERE tool = 'definition' AND first IS NULL
  UNION ALL SELECT session, seq, 'passage ' || sha256(coalesce(text, '')), text IS NOT NULL, 0 FROM e JOIN documents ON doc_id::VARCHAR = arg WHERE tool = 'passage' AND first IS NULL
  UNION ALL SELECT session, seq, 'status ' || s_name, s_acctbal > 0, 0 FROM e JOIN supplier ON s_suppkey::VARCHAR = arg WHERE tool = 'status' AND first IS NULL
  UNION ALL SELECT session, seq, 'relation ' || k, true, 0 FROM e JOIN (SELECT DISTINCT l_suppkey, l_partkey AS k FROM lineitem WHERE l_quantity > 48) ON l_suppkey::VARCHAR = arg WHERE tool = 'relations' AND first IS NULL),
g AS (SELECT session, seq, list(payload ORDER BY rank, payload) AS results, bool_and(authoritative) AS authoritative FROM h GROUP BY 1, 2),
o AS (SELECT e.session, e.seq, coalesce(first, CASE WHEN tool = 'definition' AND results IS NULL THEN 'unknownEntry' WHEN tool = 'passage' AND results IS NULL THEN 'unknownPassage'
  WHEN tool IN ('status', 'relations') AND arg NOT IN (SELECT s_suppkey::VARCHAR FROM supplier) THEN 'unknownReference' END) AS error, results, g.authoritative FROM e LEFT JOIN g USING (session, seq))
SELECT session, seq, error, CASE WHEN error IS NULL THEN coalesce(results, []) END AS results, error IS NULL AND results IS NOT NULL AND coalesce(authoritative, false) AS authoritative FROM o
""")
def read_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of five kinds (an event each, a user's are a session), answered by five joins within budgets."""
    from pyspark.sql import Window as W

    events = table(spark, sf_dir, "events")
    k = F.col("event_id")
    tool = F.element_at(F.array(*map(F.lit, ("search", "definition", "passage", "status", "relations", "other"))), (k % 6 + 1).cast("int"))
    argument = F.when(k % 17 == 0, " ").when(k % 6 == 0, (k * 7 % 60).cast("string")).when((k % 6).isin(3, 4), (k % 130).cast("string")).otherwise((k * 3 % 230).cast("string"))
    requests = events.select(F.col("user_id").alias("session"), k.alias("seq"), tool.alias("tool"), argument.alias("argument"), (k % 8).alias("limit"))
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    entries = part.select(F.col("p_partkey").cast("string").alias("key"), F.concat(F.lit("definition "), "p_name").alias("payload"), (F.col("p_size") > 5).alias("authoritative"))
    text = F.col("text")
    passages = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), F.concat(F.lit("passage "), F.sha2(F.coalesce(text, F.lit("")), 256)).alias("payload"), text.isNotNull().alias("authoritative"))
    key = F.col("s_suppkey").cast("string").alias("key")
    status = supplier.select(key, F.concat(F.lit("status "), "s_name").alias("payload"), (F.col("s_acctbal") > 0).alias("authoritative"))
    related = table(spark, sf_dir, "lineitem").where("l_quantity > 48").select(F.col("l_suppkey").cast("string").alias("key"), F.concat(F.lit("relation "), F.col("l_partkey").cast("string")).alias("payload"), F.lit(True).alias("authoritative")).distinct()
    tools = {
        "definition": d.Tool(entries, "missingEntry", "unknownEntry"),
        "passage": d.Tool(passages, "missingPassage", "unknownPassage"),
        "status": d.Tool(status, "missingReference", "unknownReference"),
        "relations": d.Tool(related, "missingReference", "unknownReference", supplier.select(key)),
    }

    def search(asked: DataFrame) -> DataFrame:
        """The parts of a size, dearest first; of each size only as many as a call may have meet the requests."""
        dearest = F.row_number().over(W.partitionBy("query").orderBy(F.desc("p_retailprice"), "p_partkey"))
        shown = part.withColumn("query", F.col("p_size").cast("string")).withColumn("rank", dearest).where(F.col("rank") <= d.MOST_RESULTS)
        met = asked.join(shown, "query").where("rank <= limit")
        return met.select("session", "seq", "rank", F.concat(F.lit("part "), F.col("p_partkey").cast("string")).alias("payload"), (F.col("p_size") > 5).alias("authoritative"))

    return d.dispatch(requests, tools, search, "search")
