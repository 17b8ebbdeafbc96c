"""Validation and places over whole documents, the fast router, and the corpus pack over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.functions import text as t
from glossa.operators import anchors, candidates, corpus, definitions, retrieval, review, signals, spellcheck
from glossa.plans.document_queries import PARAS, paras
from glossa.plans.language_queries import lexicon_sql
from glossa.plans.registry import query
from glossa.session import Scratch, table


def letters_sql(x: str) -> str:
    """The database's word borders know ASCII alone: for patterns with borders, other letters are written as one of it."""
    return f"regexp_replace({x}, '[^\\x00-\\x7F]', 'x', 'g')"


def _markers_sql(x: str) -> str:
    parts = []
    for p in t.MARKERS.values():
        text = letters_sql(x) if "\\b" in p else x
        parts.append("array_to_string(list_sort(regexp_extract_all(" + text + ", '" + p.replace("'", "''") + "')), '|')")
    return "[" + ", ".join(parts) + "]"


@query(f"""
WITH {PARAS}, n AS (SELECT doc_id, pos, text, lag(text) OVER w AS before, lead(text) OVER w AS after FROM paras WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
o AS (SELECT doc_id, pos, text AS context, array_to_string(string_split(CASE WHEN pos % 4 = 0 THEN coalesce(before, '') ELSE text END, ' ')[1:1 + pos % 3], ' ') AS original, array_to_string(string_split(CASE WHEN pos % 7 = 0 THEN text ELSE coalesce(after, '') END, ' ')[1:2 + pos % 5], ' ') AS replacement FROM n),
k AS (SELECT *, CASE WHEN original = '' THEN 0 ELSE ((length(context) - length(replace(context, original, ''))) / length(original))::INT END AS times FROM o)
SELECT doc_id, pos, CASE WHEN trim(original, ' ') = '' THEN 'empty-original' WHEN trim(replacement, ' ') = '' THEN 'empty-replacement' WHEN original = replacement THEN 'no-change' WHEN times = 0 THEN 'not-in-context' WHEN times > 1 THEN 'ambiguous-range'
  WHEN length(replacement) > least(500, 2 * length(original)) THEN 'too-long' WHEN regexp_matches(replacement, '[\\n\\r]') THEN 'multi-line' WHEN {_markers_sql("original")} <> {_markers_sql("replacement")} THEN 'literal-changed'
  WHEN regexp_matches({letters_sql("original")}, '(?i)\\b(not|no|nicht|kein|non|pas)\\b') <> regexp_matches({letters_sql("replacement")}, '(?i)\\b(not|no|nicht|kein|non|pas)\\b') THEN 'polarity-changed' END AS error FROM k
""")
def suggestion_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First words of every paragraph, or of the one before, replaced by those of the next: the first rule that is broken."""
    w = W.partitionBy("doc_id").orderBy("pos")
    p = paras(spark, sf_dir).withColumns({"before": F.coalesce(F.lag("text").over(w), F.lit("")), "after": F.coalesce(F.lead("text").over(w), F.lit(""))})

    def first(text: F.Column, n: F.Column) -> F.Column:
        return F.array_join(F.slice(F.split(text, " "), F.lit(1), n), " ")

    original = first(F.when(F.col("pos") % 4 == 0, F.col("before")).otherwise(F.col("text")), 1 + F.col("pos") % 3)
    replacement = first(F.when(F.col("pos") % 7 == 0, F.col("text")).otherwise(F.col("after")), 2 + F.col("pos") % 5)
    return p.select("doc_id", "pos", review.validate(original, replacement, F.col("text")).alias("error"))


@query("""
WITH x AS (SELECT doc_id, text, regexp_split_to_array(text, '[0-9]+') AS gaps, regexp_extract_all(text, '[0-9]+') AS nums FROM documents),
p AS (SELECT doc_id, text, (list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(nums[1:i - 1], lambda g: length(g))), 0))::BIGINT AS start, nums[i] AS v FROM x, unnest(range(1, len(nums) + 1)) AS u(i)),
c AS (SELECT doc_id, start, v, list_filter(regexp_split_to_array(text[greatest(start - 40, 0) + 1:start], '\\s+'), lambda w: w <> '') AS b, list_filter(regexp_split_to_array(text[start + length(v) + 1:start + length(v) + 40], '\\s+'), lambda w: w <> '') AS a FROM p)
SELECT doc_id, start, v AS value, b[len(b)] AS prefix, a[1] || '...' AS suffix FROM c
""")
def word_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words around every number of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = review.matches(docs, "doc_id", "text", "[0-9]+").join(docs, "doc_id")
    return found.select("doc_id", "start", "value", t.word_context(F.col("text"), F.col("start").cast("int"), F.col("end").cast("int")).alias("c")).select("doc_id", "start", "value", "c.prefix", "c.suffix")


@query(f"""
WITH {lexicon_sql(20, 1, 1)}, sp AS (SELECT DISTINCT doc_id FROM dw JOIN g USING (word)), ev AS (SELECT DISTINCT doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)),
r AS (SELECT doc_id, CASE WHEN length(text) > 8192 THEN 'longDocument' WHEN regexp_matches(text, '[“”"‘’«»`]|(^|[^\\p{{L}}\\p{{N}}])''') THEN 'quotationOrCode' WHEN regexp_matches(text, '(?i)\\b(?:adalah|ialah|merupakan|berarti|didefinisikan|diartikan)\\b|yang\\s+dimaksud\\s+dengan|selanjutnya\\s+disebut') THEN 'definitionCue'
  WHEN doc_id IN (SELECT doc_id FROM sp) THEN 'nativeSpellingCandidate' WHEN doc_id IN (SELECT doc_id FROM ev) THEN 'lexicalRetrievalEvidence' ELSE 'localBaseWithSelectiveContextualReview' END AS reason FROM documents)
SELECT doc_id, reason, reason <> 'localBaseWithSelectiveContextualReview' AS full FROM r
""")
def fast_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents need the full review, and the first reason: length, cues, a spelling guess, a benchmark passage."""
    scratch = Scratch(spark, "routes")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = scratch.cut(spellcheck.word_counts(docs, "doc_id", "text"), "counts")
    guessed = spellcheck.guesses(counts.where("weight <= 1"), counts.where("weight >= 20"), edits=1).select("word").distinct()
    words = docs.select("doc_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}{4,}"), F.lit(0)))).alias("word"))
    spelled = words.join(guessed, "word", "left_semi").select("doc_id")
    passages = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("q"))
    evident = retrieval.holding(docs.withColumnRenamed("text", "nt"), passages, scratch).select("doc_id")
    return candidates.fast_route(docs, spelled, evident, None)


LINKS = "l_orderkey * 8 + l_linenumber AS link_id, l_partkey AS definition_id, l_suppkey * 11 % 140 AS passage_id, l_suppkey AS regulation_id, CAST(l_suppkey * 1000000 + l_partkey * 100 + l_quantity AS BIGINT) AS position"


@query(f"""
WITH l AS (SELECT * FROM (SELECT {LINKS} FROM lineitem) QUALIFY row_number() OVER (PARTITION BY link_id ORDER BY position) = 1),
e AS (SELECT l.*, doc_id % 5 > 0 AND s_acctbal > 0 AND lang <> 'de' AND length(trim(text, ' ')) > 0 AS ok FROM l JOIN documents ON doc_id = passage_id JOIN supplier ON s_suppkey = regulation_id)
SELECT p_partkey AS definition_id, count(link_id) AS evidence, (list(link_id ORDER BY position, link_id))[1] AS first_link, coalesce(bool_or(ok), false) AS actionable FROM part LEFT JOIN e ON definition_id = p_partkey GROUP BY 1
""")
def pack_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts of the corpus pack with their evidence in order: a link keeps its first row, and needs its passage and regulation."""
    links = table(spark, sf_dir, "lineitem").selectExpr(*LINKS.split(", "))
    passages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("passage_id"), "text", (F.col("lang") == "de").alias("requires_ocr"), (F.col("doc_id") % 5 > 0).alias("verified"))
    regulations = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("regulation_id"), (F.col("s_acctbal") > 0).alias("in_force"))
    relations = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_linenumber").cast("long").alias("target_id"))
    pack = corpus.build_pack(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("definition_id")), links, passages, regulations, relations)
    return pack["concepts"].select("definition_id", F.size("evidence").cast("long").alias("evidence"), F.get("evidence", F.lit(0))["link_id"].alias("first_link"), "actionable")


@query("""
WITH o AS (SELECT o_custkey AS term, o_orderpriority AS def, max(o_totalprice) AS v FROM orders WHERE o_orderdate < DATE '1995-06-01' GROUP BY 1, 2), s AS (SELECT term, max(v) AS v FROM o GROUP BY 1 HAVING count(*) = 1)
SELECT o_orderkey AS definition_id, coalesce(o.v, s.v) AS value FROM orders LEFT JOIN o ON o.term = o_custkey AND o.def = o_orderpriority LEFT JOIN s ON s.term = o_custkey
""")
def reused_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of earlier entries for new ones: of equal term and definition, else of the term's only entry."""
    orders = table(spark, sf_dir, "orders")
    old = orders.where("o_orderdate < DATE '1995-06-01'").groupBy(F.col("o_custkey").alias("term"), F.col("o_orderpriority").alias("definition")).agg(F.array(F.max("o_totalprice")).alias("v"))
    new = orders.select(F.col("o_orderkey").alias("definition_id"), F.col("o_custkey").alias("term"), F.col("o_orderpriority").alias("definition"))
    return corpus.reuse_vectors(new, old).select("definition_id", F.get("v", F.lit(0)).alias("value"))


HEADINGS = "CASE l_returnflag WHEN 'R' THEN 'Definisi dan ruang' WHEN 'N' THEN 'KETENTUAN  UMUM' ELSE 'Harga' END"


@query(f"""
WITH s AS (SELECT l_orderkey AS doc_id, l_linenumber AS section, {HEADINGS} AS heading, l_linenumber * 100 AS start, l_linenumber * 100 + l_quantity::INT AS "end" FROM lineitem WHERE l_linenumber < 5),
m AS (SELECT l_orderkey AS doc_id, l_partkey AS term, heading IS NULL OR regexp_matches(heading, '(?i)definisi|pengertian|ketentuan\\s+umum') AS whole, start, "end", o_custkey + 1000 AS length FROM lineitem LEFT JOIN s ON s.doc_id = l_orderkey AND s.section = l_linenumber JOIN orders ON o_orderkey = l_orderkey)
SELECT doc_id, term, CASE WHEN whole THEN 0 ELSE start END AS from_pos, CASE WHEN whole THEN length ELSE "end" END AS to_pos FROM m
""")
def term_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where terms hold: in all of a document, or in the section that declares them."""
    lines = table(spark, sf_dir, "lineitem")
    terms = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("term"), F.col("l_linenumber").alias("section"))
    start = F.col("l_linenumber") * 100
    sections = lines.where("l_linenumber < 5").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("section"), F.expr(HEADINGS).alias("heading"), start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("end"))
    size = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), (F.col("o_custkey") + 1000).alias("length"))
    return anchors.term_scope(terms, sections, size)


@query(f"WITH {PARAS} SELECT p.doc_id, p.pos, ((length(d.text[1:p.start]) - length(replace(d.text[1:p.start], 'en ', ''))) / 3)::INT AS occurrence FROM paras p JOIN documents d USING (doc_id)")
def literal_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often a literal stands before each paragraph: the number of its next occurrence."""
    p = paras(spark, sf_dir).select("doc_id", "pos", "start").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return p.select("doc_id", "pos", t.occurrences(F.substring("text", F.lit(1), F.col("start")), F.lit("en ")).alias("occurrence"))


@query("""
SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity, l_linenumber, l_returnflag || l_linestatus) AS number, l_quantity AS start, l_returnflag || l_linestatus AS rule_id FROM lineitem
""")
def source_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings numbered in the order of the text: by place, then the shorter, then the rule."""
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_quantity").alias("start"), (F.col("l_quantity") + F.col("l_linenumber")).alias("end"), F.concat("l_returnflag", "l_linestatus").alias("rule_id"))
    return signals.source_order(found).select("doc_id", "number", "start", "rule_id")


@query("""
WITH m AS (SELECT l_orderkey AS segment_id, bool_and(l_returnflag <> 'R') AS silent FROM lineitem GROUP BY 1), d AS (SELECT o_orderkey AS segment_id, o_custkey AS start FROM orders WHERE o_orderstatus = 'F')
SELECT segment_id, CASE WHEN silent AND d.start IS NOT NULL THEN 'deterministic' ELSE 'model' END AS origin, CASE WHEN silent AND d.start IS NULL THEN 'no-suggestion' ELSE 'suggestion' END AS status FROM m LEFT JOIN d USING (segment_id)
""")
def silent_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule suggestions stand where the model found nothing in a segment, and yield where it found something."""
    silent = F.min(F.col("l_returnflag") != "R")
    place = [F.lit(v).cast("int").alias(n) for n, v in (("start", 0), ("end", 4))]
    model = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("segment_id")).agg(silent.alias("silent"))
    model = model.select("segment_id", (F.col("segment_id") * 2).alias("review_id"), F.when(F.col("silent"), "no-suggestion").otherwise("suggestion").alias("status"), F.lit("model").alias("origin"), F.lit("spelling").alias("category"), *place)
    rules = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("segment_id"), (F.col("o_orderkey") * 2 + 1).alias("review_id"), F.lit("suggestion").alias("status"), F.lit("deterministic").alias("origin"), F.lit("spelling").alias("category"), *place)
    return anchors.survive_silence(model, rules.join(model, "segment_id", "left_semi")).select("segment_id", "origin", "status")


@query(f"""
WITH {PARAS}, x AS (SELECT doc_id, pos, text, string_split(text, ' ')[1] AS term FROM paras),
y AS (SELECT *, CASE pos % 4 WHEN 0 THEN term || ' adalah ' || text WHEN 1 THEN '  ' || lower(term) || ', berarti   ' || text || ' ' WHEN 2 THEN text ELSE term || ' Didefinisikan  sebagai ' || text || ';' END AS source, CASE WHEN pos % 5 = 4 THEN 'review' ELSE 'mismatch' END AS alignment, CASE WHEN pos % 3 = 2 THEN 'retrieved' ELSE 'explicit' END AS strength FROM x),
z AS (SELECT *, trim(regexp_replace(source, '^\\s+|\\s+$', '', 'g'), ' ') AS whole FROM y),
w AS (SELECT *, regexp_extract(whole[length(term) + 1:], '(?is)^\\s*[,;:]?\\s*(?:adalah|ialah|merupakan|berarti|didefinisikan\\s+sebagai|diartikan\\s+sebagai)\\s+(.+)$', 1) AS found FROM z),
b AS (SELECT *, CASE WHEN lower(whole[1:length(term)]) = lower(term) AND found <> '' THEN regexp_replace(found, '^\\s+|\\s+$', '', 'g') ELSE whole END AS body, right(regexp_replace(text, '\\s+$', ''), 1) AS last FROM w)
SELECT doc_id, pos, sha256(CASE WHEN alignment = 'mismatch' AND strength = 'explicit' THEN CASE WHEN contains('.;:!?', last) AND NOT contains('.;:!?', right(body, 1)) THEN body || last ELSE body END END) AS digest FROM b
""")
def mismatch_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every paragraph would read by a source made from it: the term and its connector go, the end mark stays."""
    p = paras(spark, sf_dir).withColumn("term", F.get(F.split("text", " "), F.lit(0)))
    text, term, n = F.col("text"), F.col("term"), F.col("pos") % 4
    source = F.when(n == 0, F.concat(term, F.lit(" adalah "), text)).when(n == 1, F.concat(F.lit("  "), F.lower(term), F.lit(", berarti   "), text, F.lit(" "))).when(n == 2, text)
    source = source.otherwise(F.concat(term, F.lit(" Didefinisikan  sebagai "), text, F.lit(";")))
    alignment, strength = F.when(F.col("pos") % 5 == 4, "review").otherwise("mismatch"), F.when(F.col("pos") % 3 == 2, "retrieved").otherwise("explicit")
    return p.select("doc_id", "pos", F.sha2(definitions.mismatch_text(text, source, term, alignment, strength), 256).alias("digest"))


@query(f"""
SELECT o_orderkey, CASE WHEN NOT (o_orderstatus = 'F' AND o_totalprice > 60000) THEN '{definitions.SOURCE_MESSAGES["unverified"]}' WHEN o_custkey % 5 = 0 THEN '{definitions.SOURCE_MESSAGES["notInForce"]}' WHEN o_custkey % 5 = 1 THEN '{definitions.SOURCE_MESSAGES["unknown"]}'
  WHEN left(o_orderpriority, 1) = '1' THEN '{definitions.SOURCE_MESSAGES["other"]}' END AS message FROM orders
""")
def source_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why an entry (an order) may not be applied as a source, in the order of the rules."""
    n = F.col("o_custkey") % 5
    state, version = F.when(n == 0, "notInForce").when(n == 1, F.lit(None)).otherwise("inForce"), F.when(F.col("o_orderpriority").startswith("1"), "legacyKamusV1").otherwise("current")
    return table(spark, sf_dir, "orders").select("o_orderkey", definitions.source_message(F.col("o_orderstatus") == "F", F.col("o_totalprice") > 60000, state, version).alias("message"))
