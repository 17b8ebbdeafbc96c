"""Document structure, spans, review signals and change queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as t
from glossa.operators import incremental, review, spans, structure as s
from glossa.plans.registry import query
from glossa.plans.retrieval_queries import norm, toks
from glossa.session import table

PARAS = """
lines AS (SELECT doc_id, i - 1 AS line, ls[i] AS raw, list_sum(list_transform(ls[1:i - 1], lambda x: length(x) + 1)) AS before
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), unnest(range(1, len(ls) + 1)) AS u(i)),
paras AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line) - 1 AS pos, line, coalesce(before, 0) + length(raw) - length(ltrim(raw, ' ')) AS start,
  coalesce(before, 0) + length(raw) - length(ltrim(raw, ' ')) + length(trim(raw, ' ')) AS "end", trim(raw, ' ') AS text FROM lines WHERE trim(raw, ' ') <> '')
"""
LEVEL = """CASE WHEN regexp_matches(text, '(?i)^(chapter|bab|kapitel|chapitre|capítulo)\\b') OR (length(text) <= 120 AND regexp_matches(text, '\\p{L}') AND text = upper(text)) THEN 1
  WHEN regexp_matches(text, '(?i)^(article|pasal|artikel|artículo|section)\\s+\\d+') THEN 2 END"""


def paras(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.paragraphs(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f'WITH {PARAS} SELECT doc_id, pos, start, "end", sha256(text) AS digest FROM paras')
def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paras(spark, sf_dir).select("doc_id", "pos", "start", "end", F.sha2("text", 256).alias("digest"))


@query(f"""
WITH {PARAS}, h AS (SELECT *, {LEVEL} AS level FROM paras),
m AS (SELECT *, last_value(CASE WHEN level = 1 THEN pos END IGNORE NULLS) OVER w AS chapter_pos, last_value(CASE WHEN level = 2 THEN pos END IGNORE NULLS) OVER w AS a
  FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT doc_id, pos, level, CASE WHEN level = 1 THEN 'chapter' WHEN level = 2 THEN 'article' WHEN regexp_matches(text, '^(\\d+[.)]|[a-z][.)]|[-*•])\\s') THEN 'item' ELSE 'paragraph' END AS kind,
  chapter_pos, CASE WHEN a IS NOT NULL AND (chapter_pos IS NULL OR a > chapter_pos) THEN a END AS article_pos FROM m
""")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.headings(paras(spark, sf_dir)).select("doc_id", "pos", "level", "kind", "chapter_pos", "article_pos")


SECTIONS = f"""
{PARAS}, h AS (SELECT *, {LEVEL} AS level FROM paras), size AS (SELECT doc_id, max(pos) + 1 AS size FROM paras GROUP BY 1),
sec AS (SELECT doc_id, pos, level, coalesce(CASE WHEN level = 1 THEN min(CASE WHEN level = 1 THEN pos END) OVER w ELSE min(pos) OVER w END, size) AS end_pos
  FROM (SELECT * FROM h WHERE level IS NOT NULL) JOIN size USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
"""


@query(f"WITH {SECTIONS} SELECT * FROM sec")
def section_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.sections(s.headings(paras(spark, sf_dir))).select("doc_id", "pos", "level", "end_pos")


@query(f"WITH {SECTIONS} SELECT doc_id, pos, (SELECT max(s.pos) FROM sec s WHERE s.doc_id = p.doc_id AND s.pos <= p.pos AND p.pos < s.end_pos) AS section_pos FROM paras p")
def innermost_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paras(spark, sf_dir).select("doc_id", "pos", "text")
    return s.innermost(p.select("doc_id", "pos"), s.sections(s.headings(p)))


@query(f"""
WITH {PARAS} SELECT doc_id, pos, lag(pos) OVER w AS prev_pos, lead(pos) OVER w AS next_pos, row_number() OVER (PARTITION BY doc_id, text ORDER BY pos) - 1 AS occurrence
FROM paras WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
""")
def siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of each paragraph and its number among equal ones."""
    out = s.siblings(s.occurrence_no(paras(spark, sf_dir), "text"), F.lit(None))
    return out.select("doc_id", "pos", "prev_pos", "next_pos", "occurrence")


@query("SELECT doc_id, i - 1 AS cell_no, cs[i] AS cell FROM (SELECT doc_id, string_split(text, ' | ') AS cs FROM documents WHERE contains(text, ' | ')), unnest(range(1, len(cs) + 1)) AS u(i)")
def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(F.col("text").contains(" | ")).select("doc_id", "text")
    return s.cells(docs, "text", r" \| ").select("doc_id", "cell_no", "cell")


@query("""
WITH x AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS ss FROM documents)
SELECT doc_id, len(ss) AS sentences, sha256(array_to_string(ss, chr(10))) AS digest FROM x WHERE len(ss) > 0
""")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number and digest of each document's sentences."""
    flat = s.sentences(table(spark, sf_dir, "documents"), "doc_id", "text")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "sentence"))), lambda x: x["sentence"]), "\n")
    return flat.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sha2(joined, 256).alias("digest"))


@query("SELECT conv_id, turn, role, sha256(lag(text) OVER w) AS prev_digest, sha256(lead(text) OVER w) AS next_digest FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def turn_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = s.turn_context(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return out.select("conv_id", "turn", "role", F.sha2("prev_text", 256).alias("prev_digest"), F.sha2("next_text", 256).alias("next_digest"))


@query(f"""
WITH d AS (SELECT doc_id, {toks("text")} AS ws FROM documents)
SELECT doc_id, ws[i] AS word, count(*) AS n FROM d, unnest(range(2, len(ws) + 1)) AS u(i) WHERE ws[i] = ws[i - 1] GROUP BY 1, 2
""")
def adjacent_dup_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.duplicate_words(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(f"""
WITH d AS (SELECT doc_id, {toks("text")} AS ws FROM documents),
g AS (SELECT doc_id, array_to_string(ws[i:i + 5], ' ') AS g, count(*) AS c FROM d, unnest(range(1, len(ws) - 4)) AS u(i) GROUP BY 1, 2),
r AS (SELECT doc_id, sum(c - 1) / sum(c) AS ratio FROM g GROUP BY 1)
SELECT doc_id, round(coalesce(ratio, 0.0), 6) AS ratio FROM d LEFT JOIN r USING (doc_id)
""")
def six_gram_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.repeated_ngrams(table(spark, sf_dir, "documents"), "doc_id", "text")


EVENT_ORDER = "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events"


@query("""
WITH e AS (SELECT user_id, event_id, value > 50 AS f, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
g AS (SELECT *, n - row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM e WHERE f)
SELECT user_id, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM g GROUP BY user_id, g HAVING count(*) >= 2
""")
def table_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of at least two consecutive events over 50 of a user: the gaps-and-islands of table rows."""
    return s.islands(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", F.col("value") > 50)


@query("SELECT user_id, event_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 12 AS batch FROM events")
def batch_no(spark: SparkSession, sf_dir: str) -> DataFrame:
    return s.batches(table(spark, sf_dir, "events"), "user_id", F.col("event_id")).select("user_id", "event_id", F.col("batch").cast("long").alias("batch"))


@query("""
WITH e AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, (value < 30)::INT AS f FROM events)
SELECT user_id, event_id, n > 4 AND sum(CASE WHEN n <= 4 THEN f ELSE 0 END) OVER (PARTITION BY user_id) >= 3 AS deterministic FROM e
""")
def breaker_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The circuit breaker replayed over events: three failures among the first four send the rest the plain way."""
    from glossa.operators.evaluate import breaker

    return breaker(table(spark, sf_dir, "events"), "user_id", "event_id", F.col("value") < 30).select("user_id", "event_id", "deterministic")


DIGESTS = "sha256(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g'), '[ \\t]+(\\n|$)', '\\1', 'g'), '^\\s+|\\s+$', '', 'g'))"


@query(f"SELECT doc_id, {DIGESTS} AS digest FROM documents")
def content_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.content_hash(F.coalesce("text", F.lit(""))).alias("digest"))


@query(f"SELECT doc_id, first_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS first_id FROM (SELECT doc_id, {DIGESTS} AS h FROM documents)) WHERE doc_id <> first_id")
def duplicate_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.content_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


SPANS = f"""{PARAS}, a AS (SELECT doc_id, start, "end" FROM paras), b AS (SELECT doc_id, start + 5 AS start, start + 25 AS "end" FROM paras WHERE pos % 3 = 0)"""


def span_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = paras(spark, sf_dir)
    return p.select("doc_id", "start", "end"), p.where("pos % 3 = 0").select("doc_id", (F.col("start") + 5).alias("start"), (F.col("start") + 25).alias("end"))


@query(f'WITH {SPANS} SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = a.doc_id AND a.start < b."end" AND b.start < a."end")')
def span_overlap_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.overlap_anti(*span_tables(spark, sf_dir))


@query(f'WITH {SPANS} SELECT a.doc_id, a.start, a."end", b.start AS r_start, b."end" AS r_end FROM a JOIN b ON b.doc_id = a.doc_id AND a.start < b."end" AND b.start < a."end"')
def span_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.overlap_join(*span_tables(spark, sf_dir))


@query(f"""
WITH {SPANS}, u AS (SELECT DISTINCT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start - "end", start, "end") AS rank FROM u),
k1 AS (SELECT * FROM r WHERE rank = 1),
k2 AS (SELECT r.doc_id, min(r.rank) AS rank FROM r JOIN k1 USING (doc_id) WHERE NOT (r.start < k1."end" AND k1.start < r."end") GROUP BY 1),
s2 AS (SELECT r.* FROM r JOIN k2 USING (doc_id, rank)),
k3 AS (SELECT r.doc_id, min(r.rank) AS rank FROM r JOIN k1 USING (doc_id) JOIN s2 USING (doc_id) WHERE NOT (r.start < k1."end" AND k1.start < r."end") AND NOT (r.start < s2."end" AND s2.start < r."end") GROUP BY 1)
SELECT * FROM k1 UNION ALL SELECT * FROM s2 UNION ALL SELECT r.* FROM r JOIN k3 USING (doc_id, rank)
""")
def greedy_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longest spans first, none overlapping one taken before; at most three a document."""
    a, b = span_tables(spark, sf_dir)
    ranked = a.union(b).distinct().withColumn("rank", F.struct((F.col("start") - F.col("end")).alias("l"), "start", "end"))
    from pyspark.sql import Window as W

    order = F.row_number().over(W.partitionBy("doc_id").orderBy("rank"))
    return spans.greedy(ranked.withColumn("rank", order), ["doc_id"], most=3)


@query(f"""
WITH {PARAS}, o AS (SELECT doc_id % 1000 AS k, text, doc_id * 10000 + pos AS segment_id FROM paras WHERE doc_id % 2 = 0), n AS (SELECT doc_id % 1000 AS k, text, doc_id * 10000 + pos AS segment_id FROM paras WHERE doc_id % 3 = 0),
oo AS (SELECT *, row_number() OVER (PARTITION BY k, text ORDER BY segment_id) AS rn, count(*) OVER (PARTITION BY k, text) AS c FROM o),
nn AS (SELECT *, row_number() OVER (PARTITION BY k, text ORDER BY segment_id) AS rn, count(*) OVER (PARTITION BY k, text) AS c FROM n),
j AS (SELECT coalesce(oo.k, nn.k) AS k, coalesce(oo.text, nn.text) AS text, oo.segment_id AS o, nn.segment_id AS n, oo.c AS oc, nn.c AS nc FROM oo FULL OUTER JOIN nn ON oo.k = nn.k AND oo.text = nn.text AND oo.rn = nn.rn),
m AS (SELECT *, coalesce(max(oc) OVER (PARTITION BY k, text) <> max(nc) OVER (PARTITION BY k, text), false) AS amb FROM j)
SELECT CASE WHEN n IS NULL THEN 'removed' WHEN o IS NOT NULL AND NOT amb THEN 'reuse' ELSE 'reprocess' END AS action, count(*) AS n FROM m WHERE n IS NOT NULL OR NOT amb GROUP BY 1
""")
def incremental_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of even documents as the old version, of every third as the new: what is reused."""
    p = paras(spark, sf_dir).select((F.col("doc_id") % 1000).alias("k"), "text", (F.col("doc_id") * 10000 + F.col("pos")).alias("segment_id"), "doc_id")
    done = incremental.plan(p.where("doc_id % 2 = 0"), p.where("doc_id % 3 = 0"), ["k", "text"], "segment_id")
    return done.groupBy("action").agg(F.count("*").alias("n"))


@query(f"""
WITH {PARAS} SELECT doc_id, pos, max(contains(text, ' | ')) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS again FROM paras
""")
def neighbour_invalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paras(spark, sf_dir).withColumn("hit", F.col("text").contains(" | "))
    return incremental.with_neighbours(p, ["doc_id"], "pos", "hit").select("doc_id", "pos", "again")


@query(f"""
SELECT item_id, regexp_extract_all(text, '\\d+(?:[.,]\\d+)*') AS numbers, len(string_split(text, ' ')) AS words, {norm("text")} AS norm FROM benchmark
""")
def literal_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", t.markers(F.col("text"), "numbers").alias("numbers"), F.size(F.split("text", " ", -1)).alias("words"), t.normalise(F.col("text")).alias("norm"))


CLAUSES = f"""
c AS (SELECT doc_id, pos, list_sort(list_distinct({toks("text")})) AS ws, regexp_matches(text, '(?i)\\b(not|no|nicht|kein|non|pas)\\b') AS negated FROM paras WHERE len({toks("text")}) BETWEEN 4 AND 12)
"""


@query(f"""
WITH {PARAS}, {CLAUSES} SELECT a.doc_id, a.pos AS pos_a, b.pos AS pos_b, a.negated AS negated_a, b.negated AS negated_b FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.ws[1:3] = b.ws[1:3] AND a.pos < b.pos
""")
def clause_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clause pairs of a document with the same key, by an equi self-join, and their polarity."""
    return review.clause_pairs(paras(spark, sf_dir)).select("doc_id", "pos_a", "pos_b", "negated_a", "negated_b")


@query("SELECT doc_id, lang, CASE WHEN length(text) < 200 THEN 'suppressed' WHEN contains(text, ' | ') THEN 'needs-review' WHEN regexp_matches(text, '\\d') THEN 'model-review' ELSE 'deterministic' END AS route FROM documents")
def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered router: the first guard that holds decides."""
    text = F.col("text")
    guards = [(F.length(text) < 200, "suppressed"), (text.contains(" | "), "needs-review"), (text.rlike(r"\d"), "model-review")]
    return table(spark, sf_dir, "documents").select("doc_id", "lang", review.route(guards, "deterministic").alias("route"))


@query()
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as Markdown text by a streaming HTML parser."""
    from glossa.sources.documents import html_to_markdown

    return html_to_markdown(table(spark, sf_dir, "pages"), "page_id", "html")


@query(f"""
WITH w AS (SELECT DISTINCT doc_id, unnest({toks("text")}) AS token FROM documents), c AS (SELECT token, count(*) AS docs FROM w WHERE regexp_full_match(token, '\\p{{L}}{{4,24}}') GROUP BY 1),
m AS (SELECT a.token, a.docs, b.token AS suggestion, b.docs AS weight FROM c a JOIN c b ON a.docs <= 1 AND b.docs >= 20 AND abs(length(a.token) - length(b.token)) <= 1 AND damerau_levenshtein(translate(a.token, 'ßæœøđłı', '1234567'), translate(b.token, 'ßæœøđłı', '1234567')) = 1)
SELECT token, suggestion, docs FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY weight DESC, suggestion DESC) AS k FROM m) WHERE k = 1
""")
def spelling_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rare tokens one edit away from a frequent one."""
    return review.spelling(table(spark, sf_dir, "documents"), "doc_id", "text", rare=1, frequent=20)


@query("""
WITH x AS (SELECT item_id AS doc_id, text AS a, replace(text, ' the ', ' a ') AS b FROM benchmark), y AS (SELECT * FROM x WHERE a <> b),
p AS (SELECT doc_id, a, b, (SELECT max(i) FROM unnest(range(0, least(length(a), length(b)) + 1)) u(i) WHERE a[1:i] = b[1:i]) AS p FROM y),
s AS (SELECT *, (SELECT max(i) FROM unnest(range(0, least(length(a), length(b)) - p + 1)) u(i) WHERE right(a, i) = right(b, i)) AS s FROM p)
SELECT doc_id, p AS start, length(a) - s AS "end", length(b) - s AS new_end FROM s
""")
def changed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items against themselves with one word replaced: the range that changed."""
    b = table(spark, sf_dir, "benchmark")
    return incremental.changed_ranges(b, b.withColumn("text", F.regexp_replace("text", " the ", " a ")), "item_id", "text")
