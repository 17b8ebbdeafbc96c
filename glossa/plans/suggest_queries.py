"""Suggestions and dictionary search over benchmark items as entries and documents as texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import retrieval as r
from glossa.operators import suggest as g
from glossa.plans.registry import query
from glossa.plans.retrieval_queries import norm, toks
from glossa.session import table

TERM = "split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3)"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items: their second and third word as the term, the whole text as the definition."""
    b = table(spark, sf_dir, "benchmark")
    words = F.split("text", " ")
    return b.select(F.col("item_id").alias("doc_id"), F.concat_ws(" ", F.get(words, 1), F.get(words, 2)).alias("term"), F.col("text").alias("definition"), (F.col("item_id") % 5 != 0).alias("verified"), (F.col("item_id") % 7 != 0).alias("actionable"))


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query_id"), "text")


@query(f"""
WITH e AS (SELECT item_id AS doc_id, {norm(TERM)} AS nt, {toks(TERM)} AS tt, list_distinct({toks("text")}) AS dt, {toks(TERM + " || ' ' || text")} AS ws, item_id % 5 <> 0 AND item_id % 7 <> 0 AS able FROM benchmark),
n AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM e), p AS (SELECT doc_id, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS token FROM e) GROUP BY 1, 2), df AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT doc_id AS query_id, {toks("text")} AS qt FROM documents), qw AS (SELECT query_id, token, count(*) AS w FROM (SELECT query_id, unnest(qt) AS token FROM q) GROUP BY 1, 2),
s AS (SELECT query_id, doc_id, round(sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM qw JOIN df USING (token) JOIN p USING (token), n GROUP BY 1, 2),
m AS (SELECT s.*, nt, len(tt) AS words, len(list_intersect(list_distinct(qt), dt)) AS matched, len(tt) >= 2 AND contains(' ' || array_to_string(qt, ' ') || ' ', ' ' || array_to_string(tt, ' ') || ' ') AS direct FROM s JOIN e USING (doc_id) JOIN q USING (query_id) WHERE able),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, nt ORDER BY score DESC, doc_id) AS k FROM m) WHERE k = 1),
o AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM b WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, nt, doc_id)),
g AS (SELECT *, max(CASE WHEN n = 1 THEN (score >= 20 AND matched >= 4 AND (second IS NULL OR round(score - second, 6) >= 3))::INT END) OVER (PARTITION BY query_id) = 1 AS open FROM o),
u AS (SELECT *, n AS k2 FROM g WHERE open AND score >= 20 AND matched >= 4 UNION ALL SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY words DESC, nt, doc_id) FROM g WHERE NOT open AND direct)
SELECT query_id, rank, doc_id, score, matched, direct FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY k2) AS rank FROM u) WHERE rank <= 3
""")
def suggestion_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to three conservative candidates of every document."""
    return g.lexical_suggestions(entries(spark, sf_dir), texts(spark, sf_dir), 3)


SCORES = "s AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id), v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS k FROM s) WHERE k <= 10)"


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return r.semantic_search(e, asked, 10, id_col="vec_id", vector_col="embedding").select("query_id", "rank", "doc_id", F.col("score").alias("semantic_score"))


@query(f"""
WITH {SCORES}, a AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM v WHERE doc_id % 3 <> 0 WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, doc_id)),
o AS (SELECT *, max(CASE WHEN n = 1 THEN (score >= 0.3 AND (second IS NULL OR round(score - second, 6) >= 0.03))::INT END) OVER (PARTITION BY query_id) = 1 AS open FROM a)
SELECT query_id, n AS rank, doc_id, score AS semantic_score FROM o WHERE open AND score >= 0.3 AND n <= 3
""")
def semantic_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semantic matches that may become suggestions: actionable, over the floor, the first ahead of the second."""
    m = near(spark, sf_dir).withColumns({"fusion": F.lit(None).cast("double"), "actionable": F.col("doc_id") % 3 != 0})
    return g.semantic_suggestions(m, 3, least=0.3).drop("fusion")


@query(f"WITH {SCORES} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY k) AS rank, doc_id FROM v WHERE CASE WHEN doc_id % 4 = 0 THEN doc_id % 8 = 0 ELSE score >= 0.6 END QUALIFY rank <= 4")
def accepted_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fused matches that a dictionary may show; every fourth one has no semantic score."""
    m = near(spark, sf_dir)
    none = F.col("doc_id") % 4 == 0
    m = m.withColumns({"lexical_rank": F.when(F.col("doc_id") % 8 == 0, F.lit(1)), "semantic_score": F.when(~none, F.col("semantic_score"))})
    return g.accepted_matches(m, 4).select("query_id", "rank", "doc_id")


ASKED = "SELECT item_id AS query_id, text FROM benchmark UNION ALL SELECT 1000 + p_partkey, p_name || ' ' || p_type FROM part UNION ALL SELECT 1000000 + doc_id, source || ' of the ' || lang || ' pages' FROM documents"


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey") + 1000, F.concat_ws(" ", "p_name", "p_type"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id") + 1000000, F.concat("source", F.lit(" of the "), "lang", F.lit(" pages")))
    return b.union(p).union(d)


@query(f"""
WITH a AS ({ASKED}), q AS (SELECT query_id, {norm("text")} AS q, {toks("text")} AS qt FROM a), e AS (SELECT DISTINCT {norm("source || ' of the ' || lang || ' pages and others'")} AS t FROM documents WHERE doc_id % 2 = 0)
SELECT query_id, CASE WHEN len(list_distinct(qt)) <= 3 OR EXISTS (SELECT 1 FROM e WHERE contains(t, q)) THEN 'lexical' ELSE 'hybrid' END AS route FROM q
""")
def search_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a query stays lexical: short ones, and those that stand in a term or a regulation's name."""
    shown = table(spark, sf_dir, "documents").where("doc_id % 2 = 0").select(F.lit("").alias("term"), F.concat("source", F.lit(" of the "), "lang", F.lit(" pages and others")).alias("regulation"))
    return g.search_route(asked(spark, sf_dir), shown)


@query(f"""
WITH {SCORES}, x AS (SELECT query_id, doc_id, k FROM v WHERE score >= 0.6), h AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY k) AS rank, doc_id, 'hybrid' AS origin FROM x WHERE query_id % 40 <> 0 QUALIFY rank <= 5),
l AS (SELECT query_id, k AS rank, doc_id + 1 AS doc_id, 'lexical' AS origin FROM v WHERE k <= 5)
SELECT * FROM h UNION ALL SELECT * FROM l WHERE query_id NOT IN (SELECT query_id FROM h)
""")
def dictionary_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search by route: lexical, accepted fused results, and lexical ones where none are accepted."""
    m = near(spark, sf_dir)
    routes = m.select("query_id").distinct().withColumn("route", F.when(F.col("query_id") % 40 == 0, "lexical").otherwise("hybrid"))
    return g.dictionary_search(routes, m.select("query_id", "rank", (F.col("doc_id") + 1).alias("doc_id")), m.withColumn("lexical_rank", F.lit(None).cast("int")), 5)


@query(f"""
WITH {SCORES}, q AS (SELECT DISTINCT query_id, CASE query_id % 3 WHEN 0 THEN 'exactTerm' WHEN 1 THEN 'suggestion' ELSE 'reverseLookup' END AS intent, query_id % 5 AS lim FROM v)
SELECT query_id, k AS rank, CASE intent WHEN 'exactTerm' THEN doc_id + 1 ELSE doc_id END AS doc_id, CASE intent WHEN 'exactTerm' THEN 'exact' ELSE 'hybrid' END AS origin FROM v JOIN q USING (query_id) WHERE k <= lim + 1 AND query_id % 60 <> 0
""")
def intent_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests answered by their intent; blank ones get nothing."""
    m = near(spark, sf_dir)
    key = F.col("query_id")
    intent = F.when(key % 3 == 0, "exactTerm").when(key % 3 == 1, "suggestion").otherwise("reverseLookup")
    requests = m.select("query_id").distinct().select("query_id", F.when(key % 60 == 0, " ").otherwise("x").alias("text"), intent.alias("intent"), (key % 5 + 1).alias("limit"))
    return g.retrieve(requests, m.select("query_id", "rank", (F.col("doc_id") + 1).alias("doc_id")), m)


@query(f"""
WITH {SCORES}, m AS (SELECT query_id // 100 AS text_id, doc_id, score, doc_id % 3 AS matched FROM v), b AS (SELECT *, row_number() OVER (PARTITION BY text_id, doc_id ORDER BY score DESC, matched DESC) AS k FROM m)
SELECT text_id, row_number() OVER (PARTITION BY text_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM b WHERE k = 1 QUALIFY rank <= 5
""")
def multi_query_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of several queries of a text, each entry once by its best."""
    m = near(spark, sf_dir).select(F.expr("query_id div 100").alias("text_id"), "doc_id", F.col("semantic_score").alias("score"), "semantic_score", (F.col("doc_id") % 3).alias("matched"))
    return g.keep_better(m, 5).select("text_id", "rank", "doc_id", "score")


@query(f"""
WITH x AS (SELECT p_name AS term, p_size > 25 AS verified, p_size % 3 AS version, CASE WHEN p_size % 2 = 0 THEN 'u' END AS url, p_partkey AS position, p_partkey % 2 AS l FROM part)
SELECT term, position FROM (SELECT *, row_number() OVER (PARTITION BY {norm("term")} ORDER BY verified DESC, version DESC, (url IS NOT NULL) DESC, l, position) AS k FROM x) WHERE k = 1
""")
def merged_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of entries as one, the better of equal terms kept."""
    n = F.col("p_size")
    rows = table(spark, sf_dir, "part").select(F.col("p_name").alias("term"), (n > 25).alias("verified"), (n % 3).alias("version"), F.when(n % 2 == 0, "u").alias("url"), F.col("p_partkey").alias("position"))
    even = F.col("position") % 2 == 0
    return g.merge_lists(rows.where(even), rows.where(~even), F.col("version")).select("term", "position")


@query(f"""
WITH d AS (SELECT doc_id AS text_id, trim(text) AS text FROM documents WHERE contains(lower(text), 'the ')), p AS (SELECT DISTINCT text_id, part FROM (SELECT text_id, text AS part FROM d UNION ALL SELECT text_id, trim(x) FROM (SELECT text_id, unnest(regexp_split_to_array(text, '[,;]')) AS x FROM d) WHERE len({toks("x")}) >= 2) WHERE part <> ''),
m AS (SELECT DISTINCT part, n, length(part) % 10 AS c FROM p, (SELECT unnest([1, 2, 3, 4]) AS n)),
s AS (SELECT part, n AS doc_id, round(0.5 + (c * n % 10) / 20.0, 6) AS score, n <> 3 AS able, (c + n) % 4 AS matched FROM m),
o AS (SELECT *, row_number() OVER w AS k, lead(score) OVER w AS second FROM s WHERE able WINDOW w AS (PARTITION BY part ORDER BY score DESC, doc_id)),
g AS (SELECT *, max(CASE WHEN k = 1 THEN (score >= 0.6 AND (second IS NULL OR round(score - second, 6) >= 0.03))::INT END) OVER (PARTITION BY part) = 1 AS open FROM o),
b AS (SELECT text_id, doc_id, score, matched FROM p JOIN g USING (part) WHERE open AND score >= 0.6 AND k <= 3),
x AS (SELECT text_id, doc_id, max(score) AS score FROM b GROUP BY 1, 2)
SELECT text_id, row_number() OVER (PARTITION BY text_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM x QUALIFY rank <= 3
""")
def multi_query_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suggestions over a text and its clauses, by a plug-in search; only texts with a cue word are searched."""

    def search(queries: DataFrame) -> DataFrame:
        c = F.length("text") % 10
        found = queries.select("query_id", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("doc_id"), c.alias("c"))
        score = F.round(0.5 + (F.col("c") * F.col("doc_id") % 10) / 20.0, 6)
        return found.select("query_id", "doc_id", score.alias("semantic_score"), F.lit(None).cast("double").alias("fusion"), (F.col("doc_id") != 3).alias("actionable"), ((F.col("c") + F.col("doc_id")) % 4).alias("matched"))

    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    return g.suggest(docs, search, 3, cues=("the ",)).select("text_id", "rank", F.col("doc_id"), "score")
