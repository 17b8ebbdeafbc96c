"""Retrieval queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.functions import text as t
from glossa.operators import retrieval as r
from glossa.plans.registry import query
from glossa.session import table

#: DuckDB's form of functions.text.normalise and tokens.
NORM = "trim(regexp_replace(strip_accents(lower({0})), '\\s+', ' ', 'g'))"
TOKENS = "list_filter(regexp_split_to_array(" + NORM + ", '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def norm(x: str) -> str:
    return NORM.format(x)


def toks(x: str) -> str:
    return TOKENS.format(x)


def bm25_sql(weight: str, queries: str, k: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, {toks("text")} AS ws FROM documents),
n AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM d),
p AS (SELECT doc_id, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS token FROM d) GROUP BY 1, 2),
df AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
q AS (SELECT query_id, token, {weight} AS w FROM (SELECT query_id, unnest({toks("query")}) AS token FROM ({queries})) GROUP BY 1, 2),
s AS (SELECT query_id, doc_id, round(sum(w * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))), 6) AS score
  FROM q JOIN df USING (token) JOIN p USING (token), n GROUP BY 1, 2)
SELECT query_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {k}
"""


def ranked(scores: DataFrame, k: int) -> DataFrame:
    rounded = scores.withColumn("score", F.round("score", 6))
    return r.top_k(rounded, k, F.desc("score"), F.col("doc_id")).select("query_id", "rank", "doc_id", "score")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


ITEMS = "SELECT item_id AS query_id, text AS query FROM benchmark"


@query(bm25_sql("1.0", ITEMS, 10))
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten best documents of each benchmark item by BM25 over distinct query tokens."""
    return ranked(r.bm25(table(spark, sf_dir, "documents"), items(spark, sf_dir), doc_id="doc_id", doc_text="text", query_id="query_id", query_text="query"), 10)


@query(bm25_sql("count(*)", ITEMS, 10))
def bm25_repeat_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As bm25_topk, a repeated query token counting as often."""
    return ranked(r.bm25(table(spark, sf_dir, "documents"), items(spark, sf_dir), doc_id="doc_id", doc_text="text", query_id="query_id", query_text="query", repeats=True), 10)


@query(f"""
WITH d AS (SELECT doc_id, {toks("text")} AS ws FROM documents), n AS (SELECT count(*) AS n FROM d),
df AS (SELECT token, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest(ws) AS token FROM d) GROUP BY 1)
SELECT token, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) AS idf FROM df, n
""")
def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.idf_table(table(spark, sf_dir, "documents"), "doc_id", "text").withColumn("idf", F.round("idf", 9))


@query(f"SELECT count(*) AS documents, round(avg(len({toks('text')})), 6) AS mean_tokens FROM documents")
def avg_doc_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.size(t.tokens(F.coalesce("text", F.lit(""))))
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("documents"), F.round(F.avg(size), 6).alias("mean_tokens"))


@query(f"""
SELECT doc_id, token, tf FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tf DESC, token) AS k FROM
  (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest({toks("text")}) AS token FROM documents) GROUP BY 1, 2)) WHERE k <= 3
""")
def tf_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three most frequent tokens of each document."""
    p = r.postings(table(spark, sf_dir, "documents"), "doc_id", "text")
    return r.top_k(p, 3, F.desc("tf"), F.col("token"), by="doc_id").select("doc_id", "token", "tf")


PART_QUERIES = "SELECT p_partkey AS query_id, p_type AS query FROM part WHERE p_partkey % 50 = 0"


def lexical_sql(catalogue: bool) -> str:
    exact = "CASE WHEN nt = q THEN 1000.0 WHEN starts_with(nt, q) THEN 300.0 WHEN contains(nt, q) THEN 150.0 ELSE 0.0 END"
    holds = "CASE WHEN len(tt) > 0 AND contains(' ' || array_to_string(qt, ' ') || ' ', ' ' || array_to_string(tt, ' ') || ' ') THEN 40.0 ELSE 0.0 END"
    bonus = f"{exact} + {holds}" if catalogue else f"{exact} + CASE WHEN contains(nd, q) THEN 100.0 ELSE 0.0 END"
    order = "score DESC, nt, doc_id" if catalogue else "(nt = q) DESC, score DESC, nt, doc_id"
    return f"""
WITH e AS (SELECT p_partkey AS doc_id, p_name AS term, p_type AS definition, {norm("p_name")} AS nt, {norm("p_type")} AS nd, {toks("p_name")} AS tt, {toks("p_name || ' ' || p_type")} AS ws FROM part),
n AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM e),
p AS (SELECT doc_id, token, count(*) AS tf, any_value(dl) AS dl FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS token FROM e) GROUP BY 1, 2),
df AS (SELECT token, count(*) AS df FROM p GROUP BY 1),
qs AS (SELECT query_id, {norm("query")} AS q, {toks("query")} AS qt FROM ({PART_QUERIES})),
qd AS (SELECT DISTINCT query_id, unnest(qt) AS token FROM qs),
s AS (SELECT query_id, doc_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / mean))) AS score
  FROM qd JOIN df USING (token) JOIN p USING (token), n GROUP BY 1, 2),
u AS (SELECT query_id, doc_id, sum(score) AS score FROM (SELECT * FROM s UNION ALL SELECT query_id, doc_id, 0.0 FROM e JOIN qs ON contains(nt, q)) GROUP BY 1, 2),
f AS (SELECT query_id, doc_id, term, nt, q, round(score + {bonus}, 6) AS score FROM u JOIN e USING (doc_id) JOIN qs USING (query_id))
SELECT query_id, rank, doc_id, term, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}) AS rank FROM f) WHERE rank <= 10
"""


def part_search(spark: SparkSession, sf_dir: str, catalogue: bool) -> DataFrame:
    part = table(spark, sf_dir, "part")
    asked = part.where("p_partkey % 50 = 0").select(F.col("p_partkey").alias("query_id"), F.col("p_type").alias("query"))
    return r.lexical_search(part, asked, 10, entry_id="p_partkey", term="p_name", definition="p_type", query_id="query_id", query_text="query", catalogue=catalogue)


@query(lexical_sql(False))
def lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glossary search: part names as terms, part types as definitions; every fiftieth part's type is asked."""
    return part_search(spark, sf_dir, False)


@query(lexical_sql(True))
def rag_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The smaller catalogue's search, with its own bonuses and order."""
    return part_search(spark, sf_dir, True)


ASKED = "SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0"
VECTORS_SQL = f"""
s AS (SELECT query_id, vec_id AS doc_id, round(list_inner_product(embedding::DOUBLE[], q::DOUBLE[]), 6) AS score FROM embeddings, ({ASKED}) WHERE vec_id <> query_id),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10)
"""


def semantic(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return r.semantic_search(e, asked, 10, id_col="vec_id", vector_col="embedding").select("query_id", "rank", "doc_id", "score")


@query(f"WITH {VECTORS_SQL} SELECT query_id, rank, doc_id, score FROM v")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten nearest vectors by inner product for every hundredth vector."""
    return semantic(spark, sf_dir)


@query(f"""
WITH {VECTORS_SQL}
SELECT query_id, doc_id, score, second FROM (SELECT *, lead(score) OVER (PARTITION BY query_id ORDER BY rank) AS second FROM v)
WHERE rank = 1 AND score >= 0.3 AND (second IS NULL OR round(score - second, 6) >= 0.03)
""")
def margin_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First hits that score 0.3 and lead by 0.03."""
    return r.margin_gate(semantic(spark, sf_dir), 0.3, 0.03).select("query_id", "doc_id", "score", "second")


HYBRID = "SELECT doc_id AS query_id, text AS query FROM documents WHERE doc_id % 100 = 0"


@query(f"""
WITH {VECTORS_SQL}, l AS ({bm25_sql("1.0", HYBRID, 100)}),
f AS (SELECT coalesce(l.query_id, v.query_id) AS query_id, coalesce(l.doc_id, v.doc_id) AS doc_id, l.rank AS lexical_rank, v.rank AS semantic_rank, v.score AS semantic_score,
  round(coalesce(1.0 / (60 + l.rank), 0.0) + coalesce(1.0 / (60 + v.rank), 0.0), 9) AS fusion
  FROM l FULL OUTER JOIN v ON l.query_id = v.query_id AND l.doc_id = v.doc_id)
SELECT query_id, rank, doc_id, fusion FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion DESC, semantic_score DESC NULLS LAST, doc_id) AS rank FROM f) WHERE rank <= 10
""")
def hybrid_rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank fusion of BM25 over documents and of the vectors of equal ids, for every hundredth document's whole text."""
    docs = table(spark, sf_dir, "documents")
    asked = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))
    lexical = ranked(r.bm25_best(docs, asked, 100, doc_id="doc_id", doc_text="text", query_id="query_id", query_text="query"), 100)
    return r.fuse(lexical, semantic(spark, sf_dir), 10).select("query_id", "rank", "doc_id", "fusion")


@query(f"SELECT p_partkey, p_name FROM part WHERE {norm('p_name')} IN (SELECT {norm('p_name')} FROM part WHERE p_partkey % 100 = 0)")
def exact_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose normalised term is one of the asked terms."""
    part = table(spark, sf_dir, "part").withColumn("nt", t.normalise(F.col("p_name")))
    return part.join(part.where("p_partkey % 100 = 0").select("nt").distinct(), "nt", "left_semi").select("p_partkey", "p_name")


@query(f"""
WITH e AS (SELECT p_partkey AS id, {toks("p_name")} AS ws, (p_size >= 25)::INT AS ok, list_distinct([p_brand, p_type]) AS refs FROM part),
f AS (SELECT id, unnest(refs) AS ref FROM e),
s AS (SELECT a.id, b.id AS other, count(*) AS shared FROM f a JOIN f b USING (ref) WHERE a.id <> b.id GROUP BY 1, 2),
g AS (SELECT s.id, other, 100 * shared + 10 * len(list_intersect(x.ws, y.ws)) + y.ok AS score FROM s JOIN e x ON x.id = s.id JOIN e y ON y.id = other)
SELECT id, rank, other, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rank FROM g) WHERE rank <= 3
""")
def related_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three most related parts: shared brand and container as references, shared name tokens."""
    part = table(spark, sf_dir, "part").withColumn("refs", F.array("p_brand", "p_type"))
    return r.related(part, id_col="p_partkey", term_col="p_name", refs_col="refs", verified=F.col("p_size") >= 25, k=3)


@query(f"""
SELECT DISTINCT query_id, part FROM (
  SELECT item_id AS query_id, trim(text) AS part FROM benchmark
  UNION ALL SELECT query_id, trim(part) FROM (SELECT item_id AS query_id, unnest(regexp_split_to_array(text, '[,;]')) AS part FROM benchmark) WHERE len({toks("part")}) >= 2) WHERE part <> ''
""")
def query_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.expand_query(table(spark, sf_dir, "benchmark"), "item_id", "text")


@query(f"""
WITH q AS (SELECT 'item' AS kind, item_id AS id, text AS query FROM benchmark UNION ALL SELECT 'part', p_partkey, p_type || ' ' || p_name FROM part UNION ALL SELECT 'brand', p_partkey, p_type FROM part)
SELECT kind, id, CASE WHEN len(list_distinct({toks("query")})) <= 3 THEN 'lexical' ELSE 'hybrid' END AS policy FROM q
""")
def search_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which search a query gets: short ones stay lexical."""
    part = table(spark, sf_dir, "part")
    asked = table(spark, sf_dir, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), F.col("text").alias("query"))
    asked = asked.union(part.select(F.lit("part"), "p_partkey", F.concat_ws(" ", "p_type", "p_name"))).union(part.select(F.lit("brand"), "p_partkey", "p_type"))
    return asked.select("kind", "id", r.search_policy(F.col("query"), F.array().cast("array<string>")).alias("policy"))


@query(f"""
SELECT p_brand, p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_size DESC, p_retailprice DESC, p_partkey) AS k FROM part) WHERE k = 1
""")
def best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.best_per_group(table(spark, sf_dir, "part"), ["p_brand"], F.desc("p_size"), F.desc("p_retailprice"), F.col("p_partkey")).select("p_brand", "p_partkey", "p_name")


@query(f"""
WITH b AS (SELECT item_id, {toks("text")} AS qs FROM benchmark), d AS (SELECT doc_id, {toks("text")} AS ws FROM documents),
bg AS (SELECT DISTINCT item_id, array_to_string(qs[i:i + 7], ' ') AS g FROM b, unnest(range(1, greatest(len(qs) - 6, 2))) AS u(i) WHERE len(qs) > 0),
dg AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 7], ' ') AS g FROM d, unnest(range(1, len(ws) + 1)) AS u(i)),
sh AS (SELECT DISTINCT doc_id, item_id, array_to_string(ws[i:i + len(qs) - 1], ' ') AS g FROM d JOIN b ON len(qs) BETWEEN 1 AND 7, unnest(range(1, len(ws) + 1)) AS u(i) WHERE array_to_string(ws[i:i + len(qs) - 1], ' ') = array_to_string(qs, ' '))
SELECT doc_id, item_id, count(*) AS shared FROM (SELECT doc_id, item_id, g FROM dg JOIN bg USING (g) UNION SELECT * FROM sh) GROUP BY 1, 2
""")
def contamination_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and how many of a benchmark item's runs of eight tokens they hold, wherever these stand in the item."""
    docs, items_ = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return r.shared_runs(docs, items_, doc_id="doc_id", doc_text="text", item_id="item_id", item_text="text", n=8)
