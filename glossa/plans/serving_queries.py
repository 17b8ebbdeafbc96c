"""What a dictionary serves, over the driver's tables: line items stand for links, orders for passages, suppliers for regulations, customers for documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import serving as v
from glossa.plans.registry import query
from glossa.plans.retrieval_queries import norm
from glossa.session import table

#: The same in both dialects.
LINK = """l_orderkey * 10 + l_linenumber AS link_id, l_orderkey AS passage_id, l_suppkey AS reference_id, cast(l_linenumber - 1 as int) AS evidence_page_start, cast(l_quantity as int) AS evidence_page_end,
  CASE l_returnflag WHEN 'A' THEN 'normalized_exact_text' WHEN 'N' THEN 'local_passage_ocr_tolerant' ELSE 'other' END AS link_type,
  CASE l_linenumber % 4 WHEN 0 THEN 'machine_exact_unreviewed' WHEN 1 THEN 'human_verified' WHEN 2 THEN 'machine_ocr_tolerant_unreviewed' END AS verification_status,
  CASE WHEN l_linenumber % 5 = 0 THEN '' ELSE l_linestatus END AS matched_definition_text, CASE WHEN l_linenumber % 3 = 0 THEN '' ELSE 'a' || l_linenumber END AS article_locator,
  CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag END AS match_method, CASE WHEN l_linenumber % 6 = 0 THEN '' ELSE 'e' || l_linenumber END AS evidence_id"""
PASSAGE = "o_orderkey AS passage_key, o_custkey AS document_id, CASE WHEN o_orderkey % 9 = 0 THEN ' ' ELSE o_orderpriority END AS text_clean, CASE WHEN o_orderkey % 2 = 0 THEN 'p' || o_orderkey ELSE '' END AS article_number, cast(o_orderkey % 7 as int) AS pdf_page_start, cast(o_orderkey % 11 as int) AS pdf_page_end"
LAW = """s_suppkey AS law_key, CASE WHEN s_suppkey % 5 = 0 THEN 'not_in_force' WHEN s_suppkey % 7 = 0 THEN NULL ELSE 'in_force' END AS official_status_code, CASE WHEN s_suppkey % 6 = 0 THEN '' ELSE 'd' || s_suppkey END AS official_detail_url,
  'u' || s_suppkey AS official_document_url, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE s_name END AS official_title"""
DOCUMENT = "c_custkey AS document_key, CASE WHEN c_custkey % 8 = 0 THEN 'failed' ELSE 'success' END AS download_status, CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS requires_ocr, 'success' AS text_extraction_status"
JOINED = f"""
l AS (SELECT {LINK} FROM lineitem), p AS (SELECT {PASSAGE} FROM orders WHERE o_orderkey % 10 <> 0), r AS (SELECT {LAW} FROM supplier), d AS (SELECT {DOCUMENT} FROM customer),
j AS (SELECT * FROM l LEFT JOIN p ON passage_id = passage_key LEFT JOIN r ON reference_id = law_key LEFT JOIN d ON document_id = document_key)
"""


def named(df: DataFrame, columns: str) -> DataFrame:
    df.createOrReplaceTempView("glossa_named")
    return df.sparkSession.sql(f"SELECT {columns} FROM glossa_named")


def joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    links, laws = named(table(spark, sf_dir, "lineitem"), LINK), named(table(spark, sf_dir, "supplier"), LAW)
    passages, docs = named(table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 0"), PASSAGE), named(table(spark, sf_dir, "customer"), DOCUMENT)
    met = links.join(passages, F.col("passage_id") == F.col("passage_key"), "left").join(laws, F.col("reference_id") == F.col("law_key"), "left")
    met = met.join(docs, F.col("document_id") == F.col("document_key"), "left")
    return met.withColumns({"passage_id_found": F.col("passage_key"), "regulation_id_found": F.col("law_key"), "document_id_found": F.col("document_key")})


@query(f"""
WITH {JOINED} SELECT link_id, coalesce(passage_key IS NOT NULL AND law_key IS NOT NULL AND document_key IS NOT NULL AND link_type <> 'other' AND verification_status IS NOT NULL AND official_status_code = 'in_force'
  AND official_detail_url <> '' AND download_status = 'success' AND requires_ocr = false AND matched_definition_text <> '' AND trim(text_clean) <> '', false) AS actionable FROM j
""")
def link_actionability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each link may be acted on, by all eleven conditions."""
    return joined(spark, sf_dir).select("link_id", v.is_actionable().alias("actionable"))


@query(f"""
WITH {JOINED} SELECT link_id, coalesce(nullif(article_number, ''), nullif(article_locator, '')) AS article_locator, coalesce(nullif(evidence_page_start, 0), pdf_page_start) AS page_start, coalesce(nullif(evidence_page_end, 0), pdf_page_end) AS page_end,
  coalesce(official_title, '') AS regulation_title, coalesce(verification_status, '') AS verification_status, nullif(evidence_id, '') AS evidence_id, nullif(match_method, '') AS match_method FROM j WHERE passage_key IS NOT NULL AND law_key IS NOT NULL
""")
def evidence_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of the links whose passage and regulation are there; optional keys only if filled."""
    rows = joined(spark, sf_dir).withColumn("edge_id", F.lit(None).cast("string")).where("passage_key is not null and law_key is not null")
    e = rows.select("link_id", v.source_evidence().alias("e"))
    return e.select("link_id", *[f"e.{c}" for c in ("article_locator", "page_start", "page_end", "regulation_title", "verification_status", "evidence_id", "match_method")])


@query(f"""
WITH {JOINED} SELECT link_id, CASE WHEN match_method = 'N' THEN 'normalized_exact_text' ELSE 'local_passage_ocr_tolerant' END AS kind,
  coalesce(link_type = 'other' AND official_status_code = 'in_force' AND official_detail_url <> '' AND verification_status IN ('machine_exact_unreviewed', 'human_verified'), false) AS serving FROM j
""")
def serving_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Link types by match method, and the serving view's stricter rule."""
    rows = joined(spark, sf_dir).withColumns({"match_method": F.when(F.col("match_method") == "N", v.EXACT_METHOD).otherwise(F.col("match_method")), "primary_is_actionable": F.col("link_type") == "other", "regulation_id": F.col("reference_id")})
    ruled = rows.withColumn("serving", v.is_serving_actionable()).withColumnRenamed("link_id", "own_id").withColumn("passage_id", F.col("passage_id").cast("string"))
    return v.link_of_evidence(ruled).select(F.col("own_id").alias("link_id"), F.col("link_type").alias("kind"), "serving")


DEFINITIONS = "SELECT p_partkey AS record_id, CASE WHEN p_size % 3 = 0 THEN [p_partkey // 2, p_partkey // 3, p_partkey // 2] WHEN p_size % 3 = 1 THEN [] END AS records, CASE WHEN p_size % 2 = 0 THEN p_partkey // 5 END AS single FROM part"


@query(f"""
WITH d AS ({DEFINITIONS}) SELECT record_id, list_transform(CASE WHEN len(records) > 0 THEN list_sort(list_distinct(list_transform(records, lambda x: x::VARCHAR))) ELSE [coalesce(single, record_id)::VARCHAR] END, lambda x: x) AS ids FROM d
""")
def source_record_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source ids of each definition: the distinct listed ones, else the single one, else its own."""
    d = definitions(spark, sf_dir)
    return d.select("record_id", v.source_record_ids(F.col("records"), F.col("single"), F.col("record_id").cast("string")).alias("ids"))


def definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    listed = F.expr("case when p_size % 3 = 0 then array(cast(p_partkey div 2 as string), cast(p_partkey div 3 as string), cast(p_partkey div 2 as string)) when p_size % 3 = 1 then cast(array() as array<string>) end")
    return part.select(F.col("p_partkey").alias("record_id"), listed.alias("records"), F.expr("case when p_size % 2 = 0 then cast(p_partkey div 5 as string) end").alias("single"))


@query(f"""
WITH d AS ({DEFINITIONS}), i AS (SELECT record_id, unnest(CASE WHEN len(records) > 0 THEN list_distinct(records) ELSE [coalesce(single, record_id)] END) AS source_id FROM d),
l AS (SELECT l_partkey AS source_id, l_suppkey AS link_id, l_orderkey * 10 + l_linenumber AS position FROM lineitem)
SELECT record_id, link_id, count(DISTINCT source_id) AS sources FROM i JOIN l USING (source_id) GROUP BY 1, 2
""")
def definition_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each definition over its source ids, a link once, with the number of sources that name it."""
    d = definitions(spark, sf_dir)
    ids = d.select("record_id", v.source_record_ids(F.col("records"), F.col("single"), F.col("record_id").cast("string")).alias("source_ids"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("source_id"), F.col("l_suppkey").alias("link_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    kept = v.links_of_definitions(ids, links)
    n = ids.select("record_id", F.explode("source_ids").alias("source_id")).join(links, "source_id").groupBy("record_id", "link_id").agg(F.count_distinct("source_id").alias("sources"))
    return kept.select("record_id", "link_id").join(n, ["record_id", "link_id"])


@query("""
WITH d AS (SELECT p_partkey AS record_id, unnest([p_partkey // 2, p_partkey]) AS source_id, unnest([0, 1]) AS place FROM part), l AS (SELECT l_partkey AS source_id, l_suppkey AS link_id, l_orderkey * 10 + l_linenumber AS position FROM lineitem),
m AS (SELECT record_id, link_id, position, row_number() OVER (PARTITION BY record_id, link_id ORDER BY place, position) AS f, row_number() OVER (PARTITION BY record_id, link_id ORDER BY place DESC, position DESC) AS l FROM d JOIN l USING (source_id))
SELECT record_id, link_id, max(CASE WHEN f = 1 THEN position END) AS first_position, max(CASE WHEN l = 1 THEN position END) AS last_position FROM m GROUP BY 1, 2
""")
def link_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last row that count for a link of a definition."""
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), F.expr("array(p_partkey div 2, p_partkey)").alias("source_ids"))
    links = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("link_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    first = v.links_of_definitions(d, links, keep="first").select("record_id", "link_id", F.col("position").alias("first_position"))
    return first.join(v.links_of_definitions(d, links, keep="last").select("record_id", "link_id", F.col("position").alias("last_position")), ["record_id", "link_id"])


PRIMARY = "SELECT p_partkey AS g, p_size % 4 <> 0 AS available, p_partkey + 1 AS d, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END AS definition, [(p_partkey % 30)::BIGINT, (p_partkey % 7)::BIGINT] AS refs FROM part"


def primary(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    rows = part.select(
        F.col("p_partkey").cast("string").alias("term_group_id"), (F.col("p_size") % 4 != 0).alias("available"), (F.col("p_partkey") + 1).cast("string").alias("definition_id"),
        F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_type")).alias("definition"), F.lit(None).cast("string").alias("term"), F.array((F.col("p_partkey") % 30).cast("string"), (F.col("p_partkey") % 7).cast("string")).alias("reference_ids"),
    )
    own = part.where("p_size % 6 <> 0").select(F.col("p_partkey").cast("string").alias("definition_id"), F.col("p_name").alias("term"), F.col("p_brand").alias("definition"))
    laws = table(spark, sf_dir, "supplier").where("s_suppkey % 5 <> 4").select(F.col("s_suppkey").cast("string").alias("reference_id"), F.col("s_name").alias("reference_name"))
    return v.primary_entries(rows, own, laws)


OWN = "o AS (SELECT p_partkey AS d, p_name AS term, p_brand AS text FROM part WHERE p_size % 6 <> 0), s AS (SELECT s_suppkey AS r, s_name FROM supplier WHERE s_suppkey % 5 <> 4)"


@query(f"""
WITH p AS ({PRIMARY}), {OWN}, k AS (SELECT p.*, o.term, o.text FROM p LEFT JOIN o USING (d) WHERE available)
SELECT g::VARCHAR AS record_id, coalesce(term, '') AS term, coalesce(nullif(definition, ''), text, '') AS definition, (SELECT count(*) FROM unnest(refs) AS x(r) JOIN s USING (r)) AS known FROM k
""")
def primary_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Available primary rows as entries, with their known references."""
    entries = primary(spark, sf_dir)[0]
    return entries.select("record_id", "term", "definition", F.size(F.filter("references", lambda x: x["name"].isNotNull())).cast("long").alias("known"))


@query(f"""
WITH p AS ({PRIMARY}), {OWN}
SELECT g::VARCHAR AS term_group_id, 'missing definition ' || d AS error FROM p WHERE available AND definition = '' AND d NOT IN (SELECT d FROM o)
UNION ALL SELECT g::VARCHAR, 'missing regulation ' || r FROM (SELECT g, unnest(refs) AS r FROM p WHERE available) WHERE r NOT IN (SELECT r FROM s)
""")
def primary_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the primary rows name and nothing has."""
    return primary(spark, sf_dir)[1]


def concepts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as concepts, their line items as evidence, suppliers as regulations."""
    n = F.col("l_linenumber")
    item = F.struct(
        n.alias("position"), F.col("l_suppkey").alias("reference_id"), (n % 3 == 0).alias("is_actionable"), F.when(n % 4 == 0, "human_verified").otherwise("needs_review").alias("verification_status"),
        F.when(n % 5 != 0, F.lit("du")).alias("detail_url"), F.when(n % 2 == 0, F.lit("eu")).alias("document_url"), F.when(n % 2 == 1, F.concat(F.lit("t"), n.cast("string"))).alias("title"),
    )
    proof = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    refs = F.array(F.struct((F.col("o_custkey") % 40).alias("reference_id"), F.lit("named").alias("name"), F.lit("rt").alias("title"), F.lit("unknown").alias("status"), F.lit("ru").alias("document_url")))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("term"), F.col("o_orderpriority").alias("definition"), (F.col("o_orderkey") % 2 == 0).alias("actionable"), refs.alias("references"))
    c = orders.join(proof, F.col("o_orderkey") == F.col("l_orderkey"), "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(proof.schema["evidence"].dataType))).withColumnRenamed("o_orderkey", "record_id")
    laws = table(spark, sf_dir, "supplier").where("s_suppkey % 3 <> 0").select(
        F.col("s_suppkey").alias("reference_id"), F.col("s_name").alias("reference_name"), F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("title"), F.when(F.col("s_suppkey") % 5 != 0, "in_force").otherwise("not_in_force").alias("status"), F.lit("lu").alias("document_url")
    )
    return c, laws


@query("""
WITH e AS (SELECT l_orderkey AS k, l_linenumber AS n, l_suppkey AS r, row_number() OVER (PARTITION BY l_orderkey ORDER BY (l_linenumber % 3 = 0) DESC, l_linenumber, l_suppkey) AS k1 FROM lineitem),
v AS (SELECT l_orderkey AS k, bool_or(l_linenumber % 4 = 0) AS verified FROM lineitem GROUP BY 1),
s AS (SELECT s_suppkey AS r, s_name AS name, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS title, CASE WHEN s_suppkey % 5 <> 0 THEN 'in_force' ELSE 'not_in_force' END AS status FROM supplier WHERE s_suppkey % 3 <> 0),
c AS (SELECT o.*, e.n, coalesce(e.r, o_custkey % 40) AS r FROM orders o LEFT JOIN e ON e.k = o_orderkey AND k1 = 1)
SELECT o_orderkey AS record_id, coalesce(name, 'named') AS regulation, coalesce(title, CASE WHEN n % 2 = 1 THEN 't' || n END, 'rt') AS regulation_title, coalesce(CASE WHEN n % 2 = 0 THEN 'eu' END, CASE WHEN name IS NOT NULL THEN 'lu' END, 'ru') AS document_url,
  CASE WHEN verified THEN 'verified' ELSE 'legacy' END AS authority, coalesce(status, 'unknown') AS status, coalesce(o_orderkey % 2 = 0 AND status = 'in_force' AND n % 5 <> 0 AND n % 2 = 0, false) AS is_actionable
FROM c LEFT JOIN s USING (r) LEFT JOIN v ON v.k = o_orderkey
""")
def dictionary_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Serving rows: chosen evidence and reference, shown texts by three levels."""
    return v.dictionary_entries(*concepts(spark, sf_dir)).drop("term", "definition", "reference_id")


@query("""
WITH a AS (SELECT l_orderkey AS k, bool_or(l_linenumber % 3 = 0) AS proof, bool_or(l_suppkey <> o_custkey % 40) AS other FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
SELECT 'actionable-without-evidence' AS "check", count(*) FILTER (o_orderkey % 2 = 0 AND NOT coalesce(proof, false)) AS bad FROM orders LEFT JOIN a ON k = o_orderkey
UNION ALL SELECT 'evidence-of-unnamed-reference', count(*) FILTER (other) FROM a
""")
def evidence_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v.evidence_consistency(concepts(spark, sf_dir)[0])


@query("SELECT c_custkey FROM customer WHERE (c_custkey % 3 = 0 AND c_custkey % 2 = 0) OR c_custkey % 7 = 0")
def provenance_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that still tell where they were discovered."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(key % 3 == 0, F.when(key % 2 == 0, "x").otherwise("")).alias("source"), F.when(key % 7 == 0, F.array(F.lit("u"))).otherwise(F.array().cast("array<string>")).alias("urls"))
    return v.provenance_leaks(rows, "source", "urls").select("c_custkey")


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 7)")
def key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the asked keys, each once."""
    return v.lookup(table(spark, sf_dir, "part"), "p_partkey", table(spark, sf_dir, "lineitem").where("l_quantity = 7"), "l_partkey").select("p_partkey", "p_name")


@query("""
WITH e AS (SELECT trim(p_name || CASE WHEN p_size % 9 = 0 THEN ';' WHEN p_size % 8 = 0 THEN ' with a very long name' ELSE ' ' END) AS term, p_partkey AS o FROM part)
SELECT lower(term) AS key, arg_max(term, o) AS term FROM e WHERE length(term) BETWEEN 1 AND 25 AND NOT contains(term, ';') GROUP BY 1
""")
def term_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short terms that a start page may draw from."""
    end = F.when(F.col("p_size") % 9 == 0, ";").when(F.col("p_size") % 8 == 0, " with a very long name").otherwise(" ")
    return v.term_pool(table(spark, sf_dir, "part").select(F.concat("p_name", end).alias("p_name"), "p_partkey"), "p_name", "p_partkey")


@query("""
WITH a AS (SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN ['s' || p_size] ELSE [] END AS a, CASE WHEN p_size % 3 = 0 THEN ['s' || (p_size + 1), 's' || p_size] ELSE [] END AS e, CASE WHEN p_size % 2 = 0 THEN ['c' || p_size] ELSE [] END AS c, ['s' || p_size, 'z'] AS s FROM part)
SELECT id, CASE WHEN len(a) > 0 THEN 'definition' WHEN len(e) > 0 THEN 'evidence' WHEN len(c) > 0 THEN 'context' ELSE 'source' END AS attribution,
  array_to_string(list_filter(list_concat(a, e, c, s), lambda x, i: list_position(list_concat(a, e, c, s), x) = i), ',') AS refs FROM a
""")
def alternative_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ordered union of an alternative's four id lists, and what it is attributed by."""
    n = F.col("p_size")
    none = F.array().cast("array<string>")

    def ids(*values) -> F.Column:
        return F.array(*values)

    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.when(n % 4 == 0, ids(F.concat(F.lit("s"), n))).otherwise(none).alias("authority_ids"), F.when(n % 3 == 0, ids(F.concat(F.lit("s"), n + 1), F.concat(F.lit("s"), n))).otherwise(none).alias("evidence_ids"),
        F.when(n % 2 == 0, ids(F.concat(F.lit("c"), n))).otherwise(none).alias("context_ids"), ids(F.concat(F.lit("s"), n), F.lit("z")).alias("source_ids"),
    )
    return v.alternative_references(rows).select("id", "attribution", F.array_join("reference_ids", ",").alias("refs"))


@query("""
WITH i AS (SELECT p_partkey AS record_id, unnest([p_partkey % 30, p_partkey % 7]) AS reference_id, unnest([0, 1]) AS place FROM part), e AS (SELECT l_partkey AS record_id, l_suppkey AS reference_id, arg_min(l_orderkey, l_orderkey * 10 + l_linenumber) AS passage_id FROM lineitem GROUP BY 1, 2)
SELECT i.record_id, place, i.reference_id, s_name AS name, passage_id, o_orderpriority AS text FROM i JOIN supplier ON s_suppkey = i.reference_id LEFT JOIN e ON e.record_id = i.record_id AND e.reference_id = i.reference_id LEFT JOIN orders ON o_orderkey = passage_id
""")
def concept_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered references of a concept with their names, evidence and passages."""
    ids = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), F.array(F.col("p_partkey") % 30, F.col("p_partkey") % 7).alias("reference_ids"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("record_id"), F.col("l_suppkey").alias("reference_id"), F.col("l_orderkey").alias("passage_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"))
    laws = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("reference_id"), F.col("s_name").alias("reference_name"))
    return v.rehydrate(ids, laws, li, table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("passage_id"), F.col("o_orderpriority").alias("text")))


@query(f"""
WITH e AS (SELECT {norm("p_name")} AS key, p_partkey AS id, p_type, p_size, p_partkey % 20 AS ref FROM part),
b AS (SELECT key, list(p_type ORDER BY id) AS definitions, CASE WHEN bool_or(p_size > 25) THEN 'verified' ELSE 'legacy' END AS authority, CASE WHEN bool_or(p_size % 3 = 0) THEN 'in_force' WHEN bool_or(p_size % 3 = 1) THEN 'not_in_force' ELSE 'unknown' END AS status, bool_or(p_size > 40) AS is_actionable FROM e GROUP BY 1),
n AS (SELECT DISTINCT n_nationkey AS relation, unnest([n_nationkey, n_regionkey]) AS ref FROM nation), l AS (SELECT key, list_sort(list(DISTINCT relation)) AS relation_ids FROM (SELECT DISTINCT key, ref FROM e) JOIN n USING (ref) GROUP BY 1)
SELECT key, len(definitions) AS definitions, array_to_string(definitions[1:3], ',') AS first_three, authority, status, is_actionable, array_to_string(relation_ids, ',') AS relations FROM b LEFT JOIN l USING (key)
""")
def entry_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a term: definitions, authority, state and relations."""
    part = table(spark, sf_dir, "part")
    n = F.col("p_size")
    state = F.when(n % 3 == 0, "in_force").when(n % 3 == 1, "not_in_force").otherwise("unknown")
    entries = part.select(
        F.col("p_name").alias("term"), F.col("p_partkey").alias("entry_id"), F.col("p_type").alias("definition"), F.when(n > 25, "verified").otherwise("legacy").alias("authority"), state.alias("status"), (n > 40).alias("is_actionable"), (F.col("p_partkey") % 20).alias("reference_id")
    )
    relations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("relation_id"), F.col("n_nationkey").cast("long").alias("source_id"), F.col("n_regionkey").cast("long").alias("target_id"))
    none = spark.createDataFrame([], "term string, definition_id long, definition string"), spark.createDataFrame([], "term string, rank int, other string")
    out = v.detail(entries, none[0], relations, none[1])
    return out.select("key", F.size("definitions").cast("long").alias("definitions"), F.array_join(F.slice("definitions", 1, 3), ",").alias("first_three"), "authority", "status", "is_actionable", F.array_join("relation_ids", ",").alias("relations"))


@query("""
WITH f AS (SELECT o_orderkey AS k, o_custkey AS rev FROM orders), r AS (SELECT l_orderkey + CASE WHEN l_linenumber = 6 THEN 1000000 ELSE 0 END AS k, o_custkey + CASE WHEN l_linenumber = 5 THEN 1 ELSE 0 END AS rev FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber > 3),
n AS (SELECT *, count(*) OVER (PARTITION BY k) AS c FROM r)
SELECT DISTINCT k AS fixture_id, CASE WHEN c > 1 THEN 'duplicate' WHEN f.k IS NULL THEN 'unknown' ELSE 'stale' END AS error FROM n LEFT JOIN f USING (k) WHERE c > 1 OR f.k IS NULL OR f.rev <> n.rev
""")
def review_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that fit no fixture: repeated, unknown or of another revision."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("fixture_id"), F.col("o_custkey").alias("revision"), F.lit("d").alias("digest"))
    n = F.col("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber > 3").join(orders.select(F.col("fixture_id").alias("l_orderkey"), "revision"), "l_orderkey")
    reviews = rows.select((F.col("l_orderkey") + F.when(n == 6, 1000000).otherwise(0)).alias("fixture_id"), (F.col("revision") + F.when(n == 5, 1).otherwise(0)).alias("revision"), F.lit("d").alias("digest"))
    return v.review_errors(reviews, orders)


@query(f"SELECT n_name FROM nation WHERE {norm('n_name')} NOT IN (SELECT {norm('r_name')} FROM region) UNION ALL SELECT p_name FROM part WHERE p_size = 3 AND {norm('p_name')} NOT IN (SELECT {norm('p_name')} FROM part WHERE p_size > 40)")
def supplemental_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries whose term the other table lacks."""
    part = table(spark, sf_dir, "part")
    nations = table(spark, sf_dir, "nation").select("n_name")
    regions = table(spark, sf_dir, "region").select(F.col("r_name").alias("n_name"))
    rest = v.without_corpus_terms(part.where("p_size = 3").select(F.col("p_name").alias("n_name")), part.where("p_size > 40").select(F.col("p_name").alias("n_name")), "n_name")
    return v.without_corpus_terms(nations, regions, "n_name").union(rest)
