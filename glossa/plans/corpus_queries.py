"""Corpus-shaped joins over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.operators import corpus as c
from glossa.plans.registry import query
from glossa.session import table


@query("""
SELECT 'lineitem-orders' AS "check", count(*) AS bad FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey)
UNION ALL SELECT 'orders-customer', count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)
UNION ALL SELECT 'labels-documents', count(*) FROM labels WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = labels.doc_id)
UNION ALL SELECT 'documents-unique', count(*) FROM (SELECT doc_id FROM documents GROUP BY 1 HAVING count(*) > 1)
UNION ALL SELECT 'turns-unique', count(*) FROM (SELECT conv_id, turn FROM conversations GROUP BY 1, 2 HAVING count(*) > 1)
""")
def fk_suite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreign keys and uniqueness, one row a check."""
    def tb(name: str) -> DataFrame:
        return table(spark, sf_dir, name)

    checks = [
        c.missing_keys(tb("lineitem"), "l_orderkey", tb("orders"), "o_orderkey", "lineitem-orders"),
        c.missing_keys(tb("orders"), "o_custkey", tb("customer"), "c_custkey", "orders-customer"),
        c.missing_keys(tb("labels"), "doc_id", tb("documents"), "doc_id", "labels-documents"),
        c.repeated_keys(tb("documents"), ["doc_id"], "documents-unique"),
        c.repeated_keys(tb("conversations"), ["conv_id", "turn"], "turns-unique"),
    ]
    out = checks[0]
    for check in checks[1:]:
        out = out.union(check)
    return out


EDGES = "SELECT l_orderkey * 10 + l_linenumber AS edge, l_partkey AS source_id, l_suppkey AS target_id FROM lineitem"


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge"), F.col("l_partkey").alias("source_id"), F.col("l_suppkey").alias("target_id"))


@query(f"SELECT * FROM ({EDGES}) WHERE source_id IN (SELECT p_partkey FROM part WHERE p_size < 20) AND target_id IN (SELECT p_partkey FROM part WHERE p_size < 20)")
def both_endpoint_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations with both ends in the selected set."""
    return c.both_ends(edges(spark, sf_dir), table(spark, sf_dir, "part").where("p_size < 20"), "source_id", "target_id", "p_partkey")


@query(f"""
WITH e AS ({EDGES}), s AS (SELECT p_partkey AS id FROM part WHERE p_size = 1)
SELECT id FROM s UNION SELECT target_id FROM e WHERE source_id IN (SELECT id FROM s) UNION SELECT source_id FROM e WHERE target_id IN (SELECT id FROM s)
""")
def one_hop_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.one_hop(edges(spark, sf_dir), table(spark, sf_dir, "part").where("p_size = 1"), "source_id", "target_id", "p_partkey")


@query(f"WITH e AS ({EDGES}) SELECT source_id AS node, target_id AS neighbour, edge FROM e UNION SELECT target_id, source_id, edge FROM e")
def undirected_adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c.undirected(edges(spark, sf_dir), "source_id", "target_id", "edge")


@query(f"""
WITH RECURSIVE e AS (SELECT DISTINCT source_id, target_id FROM ({EDGES})), r AS (SELECT p_partkey AS id FROM part WHERE p_size = 1 UNION SELECT target_id FROM e JOIN r ON e.source_id = r.id)
SELECT id FROM r
""")
def definition_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that the seeds reach over all edges: the fixpoint behind drafting checks."""
    return c.closure(edges(spark, sf_dir), table(spark, sf_dir, "part").where("p_size = 1"), "source_id", "target_id", "p_partkey")


@query("""
SELECT p_brand, count(*) AS suppliers_named, list_sort(list(DISTINCT s_nationkey)) AS nations FROM part JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ON l_partkey = p_partkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1
""")
def evidence_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set union of references by term: nations of the suppliers behind each brand."""
    links = table(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").distinct()
    part, supplier = table(spark, sf_dir, "part").select("p_partkey", "p_brand"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    joined = links.join(part, links["l_partkey"] == part["p_partkey"]).join(supplier, links["l_suppkey"] == supplier["s_suppkey"])
    return joined.groupBy("p_brand").agg(F.count("*").alias("suppliers_named"), F.array_sort(F.collect_set("s_nationkey")).alias("nations"))


@query("SELECT (SELECT count(*) FROM part) AS concepts, (SELECT count(*) FROM supplier) AS regulations, (SELECT count(*) FROM nation) AS institutions, (SELECT count(*) FROM part WHERE p_size >= 25) AS actionable")
def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the pack, some conditional, in one row; each table is scanned once."""
    part = table(spark, sf_dir, "part").agg(F.count("*").alias("concepts"), F.count_if(F.col("p_size") >= 25).alias("actionable"))
    return part.crossJoin(table(spark, sf_dir, "supplier").agg(F.count("*").alias("regulations"))).crossJoin(table(spark, sf_dir, "nation").agg(F.count("*").alias("institutions")))


@query("SELECT n_nationkey, coalesce(nullif(trim(n_name), ''), 'none') AS name, r_name FROM nation LEFT JOIN region ON r_regionkey = n_regionkey")
def reference_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference's shown name: the first filled of several columns, empty counting as missing."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    name = c.first_filled(F.trim("n_name"), F.lit("none"))
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"], "left").select("n_nationkey", name.alias("name"), "r_name")
