"""The corpus build and its checks: evidence joins, closures, uniqueness, foreign keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.session import Scratch


def first_filled(*columns: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns])


def missing_keys(rows: DataFrame, key: str, others: DataFrame, other_key: str, check: str) -> DataFrame:
    """(check, bad): how many rows name a key that the other table lacks."""
    known = others.select(F.col(other_key).alias(key)).distinct()
    return rows.where(F.col(key).isNotNull()).join(known, key, "left_anti").agg(F.count("*").alias("bad")).select(F.lit(check).alias("check"), "bad")


def repeated_keys(rows: DataFrame, keys: list[str], check: str) -> DataFrame:
    """(check, bad): how many keys stand in more than one row."""
    return rows.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("bad")).select(F.lit(check).alias("check"), "bad")


def both_ends(edges: DataFrame, nodes: DataFrame, source: str, target: str, key: str) -> DataFrame:
    """Edges whose both ends are among the nodes."""
    ids = nodes.select(F.col(key).alias("_id")).distinct()
    return edges.join(ids, edges[source] == ids["_id"], "left_semi").join(ids, edges[target] == ids["_id"], "left_semi")


def one_hop(edges: DataFrame, seeds: DataFrame, source: str, target: str, key: str) -> DataFrame:
    """The seeds and all ends of edges that touch one of them: exactly one step."""
    ids = seeds.select(F.col(key).alias("id")).distinct()
    out = edges.join(ids, edges[source] == ids["id"], "left_semi").select(F.col(target).alias("id"))
    back = edges.join(ids, edges[target] == ids["id"], "left_semi").select(F.col(source).alias("id"))
    return ids.union(out).union(back).distinct()


def undirected(edges: DataFrame, source: str, target: str, id_col: str) -> DataFrame:
    """(node, neighbour, edge): both directions of each edge, each edge once a node."""
    a = edges.select(F.col(source).alias("node"), F.col(target).alias("neighbour"), F.col(id_col).alias("edge"))
    return a.union(a.select(F.col("neighbour"), F.col("node"), "edge")).distinct()


def closure(edges: DataFrame, seeds: DataFrame, source: str, target: str, key: str) -> DataFrame:
    """All nodes that the seeds reach along the edges; a join per step until nothing is new.

    A step joins the last step's nodes alone, and what it finds is written to the shared folder.
    """
    scratch = Scratch(edges.sparkSession, "closure")
    pairs = scratch.cut(edges.select(F.col(source).alias("source"), F.col(target).alias("target")).distinct(), "edges")
    last = reached = scratch.cut(seeds.select(F.col(key).alias("id")).distinct(), "step0")
    step = 0
    while True:
        step += 1
        more = pairs.join(last, pairs["source"] == last["id"], "left_semi").select(F.col("target").alias("id")).distinct().join(reached, "id", "left_anti")
        last = scratch.cut(more, f"step{step}")
        if not last.limit(1).count():
            return reached
        reached = reached.union(last)


def evidence(links: DataFrame, passages: DataFrame, regulations: DataFrame) -> DataFrame:
    """Links with their passage and regulation, those lacking either dropped; a link id keeps its first row."""
    order = W.partitionBy("link_id").orderBy("position")
    first = links.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    joined = first.join(passages.withColumnRenamed("text", "passage_text"), "passage_id").join(regulations, "regulation_id")
    act = F.col("verified").eqNullSafe(True) & F.col("in_force").eqNullSafe(True) & F.col("requires_ocr").eqNullSafe(False) & (F.length(F.trim("passage_text")) > 0)
    return joined.withColumn("is_actionable", F.coalesce(act, F.lit(False)))


def build_pack(definitions: DataFrame, links: DataFrame, passages: DataFrame, regulations: DataFrame, relations: DataFrame) -> dict[str, DataFrame]:
    """The corpus tables: concepts with nested evidence, the regulations they need with one hop around, relations within, passages used."""
    proof = evidence(links, passages, regulations)
    item = F.struct("position", "link_id", "passage_id", "regulation_id", "is_actionable")
    nested = proof.groupBy("definition_id").agg(F.array_sort(F.collect_list(item)).alias("evidence"))
    concepts = definitions.join(nested, "definition_id", "left").withColumn("evidence", F.coalesce("evidence", F.array().cast(nested.schema["evidence"].dataType)))
    concepts = concepts.withColumn("actionable", F.exists("evidence", lambda e: e["is_actionable"]))
    named = proof.select("regulation_id").distinct()
    wanted = one_hop(relations, named, "source_id", "target_id", "regulation_id").withColumnRenamed("id", "regulation_id")
    kept = regulations.join(wanted, "regulation_id", "left_semi")
    return {
        "concepts": concepts,
        "regulations": kept,
        "relations": both_ends(relations, kept, "source_id", "target_id", "regulation_id"),
        "passages": passages.join(proof.select("passage_id").distinct(), "passage_id", "left_semi"),
    }


def reuse_vectors(definitions: DataFrame, old: DataFrame) -> DataFrame:
    """(definition_id, v): old vectors of equal term and definition, else of the only old row of the term; null if none."""
    exact = definitions.join(old.select("term", "definition", F.col("v").alias("same")).dropDuplicates(["term", "definition"]), ["term", "definition"], "left")
    single = old.groupBy("term").agg(F.count("*").alias("n"), F.any_value("v").alias("only")).where("n = 1").drop("n")
    return exact.join(single, "term", "left").select("definition_id", F.coalesce("same", "only").alias("v"))
