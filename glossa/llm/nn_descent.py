"""Operator 5: embedding near-duplicates by NN-descent.

Equal vectors are one node. The neighbour graph starts from random-hyperplane buckets, then
each round joins neighbours of neighbours: every node's neighbours, forward and reverse, meet
at that node, are compared with each other where one of them is new there, and improve one
another's lists of `k` nearest. Meeting places of many members (hubs, dense buckets) are
split at random into parts of about `part` members, so no group grows with the data.

Listed pairs at or over the threshold, confirmed in double precision, join nodes to
components. A list whose every entry is over the threshold is saturated: it can't hold all
links, and those it lacks may lead to other components. Nodes of saturated lists therefore
descend again among themselves, by lists that hold no node of their own component, until
no link joins two components any more. Links within a component are then counted by comparing
its nodes in blocks, of which only counts leave. An audit compares a bounded sample of about `audit`
nodes, another one each round, with all others. It judges what the descent found by itself:
while pairs over the threshold that any audit has met are apart, the descent goes on from new
buckets, each of which may part a pair that others kept together. Only where a caller sets
`most_rounds` it may end before: a warning then gives the recall of the last audit, and the pairs
still apart, known to be links, are joined. Audit, edges and counts take one function for the
cosine (`vectors.cosines`), so a pair at the very threshold is a link to all of them or to none.

Vectors that are null, zero, or hold null or non-finite components, and those whose
length differs from the most frequent one, link with nothing and keep themselves. An
empty table gives no rows; rows that repeat an id count as further vectors. Other columns
are not read.
"""

from __future__ import annotations

import itertools
import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.llm import common, vectors
from glossa.session import Scratch

#: Half precision in the descent: pairs this far below the threshold are still confirmed.
SLACK = 0.01


def _local_join(k: int, length: int):
    """Groups of (g, node, x, floor, fresh, apart) to improvements (u, v, s) between nodes that differ in `apart`."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for group in vectors.groups(batches):
            size = group.num_rows
            if size < 2:
                continue
            node = group.column("node").to_numpy()
            x = vectors.matrix(group.column("x"), np.float16, length).astype(np.float32)
            fresh, apart = group.column("fresh").to_numpy(), group.column("apart").to_numpy()
            s = x @ x.T
            s[~(fresh[:, None] | fresh[None, :])] = -2
            s[s <= group.column("floor").to_numpy()[:, None]] = -2
            s[apart[:, None] == apart[None, :]] = -2
            if size - 1 > k:
                least = np.partition(s, size - k, axis=1)[:, size - k]
                s[s < least[:, None]] = -2
            i, j = np.nonzero(s > -2)
            yield node[i], node[j], s[i, j]

    def run(batches):
        return vectors.batched(pairs(batches), ["u", "v", "s"], [pa.int64(), pa.int64(), pa.float32()])

    return run


def _buckets(tables: int, bits: int, length: int, seed: int):
    planes = np.random.default_rng(seed).normal(size=(length, tables * bits)).astype(np.float32)

    def run(batches):
        for batch in batches:
            x = vectors.matrix(batch.column(1), np.float16, length).astype(np.float32)
            node = batch.column(0).to_numpy()
            sign = (x @ planes > 0).reshape(len(x), tables, bits)
            code = sign @ (1 << np.arange(bits, dtype=np.int64)) + (np.arange(tables, dtype=np.int64) << 40)
            yield pa.RecordBatch.from_arrays([pa.array(code.ravel()), pa.array(np.repeat(node, tables))], ["c", "node"])

    return run


def _block_counts(length: int, threshold: float):
    """Groups of (g, first, node, copies, x) to linked copies (node, links) between two blocks."""

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for group in vectors.groups(batches):
            x = vectors.matrix(group.column("x"), np.float64, length)
            node, copies, side = (group.column(c).to_numpy() for c in ("node", "copies", "side"))
            a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            if (side == 2).all():
                near = vectors.near(x, x, threshold)
                np.fill_diagonal(near, False)
                yield node, (near * copies).sum(1)
            elif len(a) and len(b):
                near = vectors.near(x[a], x[b], threshold)
                yield node[a], (near * copies[b]).sum(1)
                yield node[b], (near * copies[a][:, None]).sum(0)

    def run(batches):
        return vectors.batched(counts(batches), ["node", "links"], [pa.int64(), pa.int64()])

    return run


def near_duplicates(
    rows: DataFrame,
    *,
    threshold: float = 0.9,
    k: int = 10,
    tables: int = 4,
    part: int = 64,
    sweeps: int = 4,
    block: int = 512,
    audit: int = 256,
    most_rounds: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    report: dict | None = None,
) -> DataFrame:
    """One row per vector: id, n_links, component_id (the smallest id reachable), kept.

    `report` is given the rounds and the recall: the share of the last audit's links that
    the descent had joined.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "nn")
    given = rows.select(rows[id_col].alias("id"), rows[vector_col].alias("e"))
    good = given.where(vectors.valid_vectors(given, "e") & F.col("id").isNotNull())
    length = vectors.main_length(good, "e")
    good = good.where(F.size("e") == length)
    classes = good.groupBy("e").agg(F.min("id").alias("least"), F.count("*").alias("copies")).withColumn("node", F.monotonically_increasing_id())

    def pack(batches):
        for batch in batches:
            x = vectors.list_matrix(batch.column(3), length)
            unit = (x / np.sqrt((x * x).sum(1, keepdims=True))).astype(np.float16)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([r.tobytes() for r in unit], pa.binary()), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(3)],
                ["node", "least", "copies", "x", "full", "e"],
            )

    kinds = f"node long, least {good.schema['id'].dataType.simpleString()}, copies long, x binary, full binary, e {good.schema['e'].dataType.simpleString()}"
    nodes = scratch.cut(common.arrow_pass(classes.select("node", "least", "copies", "e"), pack, kinds), "nodes")
    n = nodes.count()
    light = nodes.select("node", "x")

    def meet(members: DataFrame, lists: DataFrame | None, step: int) -> DataFrame:
        """(c, node, fresh, apart) to improvements of the members' lists."""
        sizes = members.groupBy("c").agg(F.count("*").alias("m"), F.max("fresh").alias("any"), (F.min("apart") < F.max("apart")).alias("mixed")).where("any and mixed")
        parts = F.pmod(F.xxhash64("node", F.lit(step)), F.ceil(F.col("m") / part))
        split = members.join(sizes, "c").select(F.xxhash64("c", parts, F.lit(step)).alias("g"), "node", "fresh", "apart")
        if lists is None:
            split = split.withColumn("floor", F.lit(-1.0).cast("float"))
        else:
            floors = lists.groupBy("u").agg(F.min("s").alias("low"), F.count("*").alias("have"))
            floors = floors.select(F.col("u").alias("node"), F.when(F.col("have") >= k, F.col("low")).otherwise(-1.0).cast("float").alias("floor"))
            split = split.join(floors, "node", "left").withColumn("floor", F.coalesce("floor", F.lit(-1.0).cast("float")))
        dealt = split.join(light, "node").select("g", "node", "x", "floor", "fresh", "apart").repartition("g").sortWithinPartitions("g")
        return common.arrow_pass(dealt, _local_join(k, length), "u long, v long, s float")

    def merge(lists: DataFrame | None, found: DataFrame) -> DataFrame:
        both = found.select("u", "v", "s", F.lit(True).alias("new"))
        if lists is not None:
            both = both.union(lists.select("u", "v", "s", F.lit(False)))
        best = both.groupBy("u", "v").agg(F.max("s").alias("s"), F.min("new").alias("fresh"))
        place = F.row_number().over(W.partitionBy("u").orderBy(F.desc("s"), "v"))
        return best.withColumn("at", place).where(F.col("at") <= k).select("u", "v", "s", "fresh")

    def around(lists: DataFrame) -> DataFrame:
        """Every node's neighbours, forward and reverse, as (c, node, fresh)."""
        ways = lists.select(F.col("u").alias("c"), F.col("v").alias("node"), "fresh").union(lists.select(F.col("v").alias("c"), F.col("u").alias("node"), "fresh"))
        return ways.groupBy("c", "node").agg(F.max("fresh").alias("fresh"))

    def confirmed(lists: DataFrame) -> DataFrame:
        """Pairs at or over the threshold in double precision."""
        close = lists.where(F.col("s") >= threshold - SLACK).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
        full = nodes.select("node", "full")
        both = close.join(full.select(F.col("node").alias("a"), F.col("full").alias("xa")), "a").join(full.select(F.col("node").alias("b"), F.col("full").alias("xb")), "b")

        def check(batches):
            for batch in batches:
                a, b = (vectors.matrix(batch.column(i), np.float64, length) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(vectors.cosines(a, b))], ["a", "b", "cosine"])

        return common.arrow_pass(both.select("a", "b", "xa", "xb"), check, "a long, b long, cosine double").where(F.col("cosine") >= threshold).select("a", "b")

    def across(lists: DataFrame, edges: DataFrame, roots: DataFrame, round_: int) -> tuple[DataFrame, DataFrame]:
        """Edges and roots with the links between components that saturated lists had no place for.

        A link that is in neither end's list has two saturated ends, so only these take part.
        They meet by the lists they have, and fill new ones with nodes of other components only.
        """
        ends = lists.groupBy("u").agg(F.min("s").alias("low"), F.count("*").alias("have"))
        full = ends.where((F.col("have") >= k) & (F.col("low") >= threshold - SLACK)).select(F.col("u").alias("node"))
        full = scratch.cut(full, f"full{round_}")
        m = full.count()
        few = max(1, int(np.log2(max(2, m / (part / 2)))))
        known = lists.join(full.select(F.col("node").alias("u")), "u").join(full.select(F.col("node").alias("v")), "v").select("u", "v")
        known = scratch.cut(known, f"known{round_}")
        turn = 0
        while True:
            name = f"{round_}_{turn}"
            homes = scratch.cut(full.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("apart")), f"homes{name}")
            if homes.select("apart").distinct().limit(2).count() < 2:
                return edges, roots
            hashed = common.arrow_pass(light.join(homes, "node").select("node", "x"), _buckets(tables, few, length, 1000 * (turn + 1) + round_), "c long, node long")
            other = scratch.cut(merge(None, meet(hashed.withColumn("fresh", F.lit(True)).join(homes, "node"), None, turn)), f"other{name}_0")
            for sweep in range(1, sweeps + 1):
                ways = around(other.select("u", "v", "fresh").union(known.withColumn("fresh", F.lit(sweep == 1))))
                other = scratch.cut(merge(other, meet(ways.join(homes, "node"), other, turn + sweep)), f"other{name}_{sweep}")
                scratch.drop(f"other{name}_{sweep - 1}")
                if other.where("fresh").count() <= 0.01 * k * m:
                    break
            found = scratch.cut(confirmed(other), f"found{name}")
            if not found.count():
                return edges, roots
            edges = scratch.cut(found.union(edges).distinct(), f"wider{name}")
            roots = scratch.cut(common.components(edges, scratch, f"ww{name}_"), f"wider_roots{name}")
            turn += 1

    def audited(round_: int) -> DataFrame:
        """Pairs over the threshold of the sample's nodes with any other."""
        rate = max(1, n // audit)
        some = nodes.where(F.pmod(F.xxhash64("node", F.lit(round_)), F.lit(rate)) == 0).select("node", "full").limit(2 * audit).toPandas()
        if not len(some):
            return nodes.where("false").select(F.col("node").alias("a"), F.col("node").alias("b"))
        x = np.stack([np.frombuffer(v, np.float64) for v in some["full"]])
        sent = spark.sparkContext.broadcast((some["node"].to_numpy(), x))

        def compare(batches):
            ids, q = sent.value
            for batch in batches:
                y = vectors.matrix(batch.column(1), np.float64, length)
                node = batch.column(0).to_numpy()
                near = vectors.near(y, q, threshold)
                near &= node[:, None] != ids[None, :]
                i, j = np.nonzero(near)
                yield pa.RecordBatch.from_arrays([pa.array(node[i]), pa.array(ids[j])], ["a", "b"])

        return common.arrow_pass(nodes.select("node", "full"), compare, "a long, b long")

    def apart(links: DataFrame, roots: DataFrame) -> DataFrame:
        """Links between different components."""
        place = roots.select("node", "root")
        at = links.join(place.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(place.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
        return at.where(~F.coalesce(F.col("ra") == F.col("rb"), F.lit(False))).select("a", "b")

    bits = max(1, int(np.log2(max(2, n / (part / 2)))))
    lists, edges, missed, step = None, None, None, 0
    for round_ in itertools.count() if most_rounds is None else range(most_rounds):
        hashed = common.arrow_pass(light, _buckets(tables, bits, length, round_), "c long, node long").withColumn("fresh", F.lit(True)).withColumn("apart", F.col("node"))
        lists = scratch.cut(merge(lists, meet(hashed, lists, step)), f"lists{step}")
        for _ in range(sweeps):
            step += 1
            members = around(lists).withColumn("apart", F.col("node"))
            lists = scratch.cut(merge(lists, meet(members, lists, step)), f"lists{step}")
            scratch.drop(f"lists{step - 1}")
            if lists.where("fresh").count() <= 0.01 * k * n:
                break
        step += 1
        found = confirmed(lists)
        edges = scratch.cut(found if edges is None else found.union(edges).distinct(), f"edges{round_}")
        roots = scratch.cut(common.components(edges, scratch, f"cc{round_}_"), f"roots{round_}")
        edges, roots = across(lists, edges, roots, round_)
        links = scratch.cut(audited(round_), f"audit{round_}")
        total, lost = links.count(), apart(links, roots).count()
        # what earlier audits met counts until the descent has joined it too
        missed = scratch.cut(apart(links if missed is None else links.union(missed), roots), f"missed{round_}")
        left = missed.count()
        if report is not None:
            report.update(rounds=round_ + 1, recall=1 - lost / total if total else 1.0)
        if not left:
            break
    else:
        warnings.warn(f"after {most_rounds} rounds {left} audited links join components that the descent left apart; it had joined {total - lost} of the last audit's {total}", stacklevel=2)
        roots = scratch.cut(common.components(edges.union(missed), scratch, "dd"), "all_roots")

    # counts of links: whole components, in blocks of nodes compared pair by pair
    placed = roots.join(nodes.select("node", "copies", "full"), "node")
    sizes = roots.groupBy("root").agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / block)
    own = placed.join(sizes, "root").withColumn("blocks", blocks).withColumn("i", F.pmod(F.xxhash64("node"), F.col("blocks")))
    each = own.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    side = F.when(F.col("i") == F.col("j"), 2).when(F.col("i") < F.col("j"), 0).otherwise(1).cast("int")
    dealt = each.select(F.xxhash64("root", F.least("i", "j"), F.greatest("i", "j")).alias("g"), "node", "copies", side.alias("side"), F.col("full").alias("x"))
    counts = common.arrow_pass(dealt.repartition("g").sortWithinPartitions("g"), _block_counts(length, threshold), "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))
    least = roots.join(nodes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("component_id"))
    home = roots.join(least, "root").join(counts, "node", "left").select("node", "component_id", F.coalesce("links", F.lit(0)).alias("links"))
    home = nodes.join(home, "node", "left").select("e", F.coalesce("component_id", "least").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    home = scratch.cut(home, "home")
    linked = good.join(home, "e").select(F.col("id").alias(id_col), "n_links", "component_id")
    bad = given.where(~(vectors.valid_vectors(given, "e") & F.col("id").isNotNull() & F.coalesce(F.size("e") == length, F.lit(False))))
    out = linked.union(bad.select("id", F.lit(0).cast("long"), "id"))
    return out.select(id_col, "n_links", "component_id", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)).alias("kept"))
