"""Operator 6: nearest neighbours by inner product over balanced posting lists.

Centroids, as many as the square root of the vectors' number at most, are fitted by balanced
k-means on a bounded sample (`sample` vectors, the parameter, or four for each list where those
are more); every vector is indexed. A vector goes to its nearest list and, if it lies near the
boundary, also to other lists (at most `replicas`). Centroids are searched by a graph in memory:
best-first over each centroid's nearest ones, in batches; a search that asks for a quarter of all
centroids compares them all. A query reads the lists whose centroid is no farther than `ratio`
times the nearest one's; the ratio is chosen on a bounded sample of queries, compared with all
vectors, as the least that finds `first` of their true neighbours. Lists are read until they hold
several times the asked number, whatever the ratio.

Distances to centroids say little about lists of unlike spread, so a second reading checks the
first: a query reads every other list that may hold something of at least its k-th score. A list
holds nothing above its centre's product plus its radius; below that it counts with its spread in
one direction times `reach`, which is chosen on the same sample as the least that finds `aim` of
all true neighbours, and nine tenths of them for nearly every query (`fair`).

For inner products, vectors get one more coordinate that makes all norms equal, queries a 0
there: the nearest by distance are then the largest by inner product. Lists are fitted and
searched with the largest norm as 1, and queries of norm 1, so the scale of the vectors does not
matter. Scores are inner products
of the original vectors in double precision, summed in one order wherever they are taken; ties
go to the smaller id.

All lists are dealt over shelves by a hash of the vector, so a long list fills no task, and
queries by their nearest list to parts of bounded size. A task streams one shelf's vectors, list
by list, past one part's queries and gives each query's k best of the shelf: what leaves the
lists grows with the queries, not with the lists they read.

Vectors that are null, zero, or hold null or non-finite components, rows without an id, and
vectors whose length is not the most frequent one take no part. An empty table gives no rows.
Every row is a candidate of its own and, if its id is divisible, a query of its own; a query
finds every row but itself, also rows that repeat its id. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.llm import common, vectors
from glossa.session import Scratch, broadcast_if_small

BROADCAST_ROWS = 200_000

#: Lists whose centre, with so many times their spread, reaches a query's k-th score are always read.
LEAST_REACH = 2.0


def _balanced(x: np.ndarray, count: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """k-means in which a cluster over its share of the sample repels further members."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), count, replace=False)].copy()
    push = np.zeros(count, x.dtype)
    share = len(x) / count
    for _ in range(rounds):
        near = np.concatenate([(((c * c).sum(1) + push) - 2 * b @ c.T).argmin(1) for b in np.array_split(x, max(1, len(x) // 4096))])
        sizes = np.bincount(near, minlength=count)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        full = sizes > 0
        c[full] = sums[full] / sizes[full, None]
        if not full.all():
            c[~full] = x[rng.choice(len(x), int((~full).sum()))]
        spread = float(((x - c[near]) ** 2).sum(1).mean())
        push += (0.1 * spread * (sizes / share - 1)).astype(x.dtype)
        push = np.clip(push, -0.5 * spread, 0.5 * spread)
    return c


def balanced_centroids(x: np.ndarray, count: int, together: int = 512) -> np.ndarray:
    """Balanced k-means; more than `together` centroids are fitted in two levels."""
    if count <= together:
        return _balanced(x, count)
    coarse = _balanced(x, math.isqrt(count))
    near = np.concatenate([((coarse * coarse).sum(1) - 2 * part @ coarse.T).argmin(1) for part in np.array_split(x, max(1, len(x) // 4096))])
    shares = np.bincount(near, minlength=len(coarse)) * (count / len(x))
    return np.concatenate([balanced_centroids(x[near == k], max(1, round(share)), together) for k, share in enumerate(shares) if share])


class CentroidGraph:
    """Centroids linked to their nearest ones; best-first search for batches of points."""

    #: Points searched together, and beam entries that a turn follows.
    TOGETHER, TURN = 256, 4

    def __init__(self, centroids: np.ndarray, degree: int = 16, seed: int = 0):
        self.c = centroids.astype(np.float64)
        self.norm = (self.c * self.c).sum(1)
        n = len(self.c)
        degree = min(degree, n - 1)
        rng = np.random.default_rng(seed)
        links = np.zeros((n, degree + 2), np.int64)
        for at in range(0, n, 1024):
            d = self.norm - 2 * self.c[at : at + 1024] @ self.c.T
            d[np.arange(len(d)), at + np.arange(len(d))] = np.inf
            if degree:
                links[at : at + 1024, :degree] = np.argpartition(d, degree - 1, axis=1)[:, :degree]
        links[:, degree:] = rng.integers(0, n, (n, 2))  # a few long links join far parts
        self.links = links
        self.entries = np.arange(n) if n <= 64 else rng.choice(n, 64, replace=False)

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1, keepdims=True) + self.norm - 2 * x @ self.c.T, 0))

    def search(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The `width` nearest centroids found and their distances, nearest first, for each row."""
        width = min(width, len(self.c))
        one = self._all if width * 4 >= len(self.c) else self._walk
        found = [one(x[at : at + self.TOGETHER], width) for at in range(0, max(1, len(x)), self.TOGETHER)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _all(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        d = self.distances(x)
        at = np.argpartition(d, width - 1, axis=1)[:, :width]
        return self._sorted(at, np.take_along_axis(d, at, 1))

    @staticmethod
    def _sorted(at: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(d, axis=1, kind="stable")
        return np.take_along_axis(at, order, 1), np.take_along_axis(d, order, 1)

    def _walk(self, x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        q, n = len(x), len(self.c)
        xx, rows = (x * x).sum(1), np.arange(q)[:, None]
        seen = np.zeros((q, n + 1), bool)
        seen[:, self.entries] = seen[:, n] = True  # n: no centroid
        at = np.tile(self.entries, (q, 1))
        d = np.maximum(xx[:, None] + self.norm[self.entries] - 2 * x @ self.c[self.entries].T, 0)
        done = np.zeros(at.shape, bool)
        beam = max(width, len(self.entries))
        while True:
            open_ = np.where(done, np.inf, d)
            pick = np.argpartition(open_, self.TURN - 1, axis=1)[:, : self.TURN]
            live = np.isfinite(np.take_along_axis(open_, pick, 1))
            if not live.any():
                break
            np.put_along_axis(done, pick, True, 1)
            reach = self.links[np.take_along_axis(at, pick, 1) % n]
            reach[~live] = n
            reach = np.sort(reach.reshape(q, -1), axis=1)
            fresh = ~seen[rows, reach]
            fresh[:, 1:] &= reach[:, 1:] != reach[:, :-1]
            i, k = np.nonzero(fresh)
            to = reach[i, k]
            seen[i, to] = True
            far = np.full(reach.shape, np.inf, d.dtype)
            far[i, k] = np.maximum(xx[i] + self.norm[to] - 2 * np.einsum("ij,ij->i", x[i], self.c[to]), 0)
            at, d, done = np.concatenate([at, reach], 1), np.concatenate([d, far], 1), np.concatenate([done, ~fresh], 1)
            best = np.argpartition(d, beam - 1, axis=1)[:, :beam]
            at, d, done = (np.take_along_axis(y, best, 1) for y in (at, d, done))
        at, d = self._sorted(at, d)
        return at[:, :width], np.sqrt(d[:, :width])


def norms(x: np.ndarray) -> np.ndarray:
    """Norms of rows that are not zero, whose squares may be too large or too small for a double."""
    peak = np.abs(x).max(1, initial=0)
    y = x / peak[:, None]
    return np.minimum(peak * np.sqrt((y * y).sum(1)), np.finfo(np.float64).max)


def lengthened(x: np.ndarray, most: float) -> np.ndarray:
    """Vectors with the largest norm as 1, and a coordinate that gives all of them this norm."""
    x = x / most
    return np.c_[x, np.sqrt(np.maximum(1 - (x * x).sum(1), 0))]


def asking(x: np.ndarray) -> np.ndarray:
    """Queries of norm 1 for `lengthened` vectors."""
    return np.c_[x / norms(x)[:, None], np.zeros(len(x))]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in one order of sums whatever stands around a row."""
    return (a * b).sum(1)


class Best:
    """Each query's k best candidates so far; a candidate that comes from several lists counts once."""

    def __init__(self, floor: np.ndarray, k: int, room: int = 200_000):
        self.k, self.room = k, room
        self.floor = floor
        self.held, self.count = [], 0

    def add(self, q: np.ndarray, score: np.ndarray, id_: np.ndarray, row: np.ndarray) -> None:
        if len(q):
            self.held.append((q, score, id_, row))
            self.count += len(q)
        if self.count > self.room:
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, ...]:
        if not self.held:
            return tuple(np.empty(0, t) for t in (np.int64, np.float64, np.int64, np.int64))
        q, score, id_, row = (np.concatenate(x) for x in zip(*self.held))
        order = np.lexsort((row, id_, -score, q))
        q, score, id_, row = q[order], score[order], id_[order], row[order]
        new = np.r_[True, (q[1:] != q[:-1]) | (row[1:] != row[:-1])]  # one row has one score and one id: its copies stand together
        q, score, id_, row = q[new], score[new], id_[new], row[new]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        last = place == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], score[last])
        top = place < self.k
        out = q[top], score[top], id_[top], row[top]
        self.held, self.count = [out], int(top.sum())
        self.room = max(self.room, 2 * self.count)
        return out


def _streamed(length: int, dtype, k: int):
    """Rows sorted by group, kind (0: queries, 1: vectors) and list to (query row, query id, score, id, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        group, queries, best = None, [], None

        def out() -> Iterator[tuple]:
            if best is not None:
                q, score, id_, row = best.shrink()
                yield rows[q], ids[q], score, id_, row

        for batch in batches:
            g, kind, list_ = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero((g[1:] != g[:-1]) | (kind[1:] != kind[:-1]) | (list_[1:] != list_[:-1])) + 1
            for start, end in zip([0, *cuts], [*cuts, len(g)]):
                if start == end:
                    continue
                if g[start] != group:
                    yield from out()
                    group, queries, best = g[start], [], None
                part = batch.slice(start, end - start)
                if kind[start] == 0:
                    queries.append(part)
                    continue
                if not queries:
                    continue
                if best is None:
                    told = pa.Table.from_batches(queries).combine_chunks()
                    rows, ids = told["row"].to_numpy(), told["id"].to_numpy()
                    x = vectors.matrix(told["x"], dtype, length).astype(np.float64)
                    size = norms(x)
                    read = told["lists"].combine_chunks()
                    who = np.repeat(np.arange(len(rows)), read.value_lengths().to_numpy())
                    which = read.flatten().to_numpy()
                    order = np.argsort(which, kind="stable")
                    who, which = who[order], which[order]
                    best = Best(told["floor"].to_numpy().copy(), k)
                mine = who[slice(*np.searchsorted(which, [list_[start], list_[start] + 1]))]
                if not len(mine):
                    continue
                row, id_ = part.column("row").to_numpy(), part.column("id").to_numpy()
                v = vectors.matrix(part.column("x"), dtype, length).astype(np.float64)
                large = norms(v)
                for at in range(0, len(row), 1024):
                    s = x[mine] @ v[at : at + 1024].T
                    s[rows[mine][:, None] == row[None, at : at + 1024]] = -np.inf
                    least = best.floor[mine][:, None]
                    if s.shape[1] > k:
                        least = np.maximum(least, -np.partition(-s, k - 1, axis=1)[:, k - 1 : k])
                    # sums in another order may differ in the last bits, and ties stay
                    doubt = 1e-15 * (length + 8) * size[mine] * large[at : at + 1024].max()
                    i, j = np.nonzero((s >= least - doubt[:, None]) & np.isfinite(s))
                    best.add(mine[i], products(x[mine[i]], v[at + j]), id_[at + j], row[at + j])
        yield from out()

    return run


def nearest(
    rows: DataFrame,
    *,
    every: int = 20,
    k: int = 20,
    list_size: int = 128,
    sample: int = 20_000,
    replicas: int = 3,
    boundary: float = 1.05,
    first: float = 0.8,
    aim: float = 0.98,
    fair: float = 0.99,
    audit: int = 128,
    shelf: int = 1 << 17,
    part: int = 1024,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    report: dict | None = None,
) -> DataFrame:
    """Each query's k nearest found: query_id, rank, vec_id, score. Queries: rows whose id is divisible by `every`.

    `shelf` and `part` are the vectors and queries of one task; neither changes the result.

    `report`, if given, is told the number of lists, the ratio, the reach, the recall on the audit's queries, and how many copies of queries are dealt.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark, "lists")
    given = rows.select(rows[id_col].cast("long").alias("id"), rows[vector_col].alias("e"))
    good = given.where(vectors.valid_vectors(given, "e") & F.col("id").isNotNull())
    length = vectors.main_length(good, "e")

    dtype = np.float32 if good.schema["e"].dataType.simpleString() == "array<float>" else np.float64

    def pack(batches):
        for batch in batches:
            x = vectors.list_matrix(batch.column(1), length)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x.astype(dtype)], pa.binary()), pa.array(norms(x))], ["id", "x", "norm"])

    good = common.arrow_pass(good.where(F.size("e") == length), pack, "id long, x binary, norm double")
    good = scratch.cut(good.withColumn("row", F.monotonically_increasing_id()), "vectors")
    n, most = good.agg(F.count("*"), F.max("norm")).first()
    asked = good.where(F.pmod("id", F.lit(every)) == 0)
    result = "query_id long, rank int, vec_id long, score double"
    if n < 2:
        return spark.createDataFrame([], result)

    # fit on a bounded sample, chosen by a hash of the row
    lists = max(1, min(n // list_size, math.isqrt(n)))
    size = max(sample, 4 * lists)
    rate = min(1.0, size / n)
    fitted = good.where(F.pmod(F.xxhash64("row"), F.lit(1_000_000)) < int(rate * 1_000_000) + (rate == 1.0)).select("x").limit(size).toPandas()
    train = lengthened(np.stack([np.frombuffer(v, dtype) for v in fitted["x"]]).astype(np.float64), most) if len(fitted) else np.zeros((1, length + 1), np.float32)
    graph = CentroidGraph(balanced_centroids(train, min(lists, len(train))))
    lists = len(graph.c)
    sent = spark.sparkContext.broadcast(graph)

    def index(batches):
        g = sent.value
        for batch in batches:
            x = vectors.matrix(batch.column(2), dtype, length).astype(np.float64)
            at, d = g.search(lengthened(x, most), max(8, 2 * replicas))
            keep = d <= d[:, :1] * boundary + 1e-12
            keep[:, replicas:] = False
            i, j = np.nonzero(keep)
            off = x[i] / most - g.c[at[i, j], :-1]
            off = np.where(j == 0, np.sqrt((off * off).sum(1)), np.nan)
            columns = [pa.array(at[i, j].astype(np.int32)), *(batch.column(c).take(pa.array(i)) for c in range(3)), pa.array(off, from_pandas=True)]
            yield pa.RecordBatch.from_arrays(columns, ["list", "row", "id", "x", "off"])

    # off: how far a vector is from the centre of the first of its lists, null in the others
    postings = scratch.cut(common.arrow_pass(good.select("row", "id", "x"), index, "list int, row long, id long, x binary, off double"), "postings")
    sizes, spread, radius = np.zeros(lists, np.int64), np.zeros(lists), np.full(lists, -np.inf)
    for at, count, square, far in postings.groupBy("list").agg(F.count("*"), F.avg(F.col("off") * F.col("off")), F.max("off")).collect():  # a row for each list
        sizes[at] = count
        if far is not None:
            spread[at], radius[at] = math.sqrt(square / length), far
    centre = graph.c[:, :-1]
    doubt = 1e-12 * (np.sqrt((centre * centre).sum(1)) + np.maximum(radius, 0))  # of products and radii

    def lists_read(g: CentroidGraph, q: np.ndarray, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """(lists, read) of lengthened queries: the search widens until its farthest list is beyond the ratio."""
        width = 64
        while True:
            at, d = g.search(q, width)
            if width >= len(g.c) or (d[:, -1] > d[:, 0] * ratio).all():
                break
            width *= 2
        held = np.cumsum(sizes[at], axis=1)
        return at, (d <= d[:, :1] * ratio) | (held - sizes[at] < 4 * (k + 1))

    # the audit's queries and their true neighbours
    queries = asked.count()
    some = asked.select("row", "x").where(F.pmod(F.xxhash64("row"), F.lit(max(1, queries // audit))) == 0).limit(2 * audit).toPandas()
    ratio, true = np.inf, None
    if len(some) and lists > 1:
        q = np.stack([np.frombuffer(v, dtype) for v in some["x"]]).astype(np.float64)
        own = some["row"].to_numpy()
        asked_of = spark.sparkContext.broadcast((own, q))

        def compare(batches):
            own, q = asked_of.value
            for batch in batches:
                row = batch.column(0).to_numpy()
                s = vectors.matrix(batch.column(1), dtype, length).astype(np.float64) @ q.T
                s[row[:, None] == own[None, :]] = -np.inf
                top = np.argpartition(-s, min(k, len(s) - 1), axis=0)[:k]
                j = np.broadcast_to(np.arange(len(own)), top.shape)
                fine = np.isfinite(s[top, j])
                yield pa.RecordBatch.from_arrays([pa.array(j[fine]), pa.array(row[top][fine]), pa.array(s[top, j][fine])], ["q", "row", "score"])

        true = common.arrow_pass(good.select("row", "x"), compare, "q long, row long, score double")
        true = true.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "row"))).where(F.col("r") <= k)
        true = true.join(postings.select("row", "list", "off"), "row").select("q", "row", "list", "off").toPandas()
        # the ratio: how far the lists of the true neighbours are
        d = graph.distances(asking(q))
        true["far"] = (d / np.maximum(d.min(1, keepdims=True), 1e-12))[true["q"].to_numpy(), true["list"].to_numpy()]
        far = np.sort(true.groupby(["q", "row"])["far"].min().to_numpy())
        if len(far):
            ratio = float(far[min(len(far) - 1, int(np.ceil(first * len(far))) - 1)]) * (1 + 1e-6)
    if report is not None:
        report.update(lists=lists, ratio=ratio, reach=0.0, recall=1.0, mean_size=float(sizes.mean()))

    # queries of one part have near first lists, so a list's vectors meet few parts
    first = np.argsort((graph.c - graph.c.mean(0)) @ np.linalg.svd(graph.c - graph.c.mean(0), full_matrices=False)[2][0])
    order = np.empty(lists, np.int64)
    order[first] = np.arange(lists)
    parts = max(2, -(-queries // part))
    # lists that are near lie on one shelf; a shelf of more than `shelf` rows (one long list can be that) is split by
    # row, and a query goes to the cells of those lists alone that it reads
    shelves = min(lists, max(8, n // shelf))
    shelf_of = order * shelves // lists
    splits = np.maximum(1, -(-np.bincount(shelf_of, weights=sizes, minlength=shelves).astype(np.int64) // shelf))
    base = np.cumsum(splits) - splits

    def cells_of(read: np.ndarray) -> np.ndarray:
        return np.concatenate([np.arange(base[s], base[s] + splits[s]) for s in np.unique(shelf_of[read])])

    def route(batches):
        g = sent.value
        for batch in batches:
            x = vectors.matrix(batch.column(2), dtype, length).astype(np.float64)
            at, read = lists_read(g, asking(x), ratio)
            near = pa.array((order[at[:, 0]] * parts // lists).astype(np.int64))
            named = [np.sort(a[r]).astype(np.int32) for a, r in zip(at, read)]
            cells = pa.array([cells_of(a) for a in named], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([near, batch.column(0), batch.column(1), batch.column(2), pa.array(named, pa.list_(pa.int32())), cells], ["near", "row", "id", "x", "lists", "cells"])

    routed = common.arrow_pass(asked.select("row", "id", "x"), route, "near long, row long, id long, x binary, lists array<int>, cells array<long>")
    routed = scratch.cut(routed, "routed")
    # a part that many queries are near to is split again
    crowds = routed.groupBy("near").agg(F.ceil(F.count("*") / part).alias("splits"))
    routed = routed.join(broadcast_if_small(crowds, BROADCAST_ROWS), "near").withColumn("p", F.xxhash64("near", F.expr("pmod(xxhash64(row), splits)")))
    routed = scratch.cut(routed.withColumn("floor", F.lit(float("-inf"))).drop("near", "splits"), "asked")
    cells = spark.createDataFrame(list(zip(range(lists), base[shelf_of].tolist(), splits[shelf_of].tolist())), "list int, base long, splits long")  # a row for each list
    shelved = postings.join(broadcast_if_small(cells, BROADCAST_ROWS), "list").withColumn("s", F.col("base") + F.expr("pmod(xxhash64(row), splits)"))
    names, types = ["q", "query_id", "score", "vec_id", "row"], [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
    run = _streamed(length, dtype, k)

    def met(routed: DataFrame, name: str) -> DataFrame:
        """What queries find in the lists that they read: at most k vectors of each cell, of at least the query's floor."""
        reads = scratch.cut(routed.select("p", F.explode("lists").alias("list")).distinct(), name)
        some = shelved.join(broadcast_if_small(reads, BROADCAST_ROWS), "list").select(
            F.xxhash64("p", "s").alias("g"), F.lit(1).alias("kind"), "list", "row", "id", "x", F.lit(None).cast("array<int>").alias("lists"), F.lit(None).cast("double").alias("floor")
        )
        asks = routed.withColumn("s", F.explode("cells")).select(F.xxhash64("p", "s").alias("g"), F.lit(0).alias("kind"), F.lit(0).alias("list"), "row", "id", "x", "lists", "floor")
        dealt = asks.union(some).repartition("g").sortWithinPartitions("g", "kind", "list")
        return common.arrow_pass(dealt, lambda b: vectors.batched(run(b), names, types), "q long, query_id long, score double, vec_id long, row long")

    def ranked(found: DataFrame) -> DataFrame:
        # a vector that several lists hold may come from several cells, with one score: it has one place
        place = F.dense_rank().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id", "row"))
        return found.withColumn("rank", place).where(F.col("rank") <= k).dropDuplicates(["q", "rank"])

    found = scratch.cut(ranked(met(routed, "reads")), "first")
    floors = found.where(F.col("rank") == k).select(F.col("q").alias("row"), F.col("score").alias("least"))

    # the reach: how far beyond their lists' centres the true neighbours are that the first reading missed
    reach = LEAST_REACH
    if true is not None:
        held = found.where(F.col("q").isin(own.tolist())).select("q", "row", "rank", "score").toPandas()
        least = held[held["rank"] == k].set_index("q")["score"].reindex(own).fillna(-np.inf).to_numpy() / norms(q) / most
        had = set(zip(held["q"], held["row"]))
        true = true[true["off"].notna()]
        who, list_ = true["q"].to_numpy(), true["list"].to_numpy()
        need = least[who] - (asking(q)[who, :-1] * centre[list_]).sum(1) - doubt[list_]
        need = np.where(need <= 0, 0, need / np.maximum(spread[list_], 1e-300))
        need[[pair in had for pair in zip(own[who], true["row"])]] = 0
        if len(need):
            reach = max(reach, float(np.quantile(need, aim, method="higher")))
            each = true.assign(need=need).groupby("q")["need"].quantile(0.9, interpolation="higher")
            reach = min(max(reach, float(np.quantile(each, fair, method="higher"))) * (1 + 1e-6), 1e9)
            if report is not None:
                report.update(reach=reach, recall=float((need <= reach).mean()))

    def route_again(batches):
        c, most_in = centre.T, np.minimum(radius, reach * spread) + doubt
        for batch in batches:
            x = vectors.matrix(batch.column("x"), dtype, length).astype(np.float64)
            least = batch.column("least").to_numpy(zero_copy_only=False) / norms(x) / most
            named = []
            for at in range(0, len(x), 256):
                more = asking(x[at : at + 256])[:, :-1] @ c + most_in >= least[at : at + 256, None]
                for row, read in zip(more, batch.column("lists").slice(at, 256).to_pylist()):
                    row[read] = False
                    named.append(np.flatnonzero(row).astype(np.int32))
            some = pa.array(np.flatnonzero([len(a) for a in named]))
            named = [a for a in named if len(a)]
            columns = [*(batch.column(i).take(some) for i in ("p", "row", "id", "x")), pa.array(named, pa.list_(pa.int32())), pa.array([cells_of(a) for a in named], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, batch.column("least").take(some)], ["p", "row", "id", "x", "lists", "cells", "floor"])

    again = routed.join(floors, "row", "left").select("p", "row", "id", "x", "lists", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    again = common.arrow_pass(again, route_again, "p long, row long, id long, x binary, lists array<int>, cells array<long>, floor double")
    again = scratch.cut(again, "again")
    if report is not None:
        report["copies"] = sum(r.agg(F.sum(F.size("cells"))).first()[0] or 0 for r in (routed, again))
    best = ranked(found.drop("rank").union(met(again, "reads_again")))
    return best.select("query_id", "rank", "vec_id", "score")
