"""What several operators share: Arrow passes, word memos, tokenizer files, components."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.session import Scratch

#: Rows of one Arrow batch: with texts of 100 kB each a batch stays near 40 MB.
BATCH_ROWS = 400


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small enough for a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of `rows` narrow rows for what runs within."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Memo(dict):
    """A dict that computes what it lacks and holds at most about 2 * `most` entries, all of keys of up to `longest` characters.

    When full, the current entries become the old generation; an old entry that is
    asked for again moves back, the rest go with the next turn. Longer keys (a text without spaces can be one)
    are computed each time, so that memory is bounded by bytes too.
    """

    def __init__(self, compute: Callable, most: int = 250_000, longest: int = 64):
        super().__init__()
        self.compute, self.most, self.longest, self.old = compute, most, longest, {}

    def __missing__(self, key):
        if len(key) > self.longest:
            return self.compute(key)
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def tokenizer_bytes(name_or_path: str) -> bytes:
    """A vocabulary file's content, read on the driver; workers get it by broadcast.

    The files are a few MB, whatever the corpus.
    """
    with open(name_or_path, "rb") as f:
        return f.read()


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: What a Python worker keeps between its tasks, by a name that includes the content's digest: the last thing only.
_kept: dict[str, object] = {}


def keep(name: str, make: Callable[[], object]) -> object:
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def texts(column: pa.Array) -> list[str]:
    """A text column as strings, null as the empty text."""
    return [x or "" for x in column.to_pylist()]


def arrow_pass(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(f, schema)


def most_frequent(counts: DataFrame, count: str, most: int) -> DataFrame:
    """The rows of the highest counts, as many whole steps of counts as `most` rows hold.

    A histogram of counts in steps of a 32nd of a doubling (a few thousand rows at most)
    gives the least count; no rows are sorted or gathered in one task. If the highest step alone
    has more rows than `most`, there are none.
    """
    step = F.floor(F.log2(F.col(count)) * 32)
    seen, least = 0, None
    for at, rows in sorted(counts.groupBy(step.alias("k")).count().collect(), reverse=True):
        seen += rows
        if seen > most:
            break
        least = at
    return counts.where(F.lit(False)) if least is None else counts.where(step >= least)


#: Up to so many distinct edges (8 MB), one task finds their components.
ONE_TASK_EDGES = 500_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        top = x
        while root[top] != top:
            top = root[top]
        while root[x] != top:
            root[x], x = top, root[x]
        return top

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            root.setdefault(u, u)
            root.setdefault(v, v)
            a, b = find(u), find(v)
            root[max(a, b)] = min(a, b)
    nodes = list(root)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(map(find, nodes), pa.int64())], ["node", "root"])


def components(edges: DataFrame, scratch: Scratch, name: str = "cc", one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """Connected components of `edges`(a, b), as (node, root) with the smallest node as root.

    Up to `one_task` distinct edges are counted and joined in one task; beyond, by
    alternating large-star and small-star steps: each is a min per node and a join back,
    so no neighbourhood is ever gathered in one row. State is cut to the shared folder
    after each step. Only nodes with an edge are returned. Nulls and loops are ignored.
    """
    spark = edges.sparkSession
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, step, last = scratch.cut(now, f"{name}0"), 0, None
    if now.count() <= one_task:
        return arrow_pass(now.coalesce(1), _union_find, "node long, root long")
    while True:
        # large star: every larger neighbour of u goes to the least of u and its neighbours
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.u", "e.v").where("u <> v").distinct()
        )
        step += 1
        now = scratch.cut(small, f"{name}{step}")
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}{step - 1}")
        if state == last:
            break
        last = state
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
