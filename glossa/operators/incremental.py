"""What changed between two versions, what must be analysed again, and old results at new places."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.functions import text as t
from glossa.session import Scratch, broadcast_if_small

BROADCAST_ROWS = 500_000


def content_duplicates(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, first_id): later documents of equal content, by hash.

    Texts are hashed once; ids and hashes are written, and only hashes that repeat meet their rows again.
    """
    h = docs.select(F.col(id_col).alias("doc_id"), F.unhex(t.content_hash(F.coalesce(F.col(text_col), F.lit("")))).alias("h"))
    h = Scratch(docs.sparkSession, "duplicates").cut(h, "hashes")
    first = broadcast_if_small(h.groupBy("h").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n"), BROADCAST_ROWS)
    return h.join(first, "h").where("doc_id <> first_id").select("doc_id", "first_id")


def import_duplicates(docs: DataFrame, id_col: str, text_col: str, created: str) -> DataFrame:
    """(id, action, of): keep the first document of each content, by `created` and id; later ones are duplicates of it, told by
    their file if their bytes are equal, else by their content.

    Equal bytes are equal content, so one grouping by content decides both. Only ids and digests are shuffled. A null text is the empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(created).alias("created"), F.unhex(F.sha2(text, 256)).alias("file"), F.unhex(t.content_hash(text)).alias("content"))
    rows = Scratch(docs.sparkSession, "import").cut(rows, "digests")
    first = rows.groupBy("content").agg(F.min(F.struct("created", "id", "file")).alias("first"), F.count("*").alias("n"))
    several = broadcast_if_small(first.where("n > 1").drop("n"), BROADCAST_ROWS)
    met = rows.join(several, "content", "left")
    later = F.col("first").isNotNull() & (F.struct("created", "id") != F.struct("first.created", "first.id"))
    action = F.when(~later, "keep").when(F.col("file") == F.col("first.file"), "file-duplicate").otherwise("content-duplicate")
    return met.select(F.col("id").alias(id_col), action.alias("action"), F.when(later, F.col("first.id")).alias("of"))


def refresh(old: DataFrame, new: DataFrame, results: DataFrame, find: Callable[[DataFrame], DataFrame], keys: list[str], scratch: Scratch) -> DataFrame:
    """(segment_id, start, end, original): a new version's findings, found again only in segments that no old one stands for.

    `old` and `new` hold (segment_id, start, text) and `keys`; `results` the old findings (segment_id, start, end, original), places within
    the segment, and `find` gives such findings for segments. Reused findings must still stand at their place. Places returned
    are the document's. Segments without a change keep their findings wherever they moved to.
    """
    mapping = scratch.cut(map_segments(old, new, keys, "segment_id"), "mapping")
    kept = rematerialise(results.withColumnRenamed("segment_id", "old_id"), mapping, new).withColumnRenamed("new_id", "segment_id")
    again = mapping.where("new_id IS NOT NULL AND (old_id IS NULL OR ambiguous)").select(F.col("new_id").alias("segment_id"))
    fresh = find(new.join(again, "segment_id", "left_semi")).join(new.select("segment_id", F.col("start").alias("base")), "segment_id")
    return kept.unionByName(fresh.select("segment_id", (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("end")).alias("end"), "original"))


def map_segments(old: DataFrame, new: DataFrame, keys: list[str], order: str, id_col: str = "segment_id") -> DataFrame:
    """(keys, old_id, new_id, ambiguous): equal groups are paired by order; groups of unequal size are ambiguous.

    A segment of one side alone has no partner.
    """

    def numbered(df: DataFrame, name: str) -> DataFrame:
        w = W.partitionBy(*keys)
        return df.select(*keys, F.col(id_col).alias(f"{name}_id"), F.row_number().over(w.orderBy(order)).alias("rn"), F.count("*").over(w).alias(f"{name}_n"))

    both = numbered(old, "old").join(numbered(new, "new"), [*keys, "rn"], "full_outer")
    w = W.partitionBy(*keys)
    n_old, n_new = F.max("old_n").over(w), F.max("new_n").over(w)
    both = both.withColumn("ambiguous", F.coalesce(n_old != n_new, F.lit(False)))
    return both.select(*keys, F.when(~F.col("ambiguous") | F.col("new_id").isNull(), F.col("old_id")).alias("old_id"), "new_id", "ambiguous").where("new_id is not null or not ambiguous")


def with_neighbours(segments: DataFrame, group: list[str], order: str, impacted: str) -> DataFrame:
    """Segments with `again`: impacted, or next to one that is (one step, from the original set)."""
    w = W.partitionBy(*group).orderBy(order).rowsBetween(-1, 1)
    return segments.withColumn("again", F.max(F.col(impacted)).over(w))


def plan(old: DataFrame, new: DataFrame, keys: list[str], order: str, id_col: str = "segment_id") -> DataFrame:
    """(id, action): reuse, reprocess or removed for every segment of the two versions."""
    mapping = map_segments(old, new, keys, order, id_col)
    action = F.when(F.col("new_id").isNull(), "removed").when(F.col("old_id").isNotNull() & ~F.col("ambiguous"), "reuse").otherwise("reprocess")
    return mapping.select(F.coalesce("new_id", "old_id").alias(id_col), "old_id", action.alias("action"))


def rematerialise(results: DataFrame, mapping: DataFrame, segments: DataFrame) -> DataFrame:
    """Results (old_id, start, end, original) at their new places, kept only where the original text still stands there.

    `segments` holds (segment_id, start, text) of the new version.
    """
    at = results.join(mapping.where("new_id is not null and old_id is not null and not ambiguous").select("old_id", "new_id"), "old_id")
    seg = segments.select(F.col("segment_id").alias("new_id"), F.col("start").alias("base"), F.col("text").alias("whole"))
    moved = at.join(seg, "new_id").where(F.substring("whole", F.col("start") + 1, F.col("end") - F.col("start")) == F.col("original"))
    return moved.select("new_id", (F.col("base") + F.col("start")).alias("start"), (F.col("base") + F.col("end")).alias("end"), "original")


def changed_ranges(old: DataFrame, new: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, start, end, new_end): the part between the common prefix and suffix of two versions."""
    a = old.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("a"))
    b = new.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("b"))
    both = a.join(b, "doc_id").where("a <> b").withColumn("r", t.change_range(F.col("a"), F.col("b")))
    return both.select("doc_id", F.col("r.prefix").alias("start"), (F.length("a") - F.col("r.suffix")).alias("end"), (F.length("b") - F.col("r.suffix")).alias("new_end"))
