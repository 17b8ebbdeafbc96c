"""Documents to paragraphs, cells, headings, sections, sentences and segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.functions import text as t


def paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, pos, start, end, text): non-blank lines, trimmed, with their code-point ranges.

    One shuffle by document: line ends and places are running sums over its lines.
    """
    lines = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line", "raw"))
    so_far = W.partitionBy("doc_id").orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow)
    filled = F.trim("raw") != ""
    own = lines.withColumns({"upto": F.sum(F.length("raw") + 1).over(so_far), "pos": F.sum(filled.cast("int")).over(so_far) - 1}).where(filled)
    start = F.col("upto") - 1 - F.length(F.ltrim("raw"))
    kept = own.select("doc_id", F.col("pos").cast("int").alias("pos"), "line", start.cast("int").alias("start"), F.trim("raw").alias("text"))
    return kept.select("doc_id", "pos", "line", "start", (F.col("start") + F.length("text")).alias("end"), "text")


def cells(rows: DataFrame, text_col: str, sep: str = "\t") -> DataFrame:
    """Each row's cells with their place."""
    return rows.select("*", F.posexplode(F.split(F.col(text_col), sep, -1)).alias("cell_no", "cell"))


def headings(paras: DataFrame) -> DataFrame:
    """Paragraphs with `level` (null for body text), `kind` and the `chapter` and `article` above them."""
    level = t.heading_level(F.col("text"))
    kind = F.when(level == 1, "chapter").when(level == 2, "article").when(F.col("text").rlike(r"^(\d+[.)]|[a-z][.)]|[-*•])\s"), "item").otherwise("paragraph")
    so_far = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = paras.withColumns({"level": level, "kind": kind})
    out = out.withColumn("chapter_pos", F.last(F.when(F.col("level") == 1, F.col("pos")), ignorenulls=True).over(so_far))
    # an article ends where a chapter begins
    article = F.last(F.when(F.col("level") == 2, F.col("pos")), ignorenulls=True).over(so_far)
    out = out.withColumn("_a", article)
    return out.withColumn("article_pos", F.when(F.coalesce(F.col("_a") > F.col("chapter_pos"), F.col("_a").isNotNull()), F.col("_a"))).drop("_a")


def sections(heads: DataFrame) -> DataFrame:
    """Headings with the range of positions they cover: up to the next heading of their level or a higher one."""
    only = heads.where("level is not null")
    after = W.partitionBy("doc_id").orderBy("pos").rowsBetween(1, W.unboundedFollowing)
    same = F.min(F.when(F.col("level") == 1, F.col("pos"))).over(after)
    any_ = F.min("pos").over(after)
    last = heads.groupBy("doc_id").agg((F.max("pos") + 1).alias("size"))
    return only.withColumn("next", F.when(F.col("level") == 1, same).otherwise(any_)).join(last, "doc_id").select("doc_id", "pos", "level", "text", F.coalesce("next", "size").alias("end_pos"))


def siblings(paras: DataFrame, section: Column) -> DataFrame:
    """The previous and next paragraph within a section."""
    w = W.partitionBy("doc_id", F.coalesce(section.cast("string"), F.lit("root"))).orderBy("pos")
    return paras.withColumns({"prev_pos": F.lag("pos").over(w), "next_pos": F.lead("pos").over(w)})


def occurrence_no(paras: DataFrame, *keys: str) -> DataFrame:
    """Zero-based number among rows of a document with equal keys."""
    return paras.withColumn("occurrence", F.row_number().over(W.partitionBy("doc_id", *keys).orderBy("pos")) - 1)


def innermost(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """Each (doc_id, pos) with the last section (doc_id, pos, end_pos) that holds it."""
    r = ranges.select("doc_id", F.col("pos").alias("from_pos"), "end_pos")
    held = points.join(r, "doc_id").where((F.col("from_pos") <= F.col("pos")) & (F.col("pos") < F.col("end_pos")))
    best = held.groupBy("doc_id", "pos").agg(F.max("from_pos").alias("section_pos"))
    return points.join(best, ["doc_id", "pos"], "left")


def sentences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, sentence): text cut behind closing marks and at line ends; an approximation by pattern."""
    cut = F.split(F.regexp_replace(F.col(text_col), r"([.!?])\s+", "$1\n"), "\n")
    flat = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.filter(F.transform(cut, lambda x: F.trim(x)), lambda x: x != "")).alias("n", "sentence"))
    return flat


def turn_context(rows: DataFrame, group: str, order: str, text_col: str) -> DataFrame:
    """Rows with the text before and after them in their group."""
    w = W.partitionBy(group).orderBy(order)
    return rows.withColumns({"prev_text": F.lag(text_col).over(w), "next_text": F.lead(text_col).over(w)})


def islands(rows: DataFrame, group: str, order: str, flag: Column, least: int = 2) -> DataFrame:
    """(group, first, last, n): runs of at least `least` consecutive rows with the flag."""
    w = W.partitionBy(group).orderBy(order)
    marked = rows.withColumns({"_f": F.coalesce(flag, F.lit(False)), "_n": F.row_number().over(w)})
    run = marked.where("_f").withColumn("_g", F.col("_n") - F.row_number().over(w))
    return run.groupBy(group, "_g").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("_g")


def batches(rows: DataFrame, group: str, order: Column, size: int = 12) -> DataFrame:
    """Rows with the number of their batch of `size` in their group."""
    return rows.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(group).orderBy(order)) - 1) / size))


def duplicate_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, word, n): tokens that directly repeat the one before, by array functions within the row."""
    ws = t.tokens(F.col(text_col))
    base = docs.select(F.col(id_col).alias("doc_id"), ws.alias("ws"))
    pairs = F.filter(F.transform("ws", lambda w, i: F.when((i > 0) & (w == F.get("ws", i - 1)), w)), lambda w: w.isNotNull())
    return base.select("doc_id", F.explode(pairs).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


def repeated_ngrams(docs: DataFrame, id_col: str, text_col: str, n: int = 6) -> DataFrame:
    """(doc_id, ratio): share of repeated n-grams of a document; 0 below n tokens. Within the row, without a shuffle."""
    base = docs.select(F.col(id_col).alias("doc_id"), t.tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("ws"))
    size = F.size("ws")
    # n-grams by 64-bit hashes, which are compared within a document alone
    grams = F.transform(F.sequence(F.lit(1), size - (n - 1)), lambda i: F.xxhash64(F.slice("ws", i, n)))
    counted = base.select("doc_id", F.when(size >= n, grams).alias("g"))
    ratio = (F.size("g") - F.size(F.array_distinct("g"))) / F.size("g")
    return counted.select("doc_id", F.round(F.coalesce(ratio, F.lit(0.0)), 6).alias("ratio"))


def document_order(docs: DataFrame, owner: str, created: str, id_col: str) -> DataFrame:
    """Documents with their `place` among their owner's: by creation, then by id as text; without a time first."""
    return docs.withColumn("place", F.row_number().over(W.partitionBy(owner).orderBy(F.col(created).asc_nulls_first(), F.col(id_col).cast("string"))))
