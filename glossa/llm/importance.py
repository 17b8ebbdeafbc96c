"""Importance resampling towards a target distribution, in DataFrame functions alone.

Word n-grams of the corpus and of the target are hashed into buckets. A bucket's gain is the scaled
log ratio of its smoothed shares; a document's weight is the mean gain of its n-grams; Gumbel noise
from a digest of its id turns "the highest scores" into a weighted draw without replacement.

- Counts are grouped sums over exploded n-grams, added up within each task before the shuffle: at most `buckets`
  rows leave a task, whatever the corpus, and a frequent n-gram is one of them.
- The gain table has `buckets` rows (a parameter), which bounds its broadcast.
- Ranks come from a range-partitioned sort: each row's place in its partition plus the sizes of the
  partitions before it. No window holds all rows in one task; ties are parted by id and row, so
  one score or id that most rows share still spreads over the partitions.

Defined results: a null or wordless text has no n-grams and weight 0; every row is a document, also where ids
or texts repeat; a null id is drawn as the empty text and comes last among ties; an empty
corpus gives no rows, an empty target gives the gains of T = 0. Very long texts are one row
throughout. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.session import Scratch

#: Fixed by the contract: what parts words, once A-Z are lower-case.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text in order; none for null. Lower-casing covers A-Z alone."""
    return F.filter(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER), NOT_WORD), lambda w: w != "")


def ngrams(tokens: Column, shortest: int, longest: int) -> Column:
    """All runs of `shortest` to `longest` words, joined by one space, repeats kept."""
    if shortest == longest == 1:
        return tokens

    def of(w: Column, n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        return F.when(F.size(w) >= n, runs).otherwise(F.array().cast("array<string>"))

    # bound by a lambda, so that the words are split once a text and not once a run
    return F.transform(F.array(tokens), lambda w: F.concat(*[of(w, n) for n in range(shortest, longest + 1)]))[0]


def bucket(feature: Column, buckets: int) -> Column:
    """The unsigned crc32 of the UTF-8 bytes, modulo `buckets`."""
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def bucket_counts(texts: DataFrame, text_col: str, buckets: int, shortest: int, longest: int) -> DataFrame:
    """(bucket, n) over all n-grams of a table."""
    grams = texts.select(F.explode(ngrams(words(texts[text_col]), shortest, longest)).alias("feature"))
    return grams.groupBy(bucket(F.col("feature"), buckets).alias("bucket")).agg(F.count("*").alias("n"))


def gain_table(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) for every bucket from counts (bucket, n) of the corpus and of the target."""
    both = source.select("bucket", F.col("n").alias("s"), F.lit(0).alias("t")).union(target.select("bucket", F.lit(0), "n"))
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).alias("s"), F.lit(0).alias("t"))
    counts = every.union(both).groupBy("bucket").agg(F.sum("s").cast("double").alias("s"), F.sum("t").cast("double").alias("t"))
    S, T = both.agg(F.coalesce(F.sum("s"), F.lit(0)), F.coalesce(F.sum("t"), F.lit(0))).first()
    return counts.select("bucket", F.floor(1000 * F.ln((F.col("t") + 1) * float(S + buckets) / ((F.col("s") + 1) * float(T + buckets)))).alias("gain"))


def gumbel(seed: int, key: Column) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 8 hex digits of sha256(`seed:key`)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, scratch: Scratch, order: list[Column], name: str) -> DataFrame:
    """`rows` with `rank` from 1 in `order`, which must leave no ties that matter, by a range-partitioned sort.

    monotonically_increasing_id holds the partition above 33 bits of the place within it. The numbered rows are
    written, so that places and sizes come from one sort. The sizes are one row a partition.
    """
    placed = rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = scratch.cut(placed, name)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(part.alias("_part")).count().orderBy("_part").collect()  # one row a partition of the sort
    before, offsets = 0, []
    for row in sizes:
        offsets.append((row["_part"], before))
        before += row["count"]
    offset = placed.sparkSession.createDataFrame(offsets, "_part long, _before long")
    return placed.withColumn("_part", part).join(F.broadcast(offset), "_part").withColumn("rank", F.col("_before") + place + 1).drop("_part", "_before", "_at")


def resample(
    docs: DataFrame, target: DataFrame, *, buckets: int = 10_000, shortest: int = 1, longest: int = 1, percent: int = 10, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """One row per document: id, n_features, weight, score, rank (null where not drawn).

    floor(percent * N / 100) of the N documents with at least `least_words` words are drawn.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "importance")
    source_counts = scratch.cut(bucket_counts(docs, text_col, buckets, shortest, longest), "source")
    target_counts = scratch.cut(bucket_counts(target, target_col, buckets, shortest, longest), "target")
    gains = gain_table(source_counts, target_counts, buckets)

    numbered = docs.select(docs[id_col].alias("id"), words(docs[text_col]).alias("w")).withColumn("row", F.monotonically_increasing_id())
    grams = numbered.select("row", "id", F.size("w").alias("words"), F.explode_outer(ngrams(F.col("w"), shortest, longest)).alias("feature"))
    met = grams.select("row", "id", "words", bucket(F.col("feature"), buckets).alias("bucket")).join(F.broadcast(gains), "bucket", "left")
    summed = met.groupBy("row").agg(F.first("id").alias("id"), F.first("words").alias("words"), F.count("bucket").alias("n_features"), F.sum("gain").alias("gain"))
    # the exact quotient, rounded down below zero too
    weight = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0)).cast("long")
    scored = summed.select("row", "id", "words", "n_features", weight.alias("weight"), (weight + gumbel(seed, F.col("id"))).cast("long").alias("score"))
    scored = scratch.cut(scored, "scored")

    able = F.col("words") >= least_words
    draw = percent * scored.where(able).count() // 100
    order = [F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("row").asc()]
    drawn = ranked(scored.where(able), scratch, order, "placed").withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    out = drawn.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))
    return out.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
