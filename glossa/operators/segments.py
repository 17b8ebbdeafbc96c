"""Paragraphs to review segments: sentences, long ones cut at falling kinds of border, with places and neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Longer sentences are cut; segments of more word tokens are too long to review.
MOST_UNITS, MOST_TOKENS = 2048, 512
#: Where a long sentence is cut: behind each of these, the next kind only where a part is still too long.
BORDERS = (";", ",")
#: A code point that stands in no text (a noncharacter), behind which a text is split.
MARK = "￿"


def sentence_parts(text: Column) -> Column:
    """The sentences of a text, white space behind them included: joined, they are the text."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?]\s+)", f"$1{MARK}"), MARK), lambda x: x != "")


def long_parts(sentence: Column, most: int = MOST_UNITS, borders: tuple[str, ...] = BORDERS) -> Column:
    """The parts of a sentence, which joined are the sentence: as it is up to `most` code points, else cut at all borders of the
    first kind, parts that are still too long at those of the next kind, and so on; then at the last space that fits, else hard.
    """
    def cut(parts: Column, pattern: str) -> Column:
        return F.flatten(F.transform(parts, lambda x: F.when(F.length(x) > most, F.regexp_extract_all(x, F.lit(pattern), F.lit(0))).otherwise(F.array(x))))

    parts = F.array(sentence)
    for border in borders:
        parts = cut(parts, f"[^{border}]*{border}|[^{border}]+")
    return cut(parts, rf"(?s).{{1,{most}}}\z|.{{0,{most - 1}}} |.{{1,{most}}}")


def token_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def segments(heads: DataFrame, most: int = MOST_UNITS, borders: tuple[str, ...] = BORDERS) -> DataFrame:
    """(doc_id, id, pos, start, end, text, too_long, previous, next) of paragraphs as `structure.headings` gives them.

    Headings give no segments. Start and end are trimmed code-point places in the document; together with the white
    space between them, segments cover each block once. previous and next are the neighbours within a block; at
    its edges, the texts of the neighbouring blocks of the same section, so context never
    crosses a section. Ids count from 1 in each document. A blank text has no segments.
    """
    section = F.coalesce("article_pos", "chapter_pos", F.lit(-1))
    blocks = heads.where("level IS NULL").withColumn("section", section)
    by_section = W.partitionBy("doc_id", "section").orderBy("pos")
    blocks = blocks.withColumns({"block_before": F.lag("text").over(by_section), "block_after": F.lead("text").over(by_section)})
    parts = F.flatten(F.transform(sentence_parts(F.col("text")), lambda s: long_parts(s, most, borders)))
    flat = blocks.select("doc_id", "pos", F.col("start").alias("from"), "block_before", "block_after", F.posexplode(parts).alias("part", "raw"))
    in_block = W.partitionBy("doc_id", "pos").orderBy("part")
    flat = flat.withColumn("from", F.col("from") + F.coalesce(F.sum(F.length("raw")).over(in_block.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    trimmed = F.regexp_replace("raw", r"^\s+|\s+$", "")
    lead = F.length("raw") - F.length(F.regexp_replace("raw", r"^\s+", ""))
    kept = flat.withColumns({"text": trimmed, "start": (F.col("from") + lead).cast("int")}).where("text <> ''")
    kept = kept.withColumns({"previous": F.coalesce(F.lag("text").over(in_block), "block_before"), "next": F.coalesce(F.lead("text").over(in_block), "block_after")})
    numbered = kept.withColumn("id", F.row_number().over(W.partitionBy("doc_id").orderBy("pos", "part")))
    return numbered.select("doc_id", "id", "pos", "start", (F.col("start") + F.length("text")).alias("end"), "text", (token_count(F.col("text")) > MOST_TOKENS).alias("too_long"), "previous", "next")
