"""Candidate review: routing, validation, clause pairs, spelling, protected spans."""

from __future__ import annotations

import re
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions import text as t

NEGATION = r"(?i)\b(not|no|nicht|kein|non|pas)\b"


def route(guards: Iterable[tuple[Column, str]], otherwise: str) -> Column:
    """The name of the first guard that holds."""
    out = None
    for guard, name in guards:
        guard = F.coalesce(guard, F.lit(False))
        out = F.when(guard, name) if out is None else out.when(guard, name)
    return F.lit(otherwise) if out is None else out.otherwise(otherwise)


def validate(original: Column, replacement: Column, context: Column) -> Column:
    """The first rule that a suggested replacement breaks, null if none; the order of the rules matters."""
    return (
        F.when(F.trim(original) == "", "empty-original")
        .when(F.trim(replacement) == "", "empty-replacement")
        .when(original == replacement, "no-change")
        .when(t.occurrences(context, original) == 0, "not-in-context")
        .when(t.occurrences(context, original) > 1, "ambiguous-range")
        .when(F.length(replacement) > F.least(F.lit(500), 2 * F.length(original)), "too-long")
        .when(replacement.rlike(r"[\n\r]"), "multi-line")
        .when(F.size(t.lost_markers(original, replacement)) > 0, "literal-changed")
        .when(original.rlike(NEGATION) != replacement.rlike(NEGATION), "polarity-changed")
    )


def clause_pairs(paras: DataFrame) -> DataFrame:
    """Pairs of short paragraphs of a document with the same first three distinct sorted tokens."""
    ws = F.array_sort(F.array_distinct(t.tokens(F.col("text"))))
    c = paras.where(F.size(t.tokens(F.col("text"))).between(4, 12)).select("doc_id", "pos", F.array_join(F.slice(ws, 1, 3), " ").alias("key"), F.col("text").rlike(NEGATION).alias("negated"))
    a = c.select("doc_id", "key", F.col("pos").alias("pos_a"), F.col("negated").alias("negated_a"))
    b = c.select("doc_id", "key", F.col("pos").alias("pos_b"), F.col("negated").alias("negated_b"))
    return a.join(b, ["doc_id", "key"]).where("pos_a < pos_b")


def spelling(docs: DataFrame, id_col: str, text_col: str, *, rare: int, frequent: int) -> DataFrame:
    """(token, suggestion, docs): tokens in at most `rare` documents, one edit from one in at least `frequent`.

    Candidates meet on deletion variants (a token and its forms less one letter), so the lexicon
    is never compared with itself.
    """
    words = docs.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(t.tokens(F.col(text_col)))).alias("token")).where(F.col("token").rlike(r"^\p{L}{4,24}$"))
    counts = words.groupBy("token").agg(F.count("*").alias("docs"))
    forms = F.concat(F.array("token"), F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.concat(F.substring("token", F.lit(1), i - 1), F.substring("token", i + 1, F.length("token")))))
    flat = counts.withColumn("form", F.explode(F.array_distinct(forms)))
    good = flat.where(F.col("docs") >= frequent).select("form", F.col("token").alias("suggestion"), F.col("docs").alias("weight"))
    met = flat.where(F.col("docs") <= rare).join(good, "form").where(t.single_edit(F.col("token"), F.col("suggestion")))
    return met.groupBy("token").agg(F.max_by("suggestion", F.struct("weight", "suggestion")).alias("suggestion"), F.first("docs").alias("docs"))


def matches(docs: DataFrame, id_col: str, text_col: str, pattern: str, group: int = 0) -> DataFrame:
    """(doc_id, start, end, value) of a pattern's matches; an Arrow pass, as SQL functions give no places."""
    compiled = re.compile(pattern)

    def find(batches):
        for rows in batches:
            out = [(i, m.start(group), m.end(group), m[group]) for i, x in zip(rows["doc_id"], rows["text"]) if x for m in compiled.finditer(x)]
            yield pd.DataFrame(out, columns=["doc_id", "start", "end", "value"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(find, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start long, end long, value string")


def declared_terms(docs: DataFrame, id_col: str, text_col: str, pattern: str) -> DataFrame:
    """(doc_id, term, declarations, bodies, verdict) of `term` and `body` groups: duplicate or conflicting declarations.

    `pattern` has two groups: the term and its definition.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("x"))
    pairs = F.arrays_zip(F.regexp_extract_all("x", F.lit(pattern), F.lit(1)).alias("term"), F.regexp_extract_all("x", F.lit(pattern), F.lit(2)).alias("body"))
    flat = base.select("doc_id", F.explode(pairs).alias("p")).select("doc_id", t.normalise(F.col("p.term")).alias("term"), t.normalise_marks(F.col("p.body")).alias("body"))
    found = flat.groupBy("doc_id", "term").agg(F.count("*").alias("declarations"), F.count_distinct(F.when(F.col("body") != "", F.col("body"))).alias("bodies"))
    return found.withColumn("verdict", F.when(F.col("bodies") > 1, "conflicting").when(F.col("declarations") > 1, "duplicate"))
