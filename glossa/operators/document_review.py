"""The whole review of documents as one plan: what reads texts shares one written copy of them, and findings merge by place."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.operators import segments as sg
from glossa.operators import signals as s
from glossa.operators import structure
from glossa.session import Scratch

#: Maps findings that a model should see (doc_id, finding, rule_id, kind, original, unit) to (doc_id, finding, decision): flag, dismiss or uncertain.
RiskReviewer = Callable[[DataFrame], DataFrame]
DISPOSITIONS = {"flag": "flagged", "dismiss": "dismissed", "uncertain": "uncertain"}


def review(docs: DataFrame, scratch: Scratch, reviewer: RiskReviewer | None = None, most_asked: int = s.MODEL_CANDIDATES) -> DataFrame:
    """(doc_id, number, rule_id, kind, start, end, original, replacement, disposition, origin) of docs (doc_id, text), numbered in text order.

    Texts are read once and written; structure, units, sayings and declarations are made from that copy, each once, and kinds of
    findings from those. Conflicting definitions and risks need a model: of each document the first `most_asked` by their
    rules' order go to the reviewer; without one they are uncertain fallbacks, as those beyond are uncertain. Undeclared terms are
    uncertain; all others are flagged. A dismissed finding stays, marked so. Equal findings at one place count once. Null and empty texts have none.
    """
    docs = scratch.cut(docs.select("doc_id", "text").where("text IS NOT NULL"), "docs")
    heads = scratch.cut(structure.headings(structure.paragraphs(docs, "doc_id", "text")), "heads")
    units = scratch.cut(sg.segments(heads).select("doc_id", (F.col("id") - 1).alias("pos"), "start", "end", "text"), "units")
    said = scratch.cut(s.sayings(docs), "sayings")
    chapters = structure.sections(heads)
    spans = chapters.join(heads.select("doc_id", "pos", "start"), ["doc_id", "pos"]).select("doc_id", "start", "end_pos", F.col("text").alias("heading"))
    ends = heads.select("doc_id", F.col("pos").alias("end_pos"), (F.col("start") - 1).alias("next_start"))
    lengths = docs.select("doc_id", F.length("text").alias("length"))
    sections = spans.join(ends, ["doc_id", "end_pos"], "left").join(lengths, "doc_id").select("doc_id", "start", F.coalesce("next_start", "length").alias("end"), "heading")
    declared = scratch.cut(s.declarations(docs, sections, said), "declared")

    none = F.lit(None).cast("string")
    terms = s.term_findings(declared).select("doc_id", "rule_id", "start", "end", "original")
    terms = terms.union(s.undeclared_terms(declared, said)).union(s.uneven_usages(docs, declared).select("doc_id", "rule_id", "start", "end", "original"))
    terms = terms.select("doc_id", "rule_id", F.lit("definedTerm").alias("kind"), "start", "end", "original", none.alias("replacement"))
    facts = s.clause_facts(units.select("doc_id", "pos", "text"))
    place = units.select("doc_id", "pos", "start", "end", F.col("text").alias("original"))
    risks = s.risk_findings(facts).join(place, ["doc_id", "pos"]).select("doc_id", "rule_id", F.lit("legalRisk").alias("kind"), "start", "end", "original", none.alias("replacement"))
    local = s.local_findings(units.select("doc_id", "pos", "text")).join(units.select("doc_id", "pos", F.col("start").alias("base"), "text"), ["doc_id", "pos"])
    at = (F.col("base") + F.instr("text", F.col("original")) - 1).cast("int")
    local = local.select("doc_id", F.concat(F.lit("local-"), "category").alias("rule_id"), F.lit("local").alias("kind"), at.alias("start"), (at + F.length("original")).alias("end"), "original", "replacement")
    every = terms.unionByName(risks).unionByName(local).groupBy("doc_id", "rule_id", "kind", "start", "end").agg(F.min("original").alias("original"), F.min("replacement").alias("replacement"))
    every = scratch.cut(every.withColumn("finding", F.concat_ws("|", "rule_id", "start", "end")), "findings")

    order = F.array_position(F.array(*map(F.lit, s.RISK_ORDER)), F.col("rule_id"))
    needs = order > 0
    asked = every.where(needs).withColumn("place", F.row_number().over(W.partitionBy("doc_id").orderBy(order, "start", "end"))).where(F.col("place") <= most_asked)
    if reviewer is None:
        told = asked.select("doc_id", "finding", F.lit("uncertain").alias("disposition"), F.lit("deterministicFallback").alias("origin"))
    else:
        names = F.create_map(*[F.lit(x) for pair in DISPOSITIONS.items() for x in pair])
        answers = reviewer(asked.select("doc_id", "finding", "rule_id", "kind", "original")).select("doc_id", "finding", "decision")
        # an answer that is missing or unknown leaves the finding uncertain
        told = asked.join(answers, ["doc_id", "finding"], "left").select("doc_id", "finding", F.coalesce(F.try_element_at(names, F.col("decision")), F.lit("uncertain")).alias("disposition"), F.when(F.col("decision").isNull(), "deterministicFallback").otherwise("model").alias("origin"))
    met = every.join(told, ["doc_id", "finding"], "left")
    unsure = needs | (F.col("rule_id") == "defined-term-undeclared-quoted-term")
    met = met.withColumns({"disposition": F.coalesce("disposition", F.when(unsure, "uncertain").otherwise("flagged")), "origin": F.coalesce("origin", F.lit("deterministic"))})
    return s.source_order(met).select("doc_id", "number", "rule_id", "kind", "start", "end", "original", "replacement", "disposition", "origin")
