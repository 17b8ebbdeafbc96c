"""Review candidates: made by rules and the glossary, ranked, routed, dispatched, resolved."""

from __future__ import annotations

import math
from collections import Counter

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.functions import text as t
from glossa.operators.review import route, validate
from glossa.operators.spans import greedy
from glossa.session import broadcast_if_small

RULE_ROWS = 100_000


def places(text: Column, literal: Column) -> Column:
    """0-based starts of the literal's occurrences that don't overlap, folded for case and accents; a substring search."""
    pieces = F.split(t.fold(text), F.concat(F.lit("\\Q"), t.fold(literal), F.lit("\\E")), -1)
    starts = F.aggregate(
        F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("found")),
        lambda s, p: F.struct((s["at"] + F.length(p) + F.length(literal)).alias("at"), F.concat(s["found"], F.array(s["at"] + F.length(p))).alias("found")),
        lambda s: s["found"],
    )
    return F.when(F.length(literal) > 0, starts).otherwise(F.array().cast("array<int>"))


def _places(text: str, folded: str) -> tuple[str, list[int] | None]:
    """The folded text and, where folding changes the length, the original's place of each folded character."""
    if len(text) == len(folded):
        return folded, None
    table = str.maketrans(dict(zip(t.ACCENTED, t.FOLDED)) | dict.fromkeys(t.ACCENTED[len(t.FOLDED) :], ""))
    each = [c.lower().translate(table) for c in text]
    return "".join(each), [i for i, c in enumerate(each) for _ in c]


def _found_rules(sent):
    """Segments (segment_id, text, folded) to the rules' matches, from the left and without overlap within a rule."""

    def run(batches):
        automaton = ahocorasick.Automaton()
        for literal, rules in sent.value:
            automaton.add_word(literal, (literal, rules))
        automaton.make_automaton()
        for rows in batches:
            out = []
            for segment, text, folded in zip(rows["segment_id"], rows["text"], rows["folded"]):
                if not text:
                    continue
                folded, at = _places(text, folded)
                free: dict[str, int] = {}
                off: dict[str, bool] = {}
                for last, (literal, rules) in automaton.iter(folded):
                    start = last + 1 - len(literal)
                    if start < free.get(literal, 0):
                        continue
                    free[literal] = last + 1
                    first, end = (at[start], at[last] + 1) if at else (start, last + 1)
                    for rule, exceptions in rules:
                        if rule not in off:
                            off[rule] = any(x in folded for x in exceptions)
                        if not off[rule]:
                            out.append((segment, rule, first, end, text[first:end]))
            yield pd.DataFrame(out, columns=["segment_id", "rule_id", "start", "end", "original"])

    return run


def rule_suggestions(segments: DataFrame, rules: DataFrame) -> DataFrame:
    """(segment_id, rule_id, start, end, original, replacement) for active rules found in a segment.

    segments: segment_id, text. rules: rule_id, literal, replacement, active, exceptions (texts
    that switch the rule off). Literals are searched folded for case and accents, may begin and end
    within words, and meet the segments in one pass of an automaton over all literals; rules are a
    pack of bounded size and go out `RULE_ROWS` at a time.
    """
    spark = segments.sparkSession
    no = F.coalesce("exceptions", F.array().cast("array<string>"))
    live = rules.where("active").withColumns({"folded": t.fold(F.col("literal")), "no": F.transform(no, lambda x: t.fold(x))}).where("folded <> ''")
    known = live.groupBy("folded").agg(F.collect_list(F.struct("rule_id", "no")).alias("rules")).collect()
    s = segments.select("segment_id", "text", t.fold(F.col("text")).alias("folded"))
    kinds = f"segment_id {segments.schema['segment_id'].dataType.simpleString()}, rule_id {rules.schema['rule_id'].dataType.simpleString()}, start int, end int, original string"
    found = spark.createDataFrame([], kinds)
    for at in range(0, len(known), RULE_ROWS):
        sent = spark.sparkContext.broadcast([(r.folded, [(x.rule_id, list(x.no)) for x in r.rules]) for r in known[at : at + RULE_ROWS]])
        part = s.mapInPandas(_found_rules(sent), kinds)
        found = part if at == 0 else found.union(part)
    met = found.join(broadcast_if_small(live.select("rule_id", "replacement"), RULE_ROWS), "rule_id")
    return met.select("segment_id", "rule_id", "start", "end", "original", t.match_case(F.col("replacement"), F.col("original")).alias("replacement"))


def ranked(candidates: DataFrame, group: str = "segment_id") -> DataFrame:
    """Candidates with `rank`: tier, direct match, source anchor, shared tokens, score gain (null last), priority, shorter, earlier, rule."""
    order = [
        F.desc("tier"), F.desc("direct"), F.desc("anchored"), F.desc("shared_tokens"), F.desc_nulls_last("score_delta"),
        F.asc("priority"), F.col("end") - F.col("start"), F.asc("start"), F.coalesce("rule_id", F.lit("")),
    ]
    same = W.partitionBy(group, "start", "end", "replacement").orderBy(*order)
    first = candidates.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n")
    return first.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order)))


def select(candidates: DataFrame, group: str = "segment_id", most: int | None = None) -> DataFrame:
    """Ranked candidates that overlap none ranked before them."""
    return greedy(ranked(candidates, group), [group], most=most)


def dispatch(candidates: DataFrame, model: DataFrame | None = None) -> DataFrame:
    """Candidates with `outcome` by their route: accepted, invalid, review or dropped.

    deterministic ones are validated; needs-review ones are shown read-only; suppressed ones are
    dropped, with their row as the record; model-review ones take the model's decision
    (candidate_id, decision) and, without one, are shown.
    """
    error = validate(F.col("original"), F.col("replacement"), F.col("context"))
    decided = candidates.withColumn("decision", F.lit(None).cast("string")) if model is None else candidates.join(model.select("candidate_id", "decision"), "candidate_id", "left")
    fine = F.when(error.isNull(), "accepted").otherwise("invalid")
    outcome = (
        F.when(F.col("route") == "suppressed", "dropped")
        .when(F.col("route") == "deterministic", fine)
        .when(F.col("route") == "needs-review", "review")
        .when(F.col("decision") == "accept", fine)
        .when(F.col("decision") == "reject", "dropped")
        .otherwise("review")
    )
    return decided.withColumns({"error": error, "outcome": outcome})


def with_empty(results: DataFrame, segments: DataFrame) -> DataFrame:
    """Results and one row `no-suggestion` for each segment without any."""
    none = segments.select("segment_id").join(results.select("segment_id"), "segment_id", "left_anti").withColumn("outcome", F.lit("no-suggestion"))
    return results.unionByName(none, allowMissingColumns=True)


def route_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates with `route`: the first guard that holds decides."""
    guards = [
        (F.col("protected"), "suppressed"),
        (F.col("original") == F.col("replacement"), "suppressed"),
        (F.col("tier") >= 3, "deterministic"),
        (~F.col("anchored"), "needs-review"),
    ]
    return candidates.withColumn("route", route(guards, "model-review"))


def capped(rows: DataFrame, group: str, most: int, *order: Column) -> tuple[DataFrame, DataFrame]:
    """The first rows of each group, and (group, overflow): how many the cap left out. The cap is the feature."""
    n = rows.withColumn("_n", F.row_number().over(W.partitionBy(group).orderBy(*order)))
    over = rows.groupBy(group).agg(F.greatest(F.count("*") - most, F.lit(0)).alias("overflow"))
    return n.where(F.col("_n") <= most).drop("_n"), over


def references(found: DataFrame, targets: DataFrame) -> DataFrame:
    """References (doc_id, section, label) with `verdict`: missing, ok or ambiguous.

    Targets of the reference's own section count first, all of the document only if there are none.
    """
    own = targets.groupBy("doc_id", "section", "label").agg(F.count("*").alias("n_own"))
    every = targets.groupBy("doc_id", "label").agg(F.count("*").alias("n_all"))
    met = found.join(own, ["doc_id", "section", "label"], "left").join(every, ["doc_id", "label"], "left")
    n = F.coalesce("n_own", "n_all", F.lit(0))
    return met.withColumn("verdict", F.when(n == 0, "missing").when(n == 1, "ok").otherwise("ambiguous")).drop("n_own", "n_all")


def _windows(least: int, most: int, share: float):
    """The search behind `covering_window`, over batches of token arrays."""

    def best(ws, wanted) -> tuple | None:
        wanted = set() if wanted is None else set(wanted)
        if ws is None or not wanted or len(ws) < least:
            return None
        need = math.ceil(round(share * len(wanted), 9))
        at = [w if w in wanted else None for w in ws]

        def sizes(size: int):
            """(start, distinct wanted tokens) of all windows of a size."""
            held: Counter = Counter(w for w in at[:size] if w)
            yield 0, len(held)
            for i in range(size, len(at)):
                if at[i]:
                    held[at[i]] += 1
                if out := at[i - size]:
                    held[out] -= 1
                    if not held[out]:
                        del held[out]
                yield i - size + 1, len(held)

        # the shortest stretch with enough of them, by two ends that only move on
        held, first, shortest = Counter(), 0, None
        for last, w in enumerate(at):
            if w:
                held[w] += 1
            while len(held) >= need:
                shortest = min(shortest or most + 1, last - first + 1)
                if out := at[first]:
                    held[out] -= 1
                    if not held[out]:
                        del held[out]
                first += 1
        size = max(least, shortest) if shortest else most + 1
        if size > most:
            return None
        start, covered = max(sizes(size), key=lambda x: (x[1], -x[0]))
        return start, size, covered

    def run(text: pd.Series, definition: pd.Series) -> pd.DataFrame:
        found = [best(a, b) or (None, None, None) for a, b in zip(text, definition)]
        return pd.DataFrame(found, columns=["start", "size", "covered"]).astype("Int32")

    return run


def covering_window(text_tokens: Column, definition_tokens: Column, least: int = 6, most: int = 80, share: float = 0.7) -> Column:
    """(start, size, covered): the shortest token window that covers `share` of the definition's distinct tokens, null if none.

    Ties go to the better covered, then the earlier window. An Arrow pass with running counts, linear in the text.
    """
    found = F.pandas_udf(_windows(least, most, share), "start int, size int, covered int")(text_tokens, definition_tokens)
    return F.when(found["size"].isNotNull(), found)


def covered_definitions(texts: DataFrame, definitions: DataFrame, share: float = 0.7, least: int = 4) -> DataFrame:
    """(text_id, definition_id, start, size, covered) for every text that has a covering window of a definition.

    texts: text_id, ws. definitions: definition_id, wanted (distinct content tokens, `least` at least).
    Pairs come from counts of shared tokens, so only texts that hold enough of a definition are searched.
    """
    named = definitions.where(F.size("wanted") >= least)
    asked = named.select("definition_id", F.ceil(F.round(share * F.size("wanted"), 9)).alias("need"), F.explode("wanted").alias("token"))
    held = texts.select("text_id", F.explode(F.array_distinct("ws")).alias("token"))
    met = held.join(broadcast_if_small(asked, RULE_ROWS), "token").groupBy("text_id", "definition_id").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need")
    both = met.select("text_id", "definition_id").join(texts, "text_id").join(broadcast_if_small(named, RULE_ROWS), "definition_id")
    return both.withColumn("w", covering_window(F.col("ws"), F.col("wanted"), share=share)).where("w.size is not null").select("text_id", "definition_id", "w.*")


#: Texts beyond this length, and texts with these cues, always get the full review.
ROUTE_LENGTH = 8192
ROUTE_CUES = (
    ("quotationOrCode", r"[“”\"‘’«»`]|(?<![\p{L}\p{N}])'"),
    ("definitionCue", r"(?i)\b(?:adalah|ialah|merupakan|berarti|didefinisikan|diartikan)\b|yang\s+dimaksud\s+dengan|selanjutnya\s+disebut"),
    ("externalLegalSource", r"(?i)undang[ -]undang|peraturan\s+(?:pemerintah|presiden|menteri)|\bKUHP(?:erdata)?\b|\bUU\s*(?:No\b|Nomor\b|[0-9])"),
    ("riskCue", r"(?i)tanggung\s+jawab|bertanggung\s+jawab|ganti\s+(?:rugi|kerugian)|tanpa\s+batas"),
)
ROUTE_EVIDENCE = ("nativeSpellingCandidate", "lexicalRetrievalEvidence", "nativeRiskCandidate")


def fast_route(docs: DataFrame, *evidence: DataFrame | None) -> DataFrame:
    """(doc_id, full, reason): whether a document (doc_id, text) needs the full review, by the first reason that holds.

    Length and cues are read off the text; `evidence` are the documents (doc_id) with a spelling guess, a retrieval hit and a
    risk, in this order of reasons. Each is met by its distinct ids. A null text has none of the cues.
    """
    out = docs.select("doc_id", "text")
    for k, rows in enumerate(evidence):
        if rows is not None:
            out = out.join(rows.select("doc_id").distinct().withColumn(f"_e{k}", F.lit(True)), "doc_id", "left")
    guards = [(t.utf16_length(F.col("text")) > ROUTE_LENGTH, "longDocument"), *((F.col("text").rlike(p), name) for name, p in ROUTE_CUES)]
    guards += [(F.col(f"_e{k}"), ROUTE_EVIDENCE[k]) for k, rows in enumerate(evidence) if rows is not None]
    reason = F.lit("localBaseWithSelectiveContextualReview")
    for guard, name in reversed(guards):
        reason = F.when(F.coalesce(guard, F.lit(False)), name).otherwise(reason)
    return out.select("doc_id", reason.alias("reason")).withColumn("full", F.col("reason") != "localBaseWithSelectiveContextualReview")
