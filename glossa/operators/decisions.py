"""Decisions of a reviewer behind a plug-in: a ledger of pair verdicts, outcomes of attempts, bounded read tools.

A reviewer is any function from a frame of questions to a frame of answers; what is kept here is what is asked, how
answers are checked, and what they come to.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.session import Scratch

#: How many pairs go in one call, what may be said of one, and how often a broken answer is asked again.
PAIRS_A_CALL, VERDICTS, ASKED_AGAIN = 4, ("conflict", "compatible", "uncertain"), 1
DECISION_KEYS = ("evidence_ids", "pair_id", "verdict")

Reviewer = Callable[[DataFrame], DataFrame]


def pair_key(policy: str) -> Column:
    """What a verdict depends on: the policy's version, the kind of difference and both texts, in either order."""
    texts = F.array_sort(F.array("first", "second"))
    return F.sha2(F.to_json(F.struct(F.lit(policy).alias("policy"), F.col("kind"), texts.alias("texts"))), 256)


def calls_of(pairs: DataFrame, attempt: int) -> DataFrame:
    """(call_id, attempt, pairs): up to four pairs (key, doc_id, pair_id, ...) of a document in one call."""
    numbered = pairs.withColumn("call", F.floor((F.row_number().over(W.partitionBy("doc_id").orderBy("pair_id")) - 1) / PAIRS_A_CALL))
    shown = F.struct("pair_id", "key", "kind", "first_id", "second_id", "first", "second")
    return numbered.groupBy("doc_id", "call").agg(F.array_sort(F.collect_list(shown)).alias("pairs")).select(F.concat_ws("-", "doc_id", "call").alias("call_id"), F.lit(attempt).alias("attempt"), "pairs")


def checked(calls: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verdicts (key, pair_id, verdict) of the calls whose answer keeps the contract, and the calls whose doesn't.

    An answer is a JSON object of `decisions` alone: one for each pair of the call, each with a pair's id, a known verdict
    and exactly the two units that were compared. One fault breaks the whole answer; so does a missing one.
    """
    every = calls.join(answers.select("call_id", "answer"), "call_id", "left")
    rows = F.from_json("answer", "struct<decisions:array<map<string,string>>>")["decisions"]
    told = every.withColumns({"rows": rows, "top": F.json_object_keys("answer")})

    def right(pair: Column) -> Column:
        mine = F.filter("rows", lambda d: d["pair_id"] == pair["pair_id"])
        evidence = F.from_json(mine[0]["evidence_ids"], "array<string>")
        exact = (F.size(evidence) == 2) & (F.array_sort(evidence) == F.array_sort(F.array(pair["first_id"], pair["second_id"])))
        known = mine[0]["verdict"].isin(*VERDICTS) & (F.array_sort(F.map_keys(mine[0])) == F.array(*map(F.lit, DECISION_KEYS)))
        return F.coalesce((F.size(mine) == 1) & exact & known, F.lit(False))

    fine = (F.size("rows") == F.size("pairs")) & (F.array_join("top", ",") == "decisions") & F.forall("pairs", right)
    told = told.withColumn("fine", F.coalesce(fine, F.lit(False)))
    said = told.where("fine").select(F.explode("pairs").alias("p"), "rows")
    verdicts = said.select("p.key", "p.pair_id", F.filter("rows", lambda d: d["pair_id"] == F.col("p.pair_id"))[0]["verdict"].alias("verdict"))
    return verdicts, told.where("NOT fine").select("call_id", "attempt", "pairs")


def review_pairs(pairs: DataFrame, ledger: DataFrame | None, ask: Reviewer, scratch: Scratch, policy: str = "pairs-1", name: str = "run") -> tuple[DataFrame, DataFrame]:
    """(answered pairs, new ledger).

    `pairs`(doc_id, pair_id, kind, first_id, second_id, first, second) get `verdict`, `status` (known, asked, failed) and `attempts`.
    Pairs whose key the ledger (key, verdict) holds are not asked; equal ones are asked once. A call with a broken
    answer is asked once more, whole. Only certain verdicts enter the ledger: those of a call with an uncertain
    one are given, but asked again by the next run.
    """
    keyed = scratch.cut(pairs.withColumn("key", pair_key(policy)), f"{name}_keyed")
    known = ledger.select("key", F.col("verdict").alias("known")) if ledger is not None else keyed.select("key", F.lit(None).cast("string").alias("known")).where("false")
    one = W.partitionBy("key").orderBy("doc_id", "pair_id")
    fresh = keyed.join(known, "key", "left_anti").withColumn("_n", F.row_number().over(one)).where("_n = 1").drop("_n")
    calls = scratch.cut(calls_of(fresh, 1), f"{name}_calls1")
    verdicts, failed = None, None
    for attempt in range(1, ASKED_AGAIN + 2):
        answers = scratch.cut(ask(calls), f"{name}_answers{attempt}")
        good, bad = checked(calls, answers)
        sure = good.withColumn("attempts", F.lit(attempt))
        verdicts = sure if verdicts is None else verdicts.union(sure)
        failed = scratch.cut(bad, f"{name}_failed{attempt}")
        calls = failed.withColumn("attempt", F.lit(attempt + 1))
    verdicts = scratch.cut(verdicts, f"{name}_verdicts")
    whole = calls_of(fresh, 1).select("call_id", F.explode("pairs").alias("p")).select("call_id", "p.key")
    unsure = whole.join(verdicts.where("verdict = 'uncertain'").select("key"), "key").select("call_id").distinct()
    entered = whole.join(unsure, "call_id", "left_anti").join(verdicts, "key").select("key", "verdict")
    new = entered if ledger is None else ledger.select("key", "verdict").union(entered)
    lost = failed.select(F.explode("pairs").alias("p")).select(F.col("p.key").alias("key"), F.lit(ASKED_AGAIN + 1).alias("lost"))
    out = keyed.join(known, "key", "left").join(verdicts.select("key", "verdict", "attempts"), "key", "left").join(lost, "key", "left")
    status = F.when(F.col("known").isNotNull(), "known").when(F.col("lost").isNotNull(), "failed").otherwise("asked")
    attempts = F.when(F.col("known").isNotNull(), 0).otherwise(F.coalesce("attempts", "lost"))
    answered = out.select(*pairs.columns, F.coalesce("known", "verdict").alias("verdict"), status.alias("status"), attempts.alias("attempts"))
    return answered, scratch.cut(new, f"{name}_ledger")


#: How an attempt moves a candidate: (state, event) to state; other pairs leave the state as it is. A recoverable failure is
#: repaired once; a rejection of a strong candidate is looked at once more, where only a valid answer about the same
#: candidate changes it.
MOVES = {
    ("first", "accept"): "accepted", ("first", "reject"): "rejected", ("first", "strong-reject"): "challenge", ("first", "unsure"): "unsure",
    ("first", "recoverable"): "repair", ("first", "fatal"): "failed", ("first", "stranger"): "failed",
    ("repair", "accept"): "repaired-accepted", ("repair", "reject"): "repaired-rejected", ("repair", "strong-reject"): "repaired-rejected", ("repair", "unsure"): "repaired-unsure",
    ("repair", "recoverable"): "repaired-failed", ("repair", "fatal"): "repaired-failed", ("repair", "stranger"): "repaired-failed",
    ("challenge", "accept"): "challenged-accepted", ("challenge", "unsure"): "challenged-unsure",
    **{("challenge", e): "challenged-rejected" for e in ("reject", "strong-reject", "recoverable", "fatal", "stranger")},
}
#: What an unfinished state comes to when no attempt follows.
ENDS = {"first": "failed", "repair": "repaired-failed", "challenge": "rejected"}
STRONG = ("deterministicRule", "verifiedGlossary")


def outcomes(candidates: DataFrame, attempts: DataFrame) -> DataFrame:
    """One row per candidate: state, attempts used, repaired, challenged, fallback, status and origin of the result.

    `candidates`(candidate_id, mode, tier, category), `attempts`(candidate_id, attempt, result, decision, same): result is
    valid, recoverable or fatal; decision is accept, reject or unsure; `same` tells whether the answer names the candidate.
    Attempts are folded in order through MOVES; those after an end are not looked at. In hybrid mode a failed
    rule candidate falls back to its own suggestion unless it is about terminology, and a rejected rule on spelling or grammar stays.
    """
    event = F.when(F.col("result") != "valid", F.col("result")).when(~F.coalesce("same", F.lit(False)), "stranger")
    event = event.when((F.col("decision") == "reject") & F.col("tier").isin(*STRONG), "strong-reject").otherwise(F.col("decision"))
    seen = attempts.join(candidates.select("candidate_id", "tier"), "candidate_id").select("candidate_id", "attempt", event.alias("event"))
    rows = seen.groupBy("candidate_id").agg(F.array_sort(F.collect_list(F.struct("attempt", "event"))).alias("rows"))
    moves = F.create_map(*[F.lit(x) for (state, e), to in MOVES.items() for x in (f"{state}|{e}", to)])
    ends = F.create_map(*[F.lit(x) for pair in ENDS.items() for x in pair])

    def step(acc: Column, row: Column) -> Column:
        to = F.try_element_at(moves, F.concat_ws("|", acc["state"], row["event"]))
        return F.struct(F.coalesce(to, acc["state"]).alias("state"), (acc["used"] + to.isNotNull().cast("int")).alias("used"))

    start = F.struct(F.lit("first").alias("state"), F.lit(0).alias("used"))
    folded = candidates.join(rows, "candidate_id", "left").withColumn("f", F.aggregate(F.coalesce("rows", F.array().cast("array<struct<attempt:int,event:string>>")), start, step))
    folded = folded.withColumn("state", F.coalesce(F.try_element_at(ends, F.col("f.state")), F.col("f.state")))
    hybrid, rule = F.col("mode") == "hybrid", F.col("tier") == "deterministicRule"
    failed, rejected, accepted = (F.col("state").endswith(x) for x in ("failed", "rejected", "accepted"))
    fallback = failed & hybrid & rule & (F.col("category") != "terminology")
    kept = rejected & hybrid & rule & F.col("category").isin("spelling", "grammar")
    repaired = F.col("state").startswith("repaired") | (F.col("f.state") == "repair")
    challenged = F.col("state").startswith("challenged")
    origin = F.when(fallback, "deterministicFallback").when(kept, "deterministic").when(failed, None).when(repaired, "repaired").otherwise("model")
    status = F.when(fallback | kept | accepted, "suggestion").when(failed, "rejection").when(rejected, "none").otherwise("needs-review")
    return folded.select(
        "candidate_id", "state", F.col("f.used").alias("attempts"), repaired.alias("repaired"), challenged.alias("challenged"), fallback.alias("fallback"),
        (~failed & ~repaired).alias("first_pass"), status.alias("status"), origin.alias("origin"),
    )


#: Calls of a session, and results of a call.
MOST_CALLS, MOST_RESULTS = 4, 5


@dataclass(frozen=True)
class Tool:
    """A read tool: `rows`(key, payload, authoritative), what an empty argument and an unknown key are called; `many` if a key has several rows.

    `known`(key) names the keys that exist where `rows` has none for some of them.
    """

    rows: DataFrame
    missing: str
    unknown: str
    known: DataFrame | None = None


def dispatch(requests: DataFrame, tools: dict[str, Tool], search: Callable[[DataFrame], DataFrame], search_name: str) -> DataFrame:
    """(session, seq, error, results, authoritative) of `requests`(session, seq, tool, argument, limit).

    All requests of a tool are one join. A session has MOST_CALLS calls by their order, whatever comes of them; later ones get
    budgetExceeded. A search for more than MOST_RESULTS gets resultLimitExceeded, one for nothing emptyQuery.
    `search`(session, seq, query, limit) gives (session, seq, rank, payload, authoritative). Results are authoritative if
    there are any and all are; an unknown tool is unknownTool.
    """
    number = F.row_number().over(W.partitionBy("session").orderBy("seq"))
    asked = requests.withColumns({"argument": F.trim(F.coalesce("argument", F.lit(""))), "limit": F.greatest(F.coalesce("limit", F.lit(1)), F.lit(1)), "over": number > MOST_CALLS})
    empty = F.col("argument") == ""
    first = F.when(F.col("over"), "budgetExceeded").when((F.col("tool") == search_name) & empty, "emptyQuery").when((F.col("tool") == search_name) & (F.col("limit") > MOST_RESULTS), "resultLimitExceeded")
    for name, tool in tools.items():
        first = first.when((F.col("tool") == name) & empty, tool.missing)
    first = first.when(~F.col("tool").isin(search_name, *tools), "unknownTool")
    asked = asked.withColumn("error", first)
    open_ = asked.where("error IS NULL")
    found = search(open_.where(F.col("tool") == search_name).select("session", "seq", F.col("argument").alias("query"), "limit")).select("session", "seq", "rank", "payload", "authoritative", F.lit(True).alias("exists"))
    for name, tool in tools.items():
        mine = open_.where(F.col("tool") == name).select("session", "seq", F.col("argument").alias("key"))
        keys = (tool.known if tool.known is not None else tool.rows).select("key").distinct().withColumn("exists", F.lit(True))
        met = mine.join(keys, "key", "left").join(tool.rows.select("key", "payload", "authoritative"), "key", "left")
        found = found.unionByName(met.select("session", "seq", F.lit(0).alias("rank"), "payload", "authoritative", F.coalesce("exists", F.lit(False)).alias("exists")))
    grouped = found.groupBy("session", "seq").agg(
        F.transform(F.array_sort(F.collect_list(F.when(F.col("payload").isNotNull(), F.struct("rank", "payload")))), lambda x: x["payload"]).alias("results"), F.min("authoritative").alias("authoritative"), F.max("exists").alias("exists")
    )
    unknown = F.lit(None).cast("string")
    for name, tool in tools.items():
        unknown = F.when((F.col("tool") == name) & ~F.coalesce("exists", F.lit(False)), tool.unknown).otherwise(unknown)
    out = asked.join(grouped, ["session", "seq"], "left").withColumn("error", F.coalesce("error", unknown))
    fine = F.col("error").isNull()
    results = F.when(fine, F.coalesce("results", F.array().cast("array<string>")))
    return out.select("session", "seq", "error", results.alias("results"), (fine & F.coalesce(F.size(results) > 0, F.lit(False)) & F.coalesce("authoritative", F.lit(False))).alias("authoritative"))
