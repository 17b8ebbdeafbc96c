"""Fixtures against what a review found: three kinds of expectation, metrics by category, and the gate's exit codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glossa.operators.evaluate import ratio

#: Names that a safe rewrite keeps, and states in which nothing is rewritten.
KEPT_TERMS, SAFE = ("Borrower", "Lender"), ("no-suggestion", "needs-review")


def evaluate(samples: DataFrame, reviews: DataFrame) -> DataFrame:
    """(fixture_id, kind, actual_status, actual_original, actual_replacement, passed) of `samples`(fixture_id, kind, original, replacement, category).

    `reviews`(fixture_id, seq, status, category, original, replacement). What counts as actual is the first suggestion, else the first
    review. A `suggestion` must equal the expected one; `preserve` allows safe states and suggestions that keep every
    name on both sides; `none` allows safe states without any replacement. Fixtures without reviews fail.
    """
    r = F.struct("seq", "status", "category", "original", "replacement")
    suggested = F.col("status") == "suggestion"
    term_kept = F.lit(True)
    for term in KEPT_TERMS:
        term_kept = term_kept & (F.col("original").contains(term) == F.col("replacement").contains(term)) & F.col("replacement").contains(term)
    safe = F.col("status").isin(*SAFE)
    seen = reviews.groupBy("fixture_id").agg(
        F.coalesce(F.min(F.when(suggested, r)), F.min(r)).alias("actual"), F.min(safe | (suggested & F.coalesce(term_kept, F.lit(False)))).alias("preserved"),
        F.min(safe).alias("safe"), F.max(F.col("replacement").isNotNull()).alias("replaced"),
    )
    both = samples.join(seen, "fixture_id", "left")
    same = (F.col("actual.status") == "suggestion") & (F.col("actual.category") == F.col("category")) & (F.col("actual.original") == F.col("original")) & (F.col("actual.replacement") == F.col("replacement"))
    passed = F.when(F.col("kind") == "suggestion", same).when(F.col("kind") == "preserve", F.col("preserved")).otherwise(F.col("safe") & ~F.col("replaced"))
    return both.select("fixture_id", "kind", F.col("actual.status").alias("actual_status"), F.col("actual.original").alias("actual_original"), F.col("actual.replacement").alias("actual_replacement"), F.coalesce(passed, F.lit(False)).alias("passed"))


def metrics(fixtures: DataFrame, expected: DataFrame, observed: DataFrame, by: str = "category") -> DataFrame:
    """Counts and rates of each value of `by`, and of all (null).

    `fixtures`(fixture_id, `by`, no_change, hard_negative); `expected` and `observed`(fixture_id, key, seq, original, replacement,
    occurrence, source). Findings of a fixture and key are matched one to one in their order, which is a maximum
    matching, as all of a key fit each other. exact_span is the share of matches with equal place and texts, grounding that of
    matches whose expected source is also the observed one; no_change and hard_negative_fpr are over
    fixtures. A rate without cases is null.
    """
    w = W.partitionBy("fixture_id", "key").orderBy("seq")
    e, o = (df.select("fixture_id", "key", F.struct("original", "replacement", "occurrence", "source").alias(name), F.row_number().over(w).alias("rn")) for df, name in ((expected, "e"), (observed, "o")))
    pairs = e.join(o, ["fixture_id", "key", "rn"], "full")
    hit, had, got = F.col("e").isNotNull() & F.col("o").isNotNull(), F.col("e").isNotNull(), F.col("o").isNotNull()
    exact = hit & (F.col("e.occurrence") == F.col("o.occurrence")) & (F.col("e.original") == F.col("o.original")) & F.col("e.replacement").eqNullSafe(F.col("o.replacement"))
    told = hit & F.col("e.source").isNotNull()

    def count(c: Column, name: str) -> Column:
        return F.count_if(c).alias(name)

    per = pairs.groupBy("fixture_id").agg(
        count(had, "expected"), count(got, "observed"), count(hit, "tp"), count(exact, "exact"), count(told, "sourced"), count(told & F.coalesce(F.col("e.source") == F.col("o.source"), F.lit(False)), "grounded")
    )
    names = ("expected", "observed", "tp", "exact", "sourced", "grounded")
    rows = fixtures.join(per, "fixture_id", "left").select(by, "no_change", "hard_negative", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    silent, hard = F.col("no_change"), F.col("no_change") & F.col("hard_negative")
    found = F.col("observed") > 0
    sums = rows.groupingSets([[F.col(by)], []], F.col(by)).agg(
        *[F.sum(n).alias(n) for n in names], count(silent, "silent"), count(silent & ~found, "stayed"), count(hard, "hard"), count(hard & found, "hard_hit")
    )
    c = {n: F.col(n) for n in (*names, "silent", "stayed", "hard", "hard_hit")}
    fp, fn = c["observed"] - c["tp"], c["expected"] - c["tp"]
    return sums.select(
        by, "expected", "observed", "tp", fp.alias("fp"), fn.alias("fn"), ratio(c["tp"], c["observed"]).alias("precision"), ratio(c["tp"], c["expected"]).alias("recall"),
        ratio(2 * c["tp"], c["expected"] + c["observed"]).alias("f1"), ratio(c["exact"], c["tp"]).alias("exact_span"), ratio(c["stayed"], c["silent"]).alias("no_change_accuracy"),
        ratio(c["hard_hit"], c["hard"]).alias("hard_negative_fpr"), ratio(c["grounded"], c["sourced"]).alias("grounding"),
    )


def exit_codes(recorded: DataFrame, recomputed: DataFrame, key: str) -> DataFrame:
    """(key, code): 2 where a recorded status is missing, unknown or not what the metrics give, else 1 unless it is pass, else 0."""
    both = recorded.select(key, F.col("status").alias("said")).join(recomputed.select(key, "status"), key, "full")
    wrong = F.col("said").isNull() | ~F.col("said").isin("pass", "fail", "insufficient") | ~F.col("said").eqNullSafe(F.col("status"))
    return both.select(key, F.when(wrong, 2).when(F.col("said") == "pass", 0).otherwise(1).alias("code"))
