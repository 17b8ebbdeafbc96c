"""Scores of findings and runs: matches, precision, recall, percentiles, deltas, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def ratio(a: Column, b: Column) -> Column:
    """a / b to six places, null where b is 0."""
    return F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)


def prf(rows: DataFrame, expected: Column, observed: Column, *by: str, total: bool = True) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1 for each group and, with `total`, over all (the group null)."""
    e, o = F.coalesce(expected, F.lit(False)), F.coalesce(observed, F.lit(False))
    base = rows.select(*by, e.alias("_e"), o.alias("_o"))
    counts = [
        F.count_if(F.col("_e") & F.col("_o")).alias("tp"),
        F.count_if(~F.col("_e") & F.col("_o")).alias("fp"),
        F.count_if(F.col("_e") & ~F.col("_o")).alias("fn"),
        F.count_if(~F.col("_e") & ~F.col("_o")).alias("tn"),
    ]
    grouped = base.groupingSets([[*map(F.col, by)], []], *map(F.col, by)) if by and total else base.groupBy(*by)
    out = grouped.agg(*counts)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return out.withColumns({"precision": p, "recall": r, "f1": ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))})


def prf_each(rows: DataFrame, expected: Column, observed: Column, *keys: str) -> DataFrame:
    """(key, value, tp, fp, fn, precision, recall, f1) for every value of every key, and over all (key null), in one pass of grouping sets."""
    want, got = F.coalesce(expected, F.lit(False)), F.coalesce(observed, F.lit(False))
    base = rows.select(*keys, want.alias("_e"), got.alias("_o"))
    counts = [F.count_if(F.col("_e") & F.col("_o")).alias("tp"), F.count_if(~F.col("_e") & F.col("_o")).alias("fp"), F.count_if(F.col("_e") & ~F.col("_o")).alias("fn")]
    grouped = base.groupingSets([*[[F.col(k)] for k in keys], []], *map(F.col, keys)).agg(*counts, *[F.grouping(k).alias(f"_g_{k}") for k in keys])
    key, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k in keys:  # grouping() is 0 for the key that a row is about, so that a null value of it is told from the total
        key, value = F.when(F.col(f"_g_{k}") == 0, k).otherwise(key), F.when(F.col(f"_g_{k}") == 0, F.col(k).cast("string")).otherwise(value)
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return grouped.select(key.alias("key"), value.alias("value"), "tp", "fp", "fn", p.alias("precision"), r.alias("recall"), f1.alias("f1"))


def compare_modes(rows: DataFrame, mode: str, value: str, failed: Column, against: str) -> DataFrame:
    """Runs by mode: n, failures, total, p50 and p95 by nearest rank, and how far total and p95 lie from the mode `against`, in percent (null without it)."""
    v = F.col(value)
    sums = rows.groupBy(mode).agg(
        F.count("*").alias("n"), F.count_if(F.coalesce(failed, F.lit(False))).alias("failures"), F.sum(v.cast("double")).alias("total"),
        *[F.expr(f"percentile_disc({p}) within group (order by {value})").cast("double").alias(f"p{int(p * 100)}") for p in (0.5, 0.95)],
    )
    base = sums.where(F.col(mode) == against).select(F.col("total").alias("_t"), F.col("p95").alias("_p"))
    both = sums.join(F.broadcast(base), F.lit(True), "left")  # one row at most: modes are grouped

    def off(x: str, y: str) -> Column:
        return F.round(F.try_divide(100.0 * (F.col(x) - F.col(y)), F.col(y)), 4)

    return both.select(mode, "n", "failures", F.round("total", 4).alias("total"), "p50", "p95", off("total", "_t").alias("total_percent"), off("p95", "_p").alias("p95_percent"))


def match(expected: DataFrame, observed: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One-to-one matches of equal keys: the i-th expected with the i-th observed; the rest unmatched."""
    w = W.partitionBy(*keys).orderBy(order)
    e = expected.select(*keys, F.col(order).alias("expected"), F.row_number().over(w).alias("rn"))
    o = observed.select(*keys, F.col(order).alias("observed"), F.row_number().over(w).alias("rn"))
    return e.join(o, [*keys, "rn"], "full_outer")


def stage_metrics(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, total, median and p95 by linear interpolation."""
    v = F.col(value).cast("double")
    return rows.groupBy(*by).agg(
        F.count(value).alias("n"), F.round(F.sum(v), 4).alias("total"), F.round(F.percentile(v, 0.5), 6).alias("median"), F.round(F.percentile(v, 0.95), 6).alias("p95")
    )


def nearest_rank(rows: DataFrame, value: str, *by: str, shares: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Percentiles by nearest rank: the value at place ceil(p * n)."""
    aggs = [F.expr(f"percentile_disc({p}) within group (order by {value})").alias(f"p{int(p * 100)}") for p in shares]
    return rows.groupBy(*by).agg(F.count(value).alias("n"), *aggs)


def deltas(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Absolute and percent change of a value by key."""
    a, b = before.select(key, F.col(value).alias("before")), after.select(key, F.col(value).alias("after"))
    both = a.join(b, key, "full_outer")
    change = F.col("after") - F.col("before")
    return both.withColumns({"delta": F.round(change, 6), "percent": F.round(F.try_divide(100.0 * change, F.col("before")), 6)})


def missing_cells(runs: DataFrame, rows: str, columns: str) -> DataFrame:
    """Combinations of the two columns' values without a run, and how often those present ran.

    Both sides are distinct labels of a test matrix, small by nature.
    """
    a, b = runs.select(rows).distinct(), runs.select(columns).distinct()
    n = runs.groupBy(rows, columns).agg(F.count("*").alias("n"))
    return a.crossJoin(b).join(n, [rows, columns], "left").withColumn("n", F.coalesce("n", F.lit(0))).where("n <> 1")


def gate(metrics: DataFrame, floors: dict[str, float]) -> DataFrame:
    """Rows with sorted `reasons` and `status`: fail before insufficient (a null metric) before pass."""
    low = F.array(*[F.when(F.col(m) < floor, F.lit(f"{m} below {floor}")) for m, floor in floors.items()])
    none = F.array(*[F.when(F.col(m).isNull(), F.lit(f"{m} not measured")) for m in floors])
    found = metrics.withColumns({"_low": F.filter(low, lambda x: x.isNotNull()), "_none": F.filter(none, lambda x: x.isNotNull())})
    status = F.when(F.size("_low") > 0, "fail").when(F.size("_none") > 0, "insufficient").otherwise("pass")
    return found.withColumns({"reasons": F.array_join(F.array_sort(F.concat("_low", "_none")), "; "), "status": status}).drop("_low", "_none")


def breaker(rows: DataFrame, group: str, order: str, failed: Column, after: int = 4, most: int = 3) -> DataFrame:
    """Rows with `deterministic`: those after the first `after` of a group where at least `most` of these failed."""
    w = W.partitionBy(group).orderBy(order)
    n = rows.withColumns({"_n": F.row_number().over(w), "_f": F.coalesce(failed, F.lit(False)).cast("int")})
    bad = F.sum(F.when(F.col("_n") <= after, F.col("_f")).otherwise(0)).over(W.partitionBy(group))
    return n.withColumn("deterministic", (F.col("_n") > after) & (bad >= most)).drop("_n", "_f")


def value_stats(rows: DataFrame, value: str, *by: str) -> DataFrame:
    """n, low, high and mid of a value, nulls left out."""
    return rows.groupBy(*by).agg(F.count(value).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), F.round(F.median(value), 6).alias("mid"))


def filter_reasons(rows: DataFrame, reasons: list[tuple[Column, str]], *by: str) -> DataFrame:
    """How many rows each reason, the first that holds, leaves out; the reason is null for those that stay."""
    out = None
    for guard, name in reasons:
        out = F.when(guard, name) if out is None else out.when(guard, name)
    return rows.withColumn("reason", out).groupBy(*by, "reason").agg(F.count("*").alias("n"))


def corrections(rows: DataFrame, expected: Column, observed: Column, key: str, *by: str) -> DataFrame:
    """tp, fp and fn of each group with the sorted keys that were missed."""
    want, got = F.coalesce(expected, F.lit(False)), F.coalesce(observed, F.lit(False))
    return rows.groupBy(*by).agg(F.count_if(want & got).alias("tp"), F.count_if(~want & got).alias("fp"), F.count_if(want & ~got).alias("fn"), F.array_sort(F.collect_list(F.when(want & ~got, F.col(key)))).alias("misses"))


def incremental_counters(rows: DataFrame) -> DataFrame:
    """Of rows (action, incremental, fresh): how many were reused and done again, and how many reused ones equal a fresh run's."""
    same = (F.col("action") == "reuse") & F.col("incremental").eqNullSafe(F.col("fresh"))
    return rows.agg(F.count_if(F.col("action") == "reuse").alias("reused"), F.count_if(F.col("action") != "reuse").alias("reprocessed"), F.count_if(same).alias("equal"))
