"""Importance resampling against a plain loop in Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from glossa.llm import importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text, shortest, longest):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    return w, [" ".join(w[i : i + n]) for n in range(shortest, longest + 1) for i in range(len(w) - n + 1)]


def brute(docs, target, buckets, shortest, longest, percent, least):
    of = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(of, grams(text, shortest, longest)[1]))
    for text in target:
        t.update(map(of, grams(text, shortest, longest)[1]))
    S, T = sum(s.values()), sum(t.values())
    rows = []
    for key, text in docs:
        w, f = grams(text, shortest, longest)
        gains = [math.floor(1000 * math.log((t[of(x)] + 1) * (S + buckets) / ((s[of(x)] + 1) * (T + buckets)))) for x in f]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)))
    able = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = Counter()
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        drawn[(*r[:4], rank)] += 1
    plain = Counter(r[:4] for r in rows)
    for r in drawn:
        plain[r[:4]] -= drawn[r]
    return drawn + Counter({(*r, None): n for r, n in plain.items() if n > 0})


ODD = [(None, "x " * 30), (1, None), (1, ""), (2, "Ünïcode straße 日本 " * 9), (2, "Ünïcode straße 日本 " * 9), (3, "A-b_c 1a" * 3000), (4, "..."), (5, "ÀÉ à é"), (None, None)]


@pytest.mark.parametrize("shortest,longest,percent", [(1, 1, 10), (1, 2, 37), (2, 3, 100)])
def test_resample_is_brute_force(spark, sf, shortest, longest, percent):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").limit(80).collect()] + ODD
    target = [r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()] + [None, ""]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    df = df.withColumns({c: F.lit(9) for c in ("row", "id", "rank", "score", "bucket", "w", "feature", "_at")})
    got = importance.resample(df, spark.createDataFrame([(x,) for x in target], "text string"), buckets=500, shortest=shortest, longest=longest, percent=percent)
    assert Counter(map(tuple, got.collect())) == brute(docs, target, 500, shortest, longest, percent, 20)


def test_ranks_have_no_gaps_when_all_scores_tie(spark):
    docs = spark.range(2000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("same words " * 20).alias("text"))
    got = importance.resample(docs, spark.createDataFrame([("same",)], "text string"), percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 1001)) and len(got) == 2000


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert importance.resample(none, some).collect() == []
    (row,) = importance.resample(some, none, least_words=1, percent=100).collect()
    assert (row.n_features, row["rank"]) == (2, 1)
