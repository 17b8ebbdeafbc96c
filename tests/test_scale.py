"""What only larger or odder tables show."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from glossa.operators import anchors, context, decisions, retrieval, spellcheck, suggest
from glossa.plans.registry import QUERIES


def test_short_blocks_hold_segments_across_a_stretch(spark):
    # segments of blocks of one or two characters end before they begin, here beyond the stretch that their block touches
    blocks = spark.createDataFrame([(1, 0, 0, 250), (1, 1, 254, 255), (1, 2, 256, 300), (2, 0, 510, 511), (3, 0, 254, 256), (3, 1, 257, 258)], "doc_id int, block_id int, start int, end int")
    segments = blocks.select("doc_id", F.col("block_id").alias("segment_id"), (F.col("start") + 2).alias("start"), (F.col("end") - 1).alias("end"))
    got = {(r.doc_id, r.segment_id): r.block_id for r in anchors.containing_block(segments, blocks).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 2): 2, (2, 0): 0, (3, 0): 0, (3, 1): 1}


def test_best_scores_are_those_of_all_pairs(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(docs.where("doc_id % 3 = 0").select(F.col("doc_id") + 1000, "text")).union(spark.createDataFrame([(5000, None), (5001, "")], "doc_id long, text string"))

    def ranked(scores, k):
        return retrieval.top_k(scores.withColumn("score", F.round("score", 6)), k, F.desc("score"), F.col("doc_id")).select("query_id", "rank", "doc_id", "score")

    asked = docs.where("doc_id % 7 = 0").select(F.col("doc_id").alias("q"), F.col("text").alias("query"))
    names = {"doc_id": "doc_id", "doc_text": "text", "query_id": "q", "query_text": "query"}
    for name, value in {"PASS_ROWS": 2000, "TILE_CELLS": 500, "DENSE_TOKENS": 20}.items():
        monkeypatch.setattr(retrieval, name, value)
    for repeats in (False, True):
        every = ranked(retrieval.bm25(docs, asked, **names, repeats=repeats), 5).collect()
        found = retrieval.bm25_best(docs.repartition(3), asked, 5, **names, repeats=repeats)
        assert found.groupBy("query_id").count().agg(F.max("count")).first()[0] <= 15  # a task's best, not all that share a token
        assert sorted(map(tuple, ranked(found, 5).collect())) == sorted(map(tuple, every)) and every
    assert retrieval.bm25_best(docs, asked.limit(0), 5, **names).count() == 0 == retrieval.bm25_best(docs.limit(0), asked, 5, **names).count()


def test_equal_entries_and_queries_are_searched_once(spark, monkeypatch):
    rows = [(n, ("Red ring", "red ring", "blue ring", "RING")[n % 4], ("big", "big", None)[n % 3]) for n in range(60)]
    entries = spark.createDataFrame(rows, "id int, term string, d string")
    asked = spark.createDataFrame([(n, ("ring", "RING ", "red", "big  blue", " ")[n % 5]) for n in range(50)], "q int, text string")
    names = {"entry_id": "id", "term": "term", "definition": "d", "query_id": "q", "query_text": "text", "verified": F.col("id") % 8 == 1}
    sizes, bm25 = [], retrieval.bm25
    monkeypatch.setattr(retrieval, "bm25", lambda docs, queries, **kw: sizes.append((docs.count(), queries.count())) or bm25(docs, queries, **kw))
    for catalogue in (False, True):
        found = retrieval.lexical_search(entries, asked, 7, **names, catalogue=catalogue).collect()
        got = {}
        for r in sorted(found, key=lambda r: (r.query_id, r.rank)):
            got.setdefault(r.query_id, []).append((r.doc_id, r.score))
        # each row for itself
        scores = bm25(entries.withColumn("whole", F.concat_ws(" ", "term", "d")), asked, doc_id="id", doc_text="whole", query_id="q", query_text="text").collect()
        points = {(r.query_id, r.doc_id): r.score for r in scores}
        assert {q for q in got} == {q for q in range(50) if q % 5 != 4}
        for q, hits in got.items():
            text = ("ring", "ring", "red", "big blue")[q % 5]
            want = []
            for n, term, d in rows:
                nt, nd = term.lower(), d or ""
                if (q, n) in points or text in nt:
                    bonus = 1000 if nt == text else 300 if nt.startswith(text) else 150 if text in nt else 0
                    bonus += (40 if f" {nt} " in f" {text} " else 0) if catalogue else (100 if text in nd else 0)
                    score, ok = round(points.get((q, n), 0) + bonus, 6), n % 8 == 1
                    want.append(((-score, nt, n) if catalogue else (nt != text, not (nt == text and ok), -score, not ok, nt, n), (n, score)))
            assert [(n, round(s, 5)) for n, s in hits] == [(n, round(s, 5)) for _, (n, s) in sorted(want)[:7]], (q, catalogue)
    assert all(docs < 20 and queries == 3 for docs, queries in sizes) and len(sizes) == 2


def test_products_are_made_in_tiles():
    dice = np.random.default_rng(3)
    v, ids = np.round(dice.normal(size=(8000, 4)), 1), np.arange(0, 8000, 2)  # many ties
    rows = pd.DataFrame({"doc_id": np.arange(8000), "v": list(v)})
    tracemalloc.start()
    got = pd.concat(retrieval._best_products(SimpleNamespace(value=(ids, v[ids])), 3)([rows[:5000], rows[5000:]]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100 << 20  # all products of the first batch take 160 MB
    for q in (0, 1234, 7998):
        s = np.round(v @ v[q], 6)
        want = sorted((-s[n], n) for n in range(8000) if n != q)[:3]
        mine = got[got["query_id"] == q]
        assert sorted(zip(-mine["score"], mine["doc_id"])) == want


def test_suggestions_leave_their_task_only_where_they_decide(spark, sf, monkeypatch):
    b = spark.read.parquet(f"{sf}/benchmark.parquet")
    words = F.split("text", " ")
    entries = b.select(F.col("item_id").alias("doc_id"), F.concat_ws(" ", F.get(words, 1), F.get(words, 2)).alias("term"), F.col("text").alias("definition"), F.lit(True).alias("verified"), (F.col("item_id") % 7 != 0).alias("actionable"))
    entries = entries.union(entries.select(F.col("doc_id") + 1000, F.concat("term", F.lit(" ")), "definition", "verified", "actionable"))  # equal terms
    texts = spark.read.parquet(f"{sf}/documents.parquet").select(F.col("doc_id").alias("query_id"), "text").union(spark.createDataFrame([(9000, None)], "query_id long, text string"))
    made = []
    monkeypatch.setattr(suggest, "_candidates", lambda sent, limit, f=suggest._candidates: made.append(sent.value) or f(sent, limit))
    once = sorted(map(tuple, suggest.lexical_suggestions(entries, texts, 3).collect()))
    assert len(made) == 1 and once and {r[2] for r in once} < set(range(1000))  # of equal ones the smaller id
    for name, value in {"PASS_ROWS": 300, "TILE_CELLS": 200, "DENSE_TOKENS": 5}.items():
        monkeypatch.setattr(retrieval, name, value)
    assert sorted(map(tuple, suggest.lexical_suggestions(entries, texts, 3).collect())) == once and len(made) > 3


def test_parts_are_ranked_before_they_meet_requests(spark, sf, monkeypatch):
    found = []
    monkeypatch.setattr(decisions, "dispatch", lambda requests, tools, search, name: found.append(search) or requests)
    QUERIES["read_tools"](spark, sf)
    parts = spark.read.parquet(f"{sf}/part.parquet")
    size, many = parts.groupBy("p_size").count().orderBy(F.desc("count")).first()
    asked = spark.createDataFrame([(k, 1, str(size), 1 + k % 5) for k in range(10)], "session int, seq int, query string, limit int")
    got = found[0](asked)
    assert "windowspecdefinition(session" not in got._jdf.queryExecution().analyzed().toString()  # not once for every request
    dearest = [f"part {r.p_partkey}" for r in parts.where(F.col("p_size") == size).orderBy(F.desc("p_retailprice"), "p_partkey").limit(5).collect()]
    rows = got.collect()
    assert many > 5 and {k: [r.payload for r in sorted(rows, key=lambda r: r.rank) if r.session == k] for k in range(10)} == {k: dearest[: 1 + k % 5] for k in range(10)}


def test_facts_are_read_once_and_keep_their_row(spark):
    text = 'Bab I\n"Harga" berarti nilai; "HARGA" berarti lain. Rp 5, rp 6, USD 7 dan USD 8\n' * 3
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    plan = context.literal_facts(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    found = context.facts(docs, spark.createDataFrame([(1, 0, 5, "Bab I")], "doc_id int, start int, end int, text string"))
    got = {(r.category, r.value): (r.start, r.end) for r in context.literal_facts(docs).collect()}
    assert got == {("defined-term", "Harga"): (7, 12), ("currency", "Rp"): (text.index("Rp"), text.index("Rp") + 2), ("currency", "USD"): (text.index("USD"), text.index("USD") + 3)}
    sections = spark.createDataFrame([(1, 0, 9), (1, 8, 5000)], "doc_id int, start int, end int")
    held = {(r.category, r.value): r.section_start for r in context.in_sections(found, sections).collect()}
    assert held == {("defined-term", "Harga"): 8, ("currency", "Rp"): 8, ("currency", "USD"): 8} and found.count() == 3
    assert [r.section_start for r in context.in_sections(found, sections.limit(0)).collect()] == [None] * 3


def test_whole_lines_are_not_gathered_again(spark):
    docs = spark.createDataFrame([(1, "the red Ring and\nthe rde ring. The red, rnig\n\nred Rinng"), (2, None), (3, "the rde ring")], "doc_id int, text string")
    lines, phrases = spellcheck.line_words(docs, "doc_id", "text"), spark.createDataFrame([(1, "red ring")], "doc_id int, phrase string")
    got = spellcheck.phrase_errors(lines, phrases, longest=2)
    assert "collect_list" not in got._jdf.queryExecution().analyzed().toString()
    want = spellcheck.phrase_errors(spellcheck.line_tokens(docs, "doc_id", "text"), phrases, longest=2)
    rows = sorted(map(tuple, got.collect()))
    assert rows == sorted(map(tuple, want.collect())) == [(1, 3, 1, "Rinng", "Ring", "red ring")]
