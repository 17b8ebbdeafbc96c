import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from glossa.llm import neural_lm as lm


def corpus(seed=0, n=300):
    rng = random.Random(seed)
    tongues = [[f"{c}{rng.randrange(60)}{c}" for _ in range(80)] for c in "abc"]
    rows = []
    for k in range(n):
        words = tongues[k % 3]
        rows.append((k, " ".join(words[min(int(rng.expovariate(0.08)), 79)] for _ in range(rng.randrange(5, 60)))))
    return [*rows, (900, None), (901, " \t"), (902, "Ünseen\x0bWORD x0 " * 50), (None, "a1a"), (3, "A1A a1a")]


def test_base_scores_and_held_out_gain(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1.0) for d, t in rows], "doc_id long, text string, score double").repartition(3)
    out = lm.score_documents(docs, grow=0.4, classes=16, head=60, passes=20).collect()
    assert len(out) == len(rows)
    counts = Counter()
    for d, t in rows:
        if not lm.held_out(d):
            counts.update(lm.tokens(t or ""))
    n, v = sum(counts.values()), len(counts)
    want = []
    for d, t in rows:
        ws = lm.tokens(t or "")
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        want.append((repr(d), zlib.crc32(str(d if d is not None else "").encode()) % 10 == 0, len(ws), sum(counts[w] > 0 for w in ws), n, round(base, 6)))
    assert sorted((repr(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out) == sorted(want)
    held = [r for r in out if r.held_out and r.doc_id not in (900, 901, 902, None)]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def text(rng, n, words):
    """A chain in which each word depends on the one two before it."""
    out = [0, 1]
    for _ in range(n):
        out.append((out[-2] * 3 + rng.integers(0, 3)) % words)
    return np.array(out, np.int32)


def trained(u, words, steps=60):
    rng = np.random.default_rng(1)
    model = lm.LogBilinear(np.bincount(u, minlength=words).astype(float), 16)
    before = lm.context_of(u, np.array([0]), 0)
    for _ in range(steps):
        some = rng.permutation(len(u))[:2000]
        model.step(before[some], u[some], rng)
    return model, before


def test_probabilities_add_up_to_one():
    u = text(np.random.default_rng(0), 3000, 50)
    model, before = trained(u, 50, steps=5)
    total = sum(np.exp(model.log_probabilities(before[:40], np.full(40, w, np.int32))) for w in range(50))
    assert np.allclose(total, 1, atol=1e-4)
    # shares within a class: its words and one unseen add up to 1
    counts = {"aa": 3, "ba": 1}
    mass = sum(counts.values()) + lm.ADD * (len(counts) + 1)
    assert math.isclose(sum((c + lm.ADD) / mass for c in counts.values()) + lm.ADD / mass, 1)


def test_training_learns_from_more_than_one_word():
    u = text(np.random.default_rng(0), 20_000, 50)
    model, before = trained(u, 50)
    test = text(np.random.default_rng(9), 2000, 50)
    p = np.bincount(u, minlength=50) / len(u)
    score = model.log_probabilities(lm.context_of(test, np.array([0]), 0), test).mean()
    assert score > np.log(p[test] + 1e-9).mean() + 0.5


def test_averages_and_contexts():
    model = lm.LogBilinear(np.arange(1.0, 31), 4)
    u = np.arange(30, dtype=np.int32)
    model.step(lm.context_of(u, np.array([0, 10]), 7), u, np.random.default_rng(0))
    row, weight, values = model.rows()
    again = lm.LogBilinear(np.arange(1.0, 31), 4).take(row, values)
    assert all(np.array_equal(getattr(model, k), getattr(again, k)) for k in "rqbgac")
    assert lm.context_of(u, np.array([0, 10]), 7)[[0, 2, 10, 12]].tolist() == [[7, 7], [1, 0], [7, 7], [11, 10]]
    # the same row in two batches
    names, x = ["row", "weight", "values"], np.array([1, 3], np.float16).tobytes()
    y = np.array([3, 5], np.float16).tobytes()
    parts = [pa.RecordBatch.from_arrays([pa.array([4, 5]), pa.array([1, 1]), pa.array([x, x])], names), pa.RecordBatch.from_arrays([pa.array([5, 9]), pa.array([3, 1]), pa.array([y, y])], names)]
    got = {r: np.frombuffer(v, np.float32).tolist() for b in lm._average(parts) for r, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist())}
    assert got == {4: [1, 3], 5: [2.5, 4.5], 9: [3, 5]}


def test_empty_and_untrained(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_documents(none, grow=1, classes=4, head=8).count() == 0
    held = next(k for k in range(100) if lm.held_out(k))
    out = lm.score_documents(spark.createDataFrame([(held, "a b")], "doc_id long, text string"), grow=1, classes=4, head=8).collect()
    assert (out[0].n_known, out[0].train_tokens, out[0].n_tokens) == (0, 0, 3)


def test_head_that_no_step_of_counts_fits(spark):
    rows = [(1, "a b c d e f g h")]
    assert not lm.held_out(1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = 9 * math.log10(1.1 / (9 + 0.1 * 10))
    for head in (5, 100):
        out = lm.score_documents(docs, grow=1, classes=4, head=head).collect()[0]
        assert out.n_known == 9 and math.isclose(out.base_score, want)
