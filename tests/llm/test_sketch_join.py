import itertools
import random

import numpy as np
import pytest

from glossa.llm import sketch_join as sj


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return set()
    k = min(5, len(words))
    return {(k, *words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = {d: d for d, _ in sets if d is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if 100 * len(x & y) >= 75 * len(x | y):
            p, q = find(a), find(b)
            root[max(p, q)] = min(p, q)
    return sorted(((d, len(s), find(d) if d is not None else None) for d, s in sets), key=repr)


def corpus(seed=1):
    rng = random.Random(seed)

    def prose(n):
        return [f"w{rng.randrange(4000)}" for _ in range(n)]

    shared = prose(60)  # a passage in many documents
    rows = [(0, None), (1, ""), (2, " \t"), (3, "One two"), (4, "one TWO"), (5, "one two three four five"), (6, "One two three four five"), (7, "\x0bone"), (8, "a b c d e f"), (None, "one two")]
    base = prose(220)
    for k in range(60):  # a large group of near copies, with ever more changes
        words = list(base)
        for _ in range(k // 6):
            words[rng.randrange(len(words))] = f"x{rng.randrange(99)}"
        rows.append((100 + k, " ".join(words)))
    for k in range(60):
        rows.append((300 + k, " ".join(prose(rng.randrange(1, 40)) + shared + prose(rng.randrange(20)))))
    for k in range(30):  # around the threshold and across bands
        words = prose(rng.choice([12, 50, 62, 66, 250, 258, 300]))
        rows.append((500 + 3 * k, " ".join(words)))
        rows.append((501 + 3 * k, " ".join(words + prose(int(len(words) * rng.choice([0.2, 0.3, 0.34])) or 1))))
        rows.append((502 + 3 * k, " ".join(words[: int(len(words) * 0.8)])))
    rows += [(700 + k, rows[12][1]) for k in range(20)] + [(100, rows[10][1]), (0, None)]
    return rows


@pytest.mark.parametrize("shares", [{}, {"near": 1, "width": 2, "block": 7, "part": 10, "name_bits": 5}])
def test_components_are_brute_force(spark, shares):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, h int, component_id string").repartition(3)
    out = sj.jaccard_join(docs, **shares).collect()
    assert sorted((tuple(r) for r in out), key=repr) == brute(rows)


def test_keep_one_of_each_group_and_empty_tables(spark):
    rows = corpus(2)[:80]
    rows.append((11, rows[11][1]))
    docs = spark.createDataFrame(rows + [rows[-1], (None, None)], "doc_id long, text string")
    kept = sorted((r.doc_id for r in sj.keep_one(docs).collect()), key=repr)
    want = {d for d, _, c in brute(rows) if d is not None and d == c}
    assert kept == sorted([*want, None, None], key=repr)
    assert sj.jaccard_join(docs.limit(0)).count() == 0


def test_lane_values_that_differ_bound_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(64, 3000))
        a = np.unique(sj.mix(rng.integers(0, 1 << 62, n).astype(np.uint64)))
        change = int(rng.integers(0, n // 5 + 1))
        b = np.unique(np.concatenate([a[change:], sj.mix(rng.integers(0, 1 << 62, change).astype(np.uint64))]))
        band = sj.band_of(max(len(a), len(b)))
        (p, one), (q, two) = sj.lanes(a, band), sj.lanes(b, band)
        x, y = set(p.tolist()), set(q.tolist())
        apart = len(np.setxor1d(a, b))
        assert len(x - y) <= apart and len(y - x) <= apart
        assert len(set(p[one].tolist()) - y) + len(set(q[two].tolist()) - x) <= apart
        bits = sum(int(v).bit_count() for v in (sj.parity_bits(a) ^ sj.parity_bits(b)).view(np.uint64))
        assert bits <= apart


def test_shingler_is_the_contracts_set():
    texts = [t or "" for _, t in corpus(3)] + ["\x00a b", "x" * 3_000_000 + " y z", "İ I ı", "a" + " " * 5000 + "b"]
    got = list(sj.Shingler(5)(texts))
    assert [len(x) for x in got] == [len(shingles(t)) for t in texts]
    seen = {}
    for text, x in zip(texts, got):
        assert seen.setdefault(frozenset(shingles(text)), x.tobytes()) == x.tobytes()
    assert len(set(seen.values())) == len(seen)


def test_words_that_repeat_by_a_rule_differ():
    """Thue-Morse words, for which any polynomial hash modulo 2^64 collides."""
    a, b = "a", "b"
    while len(a) < 4096:
        a, b = a + b, b + a
    for n in (128, 1024, 4096):
        x, y = sj.Shingler(5)([a[:n], b[:n]])
        assert x.tobytes() != y.tobytes()


def test_very_long_texts_and_copies(spark):
    rng = random.Random(7)
    long = [f"w{rng.randrange(50_000)}" for _ in range(60_000)]
    near = [w if k % 40 else "changed" for k, w in enumerate(long)]
    rows = [(9, " ".join(long)), (4, " ".join(near)), (2, " ".join(long[:9000])), (7, "y" * 300_000), (8, "y" * 300_000), (5, "y" * 299_999)]
    got = {r.doc_id: r.component_id for r in sj.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {9: 4, 4: 4, 2: 2, 7: 7, 8: 7, 5: 5}
