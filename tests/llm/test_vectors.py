import numpy as np
import pytest

from glossa.llm import nn_descent, posting_lists, vectors


def table(spark, x, ids=None, extra=()):
    ids = range(len(x)) if ids is None else ids
    rows = [(int(i), [float(v) for v in row], 1) for i, row in zip(ids, x)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, node int").repartition(3)


BAD = [(9001, None, 0), (9002, [0.0] * 8, 0), (9003, [1.0] * 7 + [None], 0), (9004, [float("nan")] + [1.0] * 7, 0), (9005, [float("inf")] + [1.0] * 7, 0), (9006, [1.0] * 5, 0), (9007, [], 0)]


def clusters(seed=0, n=300):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8))
    dense = x[0] + 0.15 * rng.normal(size=(80, 8))  # a saturated group
    chain = [x[1]]
    for _ in range(20):
        chain.append(chain[-1] + 0.25 * np.linalg.norm(chain[-1]) * rng.normal(size=8) / np.sqrt(8))
    return np.concatenate([x, dense, chain, 3 * x[:10], x[20:30], x[20:21]]).astype(np.float32).astype(float)


@pytest.mark.parametrize("block", [512, 16])
def test_links_and_components_are_brute_force(spark, block):
    x = clusters()
    ids = np.arange(len(x)) * 7 % 10007
    ids[5] = ids[6]  # a repeated id
    out = nn_descent.near_duplicates(table(spark, x, ids, BAD), threshold=0.9, k=6, block=block).collect()
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    near = unit @ unit.T >= 0.9
    root = np.arange(len(x))
    while True:
        new = np.array([root[near[i]].min() for i in range(len(x))])
        new = new[new]
        if (new == root).all():
            break
        root = new
    least = {r: min(ids[root == r]) for r in set(root.tolist())}
    want = sorted([(int(i), int(near[k].sum()) - 1, int(least[root[k]])) for k, i in enumerate(ids)] + [(b[0], 0, b[0]) for b in BAD])
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in out)


def brute_force(x, ids, threshold):
    """Rows of (id, n_links, component_id)."""
    unit = x / np.sqrt((x * x).sum(1, keepdims=True))
    near = unit @ unit.T >= threshold
    root = np.arange(len(x))
    while True:
        new = np.array([root[near[i]].min() for i in range(len(x))])
        if (new == root).all():
            break
        root = new
    least = {r: min(ids[root == r]) for r in set(root.tolist())}
    return sorted((int(i), int(near[k].sum()) - 1, int(least[root[k]])) for k, i in enumerate(ids))


def clump_chains(chains, clumps, size, seed=0, dim=64):
    """Chains of clumps whose members, about 0.98 alike, fill each other's lists; neighbouring clumps are about 0.92 alike."""
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(chains):
        a, b = np.linalg.qr(rng.normal(size=(dim, 2)))[0].T
        for c in range(clumps):
            middle = np.cos(0.35 * c) * a + np.sin(0.35 * c) * b
            rows.append(middle + 0.14 / np.sqrt(dim) * rng.normal(size=(size, dim)))
    x = np.concatenate([*rows, rng.normal(size=(500, dim))])
    return x[rng.permutation(len(x))].astype(np.float32).astype(float)


def test_clumps_that_fill_their_lists_are_linked(spark):
    x = clump_chains(chains=20, clumps=3, size=14)
    ids = np.arange(len(x)) * 7 % 10007
    want = brute_force(x, ids, 0.9)
    assert max(sum(w[2] == c for w in want) for c in {w[2] for w in want}) == 3 * 14
    out = nn_descent.near_duplicates(table(spark, x, ids), threshold=0.9, audit=1).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == want


def test_audit_far_below_all_nodes(spark):
    x = clusters(n=1500)
    ids = np.arange(len(x))
    told = {}
    out = nn_descent.near_duplicates(table(spark, x, ids), threshold=0.9, audit=16, report=told).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == brute_force(x, ids, 0.9)
    assert told["recall"] == 1


def test_audit_judges_the_descent_alone(spark):
    x = clusters()
    ids = np.arange(len(x))
    told = {}
    with pytest.warns(UserWarning, match="after 2 rounds"):  # the audit covers all, and its own pairs don't count as found
        out = nn_descent.near_duplicates(table(spark, x, ids), threshold=0.9, tables=1, part=4, sweeps=0, most_rounds=2, report=told).collect()
    assert told["rounds"] == 2 and told["recall"] < 1
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in out) == brute_force(x, ids, 0.9)


def test_empty_vectors(spark):
    none = table(spark, np.zeros((0, 8)))
    assert nn_descent.near_duplicates(none).count() == 0 and posting_lists.nearest(none).count() == 0
    assert sorted(r.vec_id for r in nn_descent.near_duplicates(table(spark, np.zeros((0, 8)), None, BAD[:2])).collect()) == [9001, 9002]


@pytest.mark.parametrize("n, part", [(900, 1024), (900, 5), (8, 1024)])
def test_nearest_recall_and_form(spark, n, part):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 8)) * rng.uniform(0.5, 2, size=(n, 1))
    x[n // 2 :: 5] = x[0]  # ties
    x = x.astype(np.float32).astype(float)
    told = {}
    out = posting_lists.nearest(table(spark, x, None, BAD), every=20, k=20, list_size=32, part=part, shelf=100, report=told).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert sorted(got) == list(range(0, n, 20))
    hit = total = 0
    for q, found in got.items():
        s = x @ x[q]
        order = sorted((i for i in range(n) if i != q), key=lambda i: (-round(s[i], 12), i))[:20]
        assert len(found) == len(order) and q not in dict(found)
        for v, score in found:
            assert abs(s[v] - score) < 1e-9
        keys = [(-round(score, 12), v) for v, score in found]
        assert keys == sorted(keys)
        hit += len({v for v, _ in found} & set(order))
        total += len(order)
    assert hit / total >= 0.9 and told["recall"] >= 0.9


def test_graph_search_finds_nearest_centroids():
    rng = np.random.default_rng(1)
    c = rng.normal(size=(500, 8)).astype(np.float32)
    graph = posting_lists.CentroidGraph(c)
    x = rng.normal(size=(200, 8)).astype(np.float32)
    at, d = graph.search(x, 64)
    true = np.argsort(((x[:, None] - c[None]) ** 2).sum(2), axis=1)[:, :10]
    assert np.mean([len(set(a[:10]) & set(t)) / 10 for a, t in zip(at, true)]) > 0.97
    assert (np.diff(d, axis=1) >= -1e-6).all()


def test_rows_that_repeat_an_id_are_candidates_each(spark):
    x = np.array([[1.0, 0], [0.9, 0], [0.8, 0], [0.8, 0], [0.5, 0]])
    out = posting_lists.nearest(table(spark, x, [20, 1, 1, 2, 20]), every=20, k=3).collect()
    got = sorted((round(r.score, 6), r.rank, r.vec_id) for r in out if r.query_id == 20)
    first = [(0.8, 2, 1), (0.8, 3, 2), (0.9, 1, 1)]
    second = [(0.4, 3, 1), (0.45, 2, 1), (0.5, 1, 20)]
    assert got == sorted(first + second)


def test_centroids_in_two_levels():
    rng = np.random.default_rng(3)
    c = posting_lists.balanced_centroids(rng.normal(size=(4000, 8)).astype(np.float32), 700, together=64)
    assert 600 < len(c) < 800 and np.isfinite(c).all()


def test_pairs_at_the_threshold_end_the_descent(spark):
    """Cosines of exactly 0.9, which other orders of the same sums put below it: one answer everywhere, and an end."""
    x = np.array([[-3.0, 5, 4], [0, 9, 9], [9, 0, 9], [5, -3, 4], [1e160, 0, 0], [9e160, 4.358898943540673e160, 0]])
    told = {}
    out = nn_descent.near_duplicates(table(spark, x, range(len(x))), threshold=0.9, most_rounds=3, report=told).collect()
    got = {r.vec_id: (r.n_links, r.component_id) for r in out}
    assert got[0] == (1, 0) and got[1] == (1, 0) and got[2] == (1, 2) and got[3] == (1, 2) and told["rounds"] <= 2


def test_cosines_are_symmetric():
    draw = np.random.default_rng(2)
    a, b = draw.normal(size=(500, 33)), draw.normal(size=(500, 33))
    assert (vectors.cosines(a, b) == vectors.cosines(b, a)).all()
    wanted = float(vectors.cosines(a[:1], b[:1])[0])
    assert vectors.near(a, b, wanted)[0, 0] and vectors.near(b, a, wanted)[0, 0] and not vectors.near(a, b, np.nextafter(wanted, 2))[0, 0]


def test_copies_of_queries_follow_the_lists_that_they_read(spark):
    """Ten times the shelves: a query goes to those of its lists, not to all; the answers stay."""
    draw = np.random.default_rng(6)
    centres = draw.normal(size=(40, 12)) * 8
    x = centres[draw.integers(0, 40, 6000)] + draw.normal(size=(6000, 12))
    x[4000:] = x[4000] + draw.normal(size=(2000, 12)) * 1e-3  # one long list
    rows, found, copies = table(spark, x, range(len(x))), {}, {}
    for shelf in (1 << 17, 120):
        told = {}
        got = posting_lists.nearest(rows, every=50, k=5, shelf=shelf, report=told).collect()
        found[shelf], copies[shelf] = sorted((r.query_id, r["rank"], r.vec_id) for r in got), told["copies"]
    assert found[120] == found[1 << 17] and len(found[120]) == 120 * 5
    shelves = 6000 // 120
    assert copies[120] < 120 * shelves / 2


@pytest.mark.parametrize("scale", [1, 1e-18, 1e17])
def test_nearest_of_unlike_lists_at_any_scale(spark, scale):
    """Tight and loose places, long vectors and short ones, at scales whose squares single precision can't hold."""
    draw = np.random.default_rng(11)
    n = 3000
    x = draw.normal(size=(n, 32))
    x[: n // 2] = draw.normal(size=(20, 32))[draw.integers(0, 20, n // 2)] + 0.02 * x[: n // 2]
    x[n // 2 : n // 2 + 300] *= np.exp(draw.normal(size=(300, 1)))
    x = (x[draw.permutation(n)] * scale).astype(np.float32).astype(float)
    out = posting_lists.nearest(table(spark, x), every=10, k=20, list_size=32, audit=64).collect()
    got = {}
    for r in out:
        assert r.score == pytest.approx(float(x[r.query_id] @ x[r.vec_id]), rel=1e-9, abs=1e-12 * scale * scale)
        got.setdefault(r.query_id, set()).add(r.vec_id)
    shares = []
    for q in range(0, n, 10):
        s = x @ x[q]
        s[q] = -np.inf
        shares.append(len(got[q] & set(np.argsort(-s)[:20].tolist())) / 20)
    assert np.mean(shares) >= 0.97 and np.mean(np.array(shares) < 0.9) <= 0.04
