import random

import numpy as np

from glossa.llm import quality as q


def corpus(seed=0, n=240):
    rng = random.Random(seed)
    docs, labels = [], []
    for k in range(n):
        words = [rng.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(rng.randrange(20, 60))]
        good = rng.random() < 0.8
        text = ". ".join(" ".join(words[i : i + 8]).capitalize() for i in range(0, len(words), 8)) + "." if good else " ".join(w + rng.choice(["%%%", "###"]) for w in words)
        docs.append((k, text, rng.choice(["s1", "s2", "s3"]), rng.choice(["en", "fr"])))
        if k % 2 == 0:
            labels.append((k, int(good)))
    return docs, labels, {k: not ("%" in t or "#" in t) for k, t, *_ in docs}


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_posteriors_are_the_formulas(spark):
    docs, labels, good = corpus()
    docs += [(900, None, None, None), (None, "Alpha beta.", "s1", "en"), (901, "", "s1", "en"), (0, docs[0][1], "s1", "en"), (902, "x " * 50000, "rare", "zz")]
    labels += [(0, None), (2, 1 - labels[1][1]), (None, 1)]
    out = q.judge(*frames(spark, docs, labels), threshold=0.3).collect()
    assert len(out) == len(docs)
    wrong = [r.doc_id for r in out if r.doc_id in good and r.doc_id > 2 and r.keep != good[r.doc_id]]
    assert len(wrong) <= 2
    # sites: means of labels, else evidence; shrunk to the host, and that to the global mean
    truth = {}
    for d, y in labels:
        if y is not None:
            truth.setdefault(d, []).append(y)
    rows = {}
    for (d, _, host, path), r in zip(sorted(docs, key=repr), sorted(out, key=lambda r: repr((r.doc_id,)))):
        rows.setdefault((host or "", path or ""), []).append(r)
    y = {s: [np.mean(truth[r.doc_id]) if r.doc_id in truth and r.doc_id is not None else r.evidence for r in rs] for s, rs in rows.items()}
    mu = np.mean([v for vs in y.values() for v in vs])
    shrunk = {r.host_posterior for r in out}
    assert len(shrunk) <= 5 and min(shrunk) <= mu <= max(shrunk)
    for (host, _), rs in rows.items():
        mean = np.mean([v for (h, _), vs in y.items() if h == host for v in vs])
        for r in rs:
            assert min(mean, mu) - 1e-6 <= r.host_posterior <= max(mean, mu) + 1e-6
            z = np.log(r.evidence / (1 - r.evidence)) + np.log(r.path_posterior / (1 - r.path_posterior)) - np.log(mu / (1 - mu))
            assert abs(r.posterior - 1 / (1 + np.exp(-z))) < 1e-3
    # a document alone at its site takes the global mean for it, whatever it says itself
    alone = next(r for r in out if r.doc_id == 902)
    assert abs(alone.path_posterior - mu) < 1e-3 and abs(alone.host_posterior - mu) > 1e-3


def test_filter_keeps_clean_documents_and_all_columns(spark):
    docs, labels, good = corpus(1, 120)
    frame, known = frames(spark, docs + [(None, "x%%%", "s", "en")], labels)
    kept = q.keep_good(frame, known, threshold=0.3)
    assert kept.columns == frame.columns
    ids = {r.doc_id for r in kept.collect()}
    assert None in ids and {k for k, g in good.items() if g} <= ids and len(ids & {k for k, g in good.items() if not g}) <= 2


def test_no_labels_one_kind_and_empty(spark):
    docs, labels, _ = corpus(2, 20)
    frame, known = frames(spark, docs, labels)
    assert q.judge(frame, known.limit(0)).count() == 20
    assert q.judge(frame, known.where("quality = 1")).where("not keep").count() == 0
    assert q.judge(frame.limit(0), known).count() == 0


def test_features_are_finite():
    for text in ["", " ", "\n", "!!!", "x" * 100_000, "a\n" * 1000, "\x00", "| " * 50, "Ж. ॐ"]:
        f = q.features(text)
        assert len(f) == len(q.FEATURES) and np.isfinite(f).all()
