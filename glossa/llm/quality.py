"""Operator 2: document quality by hierarchical empirical Bayes.

A logistic classifier on features of the whole text gives each document's evidence p. It is
fitted in numpy on labelled documents, at most about `sample` of them (a hash of the id
picks them; that bound is the parameter). Everything else covers all documents: a document
counts for its site with its label where it has one, else with p. Host means are shrunk to
the global mean and path means to their host's, with strengths found by the method of moments
from grouped sums, so sparse sites stay near their prior. The posterior adds to the logit of p the
shift of the path's posterior from the global mean; what the document itself has given to its path
and host is taken out of them before, so neither its label nor its evidence counts for it twice.

Null texts count as empty, null hosts and paths as a site of their own, null labels as none; several labels of
a document are averaged. Rows that repeat an id are scored each; a filter keeps an id if any
of its rows is kept, and keeps rows without an id. With labels of one kind only, p is the
global mean. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import common
from glossa.session import Scratch, broadcast_if_small

SAMPLE = 20_000
BROADCAST_IDS = 500_000
LABEL_ROWS = 500_000

_ODD = re.compile(r"[^\w\s.,;:!?'\"()\-]")
_CLOSE = re.compile(r"[.!?]+(?:\s|$)")

FEATURES = ("log_words", "word_length", "distinct", "odd_words", "bar_words", "upper", "shouts", "digits", "odd", "line_repeats", "short_lines", "sentence", "closed", "top_word", "shape_share", "empty")


def features(text: str) -> list[float]:
    """Bounded numbers in the order of FEATURES, for any text."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    counts = Counter(words)
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    line_counts = Counter(lines)
    letters = sum(map(str.isalpha, text)) or 1
    odd_words = sum(c for w, c in counts.items() if _ODD.search(w))
    digits = sum(map(text.count, "0123456789"))
    return [
        np.log1p(n),
        min(len(text) / n, 40.0),
        len(counts) / n,
        odd_words / n,
        (counts["|"] + counts["/"] + counts["-"] + counts["*"]) / n,
        sum(map(str.isupper, text)) / letters,
        text.count("!!") / n,
        digits / len(text),
        len(_ODD.findall(text)) / len(text),
        1 - len(line_counts) / len(lines),
        sum(len(x.split()) <= 2 for x in lines) / len(lines),
        min(n / (1 + len(_CLOSE.findall(text))), 100.0) / 100,
        float(text.rstrip()[-1:] in ".!?"),
        max(counts.values()) / n,
        sum(w.islower() for w in words) / n,
        0.0,
    ]


@dataclass
class Classifier:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    @staticmethod
    def expand(x: np.ndarray) -> np.ndarray:
        """Features with their squares and square roots, so that thresholds bend."""
        return np.concatenate([x, np.sqrt(np.abs(x)), x * x], axis=1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = (np.clip((self.expand(x) - self.mean) / self.scale, -8, 8)) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -12, 12)))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 30) -> Classifier:
    """Ridge logistic regression by Newton steps; y may be a fraction."""
    wide = Classifier.expand(x) if len(x) else np.zeros((0, 3 * len(FEATURES)))
    share = (y.sum() + 1) / (len(y) + 2)
    bias = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        k = wide.shape[1]
        return Classifier(np.zeros(k), np.ones(k), np.zeros(k), bias)
    mean, scale = wide.mean(0), wide.std(0) + 1e-6
    z = np.c_[np.clip((wide - mean) / scale, -8, 8), np.ones(len(y))]
    w = np.zeros(z.shape[1])
    w[-1] = bias
    penalty = np.full(z.shape[1], ridge * len(y))
    penalty[-1] = 0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -12, 12)))
        g = z.T @ (y - p) - penalty * w
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-6)
        move = np.linalg.solve(h, g)
        w += move * min(1.0, 5 / (np.abs(move).max() + 1e-12))
        if np.abs(move).max() < 1e-6:
            break
    return Classifier(mean, scale, w[:-1], float(w[-1]))


def _features_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t) for t in common.texts(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], ["y", "x"])


def train(docs: DataFrame, labels: DataFrame, *, sample: int, id_col: str, text_col: str, label_col: str) -> Classifier:
    """The classifier, fitted on at most about `sample` labelled documents."""
    given = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).cast("double").alias("y"))
    n = given.count()
    rate = min(1.0, sample / max(1, n))
    some = given.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(rate * 1_000_000) + (rate == 1.0)).limit(sample)
    texts = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("t")).join(F.broadcast(some), "id")
    texts = texts.groupBy("id").agg(F.first("y").alias("y"), F.min("t").alias("t")).select("y", "t")  # a row an id, however often it stands there
    rows = common.arrow_pass(texts, _features_pass, "y double, x array<double>").toPandas()
    x = np.stack(rows["x"]) if len(rows) else np.zeros((0, len(FEATURES)))
    return fit(x.astype(float), rows["y"].to_numpy(dtype=float))


def strength(groups: DataFrame, prior) -> float:
    """Prior strength of Beta means over rows (n, k), given each row's prior mean, by moments.

    The spread of group means beyond what n draws would show is the variance of the prior.
    """
    row = groups.select("n", "k", prior.alias("m")).agg(
        F.sum("n").alias("n"),
        F.sum(F.col("n") * F.col("n")).alias("nn"),
        F.count("*").alias("g"),
        F.sum(F.col("n") * F.pow(F.col("k") / F.col("n") - F.col("m"), 2)).alias("s"),
        F.avg(F.col("m") * (1 - F.col("m"))).alias("v"),
    ).first()
    if not row["g"] or not row["v"]:
        return 1.0
    spread = (row["s"] - (row["g"] - 1) * row["v"]) / max(row["n"] - row["nn"] / row["n"], 1e-9)
    return float(np.clip(row["v"] / max(spread, 1e-9) - 1, 1.0, 1e6))


def logit(p):
    return F.log(p / (1 - p))


def judge(
    docs: DataFrame,
    labels: DataFrame,
    *,
    threshold: float = 0.5,
    sample: int = SAMPLE,
    id_col: str = "doc_id",
    text_col: str = "text",
    host=None,
    path=None,
    label_col: str = "quality",
) -> DataFrame:
    """One row per document: id, evidence, host_posterior, path_posterior (of the path's other documents), posterior, keep.

    `host` and `path` are columns of `docs` (by default its source, and its language below it).
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    scratch = Scratch(spark, "quality")
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    model = train(docs, labels, sample=sample, id_col=id_col, text_col=text_col, label_col=label_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t) for t in common.texts(batch.column(3))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(model(x))], ["id", "host", "path", "evidence"])

    rows = docs.select(docs[id_col].alias("id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), F.col(text_col).cast("string").alias("t"))
    scored = scratch.cut(common.arrow_pass(rows, score, f"id {rows.schema['id'].dataType.simpleString()}, host string, path string, evidence double"), "scored")

    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.avg(label_col).cast("double").alias("label"))
    seen = scored.join(broadcast_if_small(known, LABEL_ROWS), "id", "left").withColumn("y", F.coalesce("label", "evidence")).drop("label")
    seen = scratch.cut(seen, "seen")
    scratch.drop("scored")
    paths = scratch.cut(seen.groupBy("host", "path").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("k")), "paths")
    total = paths.agg(F.sum("n"), F.sum("k")).first()
    mu = float(np.clip((total[1] or 0.0) / max(total[0] or 0.0, 1.0), 1e-4, 1 - 1e-4)) if total[0] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    kappa = strength(hosts, F.lit(mu))
    hosts = hosts.select("host", F.col("n").alias("host_n"), F.col("k").alias("host_k"), ((F.col("k") + kappa * mu) / (F.col("n") + kappa)).alias("host_posterior"))
    sites = scratch.cut(paths.join(hosts, "host"), "sites")
    kappa_path = strength(sites, F.col("host_posterior"))
    sites = broadcast_if_small(scratch.cut(sites, "posteriors"), 50_000)
    others = (F.col("host_k") - F.col("y") + kappa * mu) / (F.col("host_n") - 1 + kappa)
    path_posterior = (F.col("k") - F.col("y") + kappa_path * others) / (F.col("n") - 1 + kappa_path)
    at_site = seen.join(sites, ["host", "path"]).withColumn("path_posterior", path_posterior)
    z = logit(F.col("evidence")) + logit(F.least(F.greatest("path_posterior", F.lit(1e-4)), F.lit(1 - 1e-4))) - F.lit(float(np.log(mu / (1 - mu))))
    return at_site.select(
        F.col("id").alias(id_col), "evidence", "host_posterior", "path_posterior", (1 / (1 + F.exp(-z))).alias("posterior")
    ).withColumn("keep", F.col("posterior") >= threshold)


def keep_good(docs: DataFrame, labels: DataFrame, *, threshold: float = 0.5, id_col: str = "doc_id", **more) -> DataFrame:
    """`docs` without the documents that `judge` rejects."""
    scratch = Scratch(docs.sparkSession, "keep_good")
    found = judge(docs, labels, threshold=threshold, id_col=id_col, **more)
    gone = found.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_gone")).agg(F.max("keep").alias("k")).where("not k").select("_gone")
    gone = broadcast_if_small(scratch.cut(gone, "gone"), BROADCAST_IDS)
    return docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
