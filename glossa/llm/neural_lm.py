"""Operator 9: a log-bilinear language model, trained by noise-contrastive estimation in numpy.

Words are runs without ASCII white space, A-Z lower-cased; every document closes with an
end token, which also stands before its first word. The most frequent tokens, as many as `grow`
times the square root of the training tokens, are units of their own, so the model grows with the
corpus; all other words (unseen ones too) share `classes` units by their last two bytes, and
within such a class a word has its add-0.1 share.

The model predicts a unit from the `CONTEXT` tokens before it: their vectors, weighted by place, add
up to h. Units stand in groups of about the square root of their number, in order of frequency:
P(u | h) = softmax over groups (h . g + a) times softmax over the group's units (h . q + b). Both
are normalised by batched matrix products, so the probabilities of all tokens add up to 1.

Training passes over all training documents, once or `passes` times. Every task starts from the same vectors, whose
biases are the counted frequencies, and takes steps of noise-contrastive estimation over its
own batches of tokens: groups against groups drawn by their frequency, units against units
drawn within their group. What the tasks have learnt is averaged for each unit, weighted by how
often a task has met it; a lost task learns the same again.

Word counts cover all training documents and stay distributed. The most frequent
tokens, at most `head`, are broadcast with their counts; all others meet their counts in a join.

Null texts count as empty (one end token), null ids as the empty text for the split.
Repeated rows are scored each. With no training documents every count is 0 and the model is
uniform over units. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import common
from glossa.session import Scratch

END = b"\n"  # never a word
ADD = 0.1
CONTEXT = 2
#: Tokens of one training step, of one matrix product, and of one scoring block.
STEP, PRODUCT, BLOCK = 4096, 4096, 100_000


def tokens(text: str) -> list[bytes]:
    return [*text.encode().lower().split(), END]


def held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def word_class(word: bytes, classes: int) -> int:
    return zlib.crc32(word[-2:]) % classes


class Lexicon(dict):
    """Head token to its place; other words to a place past the head, by class."""

    def __init__(self, head: list[bytes], classes: int):
        super().__init__((w, i) for i, w in enumerate(head))
        self.size, self.classes = len(head), classes

    def __missing__(self, word: bytes) -> int:
        return self.size + word_class(word, self.classes)

    def places(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def units(self, short: int) -> np.ndarray:
        """Unit of each place."""
        named = [i if i < short else short + word_class(w, self.classes) for w, i in self.items()]
        return np.r_[np.array(named, np.int64), short + np.arange(self.classes)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "c"])
        counts.clear()
        return batch

    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), common.texts(batch.column(1))):
            if not held_out(key):
                counts.update(tokens(text))
        if len(counts) > 500_000:
            yield out()
    if counts:
        yield out()


def context_of(units: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """The CONTEXT units before each token, nearest first; before a document's start stands the end token."""
    place = np.arange(len(units)) - np.repeat(starts, np.diff(np.r_[starts, len(units)]))
    out = np.full((len(units), CONTEXT), end, np.int32)
    for j in range(CONTEXT):
        rows = np.flatnonzero(place > j)
        out[rows, j] = units[rows - j - 1]
    return out


def row_sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the sums of their values, and how often each stands there."""
    order = np.argsort(rows, kind="stable")
    sorted_ = rows[order]
    first = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    return sorted_[first], np.add.reduceat(values[order], first), np.diff(np.r_[first, len(rows)])


class LogBilinear:
    """Units in groups; `counts` are the units' training counts, in the order of units."""

    def __init__(self, counts: np.ndarray, width: int = 24, seed: int = 0):
        rng = np.random.default_rng(seed)
        size = len(counts)
        self.width, self.size = width, size
        self.span = max(1, int(np.ceil(np.sqrt(size))))  # units of a group
        self.groups = -(-size // self.span)
        p = (counts + 0.5) / (counts + 0.5).sum()
        self.cum = np.r_[0, np.cumsum(p)]
        mass = np.add.reduceat(p, np.arange(0, size, self.span))
        self.p_group, self.p_within = mass, p / mass[np.arange(size) // self.span]
        self.r = rng.normal(0, 0.1, (size, width)).astype(np.float32)
        self.q = np.zeros((size, width), np.float32)
        self.b = np.log(self.p_within).astype(np.float32)
        self.g = np.zeros((self.groups, width), np.float32)
        self.a = np.log(mass).astype(np.float32)
        self.c = (np.ones((CONTEXT, width)) / (1 + np.arange(CONTEXT))[:, None]).astype(np.float32)
        self.pace = {k: np.full(len(getattr(self, k)), 1e-3, np.float32) for k in "rqbgac"}
        self.met = np.zeros(size, np.int64)
        self.seen = 0

    def _move(self, name: str, rows: np.ndarray, grads: np.ndarray, rate: float) -> None:
        """Adagrad with one pace a row."""
        pace = self.pace[name]
        pace[rows] += grads * grads if grads.ndim == 1 else (grads * grads).mean(1)
        step = rate / np.sqrt(pace[rows])
        getattr(self, name)[rows] += step * grads if grads.ndim == 1 else step[:, None] * grads

    def step(self, before: np.ndarray, unit: np.ndarray, rng: np.random.Generator, noise: int = 1, group_noise: int = 4, rate: float = 0.1) -> None:
        """One step over a batch of tokens (`before`: their contexts): data are told from drawn noise."""
        n, group = len(unit), unit // self.span
        x = self.r[before]
        h = np.einsum("njd,jd->nd", x, self.c)

        def sigmoid(s: np.ndarray) -> np.ndarray:
            return 1 / (1 + np.exp(-np.clip(s, -30, 30)))

        # groups: the noise of a batch is shared
        drawn = rng.choice(self.groups, group_noise, p=self.p_group)
        own = self.g[group]
        hit = 1 - sigmoid((h * own).sum(1) + self.a[group] - np.log(group_noise * self.p_group[group]).astype(np.float32))
        miss = -sigmoid(h @ self.g[drawn].T + self.a[drawn] - np.log(group_noise * self.p_group[drawn]).astype(np.float32))
        dh = hit[:, None] * own + miss @ self.g[drawn]
        # few groups: their sums are bin counts, and the bias is a last column
        ones = np.c_[h, np.ones(n, np.float32)]
        dg = np.zeros((self.groups, self.width + 1), np.float32)
        order = np.argsort(group, kind="stable")
        first = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0])
        dg[group[order][first]] = np.add.reduceat((hit[:, None] * ones)[order], first)
        np.add.at(dg, drawn, miss.T @ ones)
        g_rows = np.flatnonzero(dg.any(1))
        dg, da = dg[g_rows, :-1], dg[g_rows, -1]

        # units against units of their group
        low, high = self.cum[group * self.span], self.cum[np.minimum((group + 1) * self.span, self.size)]
        other = np.searchsorted(self.cum, low + rng.random((noise, n)) * (high - low), side="right") - 1
        units = np.concatenate([unit[None], np.clip(other, group * self.span, np.minimum((group + 1) * self.span, self.size) - 1)])
        told = self.q[units]
        s = np.einsum("knd,nd->kn", told, h) + self.b[units] - np.log(noise * self.p_within[units]).astype(np.float32)
        e = -sigmoid(s)
        e[0] += 1
        dh += np.einsum("kn,knd->nd", e, told)
        q_rows, dq, times = row_sums(units.ravel(), (e[:, :, None] * ones).reshape(-1, self.width + 1))
        dq, db = dq[:, :-1], dq[:, -1]
        r_rows, dr, again = row_sums(before.ravel(), (dh[:, None, :] * self.c).reshape(-1, self.width))
        dc = np.einsum("nd,njd->jd", dh, x)
        for name, rows, grads in (("g", g_rows, dg), ("a", g_rows, da), ("q", q_rows, dq), ("b", q_rows, db), ("r", r_rows, dr), ("c", np.arange(CONTEXT), dc)):
            self._move(name, rows, grads.astype(np.float32), rate)
        self.met[q_rows] += times
        self.met[r_rows] += again
        self.seen += n

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, weight, values): units that were met, then groups and context weights."""
        met = np.flatnonzero(self.met)
        blank = np.zeros((self.groups + CONTEXT, self.width), np.float32)
        rest = np.c_[np.concatenate([self.g, self.c]), blank, np.r_[self.a, np.zeros(CONTEXT, np.float32)]]
        row = np.r_[met, self.size + np.arange(self.groups + CONTEXT)]
        return row, np.r_[self.met[met], np.full(self.groups + CONTEXT, max(1, self.seen))], np.concatenate([np.c_[self.r[met], self.q[met], self.b[met]], rest])

    def take(self, row: np.ndarray, values: np.ndarray) -> "LogBilinear":
        """The given rows in place of its own."""
        w, unit = self.width, row < self.size
        at, x = row[unit], values[unit]
        self.r[at], self.q[at], self.b[at] = x[:, :w], x[:, w : 2 * w], x[:, 2 * w]
        at, x = row[~unit] - self.size, values[~unit]
        group = at < self.groups
        self.g[at[group]], self.a[at[group]] = x[group, :w], x[group, 2 * w]
        self.c[at[~group] - self.groups] = x[~group, :w]
        return self

    def log_probabilities(self, before: np.ndarray, unit: np.ndarray) -> np.ndarray:
        """Natural logs of the units after their contexts."""

        def normal(s: np.ndarray) -> np.ndarray:
            """Log of the sum of exponentials of each row, in place."""
            top = s.max(1)
            s -= top[:, None]
            np.exp(s, out=s)
            return top + np.log(s.sum(1))

        h = np.einsum("njd,jd->nd", self.r[before], self.c)
        group = unit // self.span
        out = np.empty(len(unit))
        for at in range(0, len(unit), PRODUCT):
            s = h[at : at + PRODUCT] @ self.g.T + self.a
            out[at : at + PRODUCT] = s[np.arange(len(s)), group[at : at + PRODUCT]] - normal(s)
        order = np.argsort(group, kind="stable")
        cuts = np.searchsorted(group[order], np.arange(self.groups + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            first = k * self.span
            for at in range(cuts[k], cuts[k + 1], PRODUCT):
                some = order[at : min(at + PRODUCT, cuts[k + 1])]
                s = h[some] @ self.q[first : first + self.span].T + self.b[first : first + self.span]
                out[some] += s[np.arange(len(some)), unit[some] - first] - normal(s)
        return out


def _train(sent, named: int, classes: int, width: int, noise: int, rate: float, passes: int):
    """Training documents of a task to what its model has learnt: (row, weight, values in half precision)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = sent.value
        lexicon = Lexicon(given["head"], classes)
        unit, end = lexicon.units(named), given["end"]
        model, rng = LogBilinear(given["counts"], width), np.random.default_rng(1)
        for batch in batches:
            texts = [tokens(text) for key, text in zip(batch.column(0).to_pylist(), common.texts(batch.column(1))) if not held_out(key)]
            if not texts:
                continue
            starts = np.cumsum([0, *map(len, texts)])[:-1]
            u = unit[np.concatenate([lexicon.places(ws) for ws in texts])].astype(np.int32)
            before = context_of(u, starts, end)
            order = np.concatenate([rng.permutation(len(u)) for _ in range(passes)])
            for at in range(0, len(order), STEP):
                some = order[at : at + STEP]
                model.step(before[some], u[some], rng, noise, rate=rate)
        if model.seen:
            row, weight, values = model.rows()
            for at in range(0, len(row), 10_000):
                part = values[at : at + 10_000].astype(np.float16)
                yield pa.RecordBatch.from_arrays([pa.array(row[at : at + 10_000]), pa.array(weight[at : at + 10_000]), pa.array([v.tobytes() for v in part], pa.binary())], ["row", "weight", "values"])

    return run


def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by `row` to each row's weighted mean."""
    held = (None, 0, None)

    def out(items: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r for r, *_ in items], pa.int64()), pa.array([(x / w).astype(np.float32).tobytes() for _, w, x in items], pa.binary())], ["row", "values"])

    for batch in batches:
        if not batch.num_rows:
            continue
        weight = batch.column(1).to_numpy().astype(np.float64)
        x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float16).reshape(batch.num_rows, -1).astype(np.float64) * weight[:, None]
        row = batch.column(0).to_numpy()
        first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        items = list(zip(row[first].tolist(), np.add.reduceat(weight, first).tolist(), np.add.reduceat(x, first)))
        if held[0] == items[0][0]:
            items[0] = (held[0], held[1] + items[0][1], held[2] + items[0][2])
        elif held[0] is not None:
            items.insert(0, held)
        held = items.pop()
        if items:
            yield out(items)
    if held[0] is not None:
        yield out([held])


def _score(sent, named: int, classes: int, width: int):
    """Documents to one row each and one for each token past the head."""
    names = ["uid", "word", "id", "held_out", "n", "known", "base", "lm"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = sent.value
        lexicon = Lexicon(given["head"], classes)
        unit, end = lexicon.units(named), given["end"]
        model = LogBilinear(given["counts"], width).take(*given["model"])
        log_count = np.r_[given["log_count"], np.zeros(classes)]
        known = np.r_[given["known"], np.zeros(classes, bool)]
        beyond = unit >= named
        within = np.where(beyond, log_count - np.r_[np.zeros(named), given["log_mass"]][unit], 0.0)  # less the count, for words past the head
        uid = TaskContext.get().partitionId() << 33
        for batch in batches:
            keys = batch.column(0).to_pylist()
            texts = [tokens(text) for text in common.texts(batch.column(1))]
            at = 0
            while at < len(texts):
                # as many documents as fill a block
                sizes = np.cumsum([len(ws) for ws in texts[at : at + 1000]])
                count = max(1, int(np.searchsorted(sizes, BLOCK)))
                some = texts[at : at + count]
                starts = np.r_[0, sizes[: len(some) - 1]]
                place = np.concatenate([lexicon.places(ws) for ws in some])
                u = unit[place].astype(np.int32)
                before = context_of(u, starts, end)
                lm = np.concatenate([model.log_probabilities(before[k : k + BLOCK], u[k : k + BLOCK]) for k in range(0, len(u), BLOCK)]) / np.log(10)
                lm_sum, base, seen = (np.add.reduceat(x, starts) for x in (lm + within[place], log_count[place], known[place].astype(np.int64)))
                ids = uid + np.arange(len(some))
                columns = [ids, [b" %d" % i for i in ids], keys[at : at + len(some)], [held_out(k) for k in keys[at : at + len(some)]], [len(ws) for ws in some], seen, base, lm_sum]
                types = [pa.int64(), pa.binary(), batch.schema.field(0).type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
                past = np.flatnonzero(place >= lexicon.size)
                if len(past):
                    doc = np.searchsorted(starts, past, side="right") - 1
                    words = [some[d][i] for d, i in zip(doc.tolist(), (past - starts[doc]).tolist())]
                    none = [None] * len(words)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip([ids[doc], words, *[none] * 6], types)], names)
                uid += len(some)
                at += len(some)

    return run


def score_documents(
    docs: DataFrame, *, grow: float = 0.5, classes: int = 512, head: int = 300_000, width: int = 8, noise: int = 1, rate: float = 0.1, passes: int = 1, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document row: id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    common.bounded_batches(spark)
    scratch = Scratch(spark, "lm")
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("t"))
    id_type = rows.schema["id"].dataType.simpleString()

    counts = scratch.cut(common.arrow_pass(rows, _count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    short = max(1, int(grow * np.sqrt(n)))
    top = common.most_frequent(counts, "c", head).toPandas().sort_values(["c", "word"], ascending=[False, True])
    words, top_counts = [bytes(w) for w in top["word"]], top["c"].to_numpy(dtype=np.float64)
    least = float(top_counts[-1]) if len(words) else np.inf  # every word of so many counts is in the head
    # short units: the first words, with the end token always among them
    if END not in words[:short]:
        if END in words:
            at = words.index(END)
            words.pop(at)
            top_counts = np.delete(top_counts, at)
        ends = counts.where(F.col("word") == F.lit(END)).select("c").first()
        place = min(short - 1, len(words))
        words.insert(place, END)
        top_counts = np.insert(top_counts, place, float(ends.c) if ends else 0.0)
    named = min(short, len(words))
    in_short = set(words[:named])

    # mass and number of the words of each class: all but the short ones
    cls = F.pmod(F.crc32(F.expr("substring(word, -2, 2)")), F.lit(classes))
    mass, kinds = np.zeros(classes), np.zeros(classes)
    for c, m, k in counts.groupBy(cls.alias("k")).agg(F.sum("c"), F.count("*")).collect():
        mass[c], kinds[c] = m, k
    for w, c in zip(words[:named], top_counts):
        if c:
            mass[word_class(w, classes)] -= c
            kinds[word_class(w, classes)] -= 1
    log_mass = np.log10(mass + ADD * (kinds + 1))

    end = words.index(END)
    unit_counts = np.r_[top_counts[:named], mass]
    sent = spark.sparkContext.broadcast({"head": words, "end": end, "counts": unit_counts})
    learnt = common.arrow_pass(rows, _train(sent, named, classes, width, noise, rate, passes), "row long, weight long, values binary").repartition("row").sortWithinPartitions("row")
    with common.batch_rows(spark, 10_000):
        learnt = scratch.cut(common.arrow_pass(learnt, _average, "row long, values binary"), "model").toPandas()  # a row for each unit and group
    model = learnt["row"].to_numpy(dtype=np.int64), np.frombuffer(b"".join(learnt["values"]), np.float32).reshape(-1, 2 * width + 1)
    log_count = np.log10(top_counts + ADD)
    given = spark.sparkContext.broadcast({"head": words, "end": end, "counts": unit_counts, "model": model, "log_count": log_count, "known": top_counts > 0, "log_mass": log_mass})
    parts = common.arrow_pass(rows, _score(given, named, classes, width), f"uid long, word binary, id {id_type}, held_out boolean, n long, known long, base double, lm double")
    rest = counts.select("word", "c").where(F.col("c") < F.lit(least))
    log_c = F.when(F.col("n").isNull(), F.log10(F.coalesce(F.col("c"), F.lit(0)) + ADD)).otherwise(0.0)
    met = parts.join(rest, "word", "left").withColumn("t", log_c).withColumn("k", F.when(F.col("n").isNull(), F.col("c").isNotNull().cast("long")).otherwise(F.col("known")))
    scored = met.groupBy("uid").agg(
        F.max("id").alias(id_col), F.max("held_out").alias("held_out"), F.max("n").alias("n_tokens"), F.sum("k").alias("n_known"), F.sum("t").alias("t"), F.max("base").alias("base"), F.max("lm").alias("lm")
    )
    whole = float(np.log10(n + ADD * (v + 1)))
    return scored.select(
        id_col,
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("t") - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        (F.col("lm") + F.col("t")).alias("score"),
    )
