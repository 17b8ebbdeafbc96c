"""Operator 10: n-gram Jaccard self-join by parity sketches.

A document's set holds the 64-bit hashes of its distinct shingles. A parity sketch splits
the hash space into lanes and XORs the hashes that fall into each lane, so one shingle that
only one of two documents has changes one lane at most: the number of lanes that differ (the
sketches' Hamming distance, lane by lane) is a lower bound of the symmetric difference.
Jaccard >= t bounds the symmetric difference of sets of a and b elements by
(a + b) * (1 - t) / (1 + t) = D. Hence, by the pigeonhole principle, in any one order of all
lane values, the first D + 1 filled lanes of two similar documents share one. These are the
join keys. Documents are sketched per size band (a factor of 4, with LOAD lanes for each element
of the band's largest set) and, where a larger partner may be in the next band, there too.

Any order gives whole results; lanes that many documents share go last, so passages that
stand in many documents seldom become keys. A key carries its place: how many lanes of a single
element stand before it. At the first lane that two documents share, all those lanes differ, and
each is an element of its own, so the two places together are D at most. Within a key, pairs of
close sizes and places are candidates; sketches of single bits (1024, for large sets 4 to 8 an
element) prune them by their Hamming distance, and the rest is verified on whole sets. A key's
group of more than a few documents is first linked by its neighbours and its first member; only
where that leaves it in more than one component are its pairs across components tested: first in
a window, of which each document gives its best partner, then all of them, in blocks of bounded
size. So no group's pairs are all listed, and yet no link between components is lost.

Equal sets are one class, found by a hash of the set (64 bits; where two sets of one such hash
differ in another 64 bits, those name them). Documents without words, or with a null id, link
with nothing; null texts count as empty. Rows that repeat a document id are versions of one
document and share its component. Other columns are not read by the join. An empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import common
from glossa.session import Scratch, broadcast_if_small

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Below this size every shingle has its own lane; above, bands grow by 4.
SMALL = 64
#: Lanes of a band for each element of its largest set (a power of two).
LOAD = 8
SKETCH_BITS = 1024
#: Lane values that occur so often among `WINDOW` lanes of one task count as common there.
COMMON, WINDOW = 2, 2_000_000
#: Common lane values are known by so many bits of theirs (4 MB are sent out); they change the order alone.
COMMON_BITS = 25
#: Rows next to each other in a key's group that the first round compares, and the second.
NEAR, WIDTH = 3, 64
#: Members of a block of a group, in the last round.
BLOCK = 256
#: A key of more rows is dealt to several tasks, for up to so many keys.
PART, SPLITS = 20_000, 20_000
BROADCAST_IDS = 500_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Texts to sorted arrays of distinct shingle hashes, whole batches at a time.

    Words are hashed eight bytes a step, all words of a chunk at once, so no word becomes
    an object. A shingle mixes its words' hashes in order.
    """

    #: Bytes hashed at a time; a longer text is hashed by itself.
    CHUNK = 1 << 20
    #: Words of more bytes are hashed one by one.
    LONG = 256

    def __init__(self, words: int):
        self.words = words
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.mask = np.array([(1 << 8 * k) - 1 for k in range(8)], np.uint64)

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        some, size = [], 0
        for text in texts:
            data = text.encode()
            if some and size + len(data) > self.CHUNK:
                yield from self._hash(some)
                some, size = [], 0
            some.append(data)
            size += len(data) + 1
        if some:
            yield from self._hash(some)

    def _word_hashes(self, low: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """`low`: lower-cased bytes, eight more than the words need."""
        eights = np.ndarray(len(low) - 7, "<u8", low, strides=(1,))
        left = end - begin
        out = mix(left.astype(np.uint64) + MULTIPLIER)
        for i in np.flatnonzero(left > self.LONG):
            out[i] ^= np.uint64(xxhash.xxh3_64_intdigest(low[begin[i] : end[i]].tobytes()))
        word = np.flatnonzero(left <= self.LONG)
        at, left = begin[word], left[word]
        while len(word):
            piece = eights[at]
            last = np.flatnonzero(left < 8)
            piece[last] &= self.mask[left[last]]
            out[word] = mix((out[word] ^ piece) * MULTIPLIER)
            more = left > 8
            word, at, left = word[more], at[more] + 8, left[more] - 8
        return out

    def _hash(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        low = self.lower[np.frombuffer(b"\n".join([*texts, b"\0" * 8]), np.uint8)]
        edge = np.diff(self.space[low[:-8]].astype(np.int8), prepend=np.int8(1))
        begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        word = self._word_hashes(low, begin, end)
        bounds = np.cumsum([len(t) + 1 for t in texts])
        at = np.searchsorted(begin, bounds)  # words before each text's end
        k = self.words
        runs = max(0, len(word) - k + 1)
        whole = np.full(runs, k, np.uint64)
        for i in range(k):
            whole = whole * MULTIPLIER + word[i : i + runs]
        whole = mix(whole)
        first = 0
        for last in at.tolist():
            n = last - first
            if n >= k:
                found = np.sort(whole[first : last - k + 1])
                yield found[np.r_[True, found[1:] != found[:-1]]]
            elif n:
                h = np.full(1, n, np.uint64)
                for i in range(first, last):
                    h = h * MULTIPLIER + word[i]
                yield mix(h)
            else:
                yield np.empty(0, np.uint64)
            first = last


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


class Namer:
    """Names of sets: `both` gives two independent hashes, a call the first, or the second where different sets share the first."""

    def __init__(self, bits: int = 64, shared: frozenset[int] = frozenset()):
        self.mask, self.shared = (1 << bits) - 1, shared

    def both(self, shingles: np.ndarray) -> tuple[int, int]:
        x = xxhash.xxh3_128_intdigest(shingles.tobytes())
        return tuple(np.array([x & self.mask, x >> 64], np.uint64).view(np.int64).tolist())

    def __call__(self, shingles: np.ndarray) -> int:
        h, g = self.both(shingles)
        return g if h in self.shared else h


def parity_bits(shingles: np.ndarray, size: int = SKETCH_BITS) -> np.ndarray:
    """The parity sketch of `size` bits (a power of two) as longs. Its halves XORed are the sketch of half the size."""
    odd = np.bincount((shingles & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def long_bits(shingles: np.ndarray) -> np.ndarray | None:
    """A sketch of 4 to 8 bits an element, where SKETCH_BITS are fewer than that."""
    size = 4 << max(0, len(shingles) - 1).bit_length()
    return parity_bits(shingles, size) if size > SKETCH_BITS else None


def most_apart(a, b, percent: int):
    """The largest symmetric difference of sets of a and b elements whose Jaccard is percent / 100 or more."""
    return (a + b) * (100 - percent) // (100 + percent)


def lanes(shingles: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """One band's sketch: the values of its filled lanes, each with its lane and band mixed in, and which hold a single element."""
    with np.errstate(over="ignore"):
        salt = mix(np.array([band + 1], np.uint64))
        if not band:
            return mix(shingles + salt), np.ones(len(shingles), bool)
        lane = shingles >> np.uint64(64 - (6 + 2 * band + LOAD.bit_length() - 1))  # sorted hashes: lanes stand together
        starts = np.flatnonzero(np.r_[True, lane[1:] != lane[:-1]])
        single = np.diff(starts, append=len(shingles)) == 1
        return mix(np.bitwise_xor.reduceat(shingles, starts) + lane[starts] * MULTIPLIER + salt), single


def band_of(n: int) -> int:
    """0 below SMALL, then 1 up to 4 * SMALL, and so on."""
    return 0 if n < SMALL else (n.bit_length() - 7) // 2 + 1


def sketches(shingles: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(lane values, single ones, keys needed, 1 for a guest) for each band in which the document may meet a partner; guests meet only a band's own."""
    n = len(shingles)
    largest = n * 100 // percent
    own = band_of(n)
    top = SMALL * 4**own - 1
    yield *lanes(shingles, own), most_apart(n, min(largest, top), percent) + 1, 0
    if largest > top:
        yield *lanes(shingles, own + 1), most_apart(n, largest, percent) + 1, 1


def _facts(words: int, percent: int, name: Namer):
    """Documents to (kind 0: id, size, set hashes, both bit sketches) and (kind 1: low bits of common lane values, their counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = common.keep(f"shingler {words}", lambda: Shingler(words))
        names = ["kind", "doc_id", "n", "h", "g", "values", "counts"]
        longs = pa.list_(pa.int64())
        pending, size = [], 0

        def common_lanes() -> Iterator[pa.RecordBatch]:
            seen = np.concatenate([np.empty(0, np.uint64), *pending])
            pending.clear()
            seen.sort()
            repeats = seen[1:][seen[1:] == seen[:-1]]  # each value once less than it occurs
            values, counts = np.unique(repeats, return_counts=True)
            often = counts + 1 >= COMMON
            values, counts = as_long(values[often] & np.uint64((1 << COMMON_BITS) - 1)), counts[often] + 1
            for at in range(0, len(values), 20_000):
                row = [[1], [None], [None], [None], [None], [values[at : at + 20_000]], [counts[at : at + 20_000]]]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, [pa.int32(), id_type, pa.int64(), pa.int64(), pa.int64(), longs, longs])], names)

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field(0).type
            n, names_of, bits, more = [], [], [], []
            for s in shingle(common.texts(batch.column(1))):
                n.append(len(s))
                names_of.append(name.both(s) if len(s) else (None, None))
                bits.append(parity_bits(s))
                more.append(long_bits(s))
                if len(s):
                    for values, *_ in sketches(s, percent):
                        pending.append(values)
                        size += len(values)
                if size > WINDOW:
                    yield from common_lanes()
                    size = 0
            count = len(n)
            h, g = zip(*names_of) if count else ((), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * count, pa.int32()), batch.column(0), pa.array(n, pa.int64()), pa.array(h, pa.int64()), pa.array(g, pa.int64()), pa.array(bits, longs), pa.array(more, longs)], names
            )
        yield from common_lanes()

    return run


def _common_map(counts: DataFrame) -> np.ndarray:
    """A bit for each low part of a lane value, set for the most frequent ones: an eighth of the bits at most, 4 MB in all."""
    often = common.most_frequent(counts, "c", 1 << COMMON_BITS - 3)
    pieces = often.groupBy(F.shiftright("low", 16).alias("piece")).agg(F.collect_list(F.col("low").bitwiseAND(0xFFFF).cast("int")).alias("at"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = []
            for at in batch.column(1):
                x = np.zeros(1 << 16, bool)
                x[at.values.to_numpy()] = True
                bits.append(np.packbits(x).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], ["piece", "bits"])

    out = np.zeros((1 << COMMON_BITS - 16, 1 << 13), np.uint8)
    for row in common.arrow_pass(pieces, pack, "piece long, bits binary").collect():
        out[row.piece] = np.frombuffer(row.bits, np.uint8)
    return out.ravel()


def _heavy(counts: DataFrame, members: int) -> tuple[np.ndarray, np.ndarray]:
    """Low parts of lane values with far more than `members` rows, sorted, and in how many parts their rows are dealt: SPLITS values at most."""
    found = common.most_frequent(counts.where(F.col("c") > members), "c", SPLITS).collect()
    low, c = np.array(sorted((r.low, r.c) for r in found), np.int64).reshape(-1, 2).T
    return low, -(-c // members)


def _is_common(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    at = (values & np.uint64((1 << COMMON_BITS) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _keys(words: int, percent: int, name: Namer, order_by):
    """Documents to (key, part, set, size, place) rows, once for each set that a task meets. Places are doubled, plus 1 for guests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle = common.keep(f"shingler {words}", lambda: Shingler(words))
        often, heavy, parts = order_by.value
        seen: set[int] = set()
        for batch in batches:
            keys, places, hashes, sizes = [], [], [], []
            for s in shingle(common.texts(batch.column(0))):
                if not len(s) or (h := name(s)) in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(h)
                for values, single, need, guest in sketches(s, percent):
                    order = np.lexsort((values, _is_common(values, often)))[:need]
                    alone = single[order]
                    keys.append(values[order])
                    places.append((np.cumsum(alone) - alone) * 2 + guest)
                    hashes.append(h)
                    sizes.append(len(s))
            if keys:
                counts = [len(k) for k in keys]
                keys, hashes = np.concatenate(keys), np.repeat(np.array(hashes, np.int64), counts)
                part = np.zeros(len(keys), np.int32)
                if len(heavy):
                    low = (keys & np.uint64((1 << COMMON_BITS) - 1)).astype(np.int64)
                    at = np.minimum(np.searchsorted(heavy, low), len(heavy) - 1)
                    part = np.where(heavy[at] == low, 1 + hashes % parts[at], 0).astype(np.int32)
                columns = [as_long(keys), part, hashes, np.repeat(np.array(sizes, np.int32), counts), np.concatenate(places).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["key", "part", "h", "n", "q"])

    return run


def _may_pair(n1, q1, n2, q2, percent: int):
    """Rows of one key that sizes and places allow to be a pair's first shared lane."""
    close = 100 * np.minimum(n1, n2) >= percent * np.maximum(n1, n2)
    return close & ((q1 & q2 & 1) == 0) & ((q1 >> 1) + (q2 >> 1) <= most_apart(n1, n2, percent))


PAIRS = "kind int, a long, b long, na long, nb long"


def _give(kind: int, *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(columns[0]), kind, np.int32)), *(pa.array(x.astype(np.int64)) for x in columns)], ["kind", "a", "b", "na", "nb"])


def _ordered(h1, n1, h2, n2) -> tuple[np.ndarray, ...]:
    swap = h1 > h2
    return np.where(swap, h2, h1), np.where(swap, h1, h2), np.where(swap, n2, n1), np.where(swap, n1, n2)


def _pairs(percent: int, near: int):
    """Rows sorted by key, place, size and set to candidate pairs (kind 0) and members of larger groups (kind 1: key, set, size, place).

    Pairs are of rows at most `near` apart and of each row with its group's first. Members that
    the group's least place rules out for every partner are not told. Of a split key's rows (part
    over 0) all are, as their partners may be in another part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "part", "h", "n", "q", "rank", "head_h", "head_n", "head_q")
        carry = {x: np.empty(0, np.int64) for x in names}
        for batch in batches:
            if not batch.num_rows:
                continue
            new = {x: batch.column(i).to_numpy().astype(np.int64) for i, x in enumerate(names[:5])}
            old, count = len(carry["key"]), batch.num_rows
            begins = np.r_[True, (new["key"][1:] != new["key"][:-1]) | (new["part"][1:] != new["part"][:-1])]
            begins[0] = not (old and carry["key"][-1] == new["key"][0] and carry["part"][-1] == new["part"][0])
            at = np.arange(count)
            start = np.maximum.accumulate(np.where(begins, at, -1))
            inside = start >= 0  # the group began in this batch
            new["rank"] = np.where(inside, at - start, at + (carry["rank"][-1] + 1 if old else 0))
            for x in ("h", "n", "q"):
                new[f"head_{x}"] = np.where(inside, new[x][np.maximum(start, 0)], carry[f"head_{x}"][-1] if old else 0)
            rows = {x: np.concatenate([carry[x], new[x]]) for x in names}
            key, part, h, n, q, rank, head_h, head_n, head_q = rows.values()
            fresh = np.arange(len(key)) >= old
            this = np.flatnonzero(fresh & (rank > near) & (head_h != h) & _may_pair(head_n, head_q, n, q, percent))
            if len(this):
                yield _give(0, *_ordered(head_h[this], head_n[this], h[this], n[this]))
            for back in range(1, min(near, len(key) - 1) + 1):
                this = np.arange(max(old, back), len(key))
                this = this[rank[this] >= back]
                other = this - back
                keep = (h[this] != h[other]) & _may_pair(n[this], q[this], n[other], q[other], percent)
                this, other = this[keep], other[keep]
                if len(this):
                    yield _give(0, *_ordered(h[other], n[other], h[this], n[this]))
            # the group's earlier members are told with the first row past `near`
            split = part > 0
            many = fresh & (split | (rank > near))
            late = np.flatnonzero(fresh & ~split & (rank == near + 1))
            for back in range(1, near + 2):
                many[late - back] = True
            many &= split | ((q >> 1) + (head_q >> 1) <= most_apart(n, n * 100 // percent, percent))
            if many.any():
                yield _give(1, key[many], h[many], n[many], q[many])
            carry = {x: rows[x][max(0, len(key) - near - 1) :] for x in names}

    return run


def _across(percent: int, width: int | None):
    """Rows of groups, sorted by group (g), place, size and set, to candidate pairs across components that their sketches allow.

    With a `width`, rows at most so far apart are compared and each gives its closest partner;
    without one, all rows of a group that are of different blocks, or of a block that is met by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = SKETCH_BITS // 64
        carry, old_bits, old_rank = [np.empty(0, np.int64)] * 6, np.empty((0, words), np.uint64), np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [batch.column(i).to_numpy().astype(np.int64) for i in range(6)]
            bits = np.concatenate([old_bits, batch.column(6).flatten().to_numpy().view(np.uint64).reshape(-1, words)])
            old = len(carry[0])
            g, h, n, q, comp, block = (np.concatenate([c, x]) for c, x in zip(carry, new))
            begins = np.r_[True, g[1:] != g[:-1]]
            at = np.arange(len(g))
            rank = at - np.maximum.accumulate(np.where(begins, at, 0))
            if old and old_rank[0]:  # the first group began before what is carried
                rank[: np.argmax(np.r_[begins[1:], True]) + 1] += old_rank[0]
            rows = at[old:]
            best, least = np.full(len(g), -1), np.full(len(g), np.inf)
            for back in range(1, len(g)):
                rows = rows[rank[rows] >= back]
                if not len(rows) or (width and back > width):
                    break
                this, other = rows[rows >= back], rows[rows >= back] - back
                keep = (comp[this] != comp[other]) & ((block[this] != block[other]) | (block[this] < 0)) & _may_pair(n[this], q[this], n[other], q[other], percent)
                this, other = this[keep], other[keep]
                apart = np.bitwise_count(bits[this] ^ bits[other]).sum(1, dtype=np.int64)
                keep = apart <= most_apart(n[this], n[other], percent)
                this, other, apart = this[keep], other[keep], apart[keep]
                if width:
                    share = apart / (n[this] + n[other])
                    closer = share < least[this]
                    least[this[closer]], best[this[closer]] = share[closer], other[closer]
                elif len(this):
                    yield _give(0, *_ordered(h[other], n[other], h[this], n[this]))
            if width and (this := np.flatnonzero(best >= 0)).size:
                other = best[this]
                yield _give(0, *_ordered(h[other], n[other], h[this], n[this]))
            tail = max(0, len(g) - width) if width else int(np.flatnonzero(begins)[-1])
            carry, old_bits, old_rank = [x[tail:] for x in (g, h, n, q, comp, block)], bits[tail:], rank[tail:]

    return run


def _apart_bits(a, b):
    """Hamming distance of two sketches; the longer is folded to the shorter's size."""

    def half(x):
        n = (F.size(x) / 2).cast("int")
        return F.zip_with(F.slice(x, F.lit(1), n), F.slice(x, n + 1, n), lambda u, v: u.bitwiseXOR(v))

    x, y = F.when(F.size(a) > F.size(b), half(a)).otherwise(a), F.when(F.size(b) > F.size(a), half(b)).otherwise(b)
    return F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, v: s + v)


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs that their bit sketches don't rule out: the short ones first, then the long ones of large sets."""
    most = F.floor((F.col("na") + F.col("nb")) * (100 - percent) / (100 + percent))

    def kept(some: DataFrame, column: str) -> DataFrame:
        bits = classes.where(F.col(column).isNotNull()).select("h", F.col(column).alias("x"))
        a, b = bits.select(F.col("h").alias("a"), F.col("x").alias("xa")), bits.select(F.col("h").alias("b"), F.col("x").alias("xb"))
        # sets of which one has no long sketch are not ruled out
        met = some.join(a, "a", "left").join(b, "b", "left")
        return met.where(F.coalesce(_apart_bits(F.col("xa"), F.col("xb")) <= most, F.lit(True))).drop("xa", "xb")

    return kept(kept(pairs, "bits"), "more")


def _verify(likely: DataFrame, sets_of, scratch: Scratch, percent: int, name: str) -> DataFrame:
    """The pairs whose Jaccard is high enough, as (a, b); whole sets travel for these pairs alone."""
    wanted = likely.select(F.col("a").alias("h")).union(likely.select(F.col("b").alias("h"))).distinct()
    sets = scratch.cut(sets_of(wanted), f"sets{name}")
    left, right = sets.select(F.col("h").alias("a"), F.col("s").alias("sa")), sets.select(F.col("h").alias("b"), F.col("s").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    links = likely.select("a", "b", "na", "nb").join(left, "a").join(right, "b").where(100 * both >= percent * (F.col("na") + F.col("nb") - both)).select("a", "b")
    links = scratch.cut(links, f"links{name}")
    scratch.drop(f"sets{name}")
    scratch.settle()
    return links


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component yet."""
    a, b = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    return pairs.join(a, "a", "left").join(b, "b", "left").where(~F.coalesce(F.col("ra") == F.col("rb"), F.lit(False))).drop("ra", "rb")


def _open_groups(larger: DataFrame, roots: DataFrame, percent: int, scratch: Scratch, name: str) -> DataFrame:
    """Members of the keys' groups that are in more than one component, with the group's size and its largest component."""
    placed = larger.join(roots, larger["h"] == roots["node"], "left").select("key", "h", "n", "q", F.coalesce("root", "h").alias("comp"))
    parts = placed.groupBy("key", "comp").agg(F.count("*").alias("c"), F.min("q").alias("q"))
    groups = parts.groupBy("key").agg(F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("most"), F.sum("c").alias("members"), F.min("q").alias("least")).where("comps > 1")
    groups = scratch.cut(groups.select("key", "members", "least", F.col("most.c").alias("major_size"), F.col("most.comp").alias("major")), f"{name}_open")
    may = f"shiftright(q, 1) + shiftright(least, 1) <= (n + n * 100 div {percent}) * {100 - percent} div {100 + percent}"
    return scratch.cut(placed.join(groups, "key").where(may), f"{name}_rest")


def _windows(rest: DataFrame, members: int) -> DataFrame:
    """Each group in parts of about so many members."""
    return rest.withColumns({"g": F.xxhash64("key", F.expr(f"pmod(xxhash64(h), ceil(members / {members}))")), "own": F.lit(-1)})


def _blocks(rest: DataFrame, block: int) -> DataFrame:
    """Each group's pairs of blocks of about `block` members. Blocks of the largest component meet all others, but not each other."""
    minor, major = (F.ceil(x / block) for x in (F.col("members") - F.col("major_size"), F.col("major_size")))
    dealt = rest.withColumns({"is_major": F.col("comp") == F.col("major"), "minor": minor, "majors": major})
    dealt = dealt.withColumn("own", F.expr("case when is_major then minor + pmod(xxhash64(h), majors) else pmod(xxhash64(h), minor) end"))
    met = dealt.withColumn("other", F.explode(F.expr("sequence(0L, case when is_major then minor else minor + majors end - 1)")))
    met = met.withColumns({"g": F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")), "same": F.col("own") == F.col("other")})
    return met.withColumn("own", F.when(F.col("same"), F.lit(-1)).otherwise(F.col("own")))


def jaccard_join(
    docs: DataFrame, *, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text", near: int = NEAR, width: int = WIDTH, block: int = BLOCK, part: int = PART, name_bits: int = 64
) -> DataFrame:
    """One row per document row: id, n_shingles, component_id (the smallest id reachable by links).

    `near`, `width`, `block` and `part` share out the work and `name_bits` shortens the sets' first hash; none of them changes the result.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    scratch = Scratch(spark, "jaccard")
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("t"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    # pass 1: sizes, classes of equal sets, common lane values
    facts = scratch.cut(common.arrow_pass(rows, _facts(words, percent, Namer(name_bits)), f"kind int, doc_id {id_type}, n long, h long, g long, values array<long>, counts array<long>"), "facts")
    meta = facts.where("kind = 0").select("doc_id", "n", "h", "g", F.col("values").alias("bits"), F.col("counts").alias("more"))
    twice = meta.where("n > 0").groupBy("h").agg(F.min("g").alias("x"), F.max("g").alias("y")).where("x <> y")
    shared = frozenset(r.h for r in twice.select("h").collect())  # about n^2 / 2^65 hashes: none below a billion sets
    name = Namer(name_bits, shared)
    if shared:
        meta = meta.withColumn("h", F.when(F.col("h").isin(*shared), F.col("g")).otherwise(F.col("h")))
    classes = meta.where("doc_id is not null and n > 0").groupBy("h").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("more").alias("more"))
    classes = scratch.cut(classes, "classes")
    counts = facts.where("kind = 1").select(F.explode(F.arrays_zip("values", "counts")).alias("x")).groupBy(F.col("x.values").alias("low")).agg(F.sum("x.counts").alias("c"))
    counts = scratch.cut(counts, "counts")
    sent = spark.sparkContext.broadcast((_common_map(counts), *_heavy(counts, part)))
    scratch.drop("counts")

    # pass 2: keys, dealt by key and sorted, to candidates
    keys = common.arrow_pass(rows.where("doc_id is not null").select("t"), _keys(words, percent, name, sent), "key long, part int, h long, n int, q int")
    dealt = keys.repartition("key", "part").sortWithinPartitions("key", "part", "q", "n", "h")
    with common.batch_rows(spark, 50_000):
        found = scratch.cut(common.arrow_pass(dealt, _pairs(percent, near), PAIRS), "found")
    del keys, dealt
    scratch.settle()
    pairs = found.where("kind = 0").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("shared"))
    larger = found.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("h"), F.col("na").cast("int").alias("n"), F.col("nb").cast("int").alias("q"))

    def sets_of(wanted: DataFrame) -> DataFrame:
        ids = broadcast_if_small(classes.join(wanted, "h", "left_semi").select(F.col("doc").alias("doc_id")), BROADCAST_IDS)
        some = rows.join(ids, "doc_id", "left_semi").select("t")

        def run(batches):
            shingle = common.keep(f"shingler {words}", lambda: Shingler(words))
            seen: set[int] = set()
            for batch in batches:
                sets = {name(s): as_long(s) for s in shingle(common.texts(batch.column(0)))}
                for h in seen & sets.keys():  # rows that repeat an id
                    del sets[h]
                seen |= sets.keys()
                yield pa.RecordBatch.from_arrays([pa.array(list(sets), pa.int64()), pa.array(list(sets.values()), pa.list_(pa.int64()))], ["h", "s"])

        return common.arrow_pass(some, run, "h long, s array<long>")

    # first each class with the one it shares most keys with, then what that left apart
    likely = scratch.cut(_likely(pairs, classes, percent), "likely")
    best = likely.groupBy("b").agg(F.max_by(F.struct("a", "na", "nb"), F.struct("shared", "a")).alias("x")).select("x.a", "b", "x.na", "x.nb")
    links = _verify(scratch.cut(best, "best"), sets_of, scratch, percent, "first")
    roots = scratch.cut(common.components(links, scratch, "first_cc"), "first_roots")
    rest = _apart(likely.join(best, ["a", "b"], "left_anti"), roots)
    links = links.union(_verify(scratch.cut(rest, "second"), sets_of, scratch, percent, "second"))
    versions = meta.where("n > 0 and doc_id is not null").groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("a <> b")
    links = links.union(meta.where("n > 0").select("doc_id", "h").join(versions, "doc_id").where("a <> h").select("a", F.col("h").alias("b")))
    for step in ("window", "blocks"):
        roots = scratch.cut(common.components(links, scratch, f"{step}_cc"), f"{step}_roots")
        rest = _open_groups(larger, roots, percent, scratch, step)
        grouped = _windows(rest, near * width) if step == "window" else _blocks(rest, block)
        again = grouped.join(classes.select("h", "bits"), "h").select("g", "h", "n", "q", "comp", "own", "bits").repartition("g").sortWithinPartitions("g", "q", "n", "h")
        with common.batch_rows(spark, 10_000):
            more = common.arrow_pass(again, _across(percent, width if step == "window" else None), PAIRS).select("a", "b", "na", "nb").distinct()
            more = scratch.cut(more.join(likely.select("a", "b"), ["a", "b"], "left_anti"), f"{step}_pairs")
        now = scratch.cut(_likely(more, classes, percent), f"{step}_likely")
        links = links.union(_verify(now, sets_of, scratch, percent, step))
        likely = likely.select("a", "b").union(now.select("a", "b"))
    roots = scratch.cut(common.components(links, scratch, "cc"), "roots")

    # the smallest document of each component, for its classes
    home = classes.join(roots, classes["h"] == roots["node"], "left").select("h", "doc", F.coalesce("root", "h").alias("root"))
    least = home.groupBy("root").agg(F.min("doc").alias("component_id"))
    home = scratch.cut(home.join(least, "root").select("h", "component_id"), "home")
    linked = meta.where("n > 0 and doc_id is not null").join(home, "h").select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    alone = meta.where("n = 0 or doc_id is null").select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.union(alone)


def keep_one(docs: DataFrame, *, words: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with one document of each component, the smallest id; rows that repeat an id count as copies."""
    scratch = Scratch(docs.sparkSession, "keep_one")
    found = jaccard_join(docs, words=words, percent=percent, id_col=id_col, text_col=text_col)
    gone = found.where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("_gone")).distinct()
    gone = broadcast_if_small(scratch.cut(gone, "gone"), BROADCAST_IDS)
    kept = docs.join(gone, docs[id_col] == gone["_gone"], "left_anti")
    repeated = docs.where(docs[id_col].isNotNull()).groupBy(id_col).count().where("count > 1").limit(1).count()
    if repeated:
        named = kept.where(kept[id_col].isNotNull()).dropDuplicates([id_col])
        kept = named.union(kept.where(kept[id_col].isNull()))
    return kept
