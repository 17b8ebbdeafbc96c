"""Alignment of two tokenizers' tokens over the same bytes, and how often each pair of ids meets.

A text is encoded twice: with a leading space by a byte-level BPE (A), and by a piece model
that adds that space itself (B). The ends of both token sequences are merged (union1d): between two neighbouring ends lies
an elementary interval, owned by one A and one B token (searchsorted), so each interval is exactly one
overlapping pair of occurrences. Ends that both sequences share close a group; the product of a
group's two sides (n_products, `products`) is what a word-level alignment would link.

Both tokenizers cut before a space that stands between two other characters than white space: A by its pattern, B
because no piece has a space after another character (checked when the file is read; else a whole text is one unit).
So a text is a run of units that are aligned by themselves, a batch's unknown units in one
pass of numpy, and short ones are remembered. Long units (a text without spaces is one) are aligned each time.

Counts: each document's distinct pairs are written once with their repeats; pairs are counted by documents over
exploded rows, added up in tasks first. The `head` most frequent pairs (a bound of rows) are broadcast to the
documents' pairs, all others meet theirs in a join, where no pair is frequent. The A ids' highest counts have
at most as many rows as A has ids.

Defined results: a null or empty text, and one whose joined A or B bytes differ from space + text (a text that holds U+2581), has no
tokens: zeros, and '' for groups. Every row is a document, also where ids or texts repeat. A null id stays null. An
empty table gives no rows. Other columns are not read, so their names can't clash.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import common
from glossa.session import Scratch

#: A space between two characters that are white space for neither library.
BORDER = re.compile(r"(?<=[^\s\x1c-\x1f\x85\u180e\u200b\ufeff]) (?=[^\s\x1c-\x1f\x85\u180e\u200b\ufeff])")
#: What may stand where a border doesn't hold: a space beside white space, or beside a text's end.
ODD = re.compile(r"(?:^|[\s\x1c-\x1f\x85\u180e\u200b\ufeff]) | (?:[\s\x1c-\x1f\x85\u180e\u200b\ufeff]|$)")

WHITE = frozenset(c for c in map(chr, range(0x10000)) if c.isspace() or c in "\u180e\u200b\ufeff") | {""}


def byte_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as itself, all others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def elementary(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ends of all elementary intervals, and which A and which B token owns each.

    Both arrays rise strictly and end alike.
    """
    cuts = np.union1d(ends_a, ends_b)
    return cuts, np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)


def products(group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs (place in A, place in B) within groups; groups number from 0 and neither side lacks one."""
    sizes = np.bincount(group_b)
    first = np.cumsum(sizes) - sizes
    each = sizes[group_a]
    a = np.repeat(np.arange(len(group_a)), each)
    within = np.arange(len(a)) - np.repeat(np.cumsum(each) - each, each)
    return a, first[group_a[a]] + within


class Aligner:
    """Units of text to (tokens of A, tokens of B, groups, size of products, groups as text, packed pairs), None where bytes differ.

    A pair is a * |B| + b in eight bytes. Units of up to `most_chars` characters are remembered, in at most
    about 2 * `most_bytes`: when full, they become the old generation, from which those that are asked for again come back.
    """

    def __init__(self, content_a: bytes, content_b: bytes, most_bytes: int = 100 << 20, most_chars: int = 64):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_str(content_a.decode())
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=content_b)
        alphabet = byte_alphabet()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, k in self.a.get_vocab().items():
            self.bytes_a[k] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(pieces)]
        self.width_a, self.width_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.size_b = len(pieces)
        rules = json.loads(content_a)
        split = rules.get("pre_tokenizer") or {}
        self.by_units = (
            rules.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
            and not any("▁" in p.lstrip("▁") for p in pieces)
        )
        self.text_a = [[f"{k}," for k in range(len(self.bytes_a))], [f"{k}|" for k in range(len(self.bytes_a))]]
        self.text_b = [[f"{k}," for k in range(self.size_b)], [f"{k};" for k in range(self.size_b)]]
        self.known, self.old, self.held, self.most_bytes, self.most_chars = {}, {}, 0, most_bytes, most_chars

    def _keep(self, found: dict[str, tuple | None]) -> None:
        self.known.update(found)
        # what Python takes for the key, the entry and the six values, besides their contents
        self.held += sum(400 + 2 * len(u) + (len(x[4]) + len(x[5]) if x else 0) for u, x in found.items())

    def units(self, text: str) -> list[str]:
        """The text with its leading space, in units that begin with a space each."""
        if not self.by_units:
            return [" " + text]
        if ODD.search(text):
            return [" " + x for x in BORDER.split(text)]
        return [" " + x for x in text.split(" ")]

    def _encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        return [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)], self.b.encode([u[1:] for u in units], num_threads=1)

    def _same(self, units: list[str], a: list[list[int]], b: list[list[int]]) -> list[bool]:
        def joined(ids: list[list[int]], table: list[bytes]) -> list[bytes]:
            return [b"".join([table[k] for k in x]) for x in ids]

        want = [u.encode("utf-8", "surrogatepass") for u in units]
        return [x == y == w for x, y, w in zip(joined(a, self.bytes_a), joined(b, self.bytes_b), want)]

    def learn(self, units: list[str]) -> dict[str, tuple | None]:
        """What each unit gives. Units with no white space at their edges are encoded as the one text that they make."""
        found: dict[str, tuple | None] = {}
        if self.by_units:
            inner = [u for u in units if u[1:2] not in WHITE and u[-1] not in WHITE]
            got = self._joined(inner) if inner else None
            if got is not None:
                found, units = got, [u for u in units if u not in got]
        if not units:
            return found
        a, b = self._encode(units)
        same = self._same(units, a, b)
        found.update((u, None) for u, ok in zip(units, same) if not ok)
        units, a, b = ([x for x, ok in zip(col, same) if ok] for col in (units, a, b))
        if units:
            found.update(self._pieces(units, *(np.concatenate([np.array(x, np.int64) for x in ids]) for ids in (a, b))))
        return found

    def _joined(self, units: list[str]) -> dict[str, tuple | None] | None:
        """The units from one encoding of all of them; None where bytes differ."""
        text = "".join(units)
        a, b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:])
        want = text.encode("utf-8", "surrogatepass")
        if b"".join([self.bytes_a[k] for k in a]) != want or b"".join([self.bytes_b[k] for k in b]) != want:
            return None
        return self._pieces(units, np.array(a, np.int64), np.array(b, np.int64))

    def _pieces(self, units: list[str], ids_a: np.ndarray, ids_b: np.ndarray) -> dict[str, tuple | None]:
        """Each unit's share of the alignment of all: the units' bytes in a row are those of both sequences of ids."""
        ends_a, ends_b = np.cumsum(self.width_a[ids_a]), np.cumsum(self.width_b[ids_b])
        cuts, own_a, own_b = elementary(ends_a, ends_b)
        packed = ids_a[own_a] * self.size_b + ids_b[own_b]
        shared = np.intersect1d(ends_a, ends_b, assume_unique=True)
        group_a, group_b = np.searchsorted(shared, ends_a), np.searchsorted(shared, ends_b)
        last_a, last_b = shared[group_a] == ends_a, shared[group_b] == ends_b
        # a group's A tokens come before its B tokens, and both after all of the groups before
        order = np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")
        parts = [self.text_a[z][k] for z, k in zip(last_a.tolist(), ids_a.tolist())] + [self.text_b[z][k] for z, k in zip(last_b.tolist(), ids_b.tolist())]
        parts = [parts[k] for k in order.tolist()]
        grown = np.concatenate([[0], np.cumsum(np.bincount(group_a) * np.bincount(group_b))])
        # where each unit ends among tokens, intervals and groups: its last byte is an end of both
        ends = np.cumsum([len(u.encode("utf-8", "surrogatepass")) for u in units])
        to_a, to_b, to_cut, to_group = (np.searchsorted(x, ends) + 1 for x in (ends_a, ends_b, cuts, shared))
        if not (ends_a[to_a - 1] == ends).all() or not (ends_b[to_b - 1] == ends).all():
            raise AssertionError("a token crosses a unit's end")
        sizes = (np.diff(x, prepend=0).tolist() for x in (to_a, to_b, to_group, grown[to_group]))
        found: dict[str, tuple | None] = {}
        at_part = at_cut = 0
        blob = packed.tobytes()
        for unit, na, nb, ng, size, part, cut in zip(units, *sizes, (to_a + to_b).tolist(), (8 * to_cut).tolist()):
            found[unit] = (na, nb, ng, size, "".join(parts[at_part:part])[:-1], blob[at_cut:cut])
            at_part, at_cut = part, cut
        return found

    def align(self, texts: list[str]) -> Iterator[list[tuple | None]]:
        """For each text what its units give; an empty text gives no units."""
        if self.held > self.most_bytes:
            self.known, self.old, self.held = {}, self.known, 0
        split = [self.units(t) if t else [] for t in texts]
        lacking, short = [], []
        for unit in set().union(*split):
            if unit in self.known:
                continue
            if (known := self.old.get(unit)) is not None:
                self._keep({unit: known})
            elif len(unit) <= self.most_chars:
                short.append(unit)
            else:
                lacking.append(unit)
        for at in range(0, len(short), 5000):
            self._keep(self.learn(short[at : at + 5000]))
        long = set(lacking)
        for units in split:
            once: dict[str, tuple | None] = {}
            for u in dict.fromkeys(units) if long else ():
                if u in long:  # one at a time: nothing long is kept beyond its text
                    once.update(self.learn([u]))
            yield [once[u] if u in once else self.known[u] for u in units]


COLUMNS = "row long, n_a long, n_b long, n_groups long, n_links long, n_products long, groups_sha256 string, groups string"


def aligned(docs: DataFrame, vocabulary_a: str, model_b: str, *, with_groups: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: row, id, sizes, groups (null unless `with_groups`) and their digest, distinct pairs and how often each is linked."""
    common.bounded_batches(docs.sparkSession)
    context = docs.sparkSession.sparkContext
    content = context.broadcast((common.tokenizer_bytes(vocabulary_a), common.tokenizer_bytes(model_b)))  # a few MB, whatever the corpus
    name = "aligner " + hashlib.sha256(b"".join(content.value)).hexdigest()
    fields = [x.split()[0] for x in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = common.keep(name, lambda: Aligner(*content.value))
        for batch in batches:
            rows, pairs, times = [], [], []
            for got in aligner.align(common.texts(batch.column(2))):
                if not got or None in got:
                    rows.append((0, 0, 0, 0, 0, "", "" if with_groups else None))
                    pairs.append(np.zeros(0, np.int64))
                    times.append(np.zeros(0, np.int64))
                    continue
                na, nb, ng, size, text, packed = zip(*got)
                links = np.frombuffer(b"".join(packed), np.int64)
                groups = ";".join(text)
                distinct, repeats = np.unique(links, return_counts=True)
                pairs.append(distinct)
                times.append(repeats)
                rows.append((sum(na), sum(nb), sum(ng), len(links), sum(size), hashlib.sha256(groups.encode()).hexdigest(), groups if with_groups else None))
            columns = list(zip(*rows)) or [()] * 7
            arrays = [batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string()), pa.array(columns[6], pa.string())]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in pairs])]), pa.int32())
            flat, counts = (np.concatenate([*x, np.zeros(0, np.int64)]) for x in (pairs, times))
            arrays += [pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64())), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["row", "id", *fields[1:], "pairs", "times"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].alias("id"), docs[text_col].cast("string").alias("t"))
    return common.arrow_pass(rows, run, f"row long, id {kind}, {COLUMNS.removeprefix('row long, ')}, pairs array<long>, times array<int>")


def pair_counts(found: DataFrame, size_b: int) -> DataFrame:
    """(pair, a, docs): how many documents hold each pair linked."""
    seen = found.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("docs"))
    return seen.select("pair", F.floor(F.col("pair") / size_b).cast("int").alias("a"), "docs")


def align_documents(docs: DataFrame, vocabulary_a: str, model_b: str, *, with_groups: bool = True, head: int = 300_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, n_products, groups (if wanted).

    n_best counts the links whose pair has its A id's highest count; count_sum adds the pairs' counts over links.
    """
    import sentencepiece

    scratch = Scratch(docs.sparkSession, "alignment")
    size_b = sentencepiece.SentencePieceProcessor(model_file=model_b).get_piece_size()
    found = scratch.cut(aligned(docs, vocabulary_a, model_b, with_groups=with_groups, id_col=id_col, text_col=text_col), "found")
    counts = scratch.cut(pair_counts(found, size_b), "counts")
    highest = counts.groupBy("a").agg(F.max("docs").alias("most"))  # at most a row for each id of A
    counts = counts.join(F.broadcast(highest), "a").select("pair", "docs", (F.col("docs") == F.col("most")).cast("int").alias("best"))
    hot = F.broadcast(common.most_frequent(counts, "docs", head))
    links = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))

    def summed(met: DataFrame) -> DataFrame:
        return met.groupBy("row").agg(F.sum(F.col("times") * F.col("best")).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))

    rest = links.join(hot.select("pair"), "pair", "left_anti").join(counts, "pair")
    sums = summed(links.join(hot, "pair")).union(summed(rest)).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    out = found.drop("pairs", "times").join(sums, "row", "left")
    zero = F.lit(0).cast("long")
    last = ["groups_sha256", "n_products", *(["groups"] if with_groups else [])]
    return out.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), *last)
