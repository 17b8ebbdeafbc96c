"""Operator 7: byte-level BPE encoding by dynamic programming over prefixes, and decoding.

Every prefix of a piece (one match of the split pattern) has exactly one token that can end
its encoding. `last` stores that token for each prefix, so a prefix's ids are read by walking
back from its end, an append only extends the table, and an edit only redoes the table from
the edited place. A token t may end a prefix p if the prefix before t ends with a token l
such that the merges, run on the bytes of l and t together, give l and t again.

Null texts count as empty. Ids are those of tiktoken's encode_ordinary. A piece that is
itself in the vocabulary is that token, as in tiktoken.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from glossa.llm import common


#: A space that another one, or the end, follows.
WIDE = re.compile(r" (?:\s|\Z)")


def read_ranks(content: bytes) -> dict[bytes, int]:
    """Bytes of each token and its rank, from lines of a base64 token and a number."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}


class PrefixBPE:
    """Encoder and decoder over a rank table and a split pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, most_pieces: int = 250_000):
        import regex

        self.ranks, self.split = ranks, regex.compile(pattern)
        self.letters = r"| ?\p{L}+|" in f"|{pattern}|"  # a space, if any, and letters are one match
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.longest = max(map(len, ranks), default=1)
        self.halves: dict[bytes, tuple[bytes, bytes]] = {}
        self.whole = {token for token in ranks if self._split(token)}
        self.fronts = {token[:end] for token in self.whole for end in range(len(token))} | self.whole | {b""}
        self.turns = common.Memo(lambda key: self._turn(*key), most_pieces)
        self.stands = common.Memo(lambda pair: self._may_follow(*pair), most_pieces)
        self.known = common.Memo(self._piece, most_pieces)
        self.chunks = common.Memo(self._chunk, 2 * most_pieces)

    def _split(self, token: bytes) -> bool:
        """Whether the merges make `token` of its bytes; notes the two halves of the last merge."""
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:])]
            best = ranks.index(min(ranks))
            if ranks[best] == 1 << 60:
                return False
            if len(parts) == 2:
                self.halves[token] = (parts[0], parts[1])
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return True

    def _may_follow(self, left: bytes, right: bytes) -> bool:
        """Whether the merges, run on both tokens' bytes together, give `left` and `right`.

        Undo the merges from the last one back. If at any time the parts that touch would
        have merged before the merge just undone, the boundary would not have stood.
        """
        ranks, before = self.ranks, 1 << 60
        while True:
            across = ranks.get(left + right)
            if across is not None and across < before:
                return False
            l_rank = ranks[left] if len(left) > 1 else -1
            r_rank = ranks[right] if len(right) > 1 else -1
            if l_rank > r_rank:
                before, left = l_rank, self.halves[left][1]
            elif r_rank >= 0:
                before, right = r_rank + 1, self.halves[right][0]  # of equal ranks, the left one merges first
            else:
                return True

    def _turn(self, front: bytes, byte: int) -> tuple[bytes, bytes, tuple[tuple[bytes, int], ...]]:
        """The longest end of both that begins a token; the shortest token that ends there; the others and their sizes, the longest first."""
        front += bytes([byte])
        while front not in self.fronts:
            front = front[1:]
        ends = [front[at:] for at in range(len(front)) if front[at:] in self.whole]
        if not ends:
            raise ValueError("the vocabulary lacks a byte")
        return front, ends[-1], tuple((token, len(token)) for token in ends[:-1])

    def extend(self, last: list[bytes], piece: bytes) -> list[bytes]:
        """`last` for the prefixes of `piece`, kept where given (entry i: the prefix of i + 1 bytes)."""
        turns, stands, done = self.turns, self.stands, len(last)
        front = b""
        for byte in piece[max(0, done - self.longest) : done]:
            front, *_ = turns[front, byte]
        for at, byte in enumerate(piece[done:], done):
            front, least, longer = turns[front, byte]
            for token, size in longer:
                if size > at or stands[last[at - size], token]:
                    last.append(token)
                    break
            else:  # one of them stands
                last.append(least)
        return last

    @staticmethod
    def tokens(last: list[bytes]) -> list[bytes]:
        """The tokens of the longest prefix in the table."""
        out, end = [], len(last)
        while end:
            out.append(last[end - 1])
            end -= len(out[-1])
        return out[::-1]

    def piece_ids(self, piece: bytes) -> list[int]:
        if piece in self.ranks:
            return [self.ranks[piece]]
        return [self.ranks[t] for t in self.tokens(self.extend([], piece))]

    def _piece(self, piece: str) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in self.piece_ids(piece.encode())])

    def _chunk(self, chunk: str) -> bytes:
        if self.letters and chunk.isascii() and (chunk[1:] if chunk[:1] == " " else chunk).isalpha():  # one match of the pattern
            return self._piece(chunk)
        return b"".join(map(self.known.__getitem__, self.split.findall(chunk)))

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        A space before a non-space starts a match of the pattern wherever it stands, so
        the text is cut there and equal chunks are encoded once.
        """
        chunks = text.split(" ")
        if len(chunks) == 1:
            return self.chunks[text] if text else b""
        if not chunks[0] or WIDE.search(text):
            return self._chunk(text)
        get = self.chunks.__getitem__
        return get(chunks[0]) + b"".join([get(" " + c) for c in chunks[1:]])

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), "<u4").tolist()

    def decode_bytes(self, ids: bytes) -> bytes:
        table = self.bytes_of
        return b"".join(map(table.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def reencode(self, text: str, ids: list[int], start: int, end: int, new: str) -> tuple[str, list[int]]:
        """The text with [start, end) replaced, and its ids, redone only near the edit.

        Ids of the matches before the one that the edit may touch stay. The match just
        before may change too (its end looked at what followed), so work starts one
        match earlier and stops at the first match of the old text that starts again at the same
        place behind the edit. Where old matches stand among the ids is read off the tokens'
        lengths; nothing but the matches in between is encoded.
        """
        edited, shift = text[:start] + new + text[end:], len(new) - (end - start)
        upto = np.cumsum([0, *(len(self.bytes_of[i]) for i in ids)])

        def before(place: int) -> int:
            """Number of ids of the old text before a match that starts at `place`."""
            return int(np.searchsorted(upto, len(text[:place].encode())))

        starts = [m.start() for m in self.split.finditer(text)]
        ends = [*starts[1:], len(text)]
        first = max(0, sum(b < start for b in ends) - 1)
        at = starts[first] if starts else 0
        old = {a + shift: a for a in starts if a >= end}
        middle: list[int] = []
        for m in self.split.finditer(edited, at):
            place = old.get(m.start())
            if place is not None and m.start() >= start + len(new) and m.start() > at:
                return edited, ids[: before(at)] + middle + ids[before(place) :]
            middle += self.piece_ids(m[0].encode())
        return edited, ids[: before(at)] + middle


def encoder(content: bytes, pattern: str) -> PrefixBPE:
    """This worker's encoder for a vocabulary file, made once."""
    return common.keep(f"prefix_bpe {hashlib.sha256(content).hexdigest()} {pattern}", lambda: PrefixBPE(read_ranks(content), pattern))


def encode_documents(docs: DataFrame, vocabulary: str, pattern: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per document: id, n_tokens, ids (little-endian u32) or their digest, decoded_sha256.

    One Arrow pass without a shuffle. Null ids stay null, repeated rows stay repeated, an
    empty table gives none. Other columns are not read, so their names can't clash.
    """
    spark = docs.sparkSession
    common.bounded_batches(spark)
    content = spark.sparkContext.broadcast(common.tokenizer_bytes(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(content.value, pattern)
        for batch in batches:
            count, ids, decoded = [], [], []
            for text in common.texts(batch.column(1)):
                got = enc.encode_bytes(text)
                count.append(len(got) // 4)
                ids.append(got if with_ids else hashlib.sha256(got).hexdigest())
                decoded.append(hashlib.sha256(enc.decode_bytes(got)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(count, pa.int64()), pa.array(ids, pa.binary() if with_ids else pa.string()), pa.array(decoded, pa.string())],
                ["id", "n_tokens", "ids" if with_ids else "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    ids = "ids binary" if with_ids else "ids_sha256 string"
    out = common.arrow_pass(docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("t")), run, f"id {kind}, n_tokens long, {ids}, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
