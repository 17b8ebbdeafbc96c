"""Operator 3: sum-of-squares online packing of token sequences into windows.

A document of more than a window's tokens gives full windows first; its rest is an item.
Each item goes, as it comes, to the fill level that minimises the sum over levels of the
squared number of windows at that level. A level array holds these numbers: an item of
size s that moves a window from level h to h + s changes the sum by
2 * (n[h + s] - n[h]) + 2, where a new window has no n[h] and a filled one no n[h + s].

Each task packs the rows of its own input split, so nothing is shuffled and a retried task
gives the same sequences. When `most_open` windows stand open, and at the end of a task,
what they hold is laid end to end and cut into full windows; so a task leaves at most one
window with padding at its end, and never holds more than `most_open` windows.

Null texts count as empty (they hold the end token alone). An empty table gives no rows,
repeated rows are packed as often as they stand there.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from glossa.llm import common

COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class SumOfSquares:
    """Windows of one task. `add` and `close` give (sequence, offset, document, start, ids) pieces."""

    def __init__(self, window: int, most_open: int = 512, first: int = 0):
        self.window, self.most_open, self.next = window, most_open, first
        self.levels = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[list]] = {}  # level: windows, each a list of (document, start, ids)
        self.count = 0

    def place(self, size: int) -> int:
        """The level whose windows the next item of `size` joins; 0 for a new window."""
        n = self.levels
        change = n[size:] - n[: self.window + 1 - size]  # by level h: n[h + size] - n[h]
        change = np.where(n[: self.window + 1 - size] > 0, 2 * change + 2, np.iinfo(np.int64).max)
        change[0] = 2 * n[size] + 1
        if size < self.window and n[self.window - size]:
            change[self.window - size] = 1 - 2 * n[self.window - size]  # a filled window counts no more
        return int(len(change) - 1 - np.argmin(change[::-1]))  # ties: the fullest

    def _emit(self, pieces: list) -> Iterator[tuple]:
        sequence, offset = self.next, 0
        self.next += 1
        for document, start, ids in pieces:
            yield sequence, offset, document, start, ids
            offset += len(ids)

    def add(self, document, ids: np.ndarray) -> Iterator[tuple]:
        w = self.window
        whole = len(ids) // w * w
        for start in range(0, whole, w):
            yield from self._emit([(document, start, ids[start : start + w])])
        size = len(ids) - whole
        if not size:
            return
        level = self.place(size)
        pieces = []
        if level:
            pieces = self.open[level].pop()
            self.levels[level] -= 1
            self.count -= 1
        pieces.append((document, whole, ids[whole:]))
        if level + size == w:
            yield from self._emit(pieces)
            return
        self.open.setdefault(level + size, []).append(pieces)
        self.levels[level + size] += 1
        self.count += 1
        if self.count >= self.most_open:
            yield from self._cut(keep_rest=True)

    def _cut(self, keep_rest: bool) -> Iterator[tuple]:
        """Lay the open windows end to end, fullest first, and cut full ones; the rest stays open or is emitted."""
        w, pieces, level = self.window, [], 0
        opened = [p for lvl in sorted(self.open, reverse=True) for p in self.open[lvl]]
        self.open, self.count = {}, 0
        self.levels[:] = 0
        for document, start, ids in (x for p in opened for x in p):
            while level + len(ids) >= w:
                pieces.append((document, start, ids[: w - level]))
                yield from self._emit(pieces)
                start, ids = start + w - level, ids[w - level :]
                pieces, level = [], 0
            if len(ids):
                pieces.append((document, start, ids))
                level += len(ids)
        if level and keep_rest:
            self.open[level], self.count = [pieces], 1
            self.levels[level] = 1
        elif level:
            yield from self._emit(pieces)

    def close(self) -> Iterator[tuple]:
        yield from self._cut(keep_rest=False)


class WordIds:
    """Token ids of a text by a tokenizer whose tokens never span white space, word by word.

    The tokenizers library encodes each distinct word once; a text's ids are its words' ids
    in a row. That equals the ids of the whole text where the normaliser and the split work
    within words, as here. Encoded whole are texts with control characters that Python, but not
    the library, takes for white space, and texts that spell a token the vocabulary adds (as
    <|endoftext|>), which the library finds before it splits.
    """

    #: Stands between words that are encoded in one call.
    MARK = "\x01"
    #: Texts without such characters are lower-cased before the split, as the library would do: fewer words differ.
    WIDE = re.compile("[^\x00-\u024f]")
    #: Longer words (a text without white space is one) are forgotten with their batch, so that memory is bounded by bytes too.
    LONGEST = 64

    def __init__(self, content: bytes, most_words: int = 400_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_str(content.decode())
        self.added = tuple(t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values())
        self.mark = self._encode([self.MARK])[0]
        self.lower = '"type":"Lowercase"' in json.dumps(json.loads(content).get("normalizer"), separators=(",", ":"))
        self.words, self.old, self.most = {}, {}, most_words

    def _spells_added(self, text: str) -> bool:
        if "<|" not in text and all(a.startswith("<|") for a in self.added):
            return False
        low = text.lower()
        return any(a in low for a in self.added)

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, lacking: list[str]) -> None:
        for at in range(0, len(lacking), 2000):
            some = lacking[at : at + 2000]
            if len(self.mark) != 1 or any(self.MARK in w for w in some):
                found = [np.array(x, "<u4").tobytes() for x in self._encode(some)]
            else:
                ids = np.array(self._encode([f" {self.MARK} ".join(some)])[0], "<u4")
                cuts = (4 * np.flatnonzero(ids == self.mark[0])).tolist()
                packed = ids.tobytes()
                found = [packed[a:b] for a, b in zip([0, *[c + 4 for c in cuts]], [*cuts, len(packed)])]
            self.words.update(zip(some, found, strict=True))

    def ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Each text's ids."""
        if len(self.words) > self.most:
            self.words, self.old = {}, self.words
        odd = {k for k, t in enumerate(texts) if any(c in t for c in "\x1c\x1d\x1e\x1f") or self._spells_added(t)}
        folded = self.lower and [t if self.WIDE.search(t) else t.lower() for t in texts] or texts
        split = [[] if k in odd else t.split() for k, t in enumerate(folded)]
        lacking = []
        for word in set().union(*split):
            if word not in self.words:
                if (known := self.old.get(word)) is None:
                    lacking.append(word)
                else:
                    self.words[word] = known
        self._learn(lacking)
        get = self.words.__getitem__
        try:
            for k, words in enumerate(split):
                got = np.array(self._encode([texts[k]])[0], "<u4").tobytes() if k in odd else b"".join(map(get, words))
                yield np.frombuffer(got, "<u4")
        finally:
            for word in lacking:
                if len(word) > self.LONGEST:
                    del self.words[word]


def pack_documents(
    docs: DataFrame, vocabulary: str, *, end_id: int = 2, window: int = 4096, most_open: int = 512, most_words: int = 400_000, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    `vocabulary` is a tokenizers JSON file whose tokens stay within words. A worker remembers the ids of
    up to twice `most_words` words (about 200 bytes each), which saves time alone. Other columns
    are not read, so their names can't clash. See the module for nulls, repeats and ends.
    """
    common.bounded_batches(docs.sparkSession)
    content = docs.sparkSession.sparkContext.broadcast(common.tokenizer_bytes(vocabulary))
    names = [x.split()[0] for x in COLUMNS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = common.keep(f"word ids {most_words} {hashlib.sha256(content.value).hexdigest()}", lambda: WordIds(content.value, most_words))
        packer = SumOfSquares(window, most_open, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * 7
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:])], ["id", *names])

        def note(pieces: Iterator[tuple]) -> None:
            for sequence, offset, (key, total), start, ids in pieces:
                rows.append((key, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset))

        kind = pa.int64()
        for batch in batches:
            kind = batch.schema.field(0).type
            for key, got in zip(batch.column(0).to_pylist(), words.ids(common.texts(batch.column(1)))):
                ids = np.append(got, np.uint32(end_id)).astype("<u4")
                note(packer.add((key, len(ids)), ids))
            yield out()
        note(packer.close())
        if rows:
            yield out()

    kind = docs.schema[id_col].dataType.simpleString()
    found = common.arrow_pass(docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("t")), run, f"id {kind}, {COLUMNS}")
    return found.withColumnRenamed("id", id_col)
