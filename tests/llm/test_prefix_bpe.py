import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from glossa.llm import common, prefix_bpe

PATH = common.public_path("byte_bpe_multi_50k.tiktoken")
TEXTS = [
    None, "", "   ", "a\n", "  a  b\n\n c's 　x", "日本語 テスト", "İstanbul ſ \U0001f44d\U0001f3fd x", " " * 50 + "z", "12345 678.90%%" * 20, "ab" * 3000,
    "we'll they're I'd", "\t\t x \x0b y", "w " * 2000,
]


@pytest.fixture(scope="module")
def both():
    ranks = prefix_bpe.read_ranks(open(PATH, "rb").read())
    return prefix_bpe.PrefixBPE(ranks, P.PATTERN), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_ids_and_round_trip(both):
    own, other = both
    rng = random.Random(1)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice("abcdeé 's\n1.ZöT") for _ in range(rng.randrange(60))) for _ in range(500)]
    for text in texts:
        ids = own.encode(text)
        assert ids == other.encode_ordinary(text), text
        assert own.decode_bytes(np.array(ids, "<u4").tobytes()).decode() == text


def test_appends_extend_the_table_and_edits_redo_a_part(both):
    own, other = both
    piece = " internationalisations".encode()
    table = []
    for end in range(1, len(piece) + 1):
        own.extend(table, piece[:end])
        assert own.tokens(table) == [own.bytes_of[i] for i in own.piece_ids(piece[:end])] or piece[:end] in own.ranks
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice("ab 's\n1.é ") for _ in range(rng.randrange(30)))
        i = rng.randrange(len(text) + 1)
        j = rng.randrange(i, len(text) + 1)
        new = "".join(rng.choice("ab '1\n") for _ in range(rng.randrange(4)))
        edited, ids = own.reencode(text, own.encode(text), i, j, new)
        assert edited == text[:i] + new + text[j:] and ids == other.encode_ordinary(edited)


def test_query_rows(spark, both):
    _, other = both
    rows = [(i, t, "n", 1) for i, t in enumerate(TEXTS)] + [(None, "x", None, None), (1, "", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, ids int")
    out = prefix_bpe.encode_documents(docs, PATH, P.PATTERN, with_ids=False).collect()
    assert len(out) == len(rows)
    for r, (key, text, *_) in zip(out, rows):
        ids = np.array(other.encode_ordinary(text or ""), "<u4")
        assert (r.doc_id, r.n_tokens, r.ids_sha256) == (key, len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert prefix_bpe.encode_documents(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_texts_without_spaces_are_not_kept(both):
    """Whole documents as one word: neither encoder keeps them beyond their batch."""
    from glossa.llm import packing

    coder, _ = both
    words = packing.WordIds(common.tokenizer_bytes(common.public_path("word_bpe_49k.json")))
    texts = ["".join(chr(0x4E00 + (k * 31 + j * j) % 3000) for j in range(400)) for k in range(200)]
    for at in range(0, 200, 50):
        assert all(len(x) for _, x in zip(range(50), words.ids(texts[at : at + 50])))
        assert all(coder.encode_bytes(x) for x in texts[at : at + 50])
    kept = [*coder.chunks, *coder.chunks.old, *coder.known, *coder.known.old, *words.words, *words.old]
    assert max(map(len, kept), default=0) <= 64


def test_table_needs_few_looks(both, monkeypatch):
    """Places between tokens are judged once, and only where several tokens end; the ids stay tiktoken's."""
    own, other = both
    rng = random.Random(3)
    words = [" " + "".join(rng.choice(["th", "on", "er", "ing", "at", "é", "日本", "st", "9"]) for _ in range(rng.randrange(1, 12))) for _ in range(2000)]
    fresh = prefix_bpe.PrefixBPE(own.ranks, P.PATTERN)
    looks, judge = [], fresh._may_follow
    monkeypatch.setattr(fresh, "_may_follow", lambda left, right: looks.append((left, right)) or judge(left, right))
    for word in words:
        assert fresh.encode(word) == other.encode_ordinary(word), word
        half = fresh.extend([], word.encode()[: len(word) // 2])
        assert fresh.extend(half, word.encode()) == fresh.extend([], word.encode())
    assert len(looks) == len(set(looks)) < sum(len(w.encode()) for w in words) / 4
