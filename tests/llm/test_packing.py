import random
import zlib
from collections import defaultdict

import numpy as np
from tokenizers import Tokenizer

from glossa.llm import common, packing

WORDS = common.public_path("word_bpe_49k.json")


def test_levels_follow_the_sum_of_squares():
    rng = random.Random(3)
    packer, model = packing.SumOfSquares(32, most_open=1 << 30), defaultdict(int)
    for k in range(400):
        size = rng.randint(1, 31)

        def cost(h):
            n = dict(model)
            if h:
                n[h] -= 1
            if h + size < 32:
                n[h + size] = n.get(h + size, 0) + 1
            return sum(v * v for v in n.values())

        options = {h: cost(h) for h in [0, *(h for h, n in model.items() if n)] if h + size <= 32}
        at = packer.place(size)
        assert options[at] == min(options.values())
        list(packer.add(k, np.zeros(size, "<u4")))
        if at:
            model[at] -= 1
        if at + size < 32:
            model[at + size] += 1


def test_pieces_hold_every_id_once_with_little_padding(spark):
    rng = random.Random(5)
    texts = [None, "", "Á \x1f b", "漢字 x", "word " * 9000] + [" ".join(rng.choice(["alpha", "Beta!", "gamma9", "déjà"]) for _ in range(rng.randint(0, 600))) for _ in range(80)]
    docs = spark.createDataFrame([(i, t, 0, "z") for i, t in enumerate(texts)], "doc_id long, text string, start int, length string").coalesce(1)
    rows = packing.pack_documents(docs, WORDS, window=512, most_open=8).collect()
    tok = Tokenizer.from_file(WORDS)
    ids = {i: np.array([*tok.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for i, t in enumerate(texts)}
    level, at = defaultdict(int), defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == level[r.sequence_id]
        level[r.sequence_id] += r.length
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id]
        at[r.doc_id] += r.length
    assert {i: len(x) for i, x in ids.items()} == at
    assert max(level.values()) <= 512 and sum(v < 512 for v in level.values()) <= 1


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string"), WORDS).count() == 0


def test_added_tokens_are_the_librarys():
    words = packing.WordIds(open(WORDS, "rb").read())
    assert next(words.ids(["<|endoftext|> z"])).tolist() == [49407, 345]


def test_word_by_word_equals_whole_texts_of_any_case():
    """Capitals, signs that lower-case to several letters, and texts beyond Latin: ids as the library gives them."""
    import random

    from tokenizers import Tokenizer

    from glossa.llm import common, packing

    path = common.public_path("word_bpe_49k.json")
    whole, words = Tokenizer.from_file(path), packing.WordIds(common.tokenizer_bytes(path))
    assert words.lower
    draw = random.Random(9)
    pool = ["The", "THE", "ÉCOLE", "Straße", "İstanbul", "ŉ", "ǅ", "ΟΔΟΣ", "Σ", "ÀÉÎ.", "don'T", "A1B2", "x́Y", "Ⅷ", "ÞORN", " ", "ẞ", "K", "ẞ"]
    texts = [" ".join(draw.choices(pool, k=12)) for _ in range(200)] + pool
    assert [x.tolist() for x in words.ids(texts)] == [whole.encode(t, add_special_tokens=False).ids for t in texts]
