"""Cross-tokenizer alignment against whole encodings and a double loop over tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from glossa.llm import alignment, common

A, B = common.public_path("byte_bpe_50k.json"), common.public_path("piece_bpe_32k.model")

ODD = [
    None, "", " ", "  ", "a", " a", "a ", "  a  b   c ", "a\nb \n c\t\td", "x\xa0y \xa0 z", "▁a b", "naïve façade <0x0A> <unk> </s>", "<|endoftext|> and <s>", "日本語のテキスト 文字",
    "é 🙂🙂 👩‍👩‍👧 ok", "don't we'll I'm 1234567 3.14", "\x1c\x1d a\x1fb \x85 c", "\u200bzero \u180e width \ufeff bom", "\x00nul \x00", "a" * 500 + " " + "b" * 70, "ﬁ ﬀ Å ①", "tab\tsep  double",
]


def brute(text):
    """(ids of A, ids of B, groups, links) of a whole text, or None."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not hasattr(brute, "a"):
        brute.a = Tokenizer.from_file(A)
        brute.a.encode_special_tokens = True
        brute.b = sentencepiece.SentencePieceProcessor(model_file=B)
        alphabet = alignment.byte_alphabet()
        brute.bytes = {k: bytes(alphabet[c] for c in t) for t, k in brute.a.get_vocab().items() if all(c in alphabet for c in t)}
    if not text:
        return None
    a, b = brute.a.encode(" " + text, add_special_tokens=False).ids, brute.b.encode(text)
    pieces = [brute.b.id_to_piece(k) for k in b]
    ba = [brute.bytes[k] for k in a]
    bb = [bytes([int(p[3:5], 16)]) if brute.b.is_byte(k) else p.replace("▁", " ").encode() for k, p in zip(b, pieces)]
    if not b"".join(ba) == b"".join(bb) == (" " + text).encode():
        return None

    def ranges(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    ra, rb = ranges(ba), ranges(bb)
    links = [(x, y) for x, (s, e) in zip(a, ra) for y, (t, f) in zip(b, rb) if s < f and t < e]
    shared = sorted({e for _, e in ra} & {e for _, e in rb})
    groups, before = [], 0
    for end in shared:
        groups.append(([x for x, (s, e) in zip(a, ra) if before < e <= end], [y for y, (s, e) in zip(b, rb) if before < e <= end]))
        before = end
    return a, b, groups, links


def told(groups):
    return ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)


def check(rows, got):
    want = [brute(t) for _, t in rows]
    docs = Counter(p for w in want if w for p in set(w[3]))
    most = {}
    for (a, _), n in docs.items():
        most[a] = max(n, most.get(a, 0))
    expected = []
    for (key, _), w in zip(rows, want):
        if w is None:
            expected.append((key, 0, 0, 0, 0, 0, 0, "", 0))
            continue
        a, b, groups, links = w
        best, total = sum(docs[p] == most[p[0]] for p in links), sum(docs[p] for p in links)
        expected.append((key, len(a), len(b), len(groups), len(links), best, total, hashlib.sha256(told(groups).encode()).hexdigest(), sum(len(x) * len(y) for x, y in groups)))
    assert sorted(map(tuple, got), key=repr) == sorted(expected, key=repr)


@pytest.mark.parametrize("head", [300_000, 40, 0])
def test_alignment_is_brute_force(spark, sf, head):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect() if len(r.text or "") < 1500][:60]
    rows = docs + [(10_000 + k, t) for k, t in enumerate(ODD)] + [(None, "a null id"), (1, "the same id"), (1, "the same id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    df = df.withColumns({"row": df.doc_id, "pairs": df.text, "docs": df.text, "id": df.text})
    got = alignment.align_documents(df, A, B, with_groups=False, head=head)
    check(rows, got.collect())


def test_units_of_random_texts():
    """Texts of odd white space and letters: unit by unit as whole."""
    draw = random.Random(5)
    aligner = alignment.Aligner(common.tokenizer_bytes(A), common.tokenizer_bytes(B), most_bytes=20_000)
    pool = list("abcXYZ 019'.,-\n\t\r éßñ\xa0  \u0085\u200b\u3000語🙂\x1c") + [" the", " of", "  ", "ing", "'s", "\n\n"]
    for _ in range(40):
        texts = ["".join(draw.choices(pool, k=draw.randrange(1, 40))) for _ in range(25)]
        for text, got in zip(texts, aligner.align(texts)):
            want = brute(text)
            if want is None:
                assert None in got, text
                continue
            a, b, groups, links = want
            assert ";".join(x[4] for x in got) == told(groups), text
            packed = np.frombuffer(b"".join(x[5] for x in got), np.int64)
            assert sorted(divmod(int(x), aligner.size_b) for x in packed) == sorted(links)
            assert (sum(x[0] for x in got), sum(x[1] for x in got)) == (len(a), len(b))


def test_long_units_are_not_kept():
    aligner = alignment.Aligner(common.tokenizer_bytes(A), common.tokenizer_bytes(B))
    texts = ["".join(chr(0x4E00 + (k * 37 + j) % 2000) for j in range(300)) for k in range(50)]
    assert all(len(got) == 1 for got in aligner.align(texts))
    assert not aligner.known and not aligner.old


def test_products_are_all_pairs_of_groups():
    a, b = alignment.products(np.array([0, 0, 1, 2, 2]), np.array([0, 1, 1, 1, 2, 2]))
    assert list(zip(a, b)) == [(0, 0), (1, 0), (2, 1), (2, 2), (2, 3), (3, 4), (3, 5), (4, 4), (4, 5)]


def test_empty_table(spark):
    assert alignment.align_documents(spark.createDataFrame([], "doc_id long, text string"), A, B).collect() == []


def test_groups_are_given(spark):
    df = spark.createDataFrame([(7, "Hello naïve world")], "doc_id long, text string")
    (row,) = alignment.align_documents(df, A, B).collect()
    assert row.groups == told(brute("Hello naïve world")[2]) and row.groups_sha256 == hashlib.sha256(row.groups.encode()).hexdigest()
