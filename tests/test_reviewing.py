"""Segments, spelling, windows, declarations, verdicts and the whole review on small odd inputs."""

import random

import pytest
from pyspark.sql import functions as F

from glossa.operators import anchors, decisions, document_review, fixtures, incremental, plausibility, segments, signals, spellcheck, structure
from glossa.session import Scratch


def test_long_sentences_lose_nothing(spark):
    draw = random.Random(4)
    texts = ["", "a", "x" * 95, "ab; cd, ef. " * 30, " lead and trail  ", "one. two!  three?  four", "y" * 30 + " " + "z" * 60, " ;;,,  \t.", "".join(draw.choices("ab ;,.!\t", k=700))]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = rows.select("i", F.flatten(F.transform(segments.sentence_parts(F.col("text")), lambda s: segments.long_parts(s, 40))).alias("p")).collect()
    assert all("".join(r.p) == texts[r.i] and all(0 < len(x) <= 40 for x in r.p) for r in got)


def test_segments_stay_in_blocks_and_sections(spark):
    text = "BAB SATU\nFirst one. Second one.\nThird; fourth\n\nBAB DUA\nFifth. " + "w " * 600
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "  \n ")], "doc_id int, text string")
    found = segments.segments(structure.headings(structure.paragraphs(docs, "doc_id", "text"))).orderBy("id").collect()
    assert [(r.id, r.text[:6], (r.previous or "")[:6], (r.next or "")[:6], r.too_long) for r in found] == [
        (1, "First ", "", "Second", False), (2, "Second", "First ", "Third;", False), (3, "Third;", "First ", "", False), (4, "Fifth.", "", "w w w ", False), (5, "w w w ", "Fifth.", "", True),
    ]
    assert all(text[r.start : r.end] == r.text for r in found)


def distance(a, b):
    """Edits with swaps of neighbours, letters between swapped ones allowed (a table over last places)."""
    far, last = len(a) + len(b), {}
    d = {(-1, -1): far}
    for i in range(len(a) + 1):
        d[i, -1], d[i, 0] = far, i
    for j in range(len(b) + 1):
        d[-1, j], d[0, j] = far, j
    for i in range(1, len(a) + 1):
        seen = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), seen
            same = a[i - 1] == b[j - 1]
            if same:
                seen = j
            d[i, j] = min(d[i - 1, j - 1] + (not same), d[i, j - 1] + 1, d[i - 1, j] + 1, d[k - 1, m - 1] + (i - k - 1) + 1 + (j - m - 1))
        last[a[i - 1]] = i
    return d[len(a), len(b)]


def test_guesses_are_brute_force(spark):
    draw = random.Random(8)
    good = sorted({"".join(draw.choices("abcé", k=draw.randrange(4, 8))) for _ in range(60)})
    asked = sorted({"".join(draw.choices("abcé", k=draw.randrange(4, 8))) for _ in range(80)} - set(good)) + ["abcdefghij"]
    weight = {w: draw.randrange(1, 4) for w in good}
    lexicon = spark.createDataFrame(list(weight.items()), "word string, weight long")
    words = spark.createDataFrame([(w,) for w in [*asked, asked[0], good[0]]], "word string")
    got = {}
    for r in spellcheck.guesses(words, lexicon, edits=2, most=6).collect():
        got.setdefault(r.word, []).append((r["rank"], r.guess, r.edits))
    want = {}
    for w in asked:
        near = sorted((distance(w, g), -weight[g], g) for g in good if distance(w, g) <= 2)[:6]
        if near:
            want[w] = [(k + 1, g, e) for k, (e, _, g) in enumerate(near)]
    assert {w: sorted(x) for w, x in got.items()} == want


def test_phrases_restore_one_word(spark):
    docs = spark.createDataFrame([(1, "Pihak Pertma hadir\nPihak,Pertma; Pihka Pertma\nPIHAK pertama"), (2, None)], "doc_id int, text string")
    phrases = spark.createDataFrame([(1, "Pihak Pertama"), (1, "satu"), (2, "Pihak Pertama")], "doc_id int, phrase string")
    got = spellcheck.phrase_errors(spellcheck.line_tokens(docs, "doc_id", "text"), phrases).collect()
    assert [(r.doc_id, r.line, r.pos, r.original, r.replacement) for r in got] == [(1, 0, 1, "Pertma", "Pertama")]
    both = phrases.union(spark.createDataFrame([(1, "Pihak Pertmas")], phrases.schema))
    assert spellcheck.phrase_errors(spellcheck.line_tokens(docs, "doc_id", "text"), both).collect() == []  # two terms want two different words


def test_plausible_guess_wins_by_its_context(spark):
    paras = [(k, 0, "he went to the house today") for k in range(30)] + [(99, 0, "he went to teh house today"), (100, 0, "")]
    segs = plausibility.segments(spark.createDataFrame(paras, "doc_id int, pos int, text string"))
    wanted = spark.createDataFrame([("teh", "ten", 1), ("teh", "the", 2), ("zzz", "the", 1)], "word string, guess string, rank int")
    (row,) = plausibility.plausible(segs, wanted, Scratch(spark, "t")).collect()
    assert (row.doc_id, row.place, row.guess, row.pieces) == (99, 4, "the", 6) and row.guess_score > row.original_score + 0.25


def greedy(sizes, most, windows):
    out, held, opened = [], None, 0
    for n, size in enumerate(sizes):
        if size > most:
            held = None
            out.append((None, n, n + 1, size))
        elif held is not None and out[held][3] + size <= most:
            w, a, _, s = out[held]
            out[held] = (w, a, n + 1, s + size)
        else:
            held = len(out)
            out.append((opened if opened < windows else None, n, n + 1, size))
            opened += 1
    return out


def test_windows_are_packed_in_order(spark):
    draw = random.Random(3)
    docs = [[draw.choice([1, 7, 60, 99, 100, 101, 250]) for _ in range(draw.randrange(1, 40))] for _ in range(12)]
    rows = [(d, n, n, n + 1, size) for d, sizes in enumerate(docs) for n, size in enumerate(sizes)]
    got = anchors.pack_windows(spark.createDataFrame(rows, "doc_id int, n int, start int, end int, tokens int").repartition(5), tokens=100, windows=3)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((d, *w) for d, sizes in enumerate(docs) for w in greedy(sizes, 100, 3)), key=repr)


def test_conditional_units_are_one_clause(spark):
    units = spark.createDataFrame([(1, "A bayar; B kirim"), (2, "A bayar; jika B kirim"), (3, None), (4, "")], "doc_id int, text string")
    got = sorted((r.doc_id, r.start, r.end) for r in anchors.window_clauses(units).collect())
    assert got == [(1, 0, 8), (1, 8, 16), (2, 0, 21)]


def test_declarations_in_definition_sections(spark):
    text = 'Bab I Definisi\n"Satu" dan "Dua" ada; "Dua" berarti angka. "Tiga" atau "Empat" dan "Lima" selanjutnya disebut "Empat".\nBab II\n"Enam"'
    cut = text.index("Bab II")
    docs, sections = spark.createDataFrame([(1, text), (2, "")], "doc_id int, text string"), spark.createDataFrame([(1, 0, cut, "Bab I Definisi"), (1, cut, len(text), "Bab II")], "doc_id int, start int, end int, heading string")
    rows = sorted(signals.declarations(docs, sections).collect(), key=lambda r: r.ord)
    assert [(r.term, r.alias_of) for r in rows] == [("Dua", None), ("Empat", None), ("Tiga", None), ("Empat", "Tiga"), ("Lima", None), ("Satu", None), ("Dua", None)]
    assert [r.ord for r in rows] == list(range(7)) and all(text[r.start : r.end] == r.term for r in rows)


def test_broken_answers_are_asked_once_more_and_known_ones_never(spark):
    pairs = spark.createDataFrame([(1, f"p{k}", "value", f"a{k}", f"b{k}", f"text {k}", "other") for k in range(5)] + [(2, "q", "value", "b0", "a0", "other", "text 0")], "doc_id int, pair_id string, kind string, first_id string, second_id string, first string, second string")
    asked = []

    def ask(calls):
        rows = calls.collect()
        asked.extend((r.call_id, r.attempt, len(r.pairs)) for r in rows)
        out = []
        for r in rows:
            said = [f'{{"pair_id":"{p.pair_id}","verdict":"conflict","evidence_ids":["{p.second_id}","{p.first_id}"]}}' for p in r.pairs]
            broken = r.attempt == 1 and len(r.pairs) == 4
            out.append((r.call_id, '{"decisions":[' + ",".join(said) + "]" + (',"note":1}' if broken else "}")))
        return spark.createDataFrame(out, "call_id string, answer string") if out else spark.createDataFrame([], "call_id string, answer string")

    scratch = Scratch(spark, "v")
    first, ledger = decisions.review_pairs(pairs, None, ask, scratch, name="a")
    assert sorted(asked) == [("1-0", 1, 4), ("1-0", 2, 4), ("1-1", 1, 1)] and ledger.count() == 5
    assert {(r.pair_id, r.verdict, r.status, r.attempts) for r in first.collect()} == {*((f"p{k}", "conflict", "asked", 2) for k in range(4)), ("p4", "conflict", "asked", 1), ("q", "conflict", "asked", 2)}
    asked.clear()
    again, _ = decisions.review_pairs(pairs, ledger, ask, scratch, name="b")
    assert not asked and {r.status for r in again.collect()} == {"known"}


@pytest.mark.parametrize(
    "events,state,attempts",
    [([], "failed", 0), (["recoverable"], "repaired-failed", 1), (["recoverable", "accept"], "repaired-accepted", 2), (["strong-reject"], "rejected", 1), (["strong-reject", "fatal", "accept"], "challenged-rejected", 2), (["accept", "fatal"], "accepted", 1)],
)
def test_outcomes_by_the_table(spark, events, state, attempts):
    candidates = spark.createDataFrame([(1, "hybrid", "deterministicRule", "spelling")], "candidate_id int, mode string, tier string, category string")
    rows = [(1, n, e if e in ("recoverable", "fatal") else "valid", e.removeprefix("strong-"), True) for n, e in enumerate(events)]
    (r,) = decisions.outcomes(candidates, spark.createDataFrame(rows, "candidate_id int, attempt int, result string, decision string, same boolean")).collect()
    assert (r.state, r.attempts) == (state, attempts) and r.status == "suggestion"  # failed and rejected rules of this kind keep their own


def test_review_without_reviewer_and_with_odd_documents(spark):
    text = 'Harga "Data Pokok" tersebut wajib wajib dijaga.\nPenyedia dapat mengakhiri kontrak tanpa pemberitahuan.\nBiaya [NOMOR REKENING] diisi.'
    docs = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "tenang saja.")], "doc_id int, text string")
    found = sorted(document_review.review(docs, Scratch(spark, "r")).collect(), key=lambda r: (r.doc_id, r.number))
    assert [(r.doc_id, r.number, r.rule_id, r.disposition, r.origin) for r in found] == [
        (1, 1, "defined-term-undeclared-quoted-term", "uncertain", "deterministic"), (1, 2, "local-grammar", "flagged", "deterministic"),
        (1, 3, "legal-risk-unilateral-termination-no-notice", "uncertain", "deterministicFallback"), (1, 4, "local-missing", "flagged", "deterministic"),
    ]
    assert all(text[r.start : r.end] == r.original for r in found)
    silent = document_review.review(docs, Scratch(spark, "r"), lambda asked: asked.select("doc_id", "finding", F.lit("?").alias("decision")).where("false")).where("kind = 'legalRisk'").first()
    assert (silent.disposition, silent.origin) == ("uncertain", "deterministicFallback")


def test_refresh_and_import_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a \n", 5), (2, "a", 4), (3, "a", 6), (4, None, 1), (5, "", 2), (6, "b", None)], "id int, text string, at int")
    got = {r.id: (r.action, r.of) for r in incremental.import_duplicates(docs, "id", "text", "at").collect()}
    assert got == {1: ("content-duplicate", 2), 2: ("keep", None), 3: ("file-duplicate", 2), 4: ("keep", None), 5: ("file-duplicate", 4), 6: ("keep", None)}
    none = spark.createDataFrame([], "fixture_id int, category string, no_change boolean, hard_negative boolean")
    empty = spark.createDataFrame([], "fixture_id int, key string, seq int, original string, replacement string, occurrence int, source string")
    assert all(r.precision is None for r in fixtures.metrics(none, empty, empty).collect())
