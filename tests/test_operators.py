from pyspark.sql import functions as F

from glossa.functions import text as t
from glossa.session import broadcast_if_small
from glossa.operators import anchors, evaluate, incremental, retrieval, review, signals, spans, structure


def one(spark, column, **values):
    names = list(values)
    kinds = {str: "string", int: "int", float: "double", list: "array<string>"}
    schema = ", ".join(f"{n} {kinds[type(v)]}" for n, v in values.items())
    return spark.createDataFrame([tuple(values[n] for n in names)], schema).select(column).first()[0]


def test_normalisers_differ(spark):
    x = "  Déjà\tVU -  x. "
    assert one(spark, t.normalise(F.col("x")), x=x) == "deja vu - x."
    assert one(spark, t.normalise_space(F.col("x")), x=x) == "déjà vu - x."
    assert one(spark, t.normalise_marks(F.col("x")), x=x) == "déjà vu x"
    assert one(spark, t.tokens(F.col("x")), x=x) == ["deja", "vu", "x"]
    assert one(spark, t.normalise_content(F.col("x")), x="a  \r\n b\t\n\n") == "a\n b"


def test_scalars(spark):
    for a, b, want in [("abc", "acb", True), ("abc", "abd", True), ("abc", "abc", False), ("abcd", "badc", False), ("a", "ab", True), ("ab", "ba", True)]:
        assert one(spark, t.single_edit(F.col("a"), F.col("b")), a=a, b=b) is want, (a, b)
    assert one(spark, t.match_case(F.col("a"), F.col("b")), a="new", b="Old") == "New"
    assert tuple(one(spark, t.change_range(F.col("a"), F.col("b")), a="abcde", b="abXde")) == (2, 2)
    assert tuple(one(spark, t.change_range(F.col("a"), F.col("b")), a="aa", b="aaa")) == (2, 0)
    assert one(spark, t.occurrences(F.col("a"), F.col("b")), a="aaaa", b="aa") == 2
    assert one(spark, t.utf16_length(F.col("a")), a="a\U0001f600é") == 4
    assert one(spark, t.strip_prefix(F.col("d"), F.col("w"), ("is", "means")), d="Term means a thing", w="Term") == "a thing"
    assert one(spark, t.holds_sequence(F.col("a"), F.col("b")), a=["x", "ab", "c"], b=["b", "c"]) is False
    assert one(spark, t.lost_markers(F.col("a"), F.col("b")), a='5% of "x" ABC', b='6% of "x" ABC') == ["numbers", "percent"]
    assert one(spark, t.masked_numbers(F.col("a")), a="Pay 1.000 in 3 days") == "pay # in # days"


def test_validation_order(spark):
    cases = [("", "b", "empty-original"), ("a", "", "empty-replacement"), ("a", "a", "no-change"), ("zz", "b", "not-in-context"), ("x", "y", "ambiguous-range"), ("pay 5", "pay 6", "literal-changed"), ("may go", "may not go", "polarity-changed"), ("may go", "can go", None)]
    context = "x x pay 5 may go"
    for original, new, want in cases:
        assert one(spark, review.validate(F.col("a"), F.col("b"), F.lit(context)), a=original, b=new) == want, original


def test_search_of_blank_and_hybrid_gate(spark):
    entries = spark.createDataFrame([(1, "Tax", "a levy"), (2, "Tax law", "law of levies"), (3, "tax", None), (4, "", "empty")], "id int, term string, d string")
    asked = spark.createDataFrame([(1, "TAX"), (2, "  "), (3, "levy\nof")], "q int, text string")
    found = retrieval.lexical_search(entries, asked, 3, entry_id="id", term="term", definition="d", query_id="q", query_text="text", verified=F.col("id") == 3).collect()
    assert [r.doc_id for r in sorted(found, key=lambda r: (r.query_id, r.rank)) if r.query_id == 1] == [3, 1, 2]
    assert {r.query_id for r in found} == {1, 3}
    ranked = spark.createDataFrame([(1, 1, 0.7), (1, 2, 0.65), (2, 1, 0.7), (3, 1, 0.5), (4, 1, 0.9), (4, 2, 0.89)], "query_id int, rank int, score double")
    assert sorted(r.query_id for r in retrieval.margin_gate(ranked, 0.6, 0.03).collect()) == [1, 2]


def test_spans(spark):
    rows = spark.createDataFrame([(1, 0, 10, 1), (1, 5, 15, 2), (1, 10, 12, 3), (1, 20, 30, 4), (2, 0, 900, 1)], "doc_id int, start int, end int, rank int")
    kept = sorted((r.doc_id, r.start) for r in spans.greedy(rows, ["doc_id"], most=2).collect())
    assert kept == [(1, 0), (1, 10), (2, 0)]
    guard = spark.createDataFrame([(1, 9, 10), (2, 700, 701)], "doc_id int, start int, end int")
    assert sorted((r.doc_id, r.start) for r in spans.overlap_anti(rows, guard).collect()) == [(1, 10), (1, 20)]
    assert spans.overlap_join(rows, guard).count() == 3
    moved = spans.after_accept(rows.where("doc_id = 1"), 5, 12, 3).collect()
    assert [(r.start, r.end) for r in moved] == [(16, 26)]
    assert [r.start for r in spans.conflicts(rows.where("doc_id = 1")).collect()] == [0, 5]


def test_structure(spark):
    text = "Chapter 1\nArticle 1\n  body\n\n1. item\nArticle 2\nChapter 2\ntail"
    p = structure.paragraphs(spark.createDataFrame([(1, text), (2, ""), (3, None)], "d int, x string"), "d", "x")
    assert all(text[r.start : r.end] == r.text for r in p.collect())
    heads = {r.pos: (r.kind, r.chapter_pos, r.article_pos) for r in structure.headings(p).collect()}
    assert heads == {0: ("chapter", 0, None), 1: ("article", 0, 1), 2: ("paragraph", 0, 1), 3: ("item", 0, 1), 4: ("article", 0, 4), 5: ("chapter", 5, None), 6: ("paragraph", 5, None)}
    ends = {r.pos: r.end_pos for r in structure.sections(structure.headings(p)).collect()}
    assert ends == {0: 5, 1: 4, 4: 5, 5: 7}


def test_incremental(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c")], "segment_id int, text string")
    new = spark.createDataFrame([(11, "a"), (12, "b"), (13, "d")], "segment_id int, text string")
    got = {r.segment_id: r.action for r in incremental.plan(old, new, ["text"], "segment_id").collect()}
    assert got == {11: "reuse", 12: "reprocess", 13: "reprocess", 4: "removed"}
    mapping = spark.createDataFrame([(1, 11, False)], "old_id int, new_id int, ambiguous boolean")
    results = spark.createDataFrame([(1, 0, 1, "a"), (1, 0, 1, "z")], "old_id int, start int, end int, original string")
    segs = spark.createDataFrame([(11, 40, "a")], "segment_id int, start int, text string")
    assert [tuple(r) for r in incremental.rematerialise(results, mapping, segs).collect()] == [(11, 40, 41, "a")]


def test_declared_terms_and_scores(spark):
    docs = spark.createDataFrame([(1, '"A" means x. "A" means y! "B" means z. "B" means Z'), (2, "none")], "d int, x string")
    got = {r.term: r.verdict for r in review.declared_terms(docs, "d", "x", '"([^"]+)" means ([^.!]+)').collect()}
    assert got == {"a": "conflicting", "b": "duplicate"}
    rows = spark.createDataFrame([(True, True), (True, False), (False, True), (None, None)], "e boolean, o boolean")
    r = evaluate.prf(rows, F.col("e"), F.col("o")).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.precision, r.recall, r.f1) == (1, 1, 1, 1, 0.5, 0.5, 0.5)
    assert evaluate.prf(rows.limit(0), F.col("e"), F.col("o")).first().precision is None
    found = review.matches(docs, "d", "x", r"[A-Z]").collect()
    assert [(r.start, r.value) for r in found][:2] == [(1, "A"), (14, "A")]


def test_windows_protection_and_conflicts(spark):
    text = 'Harga 1,5 juta, pembeli "a; b" bayar; PT. X hadir. Pihak Kedua ada'
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id int, text string")
    got = [text[r.start : r.end] for r in sorted(anchors.clause_ranges(docs).collect(), key=lambda r: r.n)]
    assert got == ["Harga 1,5 juta,", ' pembeli "a; b" bayar;', " PT. X hadir.", " Pihak Kedua ada"]
    clauses = spark.createDataFrame([(1, n, n, n + 1, t) for n, t in enumerate((300, 200, 600, 100, 500, 10))], "doc_id int, n int, start int, end int, tokens int")
    got = [(r.window, r.start, r.end, r.tokens) for r in sorted(anchors.pack_windows(clauses, windows=2).collect(), key=lambda r: r.start)]
    assert got == [(0, 0, 2, 500), (None, 2, 3, 600), (1, 3, 4, 100), (None, 4, 6, 510)]
    spans_ = {r.value for r in anchors.protected_spans(docs).collect()}
    assert {'"a; b"', "Pihak Kedua", "PT"} <= spans_
    kinds = "segment_id int, review_id int, status string, origin string, category string, start int, end int"
    rows = [(1, 1, "suggestion", "model", "spelling", 0, 5), (1, 2, "suggestion", "deterministic", "grammar", 4, 9), (1, 3, "no-suggestion", "model", None, None, None), (2, 4, "suggestion", "model", "spelling", 0, 5)]
    assert sorted(r.review_id for r in anchors.resolve_conflicts(spark.createDataFrame(rows, kinds)).collect()) == [2, 3, 4]
    model = spark.createDataFrame([(1, 3, "no-suggestion", "model", None, None, None), (2, 4, "suggestion", "model", "spelling", 0, 5)], kinds)
    own = spark.createDataFrame([(1, 7, "suggestion", "deterministic", "spelling", 0, 2), (2, 8, "suggestion", "deterministic", "spelling", 0, 2)], kinds)
    assert sorted(r.review_id for r in anchors.survive_silence(model, own).collect()) == [4, 7]


def test_declarations_and_snapshots(spark):
    text = '"Harga" adalah  nilai jual. yang selanjutnya disebut "Barang"; "Harga" atau "Biaya" tetap. "HARGA" berarti nilai lain\n'
    found = signals.declarations(spark.createDataFrame([(1, text), (2, None)], "doc_id int, text string"), spark.createDataFrame([(1, 0, 5, "Bab I Definisi")], "doc_id int, start int, end int, heading string"))
    rows = sorted(found.collect(), key=lambda r: r.ord)
    assert [(r.term, r.body, r.alias_of) for r in rows] == [("Harga", "nilai jual", None), ("HARGA", "nilai lain", None), ("Barang", "", None), ("Biaya", "", "Harga")]
    assert all(text[r.start : r.end] == r.term for r in rows)
    kinds = sorted((r.rule_id, r.start) for r in signals.term_findings(found).collect())
    assert kinds == [("defined-term-case-inconsistency", rows[1].start), ("defined-term-conflicting-definition", 1)]
    whole = "abc def"
    snaps = spark.createDataFrame([(1, "v", "p", whole), (2, "v", "p", whole), (3, "v", "q", whole)], "doc_id int, version string, profile string, text string").withColumn("digest", t.content_hash(F.col("text")))
    marks = spark.createDataFrame([(1, 4, 7, "def"), (2, 4, 7, "xyz")], "doc_id int, start int, end int, original string").withColumn("digest", F.sha2("original", 256))
    assert [r.doc_id for r in anchors.snapshots_usable(snaps, marks, "v", "p").collect()] == [1]


def test_broadcasts_are_bounded_by_rows_and_bytes(spark):
    def is_broadcast(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()

    rows = spark.createDataFrame([(k, "x" * 1000, [1.0] * 10, {"a": 1}) for k in range(10)], "i int, s string, v array<double>, m map<string,int>")
    assert is_broadcast(broadcast_if_small(rows, 10))
    assert not is_broadcast(broadcast_if_small(rows, 9)) and not is_broadcast(broadcast_if_small(rows, 10, most_bytes=9000))
