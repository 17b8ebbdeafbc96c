import random

from pyspark.sql import functions as F

from glossa.functions import parsing as p
from glossa.operators import candidates as c
from glossa.operators import definitions as d


def test_rules_find_places_and_keep_case(spark):
    segments = spark.createDataFrame([(1, "Colour and colour, CÓLOUR."), (2, "colour of no change"), (3, "none")], "segment_id int, text string")
    rules = spark.createDataFrame([("r1", "colour", "color", True, ["no change"]), ("r2", "and", "&", False, None), ("r3", "colour,", "x", True, None)], "rule_id string, literal string, replacement string, active boolean, exceptions array<string>")
    got = sorted((r.rule_id, r.start, r.end, r.original, r.replacement) for r in c.rule_suggestions(segments, rules).collect())
    assert got == [("r1", 0, 6, "Colour", "Color"), ("r1", 11, 17, "colour", "color"), ("r1", 19, 25, "CÓLOUR", "Color"), ("r3", 11, 18, "colour,", "x")]


CANDIDATE = "candidate_id int, segment_id int, tier int, direct boolean, anchored boolean, shared_tokens int, score_delta double, priority int, start int, end int, rule_id string, original string, replacement string, context string, protected boolean"


def test_ranking_dispatch_and_empty_segments(spark):
    rows = [
        (1, 1, 1, False, True, 0, None, 1, 0, 5, "a", "teh", "the", "teh cat", False), (2, 1, 3, True, True, 2, 0.1, 1, 3, 8, "b", "cat", "dog", "teh cat", False),
        (3, 1, 1, False, True, 0, 0.5, 1, 8, 9, None, "x", "y", "x", False), (4, 1, 3, True, True, 2, 0.1, 2, 3, 8, "c", "cat", "dog", "teh cat", False),
        (5, 2, 1, True, False, 0, None, 1, 0, 2, "d", "ab", "ac", "ab", False), (6, 2, 9, True, True, 0, None, 1, 5, 6, "e", "q", "r", "q", True),
    ]
    frame = spark.createDataFrame(rows, CANDIDATE)
    assert sorted((r.candidate_id, r["rank"]) for r in c.ranked(frame).collect()) == [(1, 3), (2, 1), (3, 2), (5, 2), (6, 1)]
    assert sorted(r.candidate_id for r in c.select(frame).collect()) == [2, 3, 5, 6]
    routed = c.route_candidates(frame)
    model = spark.createDataFrame([(1, "accept"), (3, "reject")], "candidate_id int, decision string")
    out = {r.candidate_id: r.outcome for r in c.dispatch(routed, model).collect()}
    assert out == {1: "accepted", 2: "accepted", 3: "dropped", 4: "accepted", 5: "review", 6: "dropped"}
    assert {r.candidate_id: r.outcome for r in c.dispatch(routed).collect()}[1] == "review"
    segments = spark.createDataFrame([(1,), (2,), (7,)], "segment_id int")
    assert [r.segment_id for r in c.with_empty(c.dispatch(routed), segments).where("outcome = 'no-suggestion'").collect()] == [7]


def test_windows_are_brute_force(spark):
    texts = ["a b c x y d e f z", "x x x x x x x x", "d c b a d c", "a"]
    wanted = "a b c d".split()
    out = spark.createDataFrame([(i, x.split(), wanted) for i, x in enumerate(texts)], "i int, t array<string>, w array<string>").select("i", c.covering_window(F.col("t"), F.col("w")).alias("x")).collect()
    for r in out:
        ws = texts[r.i].split()
        options = [(s, -len(set(ws[i : i + s]) & set(wanted)), i) for s in range(6, min(80, len(ws)) + 1) for i in range(len(ws) - s + 1)]
        options = [o for o in options if -o[1] >= 3]
        want = min(options) if options else None
        assert (tuple(r.x) if r.x else None) == ((want[2], want[0], -want[1]) if want else None)


def test_definitions(spark):
    segments = spark.createDataFrame([(1, "Tax adalah a levy."), (2, "Income tax didefinisikan sebagai a levy on income"), (3, "Tax law"), (4, "IT ialah x"), (5, "taxation adalah"), (6, None)], "segment_id int, text string")
    terms = spark.createDataFrame([("Tax",), ("Income Tax",)], "term string")
    aliases = d.ambiguous_free(spark.createDataFrame([("IT", "Income Tax"), ("X", "Tax"), ("x", "Income Tax")], "alias string, term string"))
    got = {r.segment_id: (r.term, r.body, r.strength) for r in d.detect(segments, terms, aliases).collect()}
    assert got == {1: ("Tax", "a levy.", "explicit"), 2: ("Income Tax", "a levy on income", "explicit"), 3: ("Tax", "law", "retrieved"), 4: ("Income Tax", "x", "explicit")}
    pairs = spark.createDataFrame([(1, "a Levy, income", "A levy income"), (2, "tidak a levy", "a levy"), (3, "a fee", "a levy")], "i int, a string, b string")
    assert {r.i: r.v for r in pairs.select("i", d.alignment(F.col("a"), F.col("b")).alias("v")).collect()} == {1: "match", 2: "mismatch", 3: "review"}
    assessed = spark.createDataFrame([(1, "explicit", "mismatch", "s", True, False, True), (2, "retrieved", "review", "s", False, None, True), (3, "explicit", "mismatch", "s", True, True, True), (4, "explicit", "match", "s", True, False, True)], "id int, strength string, alignment string, source string, term_matches boolean, narrow_negation boolean, eligible boolean")
    assert sorted(map(tuple, d.resolution_options(assessed).collect())) == [(1, "reject", "informational"), (1, "use-definition", "actionable"), (2, "reject", "informational"), (2, "replace-term", "needs-review"), (2, "use-definition", "needs-review")]


GOOD = "STATUS: suggestion\nCATEGORY: spelling\nORIGINAL: teh\nREPLACEMENT: the\nREASON: typo\nGLOSSARY_ID: -"


def test_output_contracts(spark):
    cases = [
        (GOOD, None), (GOOD.replace("\n", "\r\n"), None), (None, "empty"), ("<think>x" + GOOD, "reasoning"), ("```\n" + GOOD, "code-fence"), (GOOD + "\nX: y", "line-count"), (GOOD.replace("REASON: typo", "REASON typo"), "malformed-line"),
        (GOOD.replace("REASON", "WHY"), "unexpected-key"), (GOOD.replace("the", " "), "unexpected-key"), (GOOD.replace("spelling", "taste"), "invalid-value"), (GOOD.replace("typo", "t" * 241), "reason-too-long"),
    ]
    rows = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, x string").select("i", p.review_error(F.col("x")).alias("e"), p.review_fields(F.col("x")).alias("f")).collect()
    assert {r.i: r.e for r in rows} == {i: e for i, (_, e) in enumerate(cases)}
    first = next(r for r in rows if r.i == 0).f
    assert (first.status, first.original, first.glossary_id) == ("suggestion", "teh", None)
    texts = ['{"b": 1, "a": "é"}', '{"a":1,"a":2}', "[1]", "{", None, '{"a":"' + "x" * 140_000 + '"}']
    out = p.strict_json(spark.createDataFrame(list(enumerate(texts)), "i int, x string"), "i", "x").collect()
    assert [(r.canonical, r.error) for r in sorted(out, key=lambda r: r.i)] == [('{"a":"é","b":1}', None), (None, "repeated a"), (None, "no-object"), (None, "malformed"), (None, "empty"), (None, "too-large")]


def test_tool_decisions(spark):
    good = [("decide", {"id": "c1", "decision": "accept"})]
    cases = [(good, "", None), (good, "hi", "visible-text"), ([], None, "no-call"), (good * 2, None, "many-calls"), ([("x", good[0][1])], None, "wrong-tool"), ([("decide", {"id": "c1"})], None, "keys"),
             ([("decide", {"id": "c1", "decision": " "})], None, "value"), ([("decide", {"id": "c2", "decision": "accept"})], None, "id"), ([("decide", {"id": "c1", "decision": "maybe"})], None, "decision")]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, calls array<struct<name:string,args:map<string,string>>>, visible string")
    out = rows.select("i", p.decision_error(F.col("calls"), F.col("visible"), "decide", F.lit("c1"), ("accept", "reject")).alias("e")).collect()
    assert {r.i: r.e for r in out} == {i: e for i, (*_, e) in enumerate(cases)}


def test_references(spark):
    found = spark.createDataFrame([(1, "s", "a", 0), (1, "t", "a", 1), (1, "s", "b", 2), (2, "s", "a", 3)], "doc_id int, section string, label string, n int")
    targets = spark.createDataFrame([(1, "s", "a"), (1, "u", "a"), (1, "s", "c")], "doc_id int, section string, label string")
    assert {r.n: r.verdict for r in c.references(found, targets).collect()} == {0: "ok", 1: "ambiguous", 2: "missing", 3: "missing"}


def test_narrow_negations_and_operators(spark):
    rows = spark.createDataFrame([(1, "x tidak dapat y", "X  dapat y"), (2, "x dapat y tidak dapat z", "x tidak dapat y dapat z"), (3, "tidak boleh", "boleh"), (4, "a", "a")], "i int, a string, b string")
    assert {r.i: r.v for r in rows.select("i", d.narrow_negation(F.col("a"), F.col("b")).alias("v")).collect()} == {1: True, 2: False, 3: False, 4: False}
    found = rows.limit(1).select(d.operators(F.lit("Pihak Pertama tidak dapat 5 hari, atau wajib")).alias("o")).first().o
    assert found == ["tidak", "dapat", "5", "atau", "wajib", "pihak pertama"]


def test_covered_definitions_are_brute_force(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(30)]
    texts = [(k, [rng.choice(words) for _ in range(rng.randrange(0, 120))]) for k in range(30)]
    wanted = [(k, rng.sample(words, n)) for k, n in enumerate((3, 4, 6, 9))]
    out = c.covered_definitions(spark.createDataFrame(texts, "text_id int, ws array<string>"), spark.createDataFrame(wanted, "definition_id int, wanted array<string>")).collect()
    want = {}
    for i, ws in texts:
        for j, w in wanted:
            options = [(s, -len(set(ws[a : a + s]) & set(w)), a) for s in range(6, min(80, len(ws)) + 1) for a in range(len(ws) - s + 1)]
            options = [o for o in options if -o[1] >= 0.7 * len(w) - 1e-9]
            if len(w) >= 4 and options:
                s, n, a = min(options)
                want[i, j] = (a, s, -n)
    assert {(r.text_id, r.definition_id): (r.start, r.size, r.covered) for r in out} == want and want
