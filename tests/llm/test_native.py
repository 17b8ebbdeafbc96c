"""The two operators in SQL functions alone."""

import hashlib
import json
import re

from pyspark.sql import functions as F

from glossa.llm import pseudonyms as p
from glossa.llm import tool_calls as tc

KEY = "k"


def digest(*parts):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def feistel(value, a, b, label):
    left, right = divmod(value, b)
    for i in range(1, p.ROUNDS + 1):
        if i % 2:
            left = (left + digest(KEY, label, i, a, b, right) % a) % a
        else:
            right = (right + digest(KEY, label, i, a, b, left) % b) % b
    return left * b + right


def luhn(d):
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def test_feistel_is_brute_force_and_a_permutation(spark):
    a, b = 21, 34
    out = spark.range(a * b).select(p.feistel(F.col("id"), F.lit(a).cast("long"), F.lit(b).cast("long"), KEY, "t").alias("v")).collect()
    assert [r.v for r in out] == [feistel(v, a, b, "t") for v in range(a * b)]
    assert len({r.v for r in out}) == a * b


def test_formats_stay_and_values_stay_linked(spark):
    texts = [
        "card 4539 1488 0343 6467, again 4539148803436467.", "no card 4539148803436468", "call +1 (017) 555-7713 or 017-555-7713!", "ip 10.0.0.255; not 10.0.0.256 or 010.1.1.1",
        "on 2024-02-29 and 29/02/2024 and 29.02.2024, not 2023-02-29", "ssn 123-45-6789 not 666-45-6789", "Mail a.B+c@Ex-ample.co.uk; a.b+C@ex-ample.co.uk", None, "", "12 345 plain",
        "deadbeef4539148803436467 x4539148803436467", "9" * 5000, "é\U0001f600 10.1.1.1",
    ]
    docs = spark.createDataFrame([(i, t, "c", 1) for i, t in enumerate(texts)] + [(0, texts[0], None, None), (None, texts[3], None, None)], "doc_id long, text string, kind string, n_card int")
    rows = p.pseudonymise(docs, key=KEY).collect()
    out = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) + 2
    m = re.fullmatch(r"card (\d{4} \d{4} \d{4} \d{4}), again (\d{16})\.", out[0].text)
    assert m and m[1].replace(" ", "") == m[2] != "4539148803436467" and luhn(m[2]) and out[0].n_card == 2
    payload = feistel(453914880343646, 10**7, 10**8, "card")
    assert m[2][:15] == f"{payload:015d}"
    for same in (1, 7, 8, 9, 10, 11):
        assert out[same].text == texts[same]
    m = re.fullmatch(r"call \+1 \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})-(\d{3})-(\d{4})!", out[2].text)
    assert m and out[2].n_phone == 2
    m = re.fullmatch(r"ip (\d+\.\d+\.\d+\.\d+); not 10\.0\.0\.256 or 010\.1\.1\.1", out[3].text)
    assert m and m[1] != "10.0.0.255" and all(int(x) < 256 for x in m[1].split(".")) and out[3].n_ip == 1
    m = re.fullmatch(r"on (\d{4})-(\d\d)-(\d\d) and (\d\d)/(\d\d)/(\d{4}) and (\d\d)\.(\d\d)\.(\d{4}), not 2023-02-29", out[4].text)
    assert m and m.group(1, 2, 3) == m.group(6, 5, 4) == m.group(9, 8, 7) and out[4].n_date == 3
    assert re.fullmatch(r"ssn (?!123-45-6789)\d{3}-\d\d-\d{4} not 666-45-6789", out[5].text) and out[5].n_ssn == 1
    m = re.fullmatch(r"Mail (u\w+@h\w+\.example); (u\w+@h\w+\.example)", out[6].text)
    assert m and m[1] == m[2]
    assert out[12].text.startswith("é\U0001f600 ") and "10.1.1.1" not in out[12].text
    assert p.pseudonymise(docs.limit(0), key=KEY).count() == 0


EVENT = "conv_id string, turn long, kind string, call_id string, name string, arguments string, depends_on string, content string"
SCHEMAS = {"add": {"a": ("integer", True), "b": ("number", True), "note": ("string", False)}}


def test_links_order_validation_and_json(spark):
    events = [
        ("c", 0, "call", "x", "add", '{"b": 2.5, "a": 1}', None, None), ("c", 1, "result", "x", None, None, None, "3.5"),
        ("c", 2, "call", "y", "add", '{"a": "1", "z": 0}', "x", None), ("c", 3, "message", None, None, None, None, "hi"),
        ("c", 4, "result", "q", None, None, None, "?"), ("c", 5, "call", None, "add", "{}", None, None), ("c", 6, "call", "w", "sub", "[]", None, None),
        ("back", 0, "call", "b", "add", "[1]", "a", None), ("back", 1, "call", "a", "add", '{"a":1,"b":1}', None, None), ("back", 2, "result", "b", None, None, None, "r"),
        ("back", 3, "call", "l1", "add", None, "l2", None), ("back", 4, "call", "l2", "add", "{", "l1", None),
        ("dup", 0, "call", "d", "add", '{"a":1,"b":1}', None, None), ("dup", 0, "call", "d", "add", '{"a":1,"b":1}', None, None), ("dup", 1, "result", "d", None, None, None, "1"), ("dup", 2, "result", "d", None, None, None, "2"),
        ("early", 0, "result", "e", None, None, None, "1"), ("early", 1, "call", "e", "add", '{"a":1,"b":1}', None, None), (None, None, "call", "n", "add", '{"a":1,"b":1}', None, None),
    ]
    rows = tc.link(spark.createDataFrame(events, EVENT), SCHEMAS).collect()
    assert len(rows) == len(events)
    at = {(r.conv_id, r.turn, r.kind): r for r in rows}
    assert [at["c", t, k].status for t, k in [(0, "call"), (1, "result"), (2, "call"), (3, "message"), (4, "result"), (5, "call"), (6, "call")]] == ["ok", "ok", "unanswered", "ok", "orphan", "no_id", "unanswered"]
    assert at["c", 0, "call"].errors == "" and at["c", 2, "call"].errors == "a is no integer; missing b; unknown z" and at["c", 6, "call"].errors == "unknown tool"
    assert at["back", 0, "call"].errors == "arguments are no object" and at["back", 4, "call"].errors == "arguments are no object"
    assert at["c", 0, "call"].json == '{"arguments":{"a":1,"b":2.5},"id":"x","name":"add","result_turn":1,"turn":0,"type":"call"}'
    place = {t: at["back", t, k].place for t, k in [(0, "call"), (1, "call"), (2, "result"), (3, "call"), (4, "call")]}
    assert place == {0: 1, 1: 0, 2: 1, 3: None, 4: None}
    assert {r.status for r in rows if r.conv_id == "dup"} == {"duplicate"}
    assert at["early", 0, "result"].status == "early" and at[None, None, "call"].status == "unanswered"
    for r in rows:
        assert json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json
    assert tc.link(spark.createDataFrame([], EVENT), SCHEMAS).count() == 0


def test_conversations(spark):
    said = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", None), (2, 0, "user", '{"tool_call":{"id":"i","name":"add","arguments":{"a":1}}}'), (2, 1, "tool", '{"tool_call_id":"i","content":"2"}'), (3, 0, "assistant", "{no json"), (None, None, None, None)]
    rows = tc.link(tc.events_of(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")), tc.TURN_SCHEMAS).collect()
    got = {(r.conv_id, r.turn): (r.kind, r.call_id, r.status) for r in rows}
    assert got[1, 1] == ("call", "t1", "ok") and got[1, 2] == ("result", "t1", "ok") and got[2, 0] == ("call", "i", "ok") and got[2, 1] == ("result", "i", "ok") and got[3, 0][0] == "message"
    assert len(rows) == len(said)


def test_very_long_addresses_need_no_stack(spark):
    long = "x@y" + ".ab" * 100_000
    text = f"{long} and " + "1 " * 50_000 + "+" + "12-" * 50_000
    out = p.pseudonymise(spark.createDataFrame([(1, text)], "doc_id long, text string"), key="k").collect()
    assert out[0].n_email == 1 and out[0].text.startswith("u") and len(out[0].text) < len(text)


def test_phones_stay_linked_whatever_their_spelling(spark):
    texts = ["+1 415-555-1234", "+14155551234", "(415) 555-1234", "415.555.1234", "+44 20 7946 0958", "+442079460958", "+353 1 234 5678", "+35312345678"]
    rows = p.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), key="k").orderBy("doc_id").collect()
    assert all(r.n_phone == 1 for r in rows)
    digits = ["".join(c for c in r.text if c.isdigit()) for r in rows]
    assert digits[0] == digits[1] and digits[0][0] == "1" and digits[0][1:] == digits[2] == digits[3] != "4155551234"
    assert digits[4] == digits[5] and digits[4][:2] == "44" and digits[6] == digits[7] and digits[6][:3] == "353"


def test_long_chains_that_go_back_are_ordered(spark):
    n = 300
    rows = [("c", k, "call", f"k{k}", "add", None, f"k{k + 1}" if k < n - 1 else None, None) for k in range(n)]
    rows += [("o", 0, "call", "x", "add", None, "y", None), ("o", 1, "call", "y", "add", None, "x", None), ("o", 2, "call", "z", "add", None, "y", None)]
    out = tc.link(spark.createDataFrame(rows, EVENT), SCHEMAS).collect()
    assert {r.turn: r.place for r in out if r.conv_id == "c"} == {k: n - 1 - k for k in range(n)}
    assert {r.place for r in out if r.conv_id == "o"} == {None}
