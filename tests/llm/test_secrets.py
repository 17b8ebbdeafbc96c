import re
from dataclasses import replace

import corpus_pipeline
from glossa.llm import secrets as s
from glossa.session import Scratch

SCHEMA = "doc_id long, text string, findings string, blob_id string, kind string"


def brute(text):
    """The contract's base findings, read off its patterns as they stand."""
    text = text or ""
    out = []
    for order, (kind, pattern, group, least) in enumerate(
        [
            ("assign", r"((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8),
            ("access", r"AKIA[A-Z0-9]+", 0, 16),
            ("hex", r"[0-9a-f]+", 0, 32),
        ]
    ):
        out += [(m.start(), order, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return ",".join(x for *_, x in sorted(out))


TEXTS = [
    None, "", "nothing", 'a TOKEN = "abcdefgh1" b', "paſsword=abcdefgh1", "Api_Key:short apikey:longenough1", "é\U0001f600 AKIAABCDEFGHIJKL token='AKIAAAAABBBBCCCC'",
    "x" + "0123456789abcdef" * 3, "AKIA123 AKIAAKIAAKIAAKIA", "secret" * 500 + "=" + "a" * 9, 'token = "' + "ab" * 16 + '"', "token=token=abcdefgh", "-----BEGIN RSA PRIVATE KEY-----",
]


def test_spans_are_the_contracts(spark):
    scanner = s.Scanner(s.RULES)
    for text in TEXTS:
        base = ",".join(f"{x['kind']}:{x['start']}:{x['end']}" for x in scanner.scan(text or "") if x["base"])
        assert base == brute(text), text


def test_each_blob_is_scanned_once_and_joined_to_all_paths(spark):
    rows = [(i, t, "x", "y", None) for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], None, None, None), (3, TEXTS[3], None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    scratch = Scratch(spark, "test")
    ledger = scratch.cut(s.update_ledger(docs), "ledger")
    assert ledger.count() == len({t or "" for t in TEXTS})
    plain = docs.select("doc_id", "text")
    found = s.join_back(plain, ledger, scratch).select("doc_id", "text", s.span_list(s.F.col("findings"), True).alias("b")).collect()
    assert len(found) == len(rows) and all(r.b == brute(r.text) for r in found)
    # a second run scans what is new, a new rule version all
    more = plain.union(spark.createDataFrame([(99, "token: 0123456789")], "doc_id long, text string"))
    assert s.update_ledger(more, ledger).count() == 1
    changed = (*s.RULES[:-1], replace(s.RULES[-1], version=9))
    again = scratch.cut(s.update_ledger(more, ledger, changed), "again")
    due = {r.blob_id: r.rules for r in again.collect()}
    assert len(due) == ledger.count() + 1 and sorted(len(x) for x in due.values()) == [1] * ledger.count() + [len(s.RULES)]
    both = ledger.union(again).union(ledger)  # pairs that stand there twice
    assert s.update_ledger(more, both, changed).count() == 0
    found = s.join_back(more, both, scratch, changed).select("text", s.span_list(s.F.col("findings"), True).alias("b")).collect()
    assert len(found) == len(rows) + 1 and all(r.b == brute(r.text) for r in found)
    assert s.update_ledger(plain.limit(0)).count() == 0


def test_redaction_masks_the_union_of_spans(spark):
    text = TEXTS[6] + " end"
    docs = spark.createDataFrame([(1, text), (2, "clean"), (3, None)], "doc_id long, text string")
    scratch = Scratch(spark, "redact")
    found = s.join_back(docs, scratch.cut(s.update_ledger(docs), "l"), scratch)
    out = {r.doc_id: r.t for r in found.select("doc_id", s.redact(s.F.col("text"), s.F.col("findings")).alias("t")).collect()}
    assert out[1] == "é\U0001f600 [secret] [secret]' end" and out[2] == "clean" and out[3] is None


def test_private_keys_are_masked_to_their_end():
    scanner = s.Scanner(s.RULES)

    def spans(text, kind):
        return [text[x["start"] : x["end"]] for x in scanner.scan(text) if x["kind"] == kind]

    body = "\n".join(["MIIEpAIBAAKCAQEA+/" + "aB3" * 15] * 4 + ["c2hvcnQ="])
    for kind in ("RSA ", ""):
        begin, end = f"-----BEGIN {kind}PRIVATE KEY-----", f"-----END {kind}PRIVATE KEY-----"
        for fields in ("\n", "\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0A1B\n\n"):
            for form in (str, lambda x: x.replace("\n", "\r\n"), lambda x: x.replace("\n", "\\n")):
                whole, cut = form(begin + fields + body + "\n" + end), form(begin + fields + body)
                assert spans(f"a {whole} b", "private_key") == [whole]
                assert spans(f"a {cut}", "private_key") == [cut]
                assert spans(f"a {cut}" + form("\n\nThe next paragraph.\n"), "private_key") == [cut]
                assert spans(f"{whole}\n{cut}\n{whole}", "private_key") == [whole, cut, whole]
        flat = begin + " " + body.split("\n")[0]
        assert spans(flat + " and so on", "private_key") == [flat]
        assert spans(f"a {begin} in a sentence", "private_key") == [begin]
    many = begin + "\n" + "-" * 50_000 + begin * 2000
    assert len(spans(many, "private_key")) == 2001


def test_url_logins_of_any_length():
    login = f"https://{'u' * 200}:{'p' * 300}@"
    assert [x["kind"] for x in s.Scanner(s.RULES).scan(f"at {login}host/x") if x["end"] - x["start"] == len(login)] == ["url_login"]


def test_clashing_columns_stay(spark):
    docs = spark.createDataFrame([(1, "token=abcdefgh1", "f", "i", "b")], "doc_id long, text string, findings string, _id string, _blob string")
    out = corpus_pipeline.mask_secrets(spark, docs.withColumn("n_chars", s.F.lit(1).cast("long")), "").collect()
    assert out[0].asDict() == {"doc_id": 1, "text": "[secret]", "findings": "f", "_id": "i", "_blob": "b", "n_chars": 8}


def test_very_long_text():
    text = "x" * 2_000_000 + " token=abcdefgh1 " + "0123456789abcdef" * 50_000
    found = s.Scanner(s.RULES).scan(text)
    assert [(x["kind"], x["end"] - x["start"]) for x in found] == [("assign", 15), ("hex", 800_000)]
