"""Operator 1: secret scans with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its text. A ledger row tells which
rules, each with its own version, have scanned a blob in one pass, with what they found; only
(blob, rule version) pairs it lacks are scanned, each blob once however many paths share it, and
findings are joined back to all paths. Spans count code points, the end exclusive.

Null texts count as empty. Repeated rows and equal texts share one blob; a ledger may hold a pair
twice. An empty table gives empty results. Only the text is read, and working columns get names
that no other has, so other columns can't clash.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.llm import common
from glossa.session import Scratch, broadcast_if_small


@dataclass(frozen=True)
class Rule:
    """A pattern whose leftmost, non-overlapping matches count if `group` has `least` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    base: bool = False
    #: A change of what a rule finds must change this: the ledger then scans every blob for that rule again.
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: What follows a private key's first line: all to its END line if that comes before another
#: BEGIN or END, else header fields and lines (or long runs) of base64 alone. Line breaks may be escaped.
_BREAK = r"(?:[^\S\n]|\\r)*+(?:\n|\\n)(?:[^\S\n]|\\r)*+"
_TO_END = r"[^-]*+(?:-(?!----(?:BEGIN|END)\x20)[^-]*+)*+-----END\x20[A-Z ]*PRIVATE\x20KEY-----"
_FIELDS = rf"(?:{_BREAK}(?:Proc-Type|DEK-Info):[^\n\\]*+)*+(?:{_BREAK}(?={_BREAK}))*+"
_LINES = rf"(?:\s++[A-Za-z0-9+/]{{40,}}+=*+|{_BREAK}[A-Za-z0-9+/]++=*+(?=[^\S\n]*+(?:\n|\\[rn]|\Z)))*+"

#: The first three kinds and their patterns are given by the contract.
RULES = (
    Rule("assign", r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8, True),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 0, 16, True),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32, True),
    Rule("private_key", rf"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:{_TO_END}|{_FIELDS}{_LINES})", version=2),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s/:@]++:[^\s/@]++@", version=2),
)
#: Findings are broadcast up to so many blobs, joined by shuffle beyond.
BROADCAST_ROWS = 100_000

FINDINGS = "array<struct<kind:string,start:int,end:int,base:boolean>>"


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern)) for r in rules]

    def scan(self, text: str, keys: set[str] | None = None) -> list[dict]:
        """Findings by start, ties in the rules' order; of the rules named by `keys` alone, if given."""
        found = []
        for order, (rule, pattern) in enumerate(self.rules):
            if keys is not None and rule.key not in keys:
                continue
            if rule.kind == "url_login" and "://" not in text:
                continue
            for m in pattern.finditer(text):
                if len(m[rule.group]) >= rule.least:
                    found.append((m.start(), order, {"kind": rule.kind, "start": m.start(), "end": m.end(), "base": rule.base}))
        return [x for *_, x in sorted(found, key=lambda x: x[:2])]


def blob_id(text) -> F.Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob_id, text, rules: the keys that are due) to ledger rows (blob_id, rules, findings)."""
    common.bounded_batches(blobs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())]))
        for batch in batches:
            due = batch.column(2).to_pylist()
            found = [scanner.scan(t, None if len(d) == len(rules) else set(d)) for t, d in zip(common.texts(batch.column(1)), due)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, kind)], ["blob_id", "rules", "findings"])

    return common.arrow_pass(blobs.select("blob_id", F.col("text").cast("string"), "rules"), run, f"blob_id string, rules array<string>, findings {FINDINGS}")


def unseen_blobs(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text") -> DataFrame:
    """(blob_id, text, rules) of each distinct blob for which the ledger lacks some rules, and those."""
    blobs = versions.select(F.coalesce(versions[text_col].cast("string"), F.lit("")).alias("text")).select(blob_id(F.col("text")).alias("blob_id"), "text")
    all_keys = F.array(*[F.lit(r.key) for r in rules])
    if ledger is None:
        return blobs.dropDuplicates(["blob_id"]).withColumn("rules", all_keys)
    # by kind the ledger has few rows a blob: keys meet first, texts once
    seen = ledger.groupBy("blob_id").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("seen"))
    met = blobs.join(seen, "blob_id", "left").withColumn("rules", F.array_except(all_keys, F.coalesce("seen", F.array().cast("array<string>"))))
    return met.where(F.size("rules") > 0).select("blob_id", "text", "rules").dropDuplicates(["blob_id"])


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text") -> DataFrame:
    """The ledger's new rows: blobs of `versions`, scanned for the rules that it lacks."""
    return scan_blobs(unseen_blobs(versions, ledger, rules, text_col=text_col), rules)


def join_back(versions: DataFrame, ledger: DataFrame, scratch: Scratch, rules: tuple[Rule, ...] = RULES, *, text_col: str = "text", into: str = "findings") -> DataFrame:
    """`versions` with a column `into` of findings (empty where there are none), which replaces one of that name; text still at hand.

    Only blobs with findings travel; they are broadcast while few. Findings of a rule's other versions don't count.
    """
    order = {r.kind: k for k, r in enumerate(rules)}
    place = F.create_map(*[F.lit(v) for kind, k in order.items() for v in (kind, k)])
    hits = ledger.where(F.size("findings") > 0)
    # a kind counts where the pass that found it ran its present version
    ran = F.col("rules")
    current = F.filter("findings", lambda x: F.array_contains(ran, F.element_at(F.create_map(*[F.lit(v) for r in rules for v in (r.kind, r.key)]), x["kind"])))
    spans = hits.select("blob_id", F.explode(current).alias("x")).distinct()
    key, blob = f"_id_{uuid.uuid4().hex}", f"_blob_{uuid.uuid4().hex}"
    sorted_ = F.transform(F.array_sort(F.collect_list(F.struct(F.col("x.start").alias("s"), place[F.col("x.kind")].alias("k"), F.col("x.end").alias("e"), F.col("x").alias("x")))), lambda y: y["x"])
    hits = scratch.cut(spans.groupBy("blob_id").agg(sorted_.alias("found")), "hits").select(F.col("blob_id").alias(blob), F.col("found").alias(f"{blob}_x"))
    hits = broadcast_if_small(hits, BROADCAST_ROWS)
    taken = versions.withColumn(key, blob_id(versions[text_col]))
    empty = F.array().cast(FINDINGS)
    return taken.join(hits, F.col(key) == F.col(blob), "left").withColumn(into, F.coalesce(f"{blob}_x", empty)).drop(key, blob, f"{blob}_x")


def span_list(findings, only_base: bool):
    """kind:start:end of the findings, comma-joined."""
    some = F.filter(findings, lambda x: x["base"]) if only_base else findings
    return F.array_join(F.transform(some, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(text, findings, mask: str = "[secret]"):
    """`text` with the union of the spans replaced by `mask`, as a column."""
    merged = F.aggregate(
        findings,
        F.array().cast("array<struct<start:int,end:int>>"),
        lambda acc, x: F.when(
            (F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]),
            F.concat(
                F.slice(acc, 1, F.size(acc) - 1),
                F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))),
            ),
        ).otherwise(F.concat(acc, F.array(F.struct(x["start"].alias("start"), x["end"].alias("end"))))),
    )
    built = F.aggregate(
        merged,
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, x: F.struct(F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mask)).alias("out"), x["end"].alias("at")),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    return F.when(F.size(findings) > 0, built).otherwise(text)
