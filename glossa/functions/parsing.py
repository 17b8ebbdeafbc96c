"""Checks of outputs that follow a contract: key-value lines, strict JSON, tool decisions."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The lines of a review, in order, and the values that two of them may have.
KEYS = ("STATUS", "CATEGORY", "ORIGINAL", "REPLACEMENT", "REASON", "GLOSSARY_ID")
STATUSES = ("suggestion", "no_suggestion", "needs_review")
CATEGORIES = ("spelling", "grammar", "terminology", "clarity", "consistency")
REASON_LENGTH = 240

REASONING = r"(?i)</?think>|<\|[a-z_]+\|>|^\s*(reasoning|thought):"


def review_error(output: Column) -> Column:
    """Why an output is no review, null if it is one. The order of the checks matters."""
    text = F.trim(F.regexp_replace(output, "\r\n?", "\n"))
    lines = F.split(text, "\n", -1)
    keys = F.transform(lines, lambda x: F.substring_index(x, ":", 1))
    values = F.transform(lines, lambda x: F.trim(F.substring(x, F.locate(":", x) + 1, F.length(x))))
    odd = F.exists(F.zip_with(keys, F.array(*map(F.lit, KEYS)), lambda a, b: a != b), lambda x: x)
    return (
        F.when(output.isNull(), "empty")
        .when(text.rlike(REASONING), "reasoning")
        .when(text.contains("```"), "code-fence")
        .when(F.size(lines) != len(KEYS), "line-count")
        .when(F.exists(lines, lambda x: ~x.contains(":")), "malformed-line")
        .when(odd | F.exists(values, lambda v: v == ""), "unexpected-key")
        .when(~F.get(values, 0).isin(*STATUSES) | ~F.get(values, 1).isin(*CATEGORIES), "invalid-value")
        .when(F.length(F.get(values, 4)) > REASON_LENGTH, "reason-too-long")
    )


def review_fields(output: Column) -> Column:
    """The values of a valid review by key in lower case; `-` means none."""
    lines = F.split(F.trim(F.regexp_replace(output, "\r\n?", "\n")), "\n", -1)

    def value(i: int) -> Column:
        line = F.get(lines, i)
        return F.nullif(F.trim(F.substring(line, F.locate(":", line) + 1, F.length(line))), F.lit("-"))

    return F.when(review_error(output).isNull(), F.struct(*[value(i).alias(k.lower()) for i, k in enumerate(KEYS)]))


def redacted(text: Column) -> Column:
    return F.when(text.rlike(REASONING), "[redacted]").otherwise(text)


def grounded(reason: Column, source: Column) -> Column:
    """Whether everything a reason quotes stands in the source."""
    return F.forall(F.regexp_extract_all(reason, F.lit('"([^"]+)"'), F.lit(1)), lambda q: source.contains(q))


def decision_error(calls: Column, visible: Column, tool: str, wanted_id: Column, decisions: tuple[str, ...]) -> Column:
    """The contract of a tool decision. `calls`: array<struct<name, args map<string,string>>>.

    Visible text, no call, more than one, another tool, keys not exactly id and decision, a blank or
    multi-line value, another id, an unknown decision: the first that holds.
    """
    args = F.get(calls, 0)["args"]
    keys = F.array_sort(F.map_keys(args))
    return (
        F.when(F.trim(F.coalesce(visible, F.lit(""))) != "", "visible-text")
        .when(F.size(calls) == 0, "no-call")
        .when(F.size(calls) > 1, "many-calls")
        .when(F.get(calls, 0)["name"] != tool, "wrong-tool")
        .when(keys != F.array(F.lit("decision"), F.lit("id")), "keys")
        .when(F.exists(F.map_values(args), lambda v: (F.trim(v) == "") | v.rlike(r"[\n\r]")), "value")
        .when(F.try_element_at(args, F.lit("id")) != wanted_id, "id")
        .when(~F.try_element_at(args, F.lit("decision")).isin(*decisions), "decision")
    )


def strict_json(rows: DataFrame, id_col: str, text_col: str, most_bytes: int = 128 * 1024) -> DataFrame:
    """(id, canonical, error) of JSON objects; too large, malformed, no object, and repeated keys are errors.

    SQL parsers can't see a repeated key, so this is an Arrow pass.
    """

    def parse(text: str | None) -> tuple[str | None, str | None]:
        repeated: list[str] = []

        def pairs(items):
            names = [k for k, _ in items]
            repeated.extend(k for k in set(names) if names.count(k) > 1)
            return dict(items)

        if text is None or len(text.encode()) > most_bytes:
            return None, "empty" if text is None else "too-large"
        try:
            value = json.loads(text, object_pairs_hook=pairs)
        except (ValueError, RecursionError):
            return None, "malformed"
        if not isinstance(value, dict):
            return None, "no-object"
        return (None, f"repeated {min(repeated)}") if repeated else (json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False), None)

    def run(batches):
        for batch in batches:
            found = [parse(x) for x in batch["text"]]
            yield pd.DataFrame({id_col: batch[id_col], "canonical": [c for c, _ in found], "error": [e for _, e in found]})

    kind = rows.schema[id_col].dataType.simpleString()
    return rows.select(id_col, F.col(text_col).alias("text")).mapInPandas(run, f"{id_col} {kind}, canonical string, error string")
