"""Operator 8: tool calls linked to their results, ordered, validated and serialised, in SQL alone.

Events are calls, results and plain messages of conversations. Calls and results meet in a hash
join on (conversation, identifier); both sides are first aggregated to one row for each identifier, so
identifiers that repeat can't multiply rows. Edges (a result after its call, a call after the call it depends on)
are checked against the order of turns: where every edge goes forward, turns are a
topological order, found without gathering any conversation. Only conversations with
an edge that doesn't are ordered by levels, a round of joins for each level; events on a cycle get none.
Arguments are validated against a schema for each tool, and every event is serialised as canonical JSON:
keys sorted, no spaces, nulls left out.

status of a call: ok, unanswered, duplicate (its identifier is called more than once),
no_id; of a result: ok, orphan, duplicate (more than one result), early (before its call), no_id; of a message: ok.
Null texts count as empty, null conversations as one of their own, null turns come first. Tied or repeated rows
stay rows. An empty table gives no rows. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.session import Scratch

#: tool: field: (type, required). Types are JSON's.
Schemas = Mapping[str, Mapping[str, tuple[str, bool]]]

#: What a variant's schema starts with, by JSON type.
STARTS = {"string": ("STRING",), "integer": ("BIGINT",), "number": ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "boolean": ("BOOLEAN",), "array": ("ARRAY",), "object": ("OBJECT",)}

TURN_SCHEMAS: Schemas = {"respond": {"role": ("string", True), "text": ("string", True), "turn": ("integer", False)}}

EVENTS = ("conv_id", "turn", "kind", "call_id", "name", "arguments", "depends_on", "content")


def events_of(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) to events.

    A text that is a JSON object with `tool_call` {id, name, arguments, depends_on} is a
    call, one with `tool_call_id` and `content` a result. Of other turns, one that is not the
    assistant's is a call of the tool `respond` with the turn as arguments, which depends on
    the turn two before; an assistant's turn after the first is the result of the call of the turn before it.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    looks = F.ltrim(text).startswith("{")
    tree = F.when(looks, F.try_parse_json(text))
    said = conversations.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"), tree.alias("tree"))

    def get(path: str) -> Column:
        return F.try_variant_get("tree", path, "string")

    real_call, real_result = F.coalesce(get("$.tool_call.name").isNotNull(), F.lit(False)), F.coalesce(get("$.tool_call_id").isNotNull(), F.lit(False))
    own = F.concat(F.lit("t"), F.col("turn").cast("string"))
    before = F.concat(F.lit("t"), (F.col("turn") - 1).cast("string"))
    earlier = F.when(F.col("turn") >= 2, F.concat(F.lit("t"), (F.col("turn") - 2).cast("string")))
    answer = F.col("role") == "assistant"
    kind = F.when(real_call, "call").when(real_result, "result").when(answer & (F.col("turn") >= 1), "result").when(answer, "message").otherwise("call")
    turn = F.to_json(F.struct("role", "text", "turn"))
    return said.select(
        "conv_id",
        "turn",
        kind.alias("kind"),
        F.when(real_call, get("$.tool_call.id")).when(real_result, get("$.tool_call_id")).when(kind == "result", before).when(kind == "call", own).alias("call_id"),
        F.when(real_call, get("$.tool_call.name")).when(kind == "call", F.lit("respond")).alias("name"),
        F.when(real_call, F.to_json(F.try_variant_get("tree", "$.tool_call.arguments", "variant"))).when(kind == "call", turn).alias("arguments"),
        F.when(real_call, get("$.tool_call.depends_on")).when(kind == "call", earlier).alias("depends_on"),
        F.when(real_result, get("$.content")).when(kind != "call", F.col("text")).alias("content"),
    )


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted error strings of a call's arguments; an empty array if they fit the schema."""
    tree = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(tree).startswith("OBJECT"), F.lit(False))
    none = F.array().cast("array<string>")
    errors = F.array(F.lit("unknown tool"))
    for tool, fields in schemas.items():
        found = []
        for field, (kind, required) in fields.items():
            value = F.schema_of_variant(F.try_variant_get(tree, f"$.{field}", "variant"))
            fits = F.lit(False)
            for start in STARTS[kind]:
                fits = fits | value.startswith(start)
            lacking = F.lit(f"missing {field}") if required else F.lit(None).cast("string")
            found.append(F.when(value.isNull(), lacking).when(~fits, F.lit(f"{field} is no {kind}")))
        extra = F.transform(F.array_except(F.coalesce(F.json_object_keys(arguments), none), F.array(*[F.lit(f) for f in fields])), lambda k: F.concat(F.lit("unknown "), k))
        whole = F.array_sort(F.concat(F.filter(F.array(*found), lambda e: e.isNotNull()), extra))
        errors = F.when(name == tool, F.when(is_object, whole).otherwise(F.array(F.lit("arguments are no object")))).otherwise(errors)
    return errors


def link(events: DataFrame, schemas: Schemas) -> DataFrame:
    """A row per event: conv_id, turn, kind, call_id, status, place, errors, json.

    `place` orders a conversation: events by ascending place, then kind (calls before results)
    and turn, are in topological order. It is null for events on or behind a cycle.
    """
    scratch = Scratch(events.sparkSession, "calls")
    order = F.coalesce(F.col("turn"), F.lit(-1).cast("long"))
    base = events.select(*EVENTS).withColumn("conv", F.coalesce(F.col("conv_id").cast("string"), F.lit("\x00")))
    plain = base.where("kind = 'message' or call_id is null")
    tied = base.where("kind <> 'message' and call_id is not null")
    is_call = F.col("kind") == "call"
    ids = tied.groupBy("conv", "call_id").agg(
        F.count_if(is_call).alias("calls"),
        F.count_if(~is_call).alias("results"),
        F.min(F.when(is_call, order)).alias("call_turn"),
        F.min(F.when(~is_call, order)).alias("result_turn"),
        F.min(F.when(is_call, F.col("depends_on"))).alias("needs"),
    )
    ids = scratch.cut(ids, "ids")
    needed = ids.select("conv", F.col("call_id").alias("depends_on"), F.col("call_turn").alias("needed_turn"), (F.col("calls") > 0).alias("exists"))
    joined = tied.join(ids.drop("needs"), ["conv", "call_id"]).join(needed, ["conv", "depends_on"], "left")

    # conversations in which some edge goes back: by identifiers, a row each
    early = F.coalesce(F.col("result_turn") < F.col("call_turn"), F.lit(False))
    late = F.coalesce(F.col("exists") & (F.col("needed_turn") >= F.col("call_turn")), F.lit(False))
    edges = ids.join(needed.withColumnRenamed("depends_on", "needs"), ["conv", "needs"], "left").select("conv", "call_id", "needs", "calls", "exists", (early | late).alias("back"))
    bad = scratch.cut(edges.where("back").select("conv").distinct(), "bad")
    levels = None
    if bad.limit(1).count():
        todo = edges.join(bad, "conv", "left_semi").select("conv", "call_id", F.when(F.col("exists"), F.col("needs")).alias("needs"))
        # a call depends on one other, so its level is the length of a chain: pointers double their reach each round
        most = todo.groupBy("conv").count().agg(F.max("count")).first()[0]
        state = scratch.cut(todo.select("conv", "call_id", F.col("needs").alias("ptr"), F.col("needs").isNotNull().cast("long").alias("level")), "reach0")
        for step in range(1, most.bit_length() + 1):
            if not state.where("ptr is not null").limit(1).count():
                break
            target = state.select("conv", F.col("call_id").alias("ptr"), F.col("ptr").alias("next"), F.col("level").alias("more"))
            farther = state.join(target, ["conv", "ptr"], "left").select("conv", "call_id", F.col("next").alias("ptr"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"))
            state = scratch.cut(farther, f"reach{step}")
            scratch.drop(f"reach{step - 1}")
        levels = state.where("ptr is null").select("conv", "call_id", "level")  # the rest is on or behind a cycle
    joined = joined.join(bad.withColumn("broken", F.lit(True)), "conv", "left")
    if levels is None:
        joined = joined.withColumn("level", F.lit(None).cast("long"))
    else:
        joined = joined.join(levels, ["conv", "call_id"], "left")
    status = F.when(
        is_call, F.when(F.col("calls") > 1, "duplicate").when(F.col("results") == 0, "unanswered").otherwise("ok")
    ).otherwise(F.when(F.col("calls") == 0, "orphan").when(F.col("results") > 1, "duplicate").when(order < F.col("call_turn"), "early").otherwise("ok"))
    placed = joined.select(*EVENTS, status.alias("status"), F.when(F.col("broken"), F.col("level")).otherwise(order).alias("place"), F.when(is_call, F.col("result_turn")).otherwise(F.col("call_turn")).alias("other_turn"))
    alone = plain.select(*EVENTS, F.when(F.col("kind") == "message", "ok").otherwise("no_id").alias("status"), order.alias("place"), F.lit(None).cast("long").alias("other_turn"))
    every = placed.union(alone)
    errors = F.when(F.col("kind") == "call", argument_errors(F.col("name"), F.col("arguments"), schemas)).otherwise(F.array().cast("array<string>"))
    call = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), "depends_on", F.col("call_id").alias("id"), "name", F.col("other_turn").alias("result_turn"), "turn", F.col("kind").alias("type")))
    result = F.to_json(F.struct(F.col("other_turn").alias("call_turn"), "content", F.col("call_id").alias("id"), "turn", F.col("kind").alias("type")))
    message = F.to_json(F.struct("content", "turn", F.col("kind").alias("type")))
    return every.select(
        "conv_id", "turn", "kind", "call_id", "status", "place", F.array_join(errors, "; ").alias("errors"),
        F.when(F.col("kind") == "call", call).when(F.col("kind") == "result", result).otherwise(message).alias("json"),
    )
