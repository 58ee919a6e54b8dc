"""Tool calls of conversations: linked to their results, ordered, validated, and written as canonical JSON.

Calls and results meet in a hash join by (conversation, identifier). A call may follow several other calls; levels
come from pointer doubling over chains and waves over the calls where chains meet, so a chain of n calls takes
log2(n) rounds, and the order is a distributed sort. Arguments are parsed to variants and held against compiled schemas. DataFrame functions only.
No step gathers a conversation: every linked result is a row of its own.
"""

from __future__ import annotations

import math
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeframe.llm.common import cut
from lodeframe.llm.sharding import ranked

#: What schema_of_variant says of values of each JSON type.
_KINDS = {"string": r"^STRING$", "integer": r"^BIGINT$", "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": r"^BOOLEAN$", "object": r"^OBJECT.*$", "array": r"^ARRAY.*$", "null": r"^VOID$"}


def _property(parsed: Column, name: str) -> Column:
    quoted = name.replace("\\", "\\\\").replace("'", "\\'")
    return F.try_variant_get(parsed, f"$['{quoted}']", "variant")


def schema_errors(parsed: Column, schema: Mapping[str, Any]) -> Column:
    """array<string>: what of a parsed JSON object breaks the schema.

    Of JSON Schema: required, and for properties type, enum (of strings), minimum, maximum, minLength, maxLength.
    """
    checks = [F.when(~F.coalesce(F.schema_of_variant(parsed).rlike(_KINDS["object"]), F.lit(False)), F.lit("arguments: not an object"))]
    for name in schema.get("required", ()):
        checks.append(F.when(_property(parsed, name).isNull(), F.lit(f"{name}: missing")))
    for name, rule in schema.get("properties", {}).items():
        value = _property(parsed, name)
        there = value.isNotNull()
        text, number = F.try_variant_get(value, "$", "string"), F.try_variant_get(value, "$", "double")
        if "type" in rule:
            checks.append(F.when(there & ~F.schema_of_variant(value).rlike(_KINDS[rule["type"]]), F.lit(f"{name}: not of type {rule['type']}")))
        if "enum" in rule:
            checks.append(F.when(there & ~F.coalesce(text.isin(*rule["enum"]), F.lit(False)), F.lit(f"{name}: not in enum")))
        for key, size, broken in (("minimum", number, lambda a, b: a < b), ("maximum", number, lambda a, b: a > b), ("minLength", F.length(text), lambda a, b: a < b), ("maxLength", F.length(text), lambda a, b: a > b)):
            if key in rule:
                checks.append(F.when(there & F.coalesce(broken(size, F.lit(rule[key])), F.lit(False)), F.lit(f"{name}: {key} {rule[key]}")))
    return F.array_compact(F.array(*checks))


def validate(name: Column, arguments: Column, schemas: Mapping[str, Mapping[str, Any]]) -> Column:
    """array<string> of errors of JSON arguments of a named tool; unknown tools and broken JSON are errors."""
    parsed = F.try_parse_json(arguments)
    found = F.array(F.lit("name: unknown tool"))
    for tool, schema in schemas.items():
        found = F.when(name == tool, schema_errors(parsed, schema)).otherwise(found)
    return F.when(parsed.isNull(), F.array(F.lit("arguments: not JSON"))).otherwise(found)


def _by_key(left: DataFrame, right: DataFrame, key: str, other: str) -> DataFrame:
    """left joined with right, whose conversation is _c, where left's key is right's other."""
    return left.join(right, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col(key) == F.col(other)))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level): the longest way to a call along the calls it follows; null on or behind a cycle.

    calls: (conv_id, call_id, parents), ids unique within a conversation, parents an array of ids. Parents that are
    not among the calls, nulls and repeats do not count; a null array is an empty one. Calls with one parent are
    doubled up to the nearest call with none or several (log2 of the longest chain rounds); calls with several are then
    settled in waves, as many rounds as they stand behind one another. No calls: an empty result.
    """
    ids = calls.select("conv_id", "call_id")
    known = ids.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_p"))
    asked = calls.select("conv_id", "call_id", F.explode(F.array_distinct("parents")).alias("parent"))
    edges = cut(_by_key(asked, known, "parent", "_p").select("conv_id", "call_id", "parent"), "edges")
    counted = edges.groupBy(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i")).agg(F.count("*").alias("n"), F.min("parent").alias("one"))
    linked = ids.join(counted, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("call_id") == F.col("_i")), "left")
    up, joint = F.when(F.col("n") == 1, F.col("one")), F.coalesce(F.col("n") > 1, F.lit(False))
    now = cut(linked.select("conv_id", "call_id", up.alias("up"), F.coalesce(up, "call_id").alias("top"), F.when(up.isNull(), 0).otherwise(1).cast("long").alias("level"), joint.alias("joint")), "levels")
    total = now.count()
    for _ in range(max(1, math.ceil(math.log2(max(total, 2)))) + 1):
        if not now.where("up is not null").limit(1).count():
            break
        ahead = now.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), F.col("up").alias("_up"), F.col("top").alias("_top"), F.col("level").alias("_level"))
        moved = _by_key(now.where("up is not null"), ahead, "up", "_i").select("conv_id", "call_id", F.col("_up").alias("up"), F.col("_top").alias("top"), (F.col("level") + F.col("_level")).alias("level"), "joint")
        now = cut(moved.unionAll(now.where("up is null")), "levels")
    if not now.where("joint").limit(1).count():
        return now.select("conv_id", "call_id", F.when(F.col("up").isNull(), F.col("level")).alias("level"))
    # what a call with several parents waits for: the tops of their chains (null behind a cycle), and how far off
    chain = now.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), F.when(F.col("up").isNull(), F.col("top")).alias("top"), (F.col("level") + 1).alias("far"))
    several = now.where("joint").select(F.col("conv_id").alias("_d"), F.col("call_id").alias("_j"))
    waits = edges.join(several, F.col("conv_id").eqNullSafe(F.col("_d")) & (F.col("call_id") == F.col("_j")), "left_semi")
    waits = cut(_by_key(waits, chain, "parent", "_i").groupBy("conv_id", "call_id", "top").agg(F.max("far").alias("far")), "waits")
    done = cut(now.where("up is null and not joint and top = call_id").select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), F.lit(0).cast("long").alias("_level")), "done")
    while True:
        met = waits.join(done, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("top") == F.col("_i")), "left")
        ready = met.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.count("_level").alias("found"), F.max(F.col("far") + F.col("_level")).alias("_level")).where("n = found")
        new = cut(ready.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), "_level"), "done")
        if not new.limit(1).count():
            break
        done = done.unionAll(new)
        settled = new.select(F.col("_c").alias("_d"), F.col("_i").alias("_j"))
        waits = cut(waits.join(settled, F.col("conv_id").eqNullSafe(F.col("_d")) & (F.col("call_id") == F.col("_j")), "left_anti"), "waits")
    closed = now.withColumn("top", F.when(F.col("up").isNull(), F.col("top")))
    out = closed.join(done, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("top") == F.col("_i")), "left")
    return out.select("conv_id", "call_id", (F.col("level") + F.col("_level")).alias("level"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: Mapping[str, Mapping[str, Any]], *, rows_per_part: int = 250_000) -> DataFrame:
    """One row for each result and for each call without one:
    (conv_id, position, call_id, name, level, status, valid, errors, json).

    calls: (conv_id, call_id, name, arguments, parent_id, turn), or with an array parent_ids in place of parent_id;
    results: (conv_id, call_id, content, turn). status is
    linked, no_result or no_call. position counts a conversation's rows from 0 in topological order: by level, then
    turn of the call, id, and turn of the result, so a call comes after every call it follows; rows without a level
    (no call, or a cycle, which is an error) come last. json has its keys sorted and no spaces: arguments, call_id,
    name, result; arguments that are not JSON stay there as the string they are. Calls that repeat an identifier count once, the first by turn; calls and results with null
    identifiers are not linked and keep their rows. Empty tables give an empty result; extra columns are not read.
    """
    parents = F.col("parent_ids") if "parent_ids" in calls.columns else F.array("parent_id")
    asked = calls.select("conv_id", "call_id", "name", "arguments", parents.alias("parents"), F.col("turn").cast("long").alias("turn"))
    named = asked.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "name", "arguments", "parents")).alias("_first"))
    named = cut(named.select("conv_id", "call_id", "_first.*"), "calls")
    depth = levels(named.select("conv_id", "call_id", "parents")).select(F.col("conv_id").alias("_c"), F.col("call_id").alias("_i"), "level")
    placed = named.join(depth, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("call_id") == F.col("_i"))).drop("_c", "_i")
    nameless = asked.where("call_id is null").withColumn("level", F.lit(0).cast("long"))
    every = placed.unionByName(nameless).withColumn("_call", F.lit(True))
    answered = results.select(F.col("conv_id").alias("r_conv"), F.col("call_id").alias("r_call"), F.col("content").alias("result"), F.col("turn").cast("long").alias("r_turn"), F.lit(True).alias("_result"))
    met = every.join(answered, (F.col("conv_id") == F.col("r_conv")) & (F.col("call_id") == F.col("r_call")), "full_outer")
    status = F.when(F.col("_call").isNull(), "no_call").when(F.col("_result").isNull(), "no_result").otherwise("linked")
    faults = F.when(F.col("_call").isNull(), F.array(F.lit("call: missing"))).otherwise(F.concat(validate(F.col("name"), F.col("arguments"), schemas), F.when(F.col("level").isNull(), F.array(F.lit("parent: cycle"))).otherwise(F.array().cast("array<string>"))))
    call_id = F.coalesce("call_id", "r_call")
    rows = met.select(F.coalesce("conv_id", "r_conv").alias("conv_id"), call_id.alias("call_id"), "name", "level", "turn", "r_turn", status.alias("status"), faults.alias("errors"),
        F.to_json(F.struct(F.coalesce(F.try_parse_json("arguments"), F.col("arguments").cast("variant")).alias("arguments"), call_id.alias("call_id"), F.col("name").alias("name"), F.col("result").alias("result")), {"ignoreNullFields": "false"}).alias("json"))
    rows = rows.withColumn("_last", F.col("level").isNull())
    total = calls.count() + results.count()
    order = ranked(rows, ["conv_id", "_last", "level", "turn", "call_id", "r_turn", "json"], "_rank", max(1, min(4096, -(-total // rows_per_part))))
    first = order.groupBy("conv_id").agg(F.min("_rank").alias("_from")).withColumnRenamed("conv_id", "_conv")
    out = order.join(first, F.col("conv_id").eqNullSafe(F.col("_conv")))
    return out.select("conv_id", (F.col("_rank") - F.col("_from")).alias("position"), "call_id", "name", "level", "status", (F.size("errors") == 0).alias("valid"), "errors", "json")


#: Turns as calls: a user's turn asks, a system turn instructs.
CHAT_SCHEMAS: dict[str, dict[str, Any]] = {
    tool: {"required": ["text", "turn"], "properties": {"text": {"type": "string", "minLength": 1}, "turn": {"type": "integer", "minimum": 0}}} for tool in ("ask", "instruct")
}


def chat_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations (conv_id, turn, role, text).

    User and system turns are calls named after conversation and turn, each following the call two turns before if
    there is one; an assistant's turn is the result of the call of the turn before. Other roles are calls of unknown
    tools.
    """
    named = lambda turn: F.concat_ws(":", F.col("conv_id").cast("string"), turn.cast("string"))
    answer = F.coalesce(F.col("role") == "assistant", F.lit(False))
    tool = F.when(F.col("role") == "user", "ask").when(F.col("role") == "system", "instruct").otherwise(F.col("role"))
    arguments = F.to_json(F.struct("text", "turn"))
    calls = messages.where(~answer).select("conv_id", F.when(F.col("turn").isNotNull(), named(F.col("turn"))).alias("call_id"), tool.alias("name"), arguments.alias("arguments"), F.when(F.col("turn") >= 2, named(F.col("turn") - 2)).alias("parent_id"), "turn")
    results = messages.where(answer).select("conv_id", F.when(F.col("turn").isNotNull(), named(F.col("turn") - 1)).alias("call_id"), F.col("text").alias("content"), "turn")
    return calls, results
