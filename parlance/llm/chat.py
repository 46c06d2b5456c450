"""Tool calls linked to their results, put in order, checked and written as canonical JSON.

Calls and results meet in a hash join on conversation and identifier. A call may name one
call that must come before it; its depth in that order is found by pointer doubling, so the
rounds grow with the logarithm of the longest chain, only rows whose depth is open are written
again, and no conversation is gathered in one task. Arguments are checked against the tool's schema, and each linked call becomes one line
of canonical JSON: sorted keys, no blanks, no escapes that JSON does not need.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.store import discard, pick, stored

#: Tools of the registered query, in the form that ``link_tool_calls`` takes.
SCHEMAS = {
    "answer": {"question": {"type": "string", "required": True}, "turn": {"type": "integer", "required": True}},
    "setup": {"prompt": {"type": "string", "required": True}},
}
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "object": dict, "array": list}
RESULT = "conv long, call_id string, turn long, depth long, name string, status string, message string"


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def violations(arguments, schema: dict) -> list[str]:
    """What is wrong with parsed arguments; empty when they fit the schema."""
    if not isinstance(arguments, dict):
        return ["arguments are no object"]
    wrong = [f"{k} is missing" for k, rule in schema.items() if rule.get("required") and k not in arguments]
    for key, value in arguments.items():
        rule = schema.get(key)
        if rule is None:
            wrong.append(f"{key} is unknown")
        elif isinstance(value, bool) and rule["type"] != "boolean" or not isinstance(value, TYPES[rule["type"]]):
            wrong.append(f"{key} is no {rule['type']}")
    return sorted(wrong)


def _refuse(name: str):
    raise ValueError(name)


def parsed(content: str | None):
    """Arguments as JSON that can be written again; anything else is a ``ValueError``.

    So are numbers beyond a double, characters that UTF-8 lacks and brackets nested too deep.
    """
    try:
        arguments = json.loads(content or "", parse_constant=_refuse)
        canonical(arguments).encode()
    except RecursionError:
        raise ValueError("nested too deep") from None
    return arguments


def _line(call_id, name, content, has_call, result, has_result, cyclic, aside, schemas) -> tuple[str, str]:
    """Status and message of one row; rows set aside keep their arguments as text."""
    shown = {"id": call_id}
    if has_result:
        shown["result"] = result
    if has_call:
        shown["name"] = name
    if aside:
        return aside, canonical(shown | ({"arguments": content} if has_call else {}))
    if not has_call:
        return "orphan_result", canonical(shown)
    try:
        arguments = parsed(content)
    except ValueError:
        return "invalid_json", canonical(shown | {"arguments": content})
    shown["arguments"] = arguments
    if name not in schemas:
        return "unknown_tool", canonical(shown)
    if violations(arguments, schemas[name]):
        return "invalid_arguments", canonical(shown)
    if cyclic:
        return "cycle", canonical(shown)
    return "ok" if has_result else "no_result", canonical(shown)


def _write(schemas: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = ["call_id", "name", "content", "has_call", "result", "has_result", "cyclic", "aside"]
            lines = [_line(*row, schemas) for row in zip(*(batch.column(c).to_pylist() for c in wanted))]
            kept = batch.select(["conv", "call_id", "turn", "depth", "name"])
            yield kept.append_column("status", pa.array([s for s, _ in lines], pa.string())).append_column(
                "message", pa.array([m for _, m in lines], pa.string())
            )

    return run


def depths(calls: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``(conv, call_id, depth, cyclic)`` of calls ``(conv, call_id, after)``, and what it reads.

    A call that waits for none, or for one that is not there, has depth 0. Calls in a cycle,
    or behind one, have no depth: as long as another call is open, a round closes one, so the
    rounds end with the first that closes none.
    """
    known = calls.select(F.col("conv").alias("_c"), F.col("call_id").alias("_i"))
    at = calls.join(known, (F.col("conv") == F.col("_c")) & (F.col("after") == F.col("_i")), "left")
    at = at.select("conv", "call_id", F.col("_i").alias("up"), F.col("_i").isNotNull().cast("long").alias("depth"))
    tables = [stored(at, "chat-order")]
    closed, open_ = [tables[0].where("up is null")], tables[0].where("up is not null")
    left, before = open_.count(), -1
    while left and left != before:
        over = reduce(DataFrame.unionByName, closed, open_)
        over = over.select(F.col("conv").alias("_c"), F.col("call_id").alias("_i"), F.col("up").alias("_up"), F.col("depth").alias("_d"))
        step = open_.join(over, (F.col("conv") == F.col("_c")) & (F.col("up") == F.col("_i")))
        tables.append(stored(step.select("conv", "call_id", F.col("_up").alias("up"), (F.col("depth") + F.col("_d")).alias("depth")), "chat-order"))
        closed.append(tables[-1].where("up is null"))
        open_ = tables[-1].where("up is not null")
        left, before = open_.count(), left
    done = reduce(DataFrame.unionByName, closed, open_)
    cyclic = F.col("up").isNotNull()
    return done.select("conv", "call_id", F.when(~cyclic, F.col("depth")).alias("depth"), cyclic.alias("cyclic")), tables


def _one_each(rows: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """The least row of every conversation and identifier, and the others with why they stay aside.

    Equal rows are one.
    """
    rows = rows.distinct().withColumn("_s", F.struct(*order))
    usable = F.col("conv").isNotNull() & F.col("call_id").isNotNull()
    least = rows.where(usable).groupBy("conv", "call_id").agg(F.min("_s").alias("_s"))
    chosen = least.select("conv", "call_id", "_s.*")
    over = least.select(F.col("conv").alias("_c"), F.col("call_id").alias("_i"), F.col("_s").alias("_l"))
    later = rows.where(usable).join(over, (F.col("conv") == F.col("_c")) & (F.col("call_id") == F.col("_i")))
    later = later.where(~F.col("_s").eqNullSafe(F.col("_l"))).withColumn("aside", F.lit("superseded"))
    aside = later.drop("_c", "_i", "_l").unionByName(rows.where(~usable).withColumn("aside", F.lit("unlinked")))
    return chosen, aside.drop("_s")


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: dict = SCHEMAS) -> DataFrame:
    """One row per call, and per result without a call, in topological order.

    ``calls`` has ``conv_id, call_id, turn, name, arguments, after``; ``results`` has ``conv_id,
    call_id, turn, content``. Returns ``conv_id``, ``call_id``, ``turn``, ``depth`` (calls that
    come before it), ``name``, ``status`` and ``message`` (canonical JSON), sorted by
    conversation, depth, turn and identifier.

    ``status`` is ok, no_result, orphan_result, unknown_tool, invalid_json, invalid_arguments
    or cycle, the first that applies from the arguments on. Of calls, or results, with equal
    identifiers in a conversation the one with the least turn counts (nulls first), then the
    least text; the others come back as superseded, without a depth. Rows without a
    conversation or identifier come back as unlinked. ``turn`` is the call's, or the result's
    where there is no call. Equal rows are one. A null text is
    invalid JSON for a call and null for a result. Other columns are ignored.
    """
    left = pick(calls, conv="conv_id", call_id="call_id", turn="turn", name="name", content="arguments", after="after")
    right = pick(results, conv="conv_id", call_id="call_id", turn="turn", content="content")
    typed = lambda df: df.withColumns({"conv": F.col("conv").cast("long"), "turn": F.col("turn").cast("long")})
    one, left_aside = _one_each(typed(left), ["turn", "content", "name", "after"])
    one = stored(one, "chat-calls")
    back, right_aside = _one_each(typed(right), ["turn", "content"])
    back = back.select("conv", "call_id", F.col("turn").alias("_turn"), F.col("content").alias("result"), F.lit(True).alias("_r"))
    ranked, tables = depths(one.select("conv", "call_id", "after"))
    ordered = one.join(ranked, ["conv", "call_id"]).withColumn("_h", F.lit(True))
    both = ordered.join(back.hint("shuffle_hash"), ["conv", "call_id"], "full")
    rows = both.select(
        "conv", "call_id", F.when(F.col("_h"), F.col("turn")).otherwise(F.col("_turn")).alias("turn"), "depth", "name", "content",
        F.coalesce("_h", F.lit(False)).alias("has_call"), "result", F.coalesce("_r", F.lit(False)).alias("has_result"),
        F.coalesce("cyclic", F.lit(False)).alias("cyclic"), F.lit(None).cast("string").alias("aside"),
    )
    none = lambda kind: F.lit(None).cast(kind)
    calls_aside = left_aside.select(
        "conv", "call_id", "turn", none("long").alias("depth"), "name", "content", F.lit(True).alias("has_call"),
        none("string").alias("result"), F.lit(False).alias("has_result"), F.lit(False).alias("cyclic"), "aside",
    )
    results_aside = right_aside.select(
        "conv", "call_id", "turn", none("long").alias("depth"), none("string").alias("name"), none("string").alias("content"),
        F.lit(False).alias("has_call"), F.col("content").alias("result"), F.lit(True).alias("has_result"), F.lit(False).alias("cyclic"), "aside",
    )
    every = rows.unionByName(calls_aside).unionByName(results_aside)
    lines = stored(every.mapInArrow(_write(schemas), RESULT), "chat-lines")
    discard(one, *tables)
    return lines.withColumnRenamed("conv", "conv_id").orderBy("conv_id", F.col("depth").asc_nulls_last(), "turn", "call_id")


def calls_of_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results that turns ``(conv_id, turn, role, text)`` stand for.

    A user's turn calls ``answer``, a system turn ``setup``; each waits for the call two turns
    before. An assistant's turn is the result of the turn before it.
    """
    rows = pick(turns, conv_id="conv_id", turn="turn", role="role", text="text")
    key = lambda back: F.concat_ws("-", F.lit("call"), F.col("conv_id"), (F.col("turn") - back).cast("string"))
    name = F.when(F.col("role") == "user", F.lit("answer")).when(F.col("role") == "system", F.lit("setup"))
    user = F.to_json(F.struct(F.col("text").alias("question"), "turn"))
    system = F.to_json(F.struct(F.col("text").alias("prompt")))
    calls = rows.withColumn("name", name).where("name is not null").select(
        "conv_id", key(0).alias("call_id"), "turn", "name",
        F.when(F.col("name") == "answer", user).otherwise(system).alias("arguments"), key(2).alias("after"),
    )
    results = rows.where("role = 'assistant'").select("conv_id", key(1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
