"""Tool-call linking: calls and results by identifier, in topological order, as canonical JSON."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

#: A call is a JSON object {"id", "name", "arguments"} between call marks, a result is
#: {"id", "content"} between result marks.
BLOCK = re.compile(r"<tool_(call|result)>(.*?)</tool_\1>", re.S)
#: A string argument "$id" stands for the result of an earlier call.
REFERENCE = re.compile(r"\$([A-Za-z0-9_.-]+)\Z")
#: References of a conversation that are settled in one pass.
LIMIT = 100_000
TYPES = {"string": str, "integer": int, "number": (int, float), "boolean": bool, "array": list, "object": dict, "null": type(None)}

ITEMS = "conv_id long, turn long, part int, kind string, call_id string, name string, arguments string, needs array<string>, canonical string, problem string"


#: Levels that a block's JSON may have, its object included; deeper blocks are malformed.
DEEP = 100
_LONE = re.compile("[\ud800-\udfff]")


def _refuse(text: str):
    raise ValueError(text)


def _number(text: str) -> float:
    value = float(text)
    return value if math.isfinite(value) else _refuse(text)


def read_block(text: str):
    """The value of a block.  ValueError for what is no JSON (NaN and numbers beyond a double
    are none) and for more than DEEP levels."""
    try:
        value = json.loads(text, parse_constant=_refuse, parse_float=_number)
    except RecursionError as deep:
        raise ValueError("too deep") from deep
    front = [value]
    for _ in range(DEEP):
        front = [y for x in front if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]
        if not front:
            return value
    return _refuse("too deep")


def canonical(value) -> str:
    """JSON with sorted keys, no spaces and non-ASCII characters as they are; a half of a surrogate
    pair, which no text can hold, is U+FFFD."""
    return _LONE.sub("\ufffd", json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False))


def plain(value) -> str:
    return _LONE.sub("\ufffd", str(value))


def references(value) -> set[str]:
    if isinstance(value, str):
        m = REFERENCE.match(value)
        return {m[1]} if m else set()
    parts = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return set().union(*map(references, parts))


def same(a, b) -> bool:
    """Equal as JSON: 1 and 1.0 are, true and 1 aren't."""
    return canonical(a) == canonical(b) or type(a) is not bool and type(b) is not bool and isinstance(a, (int, float)) and isinstance(b, (int, float)) and a == b


def _is(value, kind: str) -> bool:
    """Of a JSON type; an unknown one holds everything, and 1.0 is an integer."""
    if kind not in TYPES:
        return True
    if isinstance(value, bool):
        return kind == "boolean"
    return isinstance(value, TYPES[kind]) or kind == "integer" and isinstance(value, float) and value.is_integer()


def schema_fault(schema, levels: int = DEEP) -> bool:
    """Is this no schema: no object or boolean, a keyword of the wrong kind, a bad pattern, too deep?"""
    if isinstance(schema, bool):
        return False
    if not isinstance(schema, dict) or not levels:
        return True
    number = lambda x: isinstance(x, (int, float)) and not isinstance(x, bool)
    kinds = {
        "minimum": number, "maximum": number, "minLength": number, "maxLength": number, "pattern": lambda x: isinstance(x, str), "enum": lambda x: isinstance(x, list), "properties": lambda x: isinstance(x, dict),
        "required": lambda x: isinstance(x, list) and all(isinstance(y, str) for y in x), "type": lambda x: isinstance(x, str) or isinstance(x, list) and all(isinstance(y, str) for y in x), "items": lambda x: True, "additionalProperties": lambda x: True,
    }
    if any(k in kinds and not kinds[k](v) for k, v in schema.items()):
        return True
    try:
        re.compile(schema.get("pattern", ""))
    except (re.error, RecursionError, OverflowError):
        return True
    inner = [*schema.get("properties", {}).values(), *([schema["items"]] if "items" in schema else [])]
    return any(schema_fault(x, levels - 1) for x in inner)


def schema_problem(value, schema, met: frozenset[str] = frozenset(), at: str = "") -> str | None:
    """The first way, by name, in which a value misses a schema without ``schema_fault``.

    Keywords: type, enum, required, properties, additionalProperties (false), items,
    minimum, maximum, minLength, maxLength, pattern; others are ignored.  ``true`` takes and
    ``false`` refuses everything.  A string that refers to one of the calls ``met`` passes: its
    value is known when that call is answered.
    """
    name = at or "arguments"
    if isinstance(schema, bool):
        return None if schema else f"value of {name}"
    if isinstance(value, str) and (m := REFERENCE.match(value)) and m[1] in met:
        return None
    kinds = schema.get("type", "object" if not at else [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return f"type of {name}"
    if "enum" in schema and not any(same(value, x) for x in schema["enum"]):
        return f"value of {name}"
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if value < schema.get("minimum", value) or value > schema.get("maximum", value):
            return f"range of {name}"
    if isinstance(value, str):
        if not schema.get("minLength", 0) <= len(value) <= schema.get("maxLength", len(value)):
            return f"length of {name}"
        if "pattern" in schema and not re.search(schema["pattern"], value):
            return f"pattern of {name}"
    if isinstance(value, list) and "items" in schema:
        return next((x for i, v in enumerate(value) if (x := schema_problem(v, schema["items"], met, f"{name}[{i}]"))), None)
    if isinstance(value, dict):
        inside = lambda k: f"{at}.{k}" if at else k
        for k in sorted(schema.get("required", [])):
            if k not in value:
                return f"missing {inside(k)}"
        known = schema.get("properties", {})
        for k in sorted(value):
            if k not in known and schema.get("additionalProperties", True) is False:
                return f"unknown {inside(k)}"
            if k in known and (x := schema_problem(value[k], known[k], met, inside(k))):
                return x
    return None


def checked(arguments: str, schema: str, met: frozenset[str]) -> str | None:
    """``schema_problem`` of two texts; ``schema`` where the tool's schema is none."""
    try:
        wanted = read_block(schema)
    except ValueError:
        return "schema"
    return "schema" if schema_fault(wanted) else schema_problem(json.loads(arguments), wanted, met)


def split_message(role: str | None, text: str | None) -> list[dict]:
    """A message's items: its text without blocks, then its blocks in order."""
    text = text or ""
    items = [{"kind": "message", "canonical": canonical({"content": BLOCK.sub("", text), "role": role})}]
    for m in BLOCK.finditer(text):
        item = {"kind": m[1], "canonical": None}
        items.append(item)
        try:
            body = read_block(m[2])
        except ValueError:
            body = None
        if not isinstance(body, dict) or body.get("id") is None:
            item["problem"] = "malformed"
            continue
        item |= {"call_id": plain(body["id"]), "canonical": canonical(body)}
        if m[1] == "call":
            arguments = body.get("arguments", {})
            item |= {"name": plain(body.get("name")), "arguments": canonical(arguments), "needs": sorted(references(arguments))}
    return items


def parse(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    keys = ("kind", "call_id", "name", "arguments", "needs", "canonical", "problem")
    types = [pa.int64(), pa.int64(), pa.int32(), *(pa.list_(pa.string()) if k == "needs" else pa.string() for k in keys)]

    def run(batches):
        for batch in batches:
            rows = []
            for c, t, r, x in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                rows += [(c, t, part, *(item.get(k) for k in keys)) for part, item in enumerate(split_message(r, x))]
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], ["conv_id", "turn", "part", *keys])

    picked = conversations.select(F.col(conv_id).cast("long"), F.col(turn).cast("long"), F.col(role).cast("string"), F.col(text).cast("string"))
    return picked.mapInArrow(run, ITEMS)


@F.pandas_udf(T.StringType())
def _problem(arguments: pd.Series, schema: pd.Series, met: pd.Series) -> pd.Series:
    check = lambda a, s, m: None if s is None else checked(a, s, frozenset(m if m is not None else ()))
    return pd.Series([check(*x) for x in zip(arguments, schema, met, strict=True)], dtype=object)


def settle(needs: dict[str, set[str]]) -> dict[str, int]:
    """Levels of calls: one more than the highest level they need; calls on or behind a cycle have none."""
    asked: dict[str, list[str]] = {}
    for call, what in needs.items():
        for x in what:
            asked.setdefault(x, []).append(call)
    waiting = {call: len(what) for call, what in needs.items()}
    level = {x: 0 for x in asked if x not in needs}
    front = list(level)
    while front:
        done = front.pop()
        for call in asked.get(done, ()):
            level[call] = max(level.get(call, 0), level[done] + 1)
            waiting[call] -= 1
            if not waiting[call]:
                front.append(call)
    return {call: level[call] for call in needs if not waiting[call]}


def _levels(heads: DataFrame, needs: DataFrame, scratch: Scratch, limit: int) -> DataFrame:
    """(conv_id, call_id, level): 0 for calls that need nothing, else one more than the
    highest level they need.  Calls on a cycle, or behind one, get none.

    ``needs`` (conv_id, call_id, need) are references to calls that exist.  Conversations
    of at most ``limit`` references are settled each in one pass; in longer ones a round
    settles the calls whose needs are settled, so rounds are as many as levels.
    """
    sized = needs.groupBy("conv_id").agg(F.count("*").alias("n"))
    long = scratch.write(sized.where(F.col("n") > limit).select("conv_id"), "long")
    free = heads.join(needs.select("conv_id", "call_id").distinct(), ["conv_id", "call_id"], "left_anti").select("conv_id", "call_id", F.lit(0).alias("level"))

    def short(batches):
        for batch in batches:
            out = []
            for conv, edges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own: dict[str, set[str]] = {}
                for e in edges:
                    own.setdefault(e["call_id"], set()).add(e["need"])
                out += [(conv, call, n) for call, n in settle(own).items()]
            cols = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32()), strict=True)], ["conv_id", "call_id", "level"])

    packed = needs.join(long, "conv_id", "left_anti").groupBy("conv_id").agg(F.collect_list(F.struct("call_id", "need")).alias("edges"))
    settled = free.union(packed.mapInArrow(short, "conv_id long, call_id string, level int"))
    if long.isEmpty():
        return settled
    needs = scratch.write(needs.join(long, "conv_id", "left_semi"), "long-needs")
    waiting = scratch.write(needs.groupBy("conv_id", "call_id").agg(F.count("*").alias("open")), "waiting")
    done = scratch.write(free.join(long, "conv_id", "left_semi"), "level")
    level = 0
    while not waiting.isEmpty():
        level += 1
        met = needs.join(done.select("conv_id", F.col("call_id").alias("need")), ["conv_id", "need"]).groupBy("conv_id", "call_id").agg(F.count("*").alias("met"))
        left = scratch.write(waiting.join(met, ["conv_id", "call_id"], "left").select("conv_id", "call_id", (F.col("open") - F.coalesce("met", F.lit(0))).alias("open")), "left")
        done = scratch.write(left.where("open = 0").select("conv_id", "call_id", F.lit(level).alias("level")), "level")
        if done.isEmpty():
            break
        settled = settled.union(done)
        waiting = left.where("open > 0")
    return settled


def link(
    conversations: DataFrame, schemas: DataFrame | None = None, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    scratch: Scratch | None = None, limit: int = LIMIT,
) -> DataFrame:
    """One row per message, call and result: conv_id, turn, part, kind, call_id, name,
    level, linked, problem, canonical.

    ``schemas`` (name, schema as JSON text) validate the arguments of calls.  Calls and
    results meet by (conv_id, call_id); of several calls with one id the first counts.
    ``level`` is twice the call's depth among the calls it refers to, plus one for its
    result, so ordering a conversation by (level, turn, part) is topological; messages
    have none.  ``problem``: malformed, duplicate id, unknown tool, a schema's complaint,
    cycle, unanswered, orphan result, or result before its call.

    Items stay rows; of a conversation only its references (pairs of identifiers) are
    gathered, and only where they are at most ``limit``.  Null role or text makes
    an empty message; rows without conv_id link with nothing; repeated rows are kept, and
    their calls are duplicates.  Other columns of the input are not read.
    """
    spark = conversations.sparkSession
    scratch = scratch or Scratch(spark, "tools")
    items = scratch.write(parse(conversations, conv_id, turn, role, text), "items")
    ok = F.col("problem").isNull() & F.col("conv_id").isNotNull()
    first = Window.partitionBy("conv_id", "call_id").orderBy("turn", "part", "canonical")
    calls = items.where((F.col("kind") == "call")).withColumn("_n", F.when(ok, F.row_number().over(first)))
    heads = calls.where("_n = 1").select("conv_id", "call_id", F.col("call_id").alias("need"))
    # a call's references to calls that exist in its conversation
    asked = calls.where(ok).select("conv_id", "turn", "part", "call_id", "_n", F.explode("needs").alias("need")).distinct()
    needs = scratch.write(asked.join(heads.select("conv_id", "need"), ["conv_id", "need"]), "needs")
    met = needs.groupBy("conv_id", "turn", "part", "call_id").agg(F.collect_set("need").alias("met"))
    calls = calls.join(met, ["conv_id", "turn", "part", "call_id"], "left")
    if schemas is not None:
        known = schemas.where("name is not null").groupBy("name").agg(F.min("schema").alias("schema"))
        calls = calls.join(known, "name", "left")
        complaint = F.when(F.col("schema").isNull(), F.lit("unknown tool")).otherwise(_problem("arguments", "schema", "met"))
        calls = calls.withColumn("_complaint", F.when(ok, complaint))
    else:
        calls = calls.withColumn("_complaint", F.lit(None).cast("string"))
    calls = scratch.write(calls.select("conv_id", "turn", "part", "kind", "call_id", "name", "canonical", "problem", "_n", "_complaint"), "calls")
    heads = calls.where("_n = 1")
    edges = needs.where("_n = 1").select("conv_id", "call_id", "need")
    levels = scratch.write(_levels(heads.select("conv_id", "call_id"), edges, scratch, limit), "levels")
    results = items.where("kind = 'result'").select("conv_id", "turn", "part", "kind", "call_id", "canonical", "problem")
    answered = results.where(ok).select("conv_id", "call_id").distinct().withColumn("_answered", F.lit(True))
    out_calls = calls.join(levels, ["conv_id", "call_id"], "left").join(answered, ["conv_id", "call_id"], "left").select(
        "conv_id", "turn", "part", "kind", "call_id", "name", F.when(F.col("_n") == 1, 2 * F.col("level")).alias("level"),
        F.coalesce((F.col("_n") == 1) & F.col("_answered"), F.lit(False)).alias("linked"),
        F.coalesce(
            "problem", F.when(F.col("_n") > 1, "duplicate id"), "_complaint", F.when((F.col("_n") == 1) & F.col("level").isNull(), "cycle"),
            F.when(F.col("_answered").isNull(), "unanswered"),
        ).alias("problem"),
        "canonical",
    )
    asked = heads.join(levels, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.col("name").alias("_name"), "level", F.struct("turn", "part").alias("_at"))
    out_results = results.join(asked, ["conv_id", "call_id"], "left").select(
        "conv_id", "turn", "part", "kind", "call_id", F.col("_name").alias("name"), (2 * F.col("level") + 1).alias("level"),
        F.coalesce(F.col("problem").isNull() & F.col("_at").isNotNull(), F.lit(False)).alias("linked"),
        F.coalesce("problem", F.when(F.col("_at").isNull(), "orphan result"), F.when(F.struct("turn", "part") < F.col("_at"), "result before its call")).alias("problem"),
        "canonical",
    )
    none = lambda t: F.lit(None).cast(t)
    messages = items.where("kind = 'message'").select(
        "conv_id", "turn", "part", "kind", "call_id", "name", none("int").alias("level"), F.lit(False).alias("linked"), "problem", "canonical"
    )
    return messages.unionByName(out_calls).unionByName(out_results)
