"""Chat formatting: tool calls linked to their results.

Calls and results are joined by conversation and identifier, whatever their turns. Calls are put in an order in which each comes after the calls it
depends on: by turn, and a call that depends on a later one right after it. The order is a pair of numbers for each call: ``after``, the place of the
latest call it waits for (its own turn, if it waits for none), and ``wait``, the length of the longest chain of calls that it follows there. Calls that depend on
others are cut into blocks of about ``BLOCK`` dependencies by ranges of conversation and turn, so that a long conversation is in many blocks and a block holds
many short ones. A block is settled in one task, whatever the length of its chains: places spread from the latest on, then calls without an open dependency
are peeled off; only cycles and what hangs on them are left. What blocks then know of calls of other blocks is passed on in rounds, in which only blocks that
learn something are settled again: as many rounds as the longest chain has crossings between blocks, none for conversations within a block.
Arguments are validated against the JSON schema of their tool and serialised as
canonical JSON: sorted keys, no blanks, lone surrogates as escapes.

Defined results: a call without a result has status ``pending``, a result without a call ``orphan``; of several results the first by turn counts (those
without a turn last, then the least content, null first); calls in a cycle of dependencies, or depending on one in any number of steps, have status ``cyclic``
and no order; dependencies on calls that don't exist are ignored; a call without a turn comes before all others and its ``after`` is null, unless it waits;
arguments that are no JSON object, have a key twice, a number that isn't finite or too deep a nesting are invalid, with null canonical form; calls of tools
without a schema are invalid; calls and results with a null identifier link with nothing, each a row of its own; repeated calls of an identifier each get
its result, and count as one call in the order, at their least turn; schemas with keywords or types that are not known raise ValueError before
anything runs; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

import json
import math
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

_KINDS = {
    "object": lambda v: isinstance(v, dict), "array": lambda v: isinstance(v, list), "string": lambda v: isinstance(v, str), "boolean": lambda v: isinstance(v, bool),
    "null": lambda v: v is None, "integer": lambda v: isinstance(v, int) and not isinstance(v, bool) or isinstance(v, float) and v.is_integer(), "number": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
}
#: Keywords of schemas that are checked, and those that say nothing about a value.
_CHECKED = {"type", "enum", "const", "required", "properties", "additionalProperties", "items", "minLength", "maxLength", "minItems", "maxItems", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "anyOf", "allOf", "not"}
_NOTES = {"title", "description", "default", "examples", "$schema", "$id", "$comment", "deprecated", "readOnly", "writeOnly"}
_LONE = re.compile("[\ud800-\udfff]")
_KEYS = ["conv_id", "call_id"]
#: Dependencies of a block, at about this number of which blocks are cut.
BLOCK = 100_000
#: The place of calls without a turn.
_FIRST = -(1 << 63)


def check_schema(schema, at: str = "$") -> None:
    """Raises ValueError where ``schema`` has keywords or types that ``violations`` does not know."""
    if isinstance(schema, bool):
        return
    if not isinstance(schema, dict):
        raise ValueError(f"{at}: not a schema")
    if unknown := schema.keys() - _CHECKED - _NOTES:
        raise ValueError(f"{at}: unknown keywords {sorted(unknown)}")
    kinds = schema.get("type", [])
    if unknown := {kinds} - _KINDS.keys() if isinstance(kinds, str) else set(kinds) - _KINDS.keys():
        raise ValueError(f"{at}: unknown types {sorted(unknown)}")
    inner = [*schema.get("properties", {}).items(), *((k, schema[k]) for k in ("additionalProperties", "items", "not") if k in schema)]
    for k, s in [*inner, *((k, s) for k in ("anyOf", "allOf") for s in schema.get(k, []))]:
        check_schema(s, f"{at}.{k}")


def same(a, b) -> bool:
    """Equality of JSON values: numbers by value, booleans are no numbers."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return a == b
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    return type(a) is type(b) and a == b


def violations(value, schema, at: str = "$") -> list[str]:
    """What in ``value`` breaks ``schema`` (of the keywords that ``check_schema`` lets pass)."""
    if isinstance(schema, bool):
        return [] if schema else [f"{at}: not allowed"]
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_KINDS[k](value) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    out = []
    if "enum" in schema and not any(same(value, x) for x in schema["enum"]):
        out.append(f"{at}: not in enum")
    if "const" in schema and not same(value, schema["const"]):
        out.append(f"{at}: not the constant")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        out += [f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value]
        extra = schema.get("additionalProperties", True)
        for k, v in value.items():
            if k in known:
                out += violations(v, known[k], f"{at}.{k}")
            elif extra is False:
                out.append(f"{at}.{k}: unexpected")
            elif isinstance(extra, dict):
                out += violations(v, extra, f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        out += [x for i, v in enumerate(value) for x in violations(v, schema["items"], f"{at}[{i}]")]
    size = len(value) if isinstance(value, (str, list)) else None
    kind = "Length" if isinstance(value, str) else "Items"
    if size is not None and not schema.get(f"min{kind}", 0) <= size <= schema.get(f"max{kind}", size):
        out.append(f"{at}: size {size}")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        inside = schema.get("minimum", value) <= value <= schema.get("maximum", value)
        if not inside or value <= schema.get("exclusiveMinimum", -math.inf) or value >= schema.get("exclusiveMaximum", math.inf):
            out.append(f"{at}: out of range")
    for s in schema.get("allOf", []):
        out += violations(value, s, at)
    if "anyOf" in schema and all(violations(value, s, at) for s in schema["anyOf"]):
        out.append(f"{at}: fits none of anyOf")
    if "not" in schema and not violations(value, schema["not"], at):
        out.append(f"{at}: fits what it must not")
    return out


def _object(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("a key twice")
    return out


def _finite(x):
    if math.isfinite(v := float(x)):
        return v
    raise ValueError(x)


def _sound(text: str) -> str:
    """``text`` with lone surrogates, which no UTF-8 can hold, as JSON escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value) -> str:
    return _sound(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def checked(arguments: str | None, schema: dict | None) -> tuple[str | None, str | None]:
    """Canonical form and the first violation, either of which may be None."""
    try:
        value = json.loads(arguments or "", object_pairs_hook=_object, parse_float=_finite, parse_constant=_finite)
        if not isinstance(value, dict):
            return None, "$: not object"
        found = ["$: no schema"] if schema is None else violations(value, schema)
        return canonical(value), _sound(found[0]) if found else None
    except RecursionError:
        return None, "$: nested too deeply"
    except ValueError:
        return None, "$: no JSON"


def _as_on(df: DataFrame, *columns: Column) -> DataFrame:
    """``df`` by the identifier that others depend on."""
    return df.select("conv_id", F.col("call_id").alias("on"), *columns)


def _solved(edges: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
    """after and wait (-1: not known) of the calls of a block, by what is ``given`` of calls of other blocks (calls of other blocks without a place yet wait for their own turn)."""
    own = list(zip(edges["conv_id"], edges["call_id"]))
    on = list(zip(edges["conv_id"], edges["on"]))
    after = dict(zip(own, edges["t"].tolist()))
    known = {(c, o): (a, w) for c, o, a, w in zip(given["conv_id"], given["on"], given["after"].tolist(), given["wait"].tolist())}
    followers, open_, ready = {}, dict.fromkeys(after, 0), []
    for x, y, t, is_leaf in zip(own, on, edges["on_turn"].tolist(), edges["on_block"].isna().tolist()):
        followers.setdefault(y, []).append(x)
        open_[x] += 1
        if is_leaf:
            known[y] = (t, 0)
        elif y not in after:
            known.setdefault(y, (t, -1))
    # The latest places first: each call gets its place from the first that reaches it.
    final = set()
    for place, y in sorted([*((a, y) for y, a in after.items()), *((a, y) for y, (a, _) in known.items())], key=lambda p: p[0], reverse=True):
        reached = [y]
        while reached:
            for x in followers.get(reached.pop(), ()):
                if x not in final:
                    final.add(x)
                    after[x] = max(after[x], place)
                    reached.append(x)
    wait = dict.fromkeys(after, 0)
    ready = [(y, a, w) for y, (a, w) in known.items() if w >= 0] + [(x, after[x], 0) for x, n in open_.items() if not n]
    while ready:
        y, a, w = ready.pop()
        for x in followers.get(y, ()):
            open_[x] -= 1
            if a == after[x]:
                wait[x] = max(wait[x], w + 1)
            if not open_[x]:
                ready.append((x, after[x], wait[x]))
    out = pd.DataFrame({"conv_id": [c for c, _ in after], "call_id": [i for _, i in after], "after": list(after.values()), "wait": [-1 if open_[x] else wait[x] for x in after]})
    return out.assign(block=edges["block"].iloc[0] if len(edges) else 0)


def _settled(edges: DataFrame) -> DataFrame:
    """conv_id, call_id, after, wait (-1 in cycles and behind them) of the calls of ``edges``, which depend on some call."""
    n = -(-edges.count() // BLOCK) or 1
    block = edges.repartitionByRange(n, "conv_id", "t", "call_id") if n > 1 else edges.coalesce(1)
    block = common.written(block.withColumn("block", F.spark_partition_id()), "blocks")
    places = block.groupBy(*_KEYS).agg(F.min("block").alias("on_block"))
    edges = common.written(block.join(_as_on(places, F.col("on_block")), ["conv_id", "on"], "left"), "edges")
    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    result = f"conv_id {kinds['conv_id']}, call_id {kinds['call_id']}, after long, wait long, block int"
    border = edges.where("on_block <> block").select("block", "conv_id", "on").distinct()
    border = common.written(border, "border") if n > 1 else border.limit(0)
    given = border.select("*", F.lit(0).cast("long").alias("after"), F.lit(-1).cast("long").alias("wait")).limit(0)
    solve = lambda e, g: e.groupBy("block").cogroup(g.groupBy("block")).applyInPandas(_solved, result)
    found = common.written(solve(edges, given), "order")
    while n > 1:
        now = common.written(border.join(_as_on(found, F.col("after"), F.col("wait")), ["conv_id", "on"]).select(given.columns), "border")
        again = common.written(now.join(given, given.columns, "left_anti").select("block").distinct(), "again")
        if not again.limit(1).count():
            break
        given = now
        new = solve(edges.join(again, "block", "left_semi"), given.join(again, "block", "left_semi"))
        found = common.written(found.join(again, "block", "left_anti").unionByName(new), "order")
    return found.drop("block")


def ordered(calls: DataFrame) -> DataFrame:
    """``calls`` (conv_id, call_id, turn, depends array<string>), whose identifiers are not null, with after, wait and cyclic."""
    place = F.coalesce(F.min(F.col("turn").cast("long")), F.lit(_FIRST))
    nodes = common.written(calls.groupBy(_KEYS).agg(place.alias("t")), "calls")
    edges = calls.select(*_KEYS, F.explode("depends").alias("on")).distinct().join(nodes, _KEYS).join(_as_on(nodes, F.col("t").alias("on_turn")), ["conv_id", "on"])
    state = nodes.join(_settled(common.written(edges.select(*_KEYS, "on", "t", "on_turn"), "edges")), _KEYS, "left")
    after = F.nullif(F.coalesce("after", "t"), F.lit(_FIRST))
    state = state.select(*_KEYS, after.alias("after"), F.greatest("wait", F.lit(0)).cast("long").alias("wait"), F.coalesce(F.col("wait") < 0, F.lit(False)).alias("cyclic"))
    return calls.join(common.written(state, "order"), _KEYS, "left")


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """``calls`` (conv_id, call_id, turn, name, arguments, depends) and ``results`` (conv_id, call_id, turn, content): a row for each call and each orphan."""
    for schema in schemas.values():
        check_schema(schema)
    named, content = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull(), F.struct("content")
    by_turn = F.struct(F.col("turn").isNull(), "turn", "content")
    first = results.where(named).groupBy(_KEYS).agg(F.min_by(content, by_turn).alias("result"))
    left = ordered(calls.where(named).select(*_KEYS, "turn", "name", "arguments", "depends")).join(first, _KEYS, "left")
    loose = calls.where(~named).select(*_KEYS, "name", "arguments", F.col("turn").cast("long").alias("after"), F.lit(0).cast("long").alias("wait"), F.lit(False).alias("cyclic"))
    rows = left.unionByName(loose, allowMissingColumns=True).withColumn("is_call", F.lit(True))
    lost = first.join(calls.where(named).select(_KEYS).distinct(), _KEYS, "left_anti").unionByName(results.where(~named).select(*_KEYS, content.alias("result")))
    rows = rows.unionByName(lost.withColumn("is_call", F.lit(False)), allowMissingColumns=True)

    def serialise(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                form = wrong = after = wait = None
                status = "orphan"
                if r["is_call"]:
                    form, wrong = checked(r["arguments"], schemas.get(r["name"]))
                    status = "cyclic" if r["cyclic"] else "linked" if r["has_result"] else "pending"
                    after, wait = (None, None) if r["cyclic"] else (r["after"], r["wait"])
                valid = wrong is None and status != "orphan"
                before = canonical({"after": after})[:-1]
                behind = canonical({"conv": r["conv_id"], "id": r["call_id"], "name": r["name"], "result": r["content"], "status": status, "valid": valid, "wait": wait})[1:]
                out.append((r["conv_id"], r["call_id"], after, wait, status, valid, wrong, f'{before},"arguments":{form or "null"},{behind}'))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.string()]
            names = ["conv_id", "call_id", "after", "wait", "status", "valid", "violation", "json"]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 8, kinds)], names=names)

    flat = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "call_id", "name", "arguments", "after", "wait", "cyclic", "is_call", F.col("result").isNotNull().alias("has_result"), F.col("result.content").alias("content"))
    return flat.mapInArrow(serialise, "conv_id long, call_id string, after long, wait long, status string, valid boolean, violation string, json string")


#: Tools of the query; the arguments of every seventh call break their schema.
SCHEMAS = {
    "search": {"type": "object", "required": ["query", "limit"], "properties": {"query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1}}, "additionalProperties": False},
    "note": {"type": "object", "required": ["text"], "properties": {"text": {"type": "string"}, "tags": {"type": "array", "items": {"type": "string"}}}, "additionalProperties": False},
}


def from_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results in place of the plain turns of ``conversations``: an assistant's turn is a call with the whole text as its argument, a turn of any
    other role (or none) is the result of the call before it, but for the first turn. Calls depend on the call two turns
    before; two of five depend on the call two turns after instead, which then does not depend on them, but in every fiftieth conversation, where they make cycles. Rows without a conversation or
    a turn have null identifiers."""
    turn = F.col("turn")
    ident = lambda k: F.concat(F.lit("call-"), k.cast("string"))
    odd = turn % 4 == 1
    limit = F.when((turn + F.col("conv_id")) % 7 == 0, F.lit("0")).otherwise((turn + 1).cast("string"))
    value = F.expr("substring(to_json(named_struct('t', coalesce(text, ''))), 6, length(to_json(named_struct('t', coalesce(text, '')))) - 6)")
    arguments = F.when(odd, F.concat(F.lit('{"query": '), value, F.lit(', "limit": '), limit, F.lit("}"))).otherwise(F.concat(F.lit('{"text": '), value, F.lit(', "tags": []}')))
    waits = lambda k: F.pmod(F.col("conv_id") + k, F.lit(5)).isin(0, 2)
    depends = F.array(F.when(~waits(turn - 2) | (F.col("conv_id") % 50 == 0), ident(turn - 2)), F.when(waits(turn), ident(turn + 2)))
    calls = turns.where("role = 'assistant'").select("conv_id", ident(turn).alias("call_id"), "turn", F.when(odd, "search").otherwise("note").alias("name"), arguments.alias("arguments"), F.array_compact(depends).alias("depends"))
    results = turns.where("not coalesce(role = 'assistant', false) and coalesce(turn > 0, true)").select("conv_id", ident(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(*from_conversations(common.table(spark, sf_dir, "conversations")), SCHEMAS)
