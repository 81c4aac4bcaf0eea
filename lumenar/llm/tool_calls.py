"""Chat formatting: tool calls and results linked, ordered, validated and written as canonical JSON.

Calls and results are hash-joined by conversation and identifier: what is known of an
identifier (other side, level) is one row, and that of hot identifiers is broadcast to their
rows, so neither a conversation nor an identifier with a third of all rows meets in one task.
Calls that refer to results of others (an argument object ``{"$ref": id}``) are ordered by
levels: a call's level is one more than the highest level it refers to. Chains of calls with one
reference each are shortened by pointer doubling, in as many rounds as the logarithm of their
length; calls with several references are settled in rounds over the edges that are left, as many
as the longest chain of such calls. Calls on a cycle, or behind one, have no level. Arguments are
checked against a subset of JSON Schema (type, properties, required, enum, minimum, maximum,
minLength, maxLength, additionalProperties, items); every message is serialised with sorted keys
and no blanks.

Defined results: a call without a result and a result without a call stay, unlinked; of
results that repeat an identifier each is linked; of calls that repeat one each is linked, and
their references count together; a null identifier or conversation links with nothing and has
level null in results, 0 in calls without references; arguments that are null, not JSON (NaN and
numbers beyond doubles are not) or not a JSON object are invalid with error ``not an object``, and
those nested deeper than MOST_DEPTH with ``nested too deeply``: both are kept as the text they
came as; of keys that repeat in an object the last counts; lone surrogates are written as escapes;
a name without a schema is invalid; null texts are JSON nulls; texts of any length are kept
whole; ties of level are in order of turn; an empty table gives no rows; further columns
are ignored.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenar.llm.hot_keys import join_facts, look_up
from lumenar.storage import Scratch, table, written

_KINDS = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


MOST_DEPTH = 200
_LONE = re.compile("[\ud800-\udfff]")


def whole_text(text: str) -> str:
    """Lone surrogates, which UTF-8 can't hold, as escapes."""
    return _LONE.sub(lambda m: f"\\u{ord(m[0]):04x}", text)


def canonical(value: object) -> str:
    return whole_text(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))


def _finite(text: str) -> float:
    number = float(text)
    if not math.isfinite(number):
        raise ValueError(f"{text} is no JSON number that a double holds")
    return number


def _depth(value: object) -> int:
    depth, level = 0, [value]
    while level := [y for x in level if isinstance(x, (dict, list)) for y in (x.values() if isinstance(x, dict) else x)]:
        depth += 1
    return depth


def parsed(text: str | None) -> tuple[dict | None, str]:
    """(arguments, what is wrong with them)."""
    try:
        value = json.loads(text, parse_float=_finite, parse_constant=_finite) if text is not None else None
    except RecursionError:
        return None, "nested too deeply"
    except ValueError:
        return None, "not an object"
    if not isinstance(value, dict):
        return None, "not an object"
    return (None, "nested too deeply") if _depth(value) > MOST_DEPTH else (value, "")


def _is(value: object, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool) or isinstance(value, float) and value.is_integer()
    if kind == "number":
        return isinstance(value, (int, float)) and not isinstance(value, bool)
    return isinstance(value, _KINDS[kind])


def schema_errors(value: object, schema: dict, at: str = "$") -> list[str]:
    """What ``value`` breaks of ``schema``, in order of place."""
    if isinstance(value, dict) and set(value) == {"$ref"}:
        return []  # stands for another call's result
    errors = []
    kinds = schema.get("type")
    kinds = [kinds] if isinstance(kinds, str) else kinds
    if kinds and not any(_is(value, k) for k in kinds):
        return [f"{at}: not {' or '.join(kinds)}"]
    if "enum" in schema and value not in schema["enum"]:
        errors.append(f"{at}: not in enum")
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        if "minimum" in schema and value < schema["minimum"]:
            errors.append(f"{at}: under {schema['minimum']}")
        if "maximum" in schema and value > schema["maximum"]:
            errors.append(f"{at}: over {schema['maximum']}")
    if isinstance(value, str):
        if "minLength" in schema and len(value) < schema["minLength"]:
            errors.append(f"{at}: shorter than {schema['minLength']}")
        if "maxLength" in schema and len(value) > schema["maxLength"]:
            errors.append(f"{at}: longer than {schema['maxLength']}")
    if isinstance(value, dict):
        known = schema.get("properties", {})
        errors += [f"{at}.{name}: missing" for name in sorted(schema.get("required", [])) if name not in value]
        for name in sorted(value):
            if name in known:
                errors += schema_errors(value[name], known[name], f"{at}.{name}")
            elif schema.get("additionalProperties", True) is False:
                errors.append(f"{at}.{name}: not known")
    if isinstance(value, list) and "items" in schema:
        for i, item in enumerate(value):
            errors += schema_errors(item, schema["items"], f"{at}[{i}]")
    return errors


def references(value: object) -> Iterator[str]:
    if isinstance(value, dict):
        if set(value) == {"$ref"} and isinstance(value["$ref"], str):
            yield value["$ref"]
        else:
            for item in value.values():
                yield from references(item)
    elif isinstance(value, list):
        for item in value:
            yield from references(item)


def _checked(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls with valid, errors, refs and canonical columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                arguments, wrong = parsed(r["arguments"])
                if wrong:
                    errors = [wrong]
                elif r["name"] not in schemas:
                    errors = [f"no schema for {r['name']}"]
                else:
                    errors = [whole_text(e) for e in schema_errors(arguments, schemas[r["name"]])]
                refs = sorted({x for x in references(arguments) if not _LONE.search(x)})  # no identifier holds a lone surrogate
                text = canonical({"type": "call", "id": r["call_id"], "name": r["name"], "arguments": r["arguments"] if wrong else arguments})
                rows.append({**r, "valid": not errors, "errors": errors, "refs": refs, "canonical": text})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("call_id", pa.string()), ("name", pa.string()), ("arguments", pa.string()), ("valid", pa.bool_()), ("errors", pa.list_(pa.string())), ("refs", pa.list_(pa.string())), ("canonical", pa.string())])
    return calls.select("conv_id", "turn", "call_id", "name", "arguments").mapInArrow(run, "conv_id long, turn long, call_id string, name string, arguments string, valid boolean, errors array<string>, refs array<string>, canonical string").drop("arguments")


def _key(call_id: str) -> Column:
    """One name for conversation and identifier; null if either is."""
    return F.concat(F.col("conv_id").cast("string"), F.lit(":"), F.col(call_id))


def _shortened(single: DataFrame, names: int, scratch: Scratch) -> DataFrame:
    """(key, to, steps) of calls with one reference each: ``to`` is the first call on the way that has none or several, or, on a cycle, one of ``single``."""
    hops = scratch.written(single.withColumn("steps", F.lit(1).cast("long")), "call-hops")
    total = hops.count()
    for _ in range(max(1, names).bit_length()):
        if total == 0:
            break
        further = hops.select(F.col("key").alias("to"), F.col("to").alias("next"), F.col("steps").alias("more"))
        joined = look_up(hops, further, "to", total, "left")
        hops = scratch.written(joined.select("key", F.coalesce("next", "to").alias("to"), (F.col("steps") + F.coalesce("more", F.lit(0))).alias("steps"), F.col("next").isNotNull().alias("moved")), "call-hops")
        moved = hops.where("moved").limit(1).count()
        hops = hops.drop("moved")
        if not moved:
            break
    return hops


def levels_of(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, level) of the ``nodes`` (key) that are on no cycle of ``edges`` (key, ref), nor behind one. Edges are distinct; their ends are nodes."""
    counted = edges.groupBy("key").agg(F.count(F.lit(1)).alias("refs"), F.min("ref").alias("to"))
    counted = scratch.written(counted, "call-counts")
    total, names = edges.count(), nodes.count()
    hops = _shortened(counted.where("refs = 1").select("key", "to"), names, scratch)
    # what is left: calls with several references, each to a settled call some steps down
    several = look_up(edges, counted.where("refs > 1").select("key"), "key", total)
    left = look_up(several.withColumnRenamed("ref", "first"), hops.withColumnsRenamed({"key": "first", "steps": "down"}), "first", total, "left")
    left = scratch.written(left.select("key", F.coalesce("to", "first").alias("to"), F.coalesce("down", F.lit(0)).alias("down")), "call-edges")
    level = F.lit(0).cast("long").alias("level")
    fresh = scratch.written(nodes.join(counted, "key", "left_anti").select("key", level), "call-levels")
    settled, pending = [fresh], left.count()
    base = left.groupBy("key").agg(F.count(F.lit(1)).alias("open")).withColumn("least", F.lit(0).cast("long"))
    base = scratch.written(base, "call-open") if pending else base
    while pending:
        # edges to what was settled last; each counts in one round only
        hits = look_up(left, fresh.withColumnRenamed("key", "to"), "to", pending)
        got = hits.groupBy("key").agg(F.count(F.lit(1)).alias("closed"), F.max(F.col("level") + F.col("down") + 1).alias("high"))
        base = base.join(got, "key", "left").select("key", (F.col("open") - F.coalesce("closed", F.lit(0))).alias("open"), F.greatest("least", F.coalesce("high", F.lit(0))).alias("least"))
        base = scratch.written(base, "call-open")
        fresh = scratch.written(base.where("open = 0").select("key", F.col("least").alias("level")), "call-levels")
        if fresh.isEmpty():
            break
        settled.append(fresh)
        base = base.where("open > 0")
    known = settled[0]
    for more in settled[1:]:
        known = known.unionByName(more)
    ends = known.withColumnsRenamed({"key": "to", "level": "below"})
    chained = look_up(hops, ends, "to", total).select("key", (F.col("below") + F.col("steps")).alias("level"))
    return known.unionByName(chained)


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls (conv_id, turn, call_id, name, arguments) and results (conv_id, turn, call_id, content), one row each:

    conv_id, turn, kind, call_id, linked, other_turn (the smallest linked), level, valid, errors, canonical.
    """
    checked = written(_checked(calls, schemas).withColumn("key", _key("call_id")), "calls")
    answers = results.withColumn("key", _key("call_id"))
    asked = checked.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("calls"), F.min("turn").alias("call_turn"))
    told = answers.where("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("results"), F.min("turn").alias("result_turn"))
    scratch = Scratch(calls.sparkSession)
    nodes = scratch.written(asked, "call-names")
    refs = checked.where("key is not null").select("conv_id", "key", F.explode("refs").alias("ref_id")).select("key", _key("ref_id").alias("ref")).distinct()
    refs = scratch.written(refs, "call-refs")
    edges = scratch.written(look_up(refs, nodes.select(F.col("key").alias("ref")), "ref", refs.count()).select("key", "ref"), "call-edges")  # to calls that exist
    levels = levels_of(nodes.select("key"), edges, scratch) if not edges.isEmpty() else nodes.select("key", F.lit(0).cast("long").alias("level"))
    facts = nodes.join(told, "key", "full_outer").join(levels.select("key", F.col("level").cast("int").alias("level")), "key", "left")
    facts = written(facts, "call-facts")
    scratch.clear()

    ask = join_facts(checked, facts.where("calls is not null").select("key", "calls", "result_turn", "level"), "key", "calls", checked.count(), "left")
    level = F.when(F.col("key").isNull() & (F.size("refs") == 0), F.lit(0)).otherwise(F.col("level")).alias("level")
    called = ask.select("conv_id", "turn", F.lit("call").alias("kind"), "call_id", F.col("result_turn").isNotNull().alias("linked"), F.col("result_turn").alias("other_turn"), level, "valid", "errors", "canonical")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [canonical({"type": "result", "id": i, "content": c}) for i, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(texts, pa.string())], ["conv_id", "turn", "call_id", "canonical"])

    texts = results.select("conv_id", "turn", "call_id", "content").mapInArrow(write, "conv_id long, turn long, call_id string, canonical string").withColumn("key", _key("call_id"))
    texts = written(texts, "results")
    answered = join_facts(texts, facts.where("results is not null").select("key", "results", "call_turn", "level"), "key", "results", texts.count(), "left").select(
        "conv_id", "turn", F.lit("result").alias("kind"), "call_id", F.col("call_turn").isNotNull().alias("linked"), F.col("call_turn").alias("other_turn"), "level",
        F.lit(True).alias("valid"), F.array().cast("array<string>").alias("errors"), "canonical",
    )
    return called.unionByName(answered)


#: The tools that turns call: a system's turn ``instruct``, a user's ``reply``, which refers to the call of the user's turn before.
LONGEST_PROMPT, LAST_TURN = 300, 5
TURN_SCHEMAS = {
    "instruct": {"type": "object", "required": ["prompt"], "properties": {"prompt": {"type": "string"}}, "additionalProperties": False},
    "reply": {
        "type": "object", "required": ["prompt", "turn"], "additionalProperties": False,
        "properties": {"after": {"type": "string"}, "prompt": {"type": "string", "maxLength": LONGEST_PROMPT}, "turn": {"type": "integer", "maximum": LAST_TURN}},
    },
}


def calls_of_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns as calls and results: an assistant's turn is the result of the call of the turn before it, other turns are calls.

    A user's call from turn 2 on refers to the call two turns before, so the calls of a conversation are chains.
    """
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    told, system = F.col("role").eqNullSafe("assistant"), F.col("role").eqNullSafe("system")
    after = F.when(F.col("turn") >= 2, F.struct(F.concat(F.lit("turn:"), (F.col("turn") - 2).cast("string")).alias("$ref")))
    prompt = F.struct(F.col("text").alias("prompt"))
    keep = {"ignoreNullFields": "false"}
    arguments = F.when(system, F.to_json(prompt, keep)).when(after.isNull(), F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn")), keep)).otherwise(F.to_json(F.struct(after.alias("after"), F.col("text").alias("prompt"), F.col("turn")), keep))
    name = F.when(system, "instruct").otherwise("reply")
    calls = turns.where(~told).select("conv_id", "turn", F.concat(F.lit("turn:"), F.col("turn").cast("string")).alias("call_id"), name.alias("name"), arguments.alias("arguments"))
    results = turns.where(told).select("conv_id", "turn", F.concat(F.lit("turn:"), (F.col("turn") - 1).cast("string")).alias("call_id"), F.col("text").alias("content"))
    return calls, results


def op3_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = link(*calls_of_turns(table(spark, sf_dir, "conversations")), TURN_SCHEMAS)
    return linked.withColumn("errors", F.array_join("errors", "; "))


ORACLE = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role = 'assistant', FALSE) AS told, coalesce(role = 'system', FALSE) AS sys, text FROM conversations),
a AS (SELECT conv_id, turn - 1 AS asked, min(turn) AS other FROM t WHERE told GROUP BY ALL),
c AS (SELECT conv_id, turn AS asked, min(turn) AS other, bool_and(sys OR turn < 2) AS first FROM t WHERE NOT told GROUP BY ALL),
f AS (SELECT *, CASE WHEN first OR lag(asked) OVER w IS DISTINCT FROM asked - 2 THEN 1 ELSE 0 END AS fresh FROM c WINDOW w AS (PARTITION BY conv_id, asked % 2 ORDER BY asked)),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id, asked % 2 ORDER BY asked ROWS UNBOUNDED PRECEDING) AS chain FROM f),
l AS (SELECT conv_id, asked, other, CAST(row_number() OVER (PARTITION BY conv_id, asked % 2, chain ORDER BY asked) - 1 AS INTEGER) AS level FROM g),
j AS (SELECT t.*, coalesce(CAST(to_json(t.text) AS VARCHAR), 'null') AS quoted FROM t)
SELECT t.conv_id, t.turn, 'call' AS kind, concat('turn:', t.turn) AS call_id, a.other IS NOT NULL AS linked, a.other AS other_turn, l.level,
       t.text IS NOT NULL AND (t.sys OR (length(t.text) <= {LONGEST_PROMPT} AND t.turn <= {LAST_TURN})) AS valid,
       concat_ws('; ', CASE WHEN t.text IS NULL THEN '$.prompt: not string' WHEN NOT t.sys AND length(t.text) > {LONGEST_PROMPT} THEN '$.prompt: longer than {LONGEST_PROMPT}' END,
                 CASE WHEN NOT t.sys AND t.turn > {LAST_TURN} THEN '$.turn: over {LAST_TURN}' END) AS errors,
       CASE WHEN t.sys THEN concat('{{"arguments":{{"prompt":', quoted, '}},"id":"turn:', t.turn, '","name":"instruct","type":"call"}}')
            ELSE concat('{{"arguments":{{', CASE WHEN t.turn >= 2 THEN concat('"after":{{"$ref":"turn:', t.turn - 2, '"}},') ELSE '' END, '"prompt":', quoted, ',"turn":', t.turn, '}},"id":"turn:', t.turn, '","name":"reply","type":"call"}}') END AS canonical
FROM j t LEFT JOIN a ON a.conv_id = t.conv_id AND a.asked = t.turn JOIN l ON l.conv_id = t.conv_id AND l.asked = t.turn WHERE NOT told
UNION ALL
SELECT t.conv_id, t.turn, 'result', concat('turn:', t.turn - 1), l.other IS NOT NULL, l.other, l.level, TRUE, '',
       concat('{{"content":', quoted, ',"id":"turn:', t.turn - 1, '","type":"result"}}')
FROM j t LEFT JOIN l ON l.conv_id = t.conv_id AND l.asked = t.turn - 1 WHERE told
"""
