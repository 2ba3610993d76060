"""Chat formatting: tool calls linked to their results, ordered, validated, serialised.

Everything is a DataFrame expression. Results are summed up per identifier
before they meet the calls in a hash join. Levels of the dependency graph are
found in rounds: chains of calls with one dependency each are shortened by
doubling, and what is left is resolved from its sources on. Schemas become
column expressions, and canonical JSON (sorted keys, no blanks) comes from the
variant type.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Store
from .registry import query, table

#: JSON Schema type names and how Spark names the type of a variant.
TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN", "array": "ARRAY", "object": "OBJECT",
         "number": "BIGINT|DECIMAL|DOUBLE|FLOAT", "null": "VOID"}


# ------------------------------------------------------------------ validation
def _check(args: Column, name: str, rule: dict, required: bool) -> Column:
    """Errors of one argument as an array of text."""
    path = "$['" + name.replace("\\", "\\\\").replace("'", "\\'") + "']"
    value = F.try_variant_get(args, F.lit(path), "variant")
    kind = F.schema_of_variant(value)
    checks = [F.when(value.isNull(), F.lit(f"missing {name}") if required else F.lit(None))]
    if "type" in rule:
        allowed = "|".join(TYPES[t] for t in ([rule["type"]] if isinstance(rule["type"], str) else rule["type"]))
        checks.append(F.when(~kind.rlike(f"^({allowed})"), F.lit(f"type of {name}")))
    if "enum" in rule:
        text = F.to_json(value)
        checks.append(F.when(~text.isin([json.dumps(v, ensure_ascii=False, separators=(",", ":")) for v in rule["enum"]]),
                             F.lit(f"value of {name}")))
    for bound, bad in (("minimum", lambda x, y: x < y), ("maximum", lambda x, y: x > y)):
        if bound in rule:
            number = F.try_variant_get(args, F.lit(path), "double")
            checks.append(F.when(bad(number, F.lit(float(rule[bound]))), F.lit(f"{bound} of {name}")))
    if "maxLength" in rule:
        size = F.length(F.try_variant_get(args, F.lit(path), "string"))
        checks.append(F.when(kind.startswith("STRING") & (size > rule["maxLength"]), F.lit(f"length of {name}")))
    return F.array_compact(F.array(*[c.cast("string") for c in checks]))


def errors(tool: Column, arguments: Column, schemas: dict[str, dict]) -> Column:
    """What is wrong with ``arguments`` (JSON) under the schema of ``tool``, in schema order; empty if nothing.

    Of JSON Schema: type, enum, minimum, maximum, maxLength, required, additionalProperties.
    """
    args = F.try_parse_json(arguments)
    whole = F.when(F.schema_of_variant(args).startswith("OBJECT"), F.lit(True))
    out = F.array(F.lit("unknown tool"))
    for name, schema in schemas.items():
        props, need = schema.get("properties", {}), set(schema.get("required", ()))
        parts = [_check(args, p, r, p in need) for p, r in {**{n: {} for n in sorted(need - set(props))}, **props}.items()]
        if schema.get("additionalProperties", True) is False:
            extra = F.array_sort(F.array_except(F.json_object_keys(arguments), F.array(*map(F.lit, props)).cast("array<string>")))
            parts.append(F.transform(extra, lambda k: F.concat(F.lit("unknown "), k)))
        found = F.concat(*parts) if parts else F.array().cast("array<string>")
        out = F.when(tool == name, F.when(F.coalesce(whole, F.lit(False)), found).otherwise(
            F.array(F.lit("arguments are no object")))).otherwise(out)
    return out


def canonical(arguments: Column) -> Column:
    """JSON with sorted keys and without blanks; null if it can't be read."""
    return F.to_json(F.try_parse_json(arguments))


# ------------------------------------------------------------------------ order
def levels(needs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, level): 0 without needs, else one more than the highest level of what is needed.

    ``nodes`` (node) are distinct, ``needs`` (node, needs) name nodes at both ends.
    Nodes on a cycle, or behind one, have a null level. Rounds grow with the
    logarithm of the longest chain and with the depth of nodes that need several.
    """
    store = Store(nodes.sparkSession, "levels")
    needs = store.keep(needs.select("node", "needs").distinct())
    degree = needs.groupBy("node").agg(F.count("*").alias("n"), F.min("needs").alias("up"))
    nodes = store.keep(nodes.join(degree, "node", "left").select("node", F.coalesce("n", F.lit(0)).alias("n"), "up"))
    chain = store.keep(nodes.filter("n = 1").select("node", "up", F.lit(1).cast("long").alias("d")))
    total, reach = nodes.count(), 1
    while reach <= total:  # after k rounds a node points 2**k steps up, or at the top of its chain
        ahead = chain.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"))
        new = store.keep(chain.join(ahead, "up", "left").select(
            "node", F.coalesce("up2", "up").alias("up"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d"),
            F.col("up2").isNotNull().alias("moved")))
        chain, reach = new.drop("moved"), reach * 2
        if new.filter("moved").isEmpty():
            break
    top = store.keep(nodes.filter("n <> 1").select("node", "n"))
    chain = store.keep(chain.join(top.select(F.col("node").alias("up")), "up", "left_semi"))  # the rest is on cycles
    tops = nodes.filter("n <> 1").select("node", F.col("node").alias("up"), F.lit(0).cast("long").alias("d"))
    place = chain.select("node", "up", "d").union(tops)  # each node: its top and the distance from there
    links = needs.join(top.filter("n > 1").select("node"), "node", "left_semi").join(
        place.toDF("needs", "up", "d"), "needs").select("node", "up", (F.col("d") + 1).alias("d"))
    links = store.keep(links)
    known = store.keep(top.filter("n = 0").select("node", F.lit(0).cast("long").alias("level")))
    done, left = [known], store.keep(top.filter("n > 1").select("node", "n", F.lit(0).cast("long").alias("seen"),
                                                                F.lit(0).cast("long").alias("level")))
    while not known.isEmpty() and not left.isEmpty():
        got = links.join(known.toDF("up", "l"), "up").groupBy("node").agg(
            F.count("*").alias("k"), F.max(F.col("l") + F.col("d")).alias("m"))
        left = store.keep(left.join(got, "node", "left").select(
            "node", "n", (F.col("seen") + F.coalesce("k", F.lit(0))).alias("seen"),
            F.greatest("level", F.coalesce("m", F.lit(0))).alias("level")))
        known, left = store.keep(left.filter("seen = n").select("node", "level")), left.filter("seen < n")
        done.append(known)
    level = store.keep(reduce(DataFrame.union, done))
    found = place.join(level.toDF("up", "l"), "up").select("node", (F.col("l") + F.col("d")).alias("level"))
    return nodes.select("node").join(found, "node", "left")


# ------------------------------------------------------------------------- link
def link(calls: DataFrame, results: DataFrame, needs: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Calls with level, errors, results and ``line``, their canonical JSON.

    ``calls``: call_id, tool, arguments (JSON); other columns are not read.
    ``results``: call_id, seq, content. ``needs``: call_id, needs. All ids are text.

    A call's result is the one with the smallest (seq, content); ``n_results``
    counts all. ``status``: ``invalid`` (errors), else ``cycle`` (no order), else
    ``broken`` (needs a call that is not there), else ``open`` (no result), else
    ``ok``. Calls that repeat an id are each linked to the same results and
    share a level; a call without an id has no results, level 0 and status as
    above. Results and needs of calls that are not there make no rows. Null
    arguments are no object. Empty tables give no rows, or nothing to link.
    """
    store = Store(calls.sparkSession, "link")
    calls = store.keep(calls.select("call_id", "tool", "arguments"))
    nodes = calls.filter("call_id is not null").select(F.col("call_id").alias("node")).distinct()
    pairs = store.keep(needs.select(F.col("call_id").alias("node"), "needs").filter("node is not null and needs is not null").distinct())
    known = pairs.join(nodes.toDF("needs"), "needs", "left_semi").join(nodes, "node", "left_semi")
    level = levels(known, nodes).toDF("call_id", "level")
    broken = pairs.join(nodes.toDF("needs"), "needs", "left_anti").select(F.col("node").alias("call_id")).distinct().withColumn(
        "broken", F.lit(True))
    first = results.filter("call_id is not null").groupBy("call_id").agg(
        F.count("*").alias("n_results"), F.min(F.struct("seq", "content"))["content"].alias("result"))
    facts = store.keep(level.join(broken, "call_id", "left").join(first, "call_id", "left"))
    out = calls.join(facts.hint("shuffle_hash"), "call_id", "left")
    out = out.withColumn("level", F.when(F.col("call_id").isNull(), F.lit(0).cast("long")).otherwise(F.col("level")))
    out = out.withColumn("n_results", F.coalesce("n_results", F.lit(0)))
    out = out.withColumn("errors", F.array_join(errors(F.col("tool"), F.col("arguments"), schemas), "; "))
    out = out.withColumn("status", F.when(F.col("errors") != "", "invalid").when(F.col("level").isNull(), "cycle")
                         .when(F.col("broken"), "broken").when(F.col("n_results") == 0, "open").otherwise("ok"))
    line = F.to_json(F.struct(  # fields in the order of their names
        F.coalesce(F.try_parse_json("arguments"), F.try_parse_json(F.lit("null"))).alias("arguments"), F.col("call_id").alias("id"),
        "level", F.col("result"), "status", "tool"), {"ignoreNullFields": "false"})
    return out.select("call_id", "tool", "level", "n_results", "errors", "status", line.alias("line"))


SCHEMAS = {
    "answer": {"properties": {"text": {"type": "string", "maxLength": 2000}, "turn": {"type": "integer", "minimum": 0}},
               "required": ["text", "turn"], "additionalProperties": False},
    "guide": {"properties": {"text": {"type": "string"}, "role": {"type": "string", "enum": ["system"]}}, "required": ["role", "text"]},
}

_ORACLE = """
with t as (select conv_id, turn, role, text, conv_id::varchar||'-'||turn::varchar as id from conversations),
c as (select *, case when role='system' then 'guide' else 'answer' end as tool from t where role<>'assistant'),
r as (select conv_id, turn-1 as turn, text from t where role='assistant'),
g as (select conv_id, turn, turn-2*row_number() over (partition by conv_id, turn%2 order by turn) as island, turn%2 as odd from c),
l as (select conv_id, turn, row_number() over (partition by conv_id, odd, island order by turn)-1 as level,
  turn>=2 and row_number() over (partition by conv_id, odd, island order by turn)=1 as broken from g),
a as (select c.*, level, broken, r.text as result, (r.turn is not null)::int as n_results,
  tool='answer' and turn%7=3 as no_turn, tool='answer' and turn%7=5 as as_text, length(c.text)>2000 and tool='answer' as long
  from c join l using (conv_id, turn) left join r using (conv_id, turn)),
e as (select *, concat_ws('; ', case when long then 'length of text' end, case when no_turn then 'missing turn' end, case when as_text then 'type of turn' end) as errors from a),
s as (select *, case when errors<>'' then 'invalid' when broken then 'broken' when n_results=0 then 'open' else 'ok' end as status from e)
select id as call_id, tool, level, n_results::bigint as n_results, errors, status,
 '{"arguments":{'||case when tool='guide' then '"role":"system","text":'||to_json(text)::varchar
   else '"text":'||to_json(text)::varchar||case when no_turn then '' when as_text then ',"turn":"'||turn::varchar||'"' else ',"turn":'||turn::varchar end end
 ||'},"id":"'||id||'","level":'||level::varchar||',"result":'||coalesce(to_json(result)::varchar,'null')||',"status":"'||status||'","tool":"'||tool||'"}' as line from s
"""


@query("op1_tool_calls", _ORACLE)
def op1_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """System and user turns become calls, the assistant turn behind one its result; a call needs the one two turns before."""
    t = table(spark, sf_dir, "conversations")
    ident = F.concat_ws("-", "conv_id", "turn")
    asked = F.col("role") != "assistant"
    text = F.to_json(F.struct("text"))
    body = F.regexp_extract(text, "^\\{(.*)\\}$", 1)
    turn = F.when(F.col("turn") % 7 == 3, "").when(F.col("turn") % 7 == 5, F.concat(F.lit('"turn" : "'), "turn", F.lit('", '))).otherwise(
        F.concat(F.lit('"turn" : '), "turn", F.lit(", ")))
    arguments = F.when(F.col("role") == "system", F.concat(F.lit("{"), body, F.lit(', "role": "system"}'))).otherwise(
        F.concat(F.lit("{ "), turn, body, F.lit(" }")))
    calls = t.filter(asked).select(ident.alias("call_id"), F.when(F.col("role") == "system", "guide").otherwise("answer").alias("tool"),
                                   arguments.alias("arguments"))
    results = t.filter("role = 'assistant'").select(F.concat_ws("-", "conv_id", F.col("turn") - 1).alias("call_id"),
                                                    F.col("turn").alias("seq"), F.col("text").alias("content"))
    needs = t.filter(asked & (F.col("turn") >= 2)).select(ident.alias("call_id"), F.concat_ws("-", "conv_id", F.col("turn") - 2).alias("needs"))
    return link(calls, results, needs, SCHEMAS)
