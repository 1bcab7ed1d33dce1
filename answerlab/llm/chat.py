"""Tool-call linking for conversations, in DataFrame operations only.

Calls are joined with their results by identifier (a shuffled hash join on conversation and id), brought
into an order in which every call comes after those it depends on, checked against the schemas of the
tools, and written as canonical JSON: keys in ascending order at every depth, no blanks, no null members.

``step`` is the length of the longest chain of calls that a call depends on; (step, turn, call_id) is a
topological order. It takes a round for every step; each round only joins the edges still open, and is
written to the shared folder. Calls on a cycle, or behind one, have no step.

Defined results: a call without a result has none in its JSON and the problem ``no_result``; of several
results the one of the lowest turn (then text) counts; a dependency on an unknown call is ignored and
noted as ``unknown_dependency``; a null conversation or id links to nothing and has step 0; calls that
share an identifier share result and step; null or invalid arguments are ``bad_json`` and serialised as
null. :func:`link_turns` lists results that answer no call, and those of a call beyond the one that counts, as
rows of their own with the problems ``no_call`` and ``surplus_result``; a repeat of the one that counts is that result.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from answerlab.session import materialise

#: What schema_of_variant says of values of each JSON type.
_KINDS = {
    "string": "STRING",
    "integer": "BIGINT",
    "number": "(BIGINT|DOUBLE|DECIMAL.*)",
    "boolean": "BOOLEAN",
    "object": "OBJECT<.*",
    "array": "ARRAY<.*",
}


@dataclass(frozen=True)
class Tool:
    """Name of a tool and the JSON types of its arguments."""

    name: str
    required: dict[str, str] = field(default_factory=dict)
    optional: dict[str, str] = field(default_factory=dict)


def argument_problems(name: Column, arguments: Column, tools: list[Tool]) -> Column:
    """What is wrong with the arguments, as an array of words; empty where all is well."""
    value = F.try_parse_json(arguments)
    none = F.array().cast("array<string>")

    def note(wrong: Column, what: str) -> Column:
        return F.when(wrong, F.array(F.lit(what))).otherwise(none)

    def of(tool: Tool) -> Column:
        notes = [none]
        for key, kind in {**tool.required, **tool.optional}.items():
            found = F.schema_of_variant(F.try_variant_get(value, f"$['{key}']", "variant"))
            if key in tool.required:
                notes.append(note(found.isNull(), f"missing:{key}"))
            notes.append(note(found.isNotNull() & ~found.rlike(f"(?s)^{_KINDS[kind]}$"), f"type:{key}"))
        known = F.array(*[F.lit(key) for key in {**tool.required, **tool.optional}]).cast("array<string>")
        extra = F.array_except(F.coalesce(F.json_object_keys(arguments), none), known)
        notes.append(F.transform(F.array_sort(extra), lambda key: F.concat(F.lit("extra:"), key)))
        return F.concat(*notes)

    is_object = F.coalesce(F.schema_of_variant(value).rlike("(?s)^OBJECT<.*"), F.lit(False))
    checked = F.array(F.lit("unknown_tool"))
    for tool in tools:
        checked = F.when(name == tool.name, of(tool)).otherwise(checked)
    return F.when(~is_object, F.array(F.lit("bad_json"))).otherwise(checked)


def steps(keys: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv, id, step) of every key; ``edges`` are (conv, id, on) between keys, without repeats."""
    open_edges = materialise(edges)
    waiting = open_edges.select("conv", "id").distinct()
    ready = materialise(keys.join(waiting, ["conv", "id"], "left_anti").withColumn("step", F.lit(0)))
    done = [ready]
    while True:
        freed = ready.select("conv", F.col("id").alias("on"))
        left = materialise(open_edges.join(freed, ["conv", "on"], "left_anti"))
        # A call is ready once no edge of it is open any more.
        before = open_edges.select("conv", "id").distinct()
        ready = before.join(left.select("conv", "id").distinct(), ["conv", "id"], "left_anti")
        ready = materialise(ready.withColumn("step", F.lit(len(done))))
        if ready.isEmpty():
            return reduce(DataFrame.unionByName, done)
        done.append(ready)
        open_edges = left


def link_tool_calls(calls: DataFrame, results: DataFrame, tools: list[Tool]) -> DataFrame:
    """One row per call: conv_id, turn, call_id, step, problems, json.

    ``calls``: conv_id, turn, call_id, name, arguments (JSON text), depends_on (array of call ids).
    ``results``: conv_id, turn, call_id, content. Other columns are not read.
    """
    rows = calls.select("conv_id", "turn", "call_id", "name", "arguments", "depends_on")
    linked = F.col("conv_id").isNotNull() & F.col("call_id").isNotNull()
    keys = rows.where(linked).select(F.col("conv_id").alias("conv"), F.col("call_id").alias("id")).distinct()
    wanted = rows.where(linked).select(
        F.col("conv_id").alias("conv"), F.col("call_id").alias("id"), F.explode("depends_on").alias("on")
    )
    targets = keys.withColumnRenamed("id", "on")
    edges = wanted.where(F.col("on").isNotNull()).distinct().join(targets, ["conv", "on"], "left_semi")
    placed = steps(keys, edges.select("conv", "id", "on"))
    # Results are reduced to one for each identifier before they are the build side of the hash join.
    first = (
        results.where(F.col("conv_id").isNotNull() & F.col("call_id").isNotNull())
        .groupBy(F.col("conv_id").alias("conv"), F.col("call_id").alias("id"))
        .agg(F.min(F.struct("turn", "content")).alias("_first"))
    )
    known = edges.groupBy("conv", "id").agg(F.count(F.lit(1)).alias("_resolved"))
    facts = keys.join(placed, ["conv", "id"], "left").join(known, ["conv", "id"], "left").join(first, ["conv", "id"], "left")
    facts = facts.withColumn("_found", F.lit(True))
    joined = rows.join(
        facts.hint("shuffle_hash"), (rows["conv_id"] == facts["conv"]) & (rows["call_id"] == facts["id"]), "left"
    )
    asked = F.size(F.array_distinct(F.filter(F.coalesce("depends_on", F.array().cast("array<string>")), lambda d: d.isNotNull())))
    none = F.array().cast("array<string>")
    notes = [
        argument_problems(F.col("name"), F.col("arguments"), tools),
        F.when(F.col("_first").isNull(), F.array(F.lit("no_result"))).otherwise(none),
        F.when(asked > F.coalesce("_resolved", F.lit(0)), F.array(F.lit("unknown_dependency"))).otherwise(none),
        F.when(F.col("_found") & F.col("step").isNull(), F.array(F.lit("cycle"))).otherwise(none),
    ]
    # Members in ascending order of their names; a variant keeps its keys in that order at every depth.
    message = F.struct(
        F.try_parse_json("arguments").alias("arguments"),
        F.array_sort(F.filter("depends_on", lambda d: d.isNotNull())).alias("depends_on"),
        F.col("call_id").alias("id"),
        F.col("name"),
        F.col("_first.content").alias("result"),
    )
    return joined.select(
        "conv_id",
        "turn",
        "call_id",
        F.when(F.col("_found"), F.col("step")).otherwise(F.lit(0)).cast("int").alias("step"),
        F.array_join(F.array_sort(F.concat(*notes)), ",").alias("problems"),
        F.to_json(message).alias("json"),
    )


def orphan_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results that answer no call."""
    known = calls.select("conv_id", "call_id").distinct()
    return results.join(known, ["conv_id", "call_id"], "left_anti")


def unlinked_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Results that are in no call's JSON, in the columns of :func:`link_tool_calls`; they have no step.

    The result that counts is an aggregate put back by a hash join, so results of one call are never put in order.
    """
    keys = ["conv_id", "call_id"]
    rows = results.select("conv_id", "turn", "call_id", "content")
    known = calls.select(*keys).distinct().join(
        rows.groupBy(*keys).agg(F.min(F.struct("turn", "content")).alias("_first")), keys
    )
    found = rows.join(known.hint("shuffle_hash"), keys, "left")
    problem = F.when(F.col("_first").isNull(), "no_call").when(
        ~F.struct("turn", "content").eqNullSafe(F.col("_first")), "surplus_result"
    )
    message = F.struct(F.col("call_id").alias("id"), F.col("content").alias("result"))
    return found.withColumn("problems", problem).where("problems is not null").select(
        "conv_id", "turn", "call_id", F.lit(None).cast("int").alias("step"), "problems", F.to_json(message).alias("json")
    )


def link_turns(calls: DataFrame, results: DataFrame, tools: list[Tool]) -> DataFrame:
    """All calls as by :func:`link_tool_calls`, and all results that are in none of them."""
    return link_tool_calls(calls, results, tools).unionByName(unlinked_results(calls, results))


def calls_from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results read into a table of plain turns (conv_id, turn, role, text).

    An assistant's turn is a call whose tool depends on the turn's number and whose arguments hold its whole
    text; it builds on the calls at a half and a third of its number. A user's turn is the result of the
    call before it.
    """
    here = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))

    def at(turn: Column) -> Column:
        return F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))

    size = F.length(F.coalesce("text", F.lit("")))
    text = F.coalesce("text", F.lit(""))
    arguments = (
        F.when(F.col("turn") % 3 == 1, F.when(
            size % 7 == 0, F.to_json(F.struct(text.alias("query"), (size % 50).cast("string").alias("limit")))
        ).otherwise(F.to_json(F.struct(text.alias("query"), (size % 50).alias("limit")))))
        .when(F.col("turn") % 3 == 0, F.to_json(F.struct((size % 2 == 0).alias("formal"), text.alias("text"))))
        .otherwise(F.to_json(F.struct(text.alias("note"))))
    )
    name = F.when(F.col("turn") % 3 == 1, "search").when(F.col("turn") % 3 == 0, "translate").otherwise("remember")
    earlier = [at(F.floor(F.col("turn") / part)) for part in (2, 3)]
    calls = turns.where(F.col("role") == "assistant").select(
        "conv_id",
        "turn",
        F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), here).alias("call_id"),
        name.alias("name"),
        arguments.alias("arguments"),
        F.when(F.col("turn") > 1, F.array_distinct(F.array(*earlier)))
        .otherwise(F.array().cast("array<string>"))
        .alias("depends_on"),
    )
    results = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", at(F.col("turn") - 1).alias("call_id"), F.col("text").alias("content")
    )
    return calls, results


TOOLS = [
    Tool("search", {"query": "string", "limit": "integer"}),
    Tool("translate", {"text": "string"}, {"formal": "boolean"}),
]

ORACLE_SQL = """
WITH RECURSIVE a AS (
  SELECT conv_id, turn, conv_id || ':' || turn AS id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n
  FROM conversations WHERE role = 'assistant'),
ids AS (SELECT DISTINCT conv_id, turn, id FROM a),
deps AS (
  SELECT DISTINCT x.id, d.id AS on_id FROM ids x JOIN ids d
  ON d.conv_id = x.conv_id AND d.turn IN (x.turn // 2, x.turn // 3) WHERE x.turn > 1),
walk AS (
  SELECT id, 0 AS step FROM ids UNION SELECT deps.id, walk.step + 1 FROM walk JOIN deps ON deps.on_id = walk.id),
steps AS (SELECT id, max(step) AS step FROM walk GROUP BY id),
resolved AS (SELECT id, count(*) AS n_resolved FROM deps GROUP BY id),
results AS (
  SELECT conv_id || ':' || (turn - 1) AS id, min({'turn': turn, 'content': text}) AS r
  FROM conversations WHERE role = 'user' GROUP BY 1),
calls AS (
  SELECT a.conv_id, a.turn, a.id, steps.step, r, a.n, a.t,
    CASE a.turn % 3 WHEN 1 THEN 'search' WHEN 0 THEN 'translate' ELSE 'remember' END AS name,
    CASE WHEN a.turn <= 1 THEN 0 WHEN a.turn // 2 = a.turn // 3 THEN 1 ELSE 2 END AS asked,
    coalesce(n_resolved, 0) AS n_resolved
  FROM a JOIN steps ON steps.id = a.id LEFT JOIN resolved ON resolved.id = a.id LEFT JOIN results ON results.id = a.id)
SELECT conv_id, turn, id AS call_id, CAST(step AS INTEGER) AS step,
  array_to_string(list_sort([p FOR p IN [
    CASE WHEN r IS NULL THEN 'no_result' END,
    CASE WHEN name = 'search' AND n % 7 = 0 THEN 'type:limit' END,
    CASE WHEN name = 'remember' THEN 'unknown_tool' END,
    CASE WHEN asked > n_resolved THEN 'unknown_dependency' END] IF p IS NOT NULL]), ',') AS problems,
  '{"arguments":' || CASE name
    WHEN 'search' THEN '{"limit":' || CASE WHEN n % 7 = 0 THEN '"' || (n % 50) || '"' ELSE '' || (n % 50) END
      || ',"query":' || CAST(to_json(t) AS VARCHAR) || '}'
    WHEN 'translate' THEN '{"formal":' || (n % 2 = 0) || ',"text":' || CAST(to_json(t) AS VARCHAR) || '}'
    ELSE '{"note":' || CAST(to_json(t) AS VARCHAR) || '}' END
  || ',"depends_on":[' || CASE WHEN asked = 0 THEN '' ELSE array_to_string([CAST(to_json(x) AS VARCHAR) FOR x IN
    list_sort(list_distinct([conv_id || ':' || (turn // 2), conv_id || ':' || (turn // 3)]))], ',') END
  || '],"id":' || CAST(to_json(id) AS VARCHAR) || ',"name":"' || name || '"'
  || CASE WHEN r.content IS NULL THEN '' ELSE ',"result":' || CAST(to_json(r.content) AS VARCHAR) END || '}' AS json
FROM calls
UNION ALL
SELECT u.conv_id, u.turn, u.id, NULL, CASE WHEN u.id IN (SELECT id FROM ids WHERE id IS NOT NULL) THEN 'surplus_result' ELSE 'no_call' END,
  '{' || array_to_string([p FOR p IN [
    '"id":' || CAST(to_json(u.id) AS VARCHAR), '"result":' || CAST(to_json(u.text) AS VARCHAR)] IF p IS NOT NULL], ',') || '}'
FROM (SELECT *, conv_id || ':' || (turn - 1) AS id FROM conversations WHERE role = 'user') u
WHERE NOT EXISTS (
  SELECT 1 FROM ids JOIN results ON results.id = ids.id
  WHERE ids.id = u.id AND r.turn IS NOT DISTINCT FROM u.turn AND r.content IS NOT DISTINCT FROM u.text)
"""
