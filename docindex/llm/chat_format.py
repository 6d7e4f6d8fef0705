"""Chat formatting: tool-call linking with DataFrame operations only. Calls and results are hash-joined by identifier, ordered
topologically, their arguments validated against schemas, and all is serialised as canonical JSON.

Messages are rows conv_id, turn, role, text. A text that is a JSON object with `tool_calls` ([{id, name, arguments, after}])
makes calls, one with `tool_call_id` (and `content`) is a result; every other text is a plain message. A call names at most one
call of its conversation that it comes `after`; its level is the length of that chain, found by pointer doubling in
log2(longest chain) joins, so a conversation with a third of all rows costs no more than others. Joins are on (conversation,
identifier); nothing is gathered per conversation.

Result, one row for each call (with the result linked to it), each result without call, and each plain message: conv_id, turn,
kind (call, result, message), call_id, level, status, valid, errors, json. Rows of a conversation in the order of (level, turn,
call_id) have every call behind the one it follows. JSON is canonical: sorted keys, no spaces, nulls kept.

status of calls: linked, unanswered, duplicate (a later call of an identifier; its results belong to the first), cycle (its
chain never ends; level is null); of results: orphan, or repeated (a later result of an identifier); of messages: message.

Defined results: null texts are plain messages with null content; calls without an identifier are unanswered, each by itself;
rows with a null conv_id belong to no conversation, so nothing links them: their calls are unanswered, their results orphans;
`after` an unknown identifier counts as none; arguments that aren't an object are invalid, and so are those with a key that comes
twice (they read as null); integers are numbers without a point or exponent, of 38 digits at most; ties in turn go to the smaller text; of equal rows, one is the call or its answer, and the others are
duplicate or repeated; a very long text is one value, parsed by itself; an empty table gives no rows; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: tool -> argument -> (type, required). Types: string, integer, number, boolean, array, object.
Schemas = dict[str, dict[str, tuple[str, bool]]]
# How schema_of_variant names the JSON types.
TYPES = {"string": "^STRING$", "integer": r"^(BIGINT|DECIMAL\((19|[23]\d),0\))$", "number": "^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$", "boolean": "^BOOLEAN$", "array": "^ARRAY", "object": "^OBJECT"}
MESSAGE = "tool_calls array<struct<id string, name string, arguments variant, after string>>, tool_call_id string, content string"


def problems(schemas: Schemas):
    """Array of the faults of a call's `arguments` (variant) under the schema of its `name`, sorted."""
    kinds = F.transform_values(F.expr("try_cast(arguments as map<string, variant>)"), lambda _, v: F.schema_of_variant(v))
    found = F.when(F.col("name").isNull() | ~F.col("name").isin(list(schemas)), F.array(F.lit("unknown tool")))
    for tool, fields in schemas.items():
        faults = []
        for field, (kind, required) in fields.items():
            own = F.element_at(F.col("kinds"), F.lit(field))
            faults.append(F.when(own.isNull(), F.lit(f"missing {field}") if required else None).when(~own.rlike(TYPES[kind]), F.lit(f"{field} is not {kind}")))
        more = F.transform(F.array_except(F.map_keys("kinds"), F.array(*map(F.lit, fields)) if fields else F.array().cast("array<string>")), lambda k: F.concat(F.lit("unknown "), k))
        found = found.when(F.col("name") == tool, F.array_sort(F.concat(F.array_compact(F.array(*faults, F.lit(None).cast("string"))), more)))
    return kinds, F.when(F.col("kinds").isNull(), F.array(F.lit("arguments are no object"))).otherwise(found)


def levels(calls: DataFrame) -> DataFrame:
    """conv_id, call_id, level of distinct calls (conv_id, call_id, after); level is null on and behind a cycle."""
    known = calls.select("conv_id", F.col("call_id").alias("after"))
    start = calls.join(known, ["conv_id", "after"], "left_semi").select("conv_id", "call_id", "after")
    state = calls.join(start.select("conv_id", "call_id", F.col("after").alias("to")), ["conv_id", "call_id"], "left").select("conv_id", "call_id", "to", F.when(F.col("to").isNull(), 0).otherwise(1).cast("long").alias("level"))
    state = cut(state)
    for _ in range(2 + math.ceil(math.log2(max(2, state.count())))):
        if state.filter("to is not null").isEmpty():
            break
        ahead = state.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("further"), F.col("level").alias("more"))
        state = cut(state.join(ahead, ["conv_id", "to"], "left").select("conv_id", "call_id", F.col("further").alias("to"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")))
    return state.select("conv_id", "call_id", F.when(F.col("to").isNull(), F.col("level")).alias("level"), F.col("to").isNotNull().alias("endless"))


def linked(messages: DataFrame, schemas: Schemas) -> DataFrame:
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    # a number of its own tells a row from its copies
    rows = cut(rows.withColumn("row_no", F.monotonically_increasing_id())).withColumn("m", F.from_json("text", MESSAGE))
    is_call, is_result = F.coalesce(F.size("m.tool_calls") > 0, F.lit(False)), F.col("m.tool_call_id").isNotNull()
    kinds, errors = problems(schemas)
    calls = rows.filter(is_call).select("conv_id", "turn", "row_no", F.posexplode("m.tool_calls").alias("pos", "c"))
    calls = calls.select("conv_id", "turn", "row_no", "pos", F.col("c.id").alias("call_id"), F.col("c.name").alias("name"), F.col("c.arguments").alias("arguments"), F.col("c.after").alias("after"))
    calls = calls.withColumn("place", F.struct("turn", "pos", F.to_json(F.struct("name", "arguments", "after")), "row_no"))
    first = calls.filter("call_id is not null").groupBy("conv_id", "call_id").agg(F.min("place").alias("first"), F.min_by("after", "place").alias("after"))
    first = first.select(F.col("conv_id"), "call_id", "first", "after")
    tree = levels(first)
    results = rows.filter(is_result & ~is_call).select("conv_id", "turn", "row_no", F.col("m.tool_call_id").alias("call_id"), F.col("m.content").alias("content"))
    answer = results.groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "content", "row_no")).alias("answer"))

    known = first.drop("after").join(tree, ["conv_id", "call_id"]).join(answer, ["conv_id", "call_id"], "left")
    out = calls.join(known, ["conv_id", "call_id"], "left")
    out = out.withColumn("own", F.col("first").isNotNull() & (F.col("place") == F.col("first"))).withColumn("kinds", kinds).withColumn("errors", errors)
    status = F.when(F.col("first").isNotNull() & ~F.col("own"), "duplicate").when(F.col("endless"), "cycle").when(F.col("own") & F.col("answer").isNotNull(), "linked").otherwise("unanswered")
    level = F.when(F.col("first").isNull(), F.lit(0)).otherwise(F.col("level"))
    out = out.withColumn("status", status).withColumn("level", level.cast("long")).withColumn("valid", F.size("errors") == 0)
    result = F.when(F.col("own"), F.col("answer.content"))
    json = F.to_json(F.struct("arguments", F.col("call_id").alias("id"), "level", "name", result.alias("result"), "status", "valid"), {"ignoreNullFields": "false"})
    done = out.select("conv_id", "turn", F.lit("call").alias("kind"), "call_id", "level", "status", "valid", "errors", json.alias("json"))

    of = results.join(known.select("conv_id", "call_id", "answer", "level"), ["conv_id", "call_id"], "left")
    # each linked answer is in its call's row; what else came for the identifier is told by itself
    of = of.withColumn("status", F.when(F.col("answer").isNull(), "orphan").otherwise("repeated"))
    alone = of.filter(F.col("answer").isNull() | (F.struct("turn", "content", "row_no") > F.col("answer")))
    json = F.to_json(F.struct("content", F.col("call_id").alias("id"), F.lit("tool").alias("role"), "status"), {"ignoreNullFields": "false"})
    alone = alone.select("conv_id", "turn", F.lit("result").alias("kind"), "call_id", "level", "status", F.lit(None).cast("boolean").alias("valid"), F.lit(None).cast("array<string>").alias("errors"), json.alias("json"))

    plain = rows.filter(~is_call & ~is_result)
    json = F.to_json(F.struct(F.col("text").alias("content"), "role"), {"ignoreNullFields": "false"})
    plain = plain.select("conv_id", "turn", F.lit("message").alias("kind"), F.lit(None).cast("string").alias("call_id"), F.lit(None).cast("long").alias("level"), F.lit("message").alias("status"), F.lit(None).cast("boolean").alias("valid"), F.lit(None).cast("array<string>").alias("errors"), json.alias("json"))
    return done.unionByName(alone).unionByName(plain)


def as_tool_messages(conversations: DataFrame) -> DataFrame:
    """conversations told as tool calls: each user turn calls `reply`, after the user turn two before it; the assistant's turn
    behind it is its result; other turns stay."""
    user, assistant = F.col("role") == "user", F.col("role") == "assistant"
    name = lambda t: F.concat(F.lit("c"), t.cast("string"))
    call = F.struct(name(F.col("turn")).alias("id"), F.lit("reply").alias("name"), F.struct("turn", "text").alias("arguments"), name(F.col("turn") - 2).alias("after"))
    text = F.when(user, F.to_json(F.struct(F.array(call).alias("tool_calls")))).when(assistant, F.to_json(F.struct(name(F.col("turn") - 1).alias("tool_call_id"), F.col("text").alias("content"))))
    role = F.when(user, "assistant").when(assistant, "tool").otherwise(F.col("role"))
    return conversations.select("conv_id", "turn", role.alias("role"), F.coalesce(text, F.col("text")).alias("text"))
