"""Tool-call linking for chat data, in DataFrame functions only.

Calls and results are joined by identifier. A call may name the call that it
follows; its depth in that order comes from doubling the pointers through
joins, one shuffle for twice the depth, so neither a long conversation nor a
long chain is gathered. Arguments are parsed as JSON and checked against the
tool's schema; the event is serialised as canonical JSON: keys sorted, no
space, null fields left out.

Statuses: linked, no_result, bad_arguments (unknown tool, not a JSON object,
missing or mistyped field, or a field that the schema doesn't know), cycle (a
call that follows itself at some distance; depth -1), orphan_result.

Defined cases: a call with a null identifier has no result and nothing follows
it; of calls or results with one identifier the first by (position, text) is
linked and the rest are left out of the join but kept as rows, calls as
"duplicate" with their position and event, results as "orphan_result" with
their result_position and an event of call_id and result; a predecessor that doesn't exist
counts as none; empty tables give no rows. Of chat turns, one with a null
conversation or turn has a null identifier, and one of neither a user nor an
assistant is kept as "other_turn" with its role and content. A null text is a
call without its argument; a text of any length is one JSON string. Columns
other than those named are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirework.llm.workspace import Workspace

#: A field's JSON type and the names that variants of that type have.
_TYPES = {"string": ["STRING"], "integer": ["BIGINT"], "number": ["BIGINT", "DOUBLE", "DECIMAL", "FLOAT"], "boolean": ["BOOLEAN"], "array": ["ARRAY"], "object": ["OBJECT"]}


def valid_arguments(tool: Column, arguments: Column, schemas: dict[str, dict[str, tuple[str, bool]]]) -> Column:
    """Does the variant fit the tool's fields? schemas: tool -> field -> (JSON type, required)."""
    keys = F.json_object_keys(arguments.cast("string"))
    verdict = F.lit(False)
    for name, fields in schemas.items():
        fits = F.coalesce(F.size(F.array_except(keys, F.array(*map(F.lit, fields)))) == 0, F.lit(False))
        for field, (kind, required) in fields.items():
            got = F.schema_of_variant(F.variant_get(arguments, f"$['{field}']", "variant"))
            right = F.coalesce(F.split(got, "[<(]")[0].isin(_TYPES[kind]), F.lit(not required))
            fits = fits & right
        verdict = F.when(tool == name, fits).otherwise(verdict)
    return F.coalesce(verdict, F.lit(False))


def depths(calls: DataFrame, work: Workspace, rounds: int = 60) -> DataFrame:
    """call_id, depth: calls before it on its chain of predecessors; -1 on or behind a cycle."""
    known = calls.select("call_id", "after")
    exists = calls.select(F.col("call_id").alias("after"), F.lit(True).alias("there"))
    state = known.join(exists, "after", "left").select("call_id", F.when(F.col("there"), F.col("after")).alias("to"), F.when(F.col("there"), 1).otherwise(0).cast("bigint").alias("depth"))
    state = work.save(state, "depth-0")
    total = state.count()
    for k in range(1, rounds + 1):
        open_ = state.where("to IS NOT NULL").limit(1).count()
        if not open_:
            return state.select("call_id", "depth")
        if 2 ** (k - 1) > total:
            break
        onward = state.select(F.col("call_id").alias("to"), F.col("to").alias("further"), F.col("depth").alias("more"))
        new = state.join(onward, "to", "left").select("call_id", F.col("further").alias("to"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        new = work.save(new, f"depth-{k}")
        work.drop(f"depth-{k - 1}")
        state = new
    return state.select("call_id", F.when(F.col("to").isNull(), F.col("depth")).otherwise(-1).alias("depth"))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]], *, work: Workspace | None = None) -> DataFrame:
    """One row a call, and one a result without call.

    calls: call_id, after, position, tool, arguments (JSON text).
    results: call_id, position, content.
    Gives call_id, position, result_position, depth, status, event (canonical JSON).
    """
    work = work or Workspace(calls.sparkSession)
    calls = calls.select("call_id", "after", "position", "tool", "arguments")
    results = results.select("call_id", F.col("position").alias("result_position"), "content")
    first = calls.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min(F.struct("position", "tool", "arguments", "after")).alias("x"))
    first = work.save(first.select("call_id", "x.*"), "calls")
    answer = results.where("call_id IS NOT NULL").groupBy("call_id").agg(F.min(F.struct("result_position", "content")).alias("y"))

    parsed = first.withColumn("args", F.try_parse_json("arguments"))
    valid = valid_arguments(F.col("tool"), F.col("args"), schemas)
    joined = parsed.join(answer, "call_id", "left").join(depths(first, work), "call_id")
    status = F.when(F.col("depth") < 0, "cycle").when(~valid, "bad_arguments").when(F.col("y").isNull(), "no_result").otherwise("linked")
    fields = {"arguments": F.col("args"), "call_id": F.col("call_id").cast("variant"), "result": F.col("y.content").cast("variant"), "tool": F.col("tool").cast("variant")}
    event = F.to_json(F.struct(*[v.alias(k) for k, v in sorted(fields.items())]))
    linked = joined.select("call_id", "position", F.col("y.result_position").alias("result_position"), "depth", status.alias("status"), event.alias("event"))

    none = F.lit(None)
    lost = calls.where("call_id IS NULL").select("call_id", "position", none.cast(results.schema["result_position"].dataType).alias("result_position"), F.lit(0).cast("bigint").alias("depth"), F.lit("no_result").alias("status"), F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), "tool")).alias("event"))
    # each copy of a call or result beyond the linked one, numbered in the same order as the join's choice
    order = Window.partitionBy("call_id")
    again = calls.where("call_id IS NOT NULL").withColumn("k", F.row_number().over(order.orderBy("position", "tool", "arguments", "after"))).where("k > 1")
    call = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), "call_id", "tool"))
    again = again.select("call_id", "position", none.cast(results.schema["result_position"].dataType).alias("result_position"), F.lit(0).cast("bigint").alias("depth"), F.lit("duplicate").alias("status"), call.alias("event"))
    numbered = results.where("call_id IS NOT NULL").withColumn("k", F.row_number().over(order.orderBy("result_position", "content")))
    orphan = numbered.join(first.select("call_id", F.lit(True).alias("called")), "call_id", "left").where("called IS NULL OR k > 1").select("call_id", "result_position", "content")
    orphan = orphan.unionByName(results.where("call_id IS NULL").select("call_id", "result_position", "content"))
    answered = F.to_json(F.struct("call_id", F.col("content").alias("result")))
    orphan = orphan.select("call_id", none.cast(calls.schema["position"].dataType).alias("position"), "result_position", F.lit(0).cast("bigint").alias("depth"), F.lit("orphan_result").alias("status"), answered.alias("event"))
    return linked.unionByName(lost).unionByName(again).unionByName(orphan)


def _turn(turn: Column) -> Column:
    """Identifier of a turn; null if its conversation or number is."""
    return F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(calls, results) of plain chat turns: a user's turn calls "respond", the next turn of an assistant is its result."""
    words = F.size(F.array_remove(F.split(F.translate("text", "\t\n\x0b\x0c\r", "     "), " +"), ""))
    arguments = F.to_json(F.struct(F.col("text").alias("query"), words.alias("n_words")))
    calls = messages.where("role = 'user'").select(_turn(F.col("turn")).alias("call_id"), _turn(F.col("turn") - 2).alias("after"), F.col("turn").alias("position"), F.lit("respond").alias("tool"), arguments.alias("arguments"))
    results = messages.where("role = 'assistant'").select(_turn(F.col("turn") - 1).alias("call_id"), F.col("turn").alias("position"), F.col("text").alias("content"))
    return calls, results


def link_turns(messages: DataFrame, schemas: dict[str, dict[str, tuple[str, bool]]], *, work: Workspace | None = None) -> DataFrame:
    """link() of plain chat turns, and a row for each turn of another role."""
    linked = link(*turns_as_calls(messages), schemas, work=work)
    other = messages.where("role IS NULL OR role NOT IN ('user', 'assistant')")
    event = F.to_json(F.struct(F.col("text").alias("content"), "role"))
    other = other.select(_turn(F.col("turn")).alias("call_id"), F.col("turn").alias("position"), F.lit(None).cast(linked.schema["result_position"].dataType).alias("result_position"), F.lit(0).cast("bigint").alias("depth"), F.lit("other_turn").alias("status"), event.alias("event"))
    return linked.unionByName(other)
