"""Tool-call linking in DataFrame functions only.

Calls and results are joined by identifier (of a conversation and a call). A call may name the calls it follows, one or
several; its level in topological order is one more than the highest of theirs. Stretches of calls that follow one call each are
measured by doubling pointers, in a logarithmic number of rounds; only calls that follow several take a round for each layer of
such calls. No conversation is gathered anywhere. Arguments are parsed as JSON, checked against the fields of
the tool's schema (a field may be a path into nested objects and arrays), and written as canonical JSON: keys sorted, no blanks.

Defined cases: null identifiers match nothing; of repeated calls or results the first by order stays, and of equal order the
smallest by content, nulls first; a predecessor that is missing does not count; calls on a cycle, or after one, have level null; arguments that
are not a JSON object are invalid and canonical null; a tool without schema accepts no call; results without a call are left out;
empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parallax.llm.common import cut

#: What schemas may ask of a field.
TYPES = ("STRING", "BIGINT", "DOUBLE", "BOOLEAN", "OBJECT", "ARRAY")


def canonical(json: Column) -> Column:
    """JSON with sorted keys and without blanks; null if it can't be parsed."""
    return F.to_json(F.try_parse_json(json))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) from (conv_id, call_id, after: an identifier or an array of them); null on cycles and after them."""
    after = F.col("after") if dict(calls.dtypes)["after"].startswith("array") else F.array("after")
    nodes = calls.select("conv_id", "call_id").distinct()
    named = calls.select("conv_id", "call_id", F.explode(after).alias("before")).distinct()
    edges = named.join(nodes.withColumnRenamed("call_id", "before"), ["conv_id", "before"], "left_semi")
    single = edges.groupBy("conv_id", "call_id").agg(F.count("*").alias("n"), F.min("before").alias("before"))
    # Each call looks back to the nearest one that follows none or several.
    own = nodes.join(single, ["conv_id", "call_id"], "left").select("conv_id", "call_id", F.coalesce("n", F.lit(0)).alias("n"), "before")
    one = F.col("n") == 1
    state = cut(own.select("conv_id", "call_id", "n", F.when(one, F.col("before")).otherwise(F.col("call_id")).alias("at"), one.cast("long").alias("far"), (~one).alias("ended")))
    for _ in range(max(1, state.count()).bit_length() + 1):
        if state.where("not ended").isEmpty():
            break
        other = state.select("conv_id", F.col("call_id").alias("at"), F.col("at").alias("next"), F.col("far").alias("more"), F.col("ended").alias("there"))
        state = cut(state.join(other, ["conv_id", "at"]).select("conv_id", "call_id", "n", F.col("next").alias("at"), (F.col("far") + F.col("more")).alias("far"), F.col("there").alias("ended")))
    looked = state.where("ended").select("conv_id", "call_id", "at", "far")
    known = state.where("n = 0").select("conv_id", F.col("call_id").alias("at"), F.lit(0).cast("long").alias("level"))
    # Calls that follow several, as edges to those nearest ones; what leads to a cycle has no such end and is never known.
    several = edges.join(state.where("n > 1").select("conv_id", "call_id"), ["conv_id", "call_id"], "left_semi")
    if not several.isEmpty():
        back = looked.select("conv_id", F.col("call_id").alias("before"), "at", (F.col("far") + 1).alias("far"))
        wanted = cut(several.join(back, ["conv_id", "before"], "left").select("conv_id", "call_id", "at", "far"))
        known = cut(known)
        while True:
            met = wanted.join(known, ["conv_id", "at"], "left").groupBy("conv_id", "call_id").agg(F.count("*").alias("all"), F.count("level").alias("some"), F.max(F.col("level") + F.col("far")).alias("level")).where(F.col("all") == F.col("some"))
            new = cut(met.select("conv_id", F.col("call_id").alias("at"), "level"))
            if new.isEmpty():
                break
            known = cut(known.unionByName(new))
            wanted = cut(wanted.join(new.select("conv_id", F.col("at").alias("call_id")), ["conv_id", "call_id"], "left_anti"))
    found = looked.join(known, ["conv_id", "at"], "left").select("conv_id", "call_id", (F.col("level") + F.col("far")).alias("level"))
    return nodes.join(found, ["conv_id", "call_id"], "left")


def validity(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """calls with ``valid``: each field of the tool's schema is there if required and of its type. A field is a name or a path such as a.b or a[0].b."""
    fields = schemas.groupBy("name").agg(F.collect_list(F.struct("field", "type", "required")).alias("fields"))
    v = F.try_parse_json("arguments")

    def good(f: Column) -> Column:
        kind = F.schema_of_variant(F.try_variant_get(v, F.concat(F.lit("$."), f["field"]), "variant"))
        return F.when(kind.isNull() | (kind == "VOID"), ~f["required"]).otherwise(F.regexp_extract(kind, "^[A-Z]+", 0) == f["type"])

    joined = calls.join(fields, "name", "left")
    whole = F.schema_of_variant(v).startswith("OBJECT")
    return joined.withColumn("valid", F.coalesce(whole & F.col("fields").isNotNull() & F.forall("fields", good), F.lit(False))).drop("fields")


def link(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Per call: conv_id, call_id, name, level, valid, result_order, canonical.

    calls: conv_id, call_id, order, name, arguments, after; results: conv_id, call_id, order, content;
    schemas (a few rows for each tool): name, field, type, required.
    """
    identified = "conv_id is not null and call_id is not null"
    first = F.min(F.struct("order", "name", "arguments", "after")).alias("c")
    calls = calls.where(identified).groupBy("conv_id", "call_id").agg(first).select("conv_id", "call_id", "c.name", "c.arguments", "c.after")
    answer = F.min(F.struct("order", "content")).alias("r")
    results = results.where(identified).groupBy("conv_id", "call_id").agg(answer).select("conv_id", "call_id", F.col("r.order").alias("result_order"), "r.content")
    judged = validity(calls, schemas)
    linked = judged.join(results, ["conv_id", "call_id"], "left").join(levels(calls), ["conv_id", "call_id"])
    text = F.to_json(F.struct(F.try_parse_json("arguments").alias("arguments"), F.col("call_id").alias("id"), "name", F.col("content").alias("result")), {"ignoreNullFields": "false"})
    return linked.select("conv_id", "call_id", "name", "level", "valid", "result_order", F.when(canonical(F.col("arguments")).isNotNull(), text).alias("canonical"))


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations: a user's turn calls ``respond``, the assistant's next turn is its result.

    A call follows the one two turns before.
    """
    name = lambda t: F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), t)
    turn = F.col("turn")
    calls = turns.where("role = 'user'").select("conv_id", name(turn).alias("call_id"), turn.alias("order"), F.lit("respond").alias("name"), F.to_json(F.struct("turn", "text")).alias("arguments"), name(turn - 2).alias("after"))
    results = turns.where("role = 'assistant'").select("conv_id", name(turn - 1).alias("call_id"), turn.alias("order"), F.col("text").alias("content"))
    return calls, results


def respond_schema(turns: DataFrame) -> DataFrame:
    """The schema of ``respond``, as rows."""
    rows = F.array(*[F.struct(F.lit("respond").alias("name"), F.lit(f).alias("field"), F.lit(t).alias("type"), F.lit(r).alias("required")) for f, t, r in (("text", "STRING", True), ("turn", "BIGINT", True))])
    return turns.sparkSession.range(1).select(F.explode(rows).alias("s")).select("s.*")


def report(turns: DataFrame) -> DataFrame:
    turns = turns.select("conv_id", "turn", "role", "text")
    calls, results = from_turns(turns)
    return link(calls, results, respond_schema(turns))


ORACLE_SQL = """
with recursive turns as (select distinct conv_id, turn, role, text from conversations),
calls as (select conv_id, turn, 'c' || conv_id || '-' || turn as call_id, text from turns where role = 'user'),
chain as (
  select conv_id, turn, 0::bigint as level from calls c where not exists (select 1 from calls p where p.conv_id = c.conv_id and p.turn = c.turn - 2)
  union all
  select c.conv_id, c.turn, h.level + 1 from chain h join calls c on c.conv_id = h.conv_id and c.turn = h.turn + 2)
select c.conv_id, c.call_id, 'respond' as name, h.level, c.text is not null as valid, r.turn as result_order,
  '{"arguments":{' || case when c.text is null then '' else '"text":' || to_json(c.text)::varchar || ',' end || '"turn":' || c.turn || '},"id":"' || c.call_id || '","name":"respond","result":' || coalesce(to_json(r.text)::varchar, 'null') || '}' as canonical
from calls c join chain h on h.conv_id = c.conv_id and h.turn = c.turn
left join turns r on r.conv_id = c.conv_id and r.turn = c.turn + 1 and r.role = 'assistant'
"""
