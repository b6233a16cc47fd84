"""Tool-call linking and canonical serialisation, in DataFrame functions only.

Calls and results are hash-joined by conversation and identifier. The level of a call is the number of calls on the
longest chain of references below it; calls on a cycle, or behind one, get no level and an error. In each round every
open reference moves on: to the level of its target where that is known, through its target where that has one open
reference only. So unbranched chains take rounds in the logarithm of their length, other calls one for each branching
below them, and the number of references never grows. Arguments are checked against the tools' schemas, and each call becomes one canonical JSON
record: keys sorted at every depth, no white space.

Defined results: a call without a result has linked = false and a null result; of several results for one identifier
the one of the earliest turn (then the least content) is linked and n_results counts them; a call without conversation
or identifier is linked with nothing; arguments that are null or not JSON give the error `json`; references to calls
that do not exist are counted in `dangling` and order nothing; repeated calls are rows of their own and share their
identifier's references; turns may be null and order nothing; extra columns are ignored, whatever their names; empty
tables give no rows. Every join key holds the identifier, so one very long conversation spreads.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import mark, release
from .common import materialize

#: tool -> (parameter, kind, required); kinds: string integer number boolean array object.
Schemas = Mapping[str, Sequence[tuple[str, str, bool]]]
_KINDS = {
    "string": r"^STRING$",
    "integer": r"^(BIGINT|DECIMAL\(\d+,0\))$",
    "number": r"^(BIGINT|DOUBLE|FLOAT|DECIMAL\(\d+,\d+\))$",
    "boolean": r"^BOOLEAN$",
    "array": r"^ARRAY<",
    "object": r"^OBJECT<",
}
_ID = ["conv_id", "call_id"]


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """Sorted array of json, tool, missing:<p>, type:<p> and unknown:<p>; empty if the arguments are valid."""
    parsed = F.try_parse_json(arguments)
    is_object = F.schema_of_variant(parsed).rlike("^OBJECT<")
    keys = F.json_object_keys(F.to_json(parsed))
    out = F.array(F.lit("tool"))
    for tool, parameters in schemas.items():
        found = []
        for p, kind, required in parameters:
            here = F.array_contains(keys, p)
            value = F.schema_of_variant(F.variant_get(parsed, f"$['{p}']", "variant"))
            if required:
                found.append(F.when(~here, F.lit(f"missing:{p}")))
            found.append(F.when(here & ~F.coalesce(value.rlike(_KINDS[kind]), F.lit(False)), F.lit(f"type:{p}")))
        known = F.array(*[F.lit(p) for p, _, _ in parameters]).cast("array<string>")
        extra = F.transform(F.array_except(keys, known), lambda k: F.concat(F.lit("unknown:"), k))
        wrong = F.array_compact(F.array(*found)) if found else F.array().cast("array<string>")
        out = F.when(name == tool, F.concat(wrong, extra)).otherwise(out)
    return F.array_sort(F.when(F.coalesce(is_object, F.lit(False)), out).otherwise(F.array(F.lit("json"))))


def levels(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, level, dangling) of the calls that refer to others: null level on or behind a cycle.

    Calls that are not listed have level 0 and nothing dangling.
    """
    ids = calls.filter("conv_id is not null and call_id is not null").select(*_ID, "refs")
    known = ids.select("conv_id", F.col("call_id").alias("ref")).distinct().withColumn("there", F.lit(True))
    refs = ids.select(*_ID, F.explode("refs").alias("ref")).groupBy(*_ID, "ref").agg(F.count("*").alias("times"))
    edges = materialize(refs.join(known, ["conv_id", "ref"], "left").select(*_ID, "ref", "times", "there"), "references")
    loose = edges.groupBy(*_ID).agg(F.coalesce(F.sum(F.when(F.col("there").isNull(), F.col("times"))), F.lit(0)).alias("dangling"))
    # Calls with the least level known so far and their open references (ref, references away); a call has few.
    some = edges.filter("there")
    opened = some.groupBy(*_ID).agg(F.lit(0).alias("level"), F.collect_list(F.struct("ref", F.lit(1).alias("away"))).alias("open"))
    ends = some.select("conv_id", F.col("ref").alias("call_id")).distinct().join(opened, _ID, "left_anti")
    kind = "array<struct<ref:string,away:int>>"
    opened = opened.withColumn("open", F.col("open").cast(kind))
    since = mark()
    state = materialize(opened.unionByName(ends.select(*_ID, F.lit(0).alias("level"), F.array().cast(kind).alias("open"))), "levels")
    closed = -1
    while True:
        now, left = state.agg(F.count_if(F.size("open") == 0), F.count_if(F.size("open") > 0)).first()
        if not left or now == closed:  # where nothing closes, every open call leads to a cycle
            break
        closed = now
        target = state.filter(F.size("open") <= 1).select(
            "conv_id", F.col("call_id").alias("ref"), F.col("level").alias("below"), F.get("open", F.lit(0)).alias("next"), F.lit(True).alias("known")
        )
        each = state.filter(F.size("open") > 0).select(*_ID, "level", F.explode("open").alias("o")).select(*_ID, "level", "o.ref", "o.away")
        moved = each.join(target, ["conv_id", "ref"], "left")
        on = F.when(F.col("known").isNull(), F.struct("ref", "away")).when(
            F.col("next").isNotNull(), F.struct(F.col("next.ref").alias("ref"), (F.col("away") + F.col("next.away")).alias("away"))
        )
        grown = moved.groupBy(*_ID).agg(
            F.max(F.greatest("level", F.coalesce(F.col("away") + F.col("below"), F.lit(0)))).alias("level"), F.collect_list(on).alias("open")
        )
        names = F.array_distinct(F.transform("open", lambda o: o["ref"]))
        longest = F.transform(
            names, lambda r: F.struct(r.alias("ref"), F.array_max(F.transform(F.filter("open", lambda o: o["ref"] == r), lambda o: o["away"])).alias("away"))
        )
        state = materialize(state.filter(F.size("open") == 0).unionByName(grown.withColumn("open", longest.cast(kind))), "levels")
        release(calls.sparkSession, since, keep=1)
    placed = state.select(*_ID, F.when(F.size("open") == 0, F.col("level")).alias("found"), F.lit(True).alias("chained"))
    return loose.join(placed, _ID, "left").select(*_ID, "dangling", F.when(F.col("chained"), F.col("found")).otherwise(F.lit(0)).alias("level"))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call: conv_id, turn, call_id, name, level, dangling, linked, n_results, valid, errors, record.

    calls(conv_id, turn, call_id, name, arguments, refs), results(conv_id, call_id, turn, content). Ordered by
    (level, turn, call_id), the calls of a conversation are in topological order.
    """
    calls = calls.select(*_ID, "turn", "name", "arguments", "refs")
    best = (
        results.select(*_ID, "turn", "content")
        .filter("conv_id is not null and call_id is not null")
        .groupBy(*_ID)
        .agg(F.min(F.struct("turn", "content")).alias("first"), F.count("*").alias("n_results"))
    )
    joined = calls.join(best, _ID, "left").join(levels(calls), _ID, "left")
    cycle = F.col("dangling").isNotNull() & F.col("level").isNull()
    wrong = F.concat(argument_errors(F.col("name"), F.col("arguments"), schemas), F.when(cycle, F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>")))
    record = F.to_json(
        F.struct(
            F.try_parse_json("arguments").alias("arguments"),
            F.col("call_id").alias("id"),
            F.col("name"),
            F.col("first.content").alias("result"),
        ),
        {"ignoreNullFields": "false"},
    )
    return (
        joined.withColumn("errors", wrong)
        .withColumn("record", record)
        .select(
            "conv_id",
            "turn",
            "call_id",
            "name",
            F.when(cycle, F.lit(None)).otherwise(F.coalesce("level", F.lit(0))).cast("int").alias("level"),
            F.coalesce("dangling", F.lit(0)).cast("long").alias("dangling"),
            F.col("n_results").isNotNull().alias("linked"),
            F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
            (F.size("errors") == 0).alias("valid"),
            F.array_join("errors", ",").alias("errors"),
            "record",
        )
    )


#: The tools that plain conversations are read as calling.
TOOLS = {
    "chat.reply": [("prompt", "string", True), ("turn", "integer", True)],
    "chat.search": [("query", "string", True), ("limit", "integer", True), ("exact", "boolean", False)],
    "chat.note": [("body", "object", True)],
}


def from_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results of plain conversations(conv_id, turn, role, text).

    A user turn is a call, named by conversation and turn; the assistant turn that follows bears its identifier. It
    refers to the user turn two before; a text whose length is a multiple of 11 also refers to the turn two after, which
    refers back: a cycle. The tool and the shape of its arguments follow from the length of the text, so that all tools,
    a tool without schema, wrong types, missing and unknown parameters occur.
    """

    def name(turn: Column) -> Column:
        return F.concat(F.col("conv_id").cast("string"), F.lit(":"), turn.cast("string"))

    turn, text, n = F.col("turn"), F.col("text"), F.length("text")
    tool = F.when(n % 5 == 1, "chat.search").when(n % 5 == 2, "chat.note").when(n % 25 == 3, "chat.lost").otherwise("chat.reply")
    limit = F.to_json(F.struct(F.lit(10).alias("limit"), text.alias("query")))
    worded = F.to_json(F.struct(F.lit("yes").alias("exact"), F.lit("10").alias("limit"), text.alias("query")))
    note = F.to_json(F.struct(F.struct(turn.alias("at"), F.array(F.lit(1), F.lit(2)).alias("list"), text.alias("text")).alias("body"), F.lit(1).alias("odd")))
    plain = F.to_json(F.struct(text.alias("prompt"), turn.alias("turn")))
    arguments = F.when(tool == "chat.search", F.when(n % 2 == 0, worded).otherwise(limit)).when(tool == "chat.note", note).otherwise(plain)
    back = F.when((turn >= 2) & name(turn).isNotNull(), name(turn - 2))
    ahead = F.when((n % 11 == 0) & name(turn).isNotNull(), name(turn + 2))
    calls = turns.filter("role = 'user'").select(
        "conv_id", "turn", name(turn).alias("call_id"), tool.alias("name"), arguments.alias("arguments"), F.array_compact(F.array(back, ahead)).alias("refs")
    )
    results = turns.filter("role = 'assistant'").select("conv_id", name(turn - 1).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
