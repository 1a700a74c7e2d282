"""Chat formatting: linking tool calls with their results; DataFrame functions only.

Calls and results meet in a hash join on conversation and identifier. Calls are
put into a topological order of their dependencies: where all of a
conversation's dependencies point backward its own sequence is one, elsewhere
levels are peeled off round by round. Arguments are parsed as variants, checked
against their tool's schema, and serialised as canonical JSON (sorted keys, no
white space).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, written

#: The types of a schema and the variant types that satisfy them.
TYPES = {
    "string": ["STRING"],
    "integer": ["BIGINT"],
    "number": ["BIGINT", "DOUBLE", r"DECIMAL\(.*"],
    "boolean": ["BOOLEAN"],
    "object": [r"OBJECT<.*"],
    "array": [r"ARRAY<.*"],
}


def canonical_json(text: Column) -> Column:
    """Canonical JSON of a JSON text: keys sorted at every depth, no white space; null if it cannot be parsed."""
    return F.to_json(F.try_parse_json(text))


def numbered(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """Adds the position (from 1) of each row among those with its key, in the given order (no ties).

    Rows are dealt by ranges of key and order, which also cut through a key that
    has many; they are numbered within a range and offset by the ranges before.
    A key has as many ranges as there are partitions at most.
    """
    dealt = written(rows.repartitionByRange(key, *order).withColumn("range__", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy(key, "range__").agg(F.count("*").alias("n__"))
    before = Window.partitionBy(key).orderBy("range__").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        F.col(key).alias("key__"), F.col("range__").alias("r__"), F.coalesce(F.sum("n__").over(before), F.lit(0)).alias("before__")
    )
    inside = Window.partitionBy(key, "range__").orderBy(*order)
    same = F.col(key).eqNullSafe(F.col("key__")) & (F.col("range__") == F.col("r__"))
    out = dealt.withColumn("at__", F.row_number().over(inside)).join(offsets, same)
    return out.select(*rows.columns, (F.col("before__") + F.col("at__")).cast("long").alias(name))


def levels(calls: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, call_id, level) for conversations that have a dependency on a later call; level null on a cycle.

    A call's level is the length of the longest chain of calls below it. Each
    round settles the calls without an open dependency, in every conversation at
    once. Where a call waits for a call that waits for one other alone, its
    dependency is moved on to that other with the steps between added up, so a
    plain chain takes as many rounds as its length has binary digits. There is no
    limit on rounds: while any call is off the cycles a round settles one, and
    when a round settles none the rest waits for a cycle.
    """
    key = ["conv_id", "call_id"]
    one, zero = F.lit(1).cast("long"), F.lit(0).cast("long")
    nodes = calls.select(*key).distinct().withColumn("level", zero)
    open_ = written(edges.select(*key, "needs").distinct().withColumn("steps", one), "edges")
    left = state = None
    while True:
        waits = open_.groupBy(*key).agg(F.count("*").alias("n"), F.min("needs").alias("next"), F.max("steps").alias("more"))
        last, state = state, written(nodes.join(waits, key, "left"), "calls")
        if last is not None:
            discard(last, stepped)  # noqa: F821  the round before has made both
        now = state.where("n is not null").count()
        if now == 0 or now == left:
            break
        left = now
        below = state.select("conv_id", F.col("call_id").alias("needs"), F.col("level").alias("least"), "n", "next", "more")
        # Steps round a cycle double for ever; the bound, far above any count of calls, keeps them within a long.
        moved = F.least(F.col("steps") + F.col("more"), F.lit(1 << 60))
        passed = F.col("n") == 1
        stepped = written(
            open_.join(below, ["conv_id", "needs"]).select(
                *key,
                F.when(F.col("n").isNull(), F.lit(None)).when(passed, F.col("next")).otherwise(F.col("needs")).alias("needs"),
                F.when(passed, moved).otherwise(F.col("steps")).alias("steps"),
                F.least(F.col("least") + F.col("steps"), F.lit(1 << 60)).alias("least"),
            ),
            "edges",
        )
        least = stepped.groupBy(*key).agg(F.max("least").alias("least"))
        nodes = state.select(*key, "level").join(least, key, "left").select(*key, F.greatest("level", "least").alias("level"))
        closed = open_
        open_ = written(stepped.where("needs is not null").groupBy(*key, "needs").agg(F.max("steps").alias("steps")), "edges")
        discard(closed)
    return state.select(*key, F.when(F.col("n").isNull(), F.col("level")).alias("level"))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """Linked, ordered, validated and serialised tool calls.

    calls: conv_id, seq (long), call_id, tool, arguments (JSON text), depends_on
    (array of call_ids). results: conv_id, call_id, output. schemas: tool, field,
    type (see TYPES), required (boolean), low and high (bounds of a number, of a
    string's length), one row a field; a bounded table of its tools.

    Returns conv_id, call_id, seq, position (from 1 in topological order; null
    on a cycle), n_results, link ('linked', 'missing', 'ambiguous' for several
    results, 'duplicate' for a repeated call_id), errors (sorted texts, empty if
    valid) and json. Null call_ids link with nothing and are 'missing'; results
    without a call are reported by `orphans`. A dependency on an unknown call is
    an error; it does not hold up the order. Malformed or non-object arguments
    are the one error 'arguments: not an object', and serialise as null.
    Repeated rows of one call_id give as many rows. Of several results the
    smallest output is serialised. Columns other than those named are not read,
    whatever their names; empty tables give an empty result. A very long
    argument or output text is one value of its row.
    """
    calls = calls.select("conv_id", "seq", "call_id", "tool", "arguments", "depends_on")
    results = results.select("conv_id", "call_id", "output")
    schemas = schemas.select("tool", "field", "type", "required", "low", "high")
    found = results.where("call_id is not null").groupBy("conv_id", "call_id").agg(
        F.count("*").alias("n_results"), F.min("output").alias("output")
    )
    again = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.count("*").alias("copies"), F.min("seq").alias("first"))
    linked = calls.join(found, ["conv_id", "call_id"], "left").join(again, ["conv_id", "call_id"], "left")
    calls = written(linked.withColumn("row", F.monotonically_increasing_id()), "linked")

    edges = (
        calls.where("call_id is not null")
        .select("conv_id", "call_id", F.col("first").alias("at"), F.explode("depends_on").alias("needs"))
        .where("needs is not null")
        .distinct()
    )
    known = again.select(F.col("conv_id").alias("c"), F.col("call_id").alias("needed"), F.col("first").alias("needed_at"))
    edges = edges.join(known, (F.col("conv_id") == F.col("c")) & (F.col("needs") == F.col("needed")), "left").drop("c")
    edges = written(edges, "edges")
    unknown = edges.where("needed is null").groupBy("conv_id", "call_id").agg(
        F.sort_array(F.collect_set(F.concat(F.lit("depends_on: unknown "), "needs"))).alias("unknown")
    )
    real = edges.where("needed is not null")
    forward = written(real.where("needed_at >= at").select("conv_id").distinct(), "forward")
    if forward.take(1):
        hard = levels(again.join(forward, "conv_id", "left_semi"), real.join(forward, "conv_id", "left_semi"))
    else:
        hard = again.select("conv_id", "call_id", F.lit(None).cast("long").alias("level")).limit(0)
    hard = hard.withColumn("hard", F.lit(True))
    ranked = calls.join(hard, ["conv_id", "call_id"], "left").withColumn(
        "order", F.when(F.col("hard"), F.coalesce("level", F.lit(1 << 40))).otherwise(F.col("seq"))
    )
    ranked = numbered(ranked, "conv_id", ["order", "seq", "call_id", "row"], "position")
    position = F.when(F.coalesce("hard", F.lit(False)) & F.col("level").isNull(), F.lit(None)).otherwise(F.col("position"))

    fields = schemas.groupBy("tool").agg(F.collect_list(F.struct("field", "type", "required", "low", "high")).alias("fields"))
    parsed = F.try_parse_json("arguments")
    checked = (
        ranked.withColumn("position", position)
        .withColumn("is_object", F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)))
        .withColumn("own", F.from_json(F.when(F.col("is_object"), F.to_json(parsed)), "map<string,variant>"))
        .join(fields, "tool", "left")
        .join(unknown, ["conv_id", "call_id"], "left")
    )

    def of_field(f: Column) -> Column:
        held = F.element_at("own", f["field"])
        kind, value = F.schema_of_variant(held), held.cast("string")
        ok = F.lit(False)
        for name, kinds in TYPES.items():
            ok = ok | ((f["type"] == name) & F.coalesce(kind.rlike(f"^(?:{'|'.join(kinds)})$"), F.lit(False)))
        size = F.when(f["type"] == "string", F.length(value).cast("double")).when(f["type"].isin("integer", "number"), value.try_cast("double"))
        out_of = F.coalesce(size < f["low"], F.lit(False)) | F.coalesce(size > f["high"], F.lit(False))
        return (
            F.when(~F.array_contains(F.map_keys("own"), f["field"]), F.when(f["required"], F.concat(f["field"], F.lit(": missing"))))
            .when(~ok, F.concat(f["field"], F.lit(": not "), f["type"]))
            .when(out_of, F.concat(f["field"], F.lit(": out of bounds")))
        )

    of_fields = F.filter(F.transform("fields", of_field), lambda e: e.isNotNull())
    extra = F.transform(
        F.array_except(F.map_keys("own"), F.transform("fields", lambda f: f["field"])), lambda k: F.concat(k, F.lit(": not in schema"))
    )
    none = F.array().cast("array<string>")
    errors = F.concat(
        F.when(F.col("fields").isNull(), F.array(F.lit("tool: unknown"))).otherwise(none),
        F.when(~F.col("is_object"), F.array(F.lit("arguments: not an object"))).when(F.col("fields").isNotNull(), F.concat(of_fields, extra)).otherwise(none),
        F.coalesce("unknown", none),
    )
    link = (
        F.when(F.col("copies") > 1, "duplicate")
        .when(F.coalesce("n_results", F.lit(0)) == 0, "missing")
        .when(F.col("n_results") > 1, "ambiguous")
        .otherwise("linked")
    )
    text = lambda c: F.coalesce(F.to_json(F.try_parse_json(F.to_json(F.struct(F.col(c).alias("v"))))), F.lit('{"v":null}'))
    bare = lambda c: F.regexp_extract(F.when(F.col(c).isNull(), F.lit('{"v":null}')).otherwise(text(c)), r'(?s)^\{"v":(.*)\}$', 1)
    json = F.concat(
        F.lit('{"arguments":'),
        F.coalesce(F.when(F.col("is_object"), canonical_json(F.col("arguments"))), F.lit("null")),
        F.lit(',"id":'), bare("call_id"),
        F.lit(',"position":'), F.coalesce(F.col("position").cast("string"), F.lit("null")),
        F.lit(',"result":'), bare("output"),
        F.lit(',"tool":'), bare("tool"),
        F.lit("}"),
    )
    return checked.select(
        "conv_id",
        "call_id",
        "seq",
        "position",
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        link.alias("link"),
        F.sort_array(errors).alias("errors"),
        json.alias("json"),
    )


def orphans(calls: DataFrame, results: DataFrame) -> DataFrame:
    """The results whose conversation and identifier no call has (null identifiers too)."""
    known = calls.select("conv_id", "call_id").where("call_id is not null").distinct()
    return results.join(known, ["conv_id", "call_id"], "left_anti")


def calls_of_conversations(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Calls, results and schemas read out of plain chat turns (conv_id, turn, role, text).

    An assistant turn is a call of the tool `reply` (`brief` under 200
    characters) that depends on the nearest assistant turn two before; the
    user's next turn is its result. System turns are no calls. Null texts count
    as empty.
    """
    spoken = turns.where("conv_id is not null and turn is not null")
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("-"), turn.cast("string"))
    said = F.coalesce("text", F.lit(""))
    calls = spoken.where("role = 'assistant'").select(
        "conv_id",
        F.col("turn").cast("long").alias("seq"),
        name(F.col("turn")).alias("call_id"),
        F.when(F.length(said) < 200, "brief").otherwise("reply").alias("tool"),
        F.to_json(
            F.struct(
                said.alias("text"),
                F.length(said).alias("n_chars"),
                F.size(F.split(said, r"\n")).alias("lines"),
                F.struct(F.col("turn"), F.col("conv_id").alias("conv")).alias("at"),
            )
        ).alias("arguments"),
        F.when(F.col("turn") >= 3, F.array(name(F.col("turn") - 2))).otherwise(F.array().cast("array<string>")).alias("depends_on"),
    )
    results = spoken.where("role = 'user' and turn > 0").select(
        "conv_id", name(F.col("turn") - 1).alias("call_id"), F.col("text").alias("output")
    )
    rows = [
        (tool, field, kind, need, low, high)
        for tool, high_text in (("brief", 199.0), ("reply", 100_000_000.0))
        for field, kind, need, low, high in (
            ("text", "string", True, 1.0, high_text),
            ("n_chars", "integer", True, 1.0, high_text),
            ("lines", "integer", True, 1.0, 20.0),
            ("at", "object", False, None, None),
        )
    ]
    schema = "tool string, field string, type string, required boolean, low double, high double"
    return calls, results, turns.sparkSession.createDataFrame(rows, schema)
