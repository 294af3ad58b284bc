"""Tool-call linking for chat formatting (native expressions only).

Calls and results of conversations are hash-joined by (conversation, call
id).  Calls are put in topological order: turns follow one another, so only
references between calls of the same turn need ordering, and these are
peeled off in rounds.  Arguments are parsed as VARIANT, checked against the
tools' schemas and written as canonical JSON (keys sorted, no blanks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cvframe.llm.common import written

#: name -> {field: (type, required)}; types as in JSON schemas.
Schemas = dict[str, dict[str, tuple[str, bool]]]

_KEYS = ["conv_id", "turn", "idx"]


def _literal(schemas: Schemas) -> Column:
    """Map of tool name to its fields, as a constant."""
    def fields(of: dict[str, tuple[str, bool]]) -> Column:
        items = [F.struct(F.lit(k).alias("field"), F.lit(t).alias("type"), F.lit(bool(r)).alias("required"))
                 for k, (t, r) in sorted(of.items())]
        return F.array(*items) if items else F.expr("cast(array() as array<struct<field:string,type:string,required:boolean>>)")

    flat: list[Column] = []
    for name, of in sorted(schemas.items()):
        flat += [F.lit(name), fields(of)]
    return F.create_map(*flat)


def _kind(variant_type: Column) -> Column:
    """JSON type of a VARIANT's schema text."""
    return (F.when(variant_type.startswith("OBJECT"), "object").when(variant_type.startswith("ARRAY"), "array")
            .when(variant_type == "BOOLEAN", "boolean").when(variant_type == "STRING", "string")
            .when(variant_type == "VOID", "null").when((variant_type == "BIGINT") | variant_type.rlike(r"^DECIMAL\(\d+,0\)$"), "integer")
            .otherwise("number"))


def validated(calls: DataFrame, schemas: Schemas) -> DataFrame:
    """Adds ``args`` (VARIANT, NULL if not JSON) and ``faults`` (array of text).

    Faults, in this order: ``no_id``, ``unknown_tool``, ``not_an_object``,
    ``missing:<field>``, ``type:<field>`` and ``extra:<field>`` by field name."""
    out = calls.withColumn("args", F.try_parse_json("arguments"))
    out = out.withColumn("kinds", F.transform_values(
        F.try_variant_get("args", "$", "map<string,variant>"), lambda k, v: _kind(F.schema_of_variant(v))))
    out = out.withColumn("wanted", F.element_at(_literal(schemas), F.coalesce(F.col("name"), F.lit("")))) if schemas else (
        out.withColumn("wanted", F.expr("cast(null as array<struct<field:string,type:string,required:boolean>>)")))
    ok = F.col("wanted").isNotNull() & F.col("kinds").isNotNull()
    none = F.expr("cast(array() as array<string>)")

    def fits(f: Column) -> Column:
        kind = F.element_at("kinds", f["field"])
        return (kind == f["type"]) | ((f["type"] == "number") & (kind == "integer"))

    missing = F.transform(F.filter("wanted", lambda f: f["required"] & ~F.map_contains_key("kinds", f["field"])),
                          lambda f: F.concat(F.lit("missing:"), f["field"]))
    wrong = F.transform(F.filter("wanted", lambda f: F.map_contains_key("kinds", f["field"]) & ~fits(f)),
                        lambda f: F.concat(F.lit("type:"), f["field"]))
    known = F.transform("wanted", lambda f: f["field"])
    extra = F.transform(F.array_sort(F.array_except(F.map_keys("kinds"), known)), lambda k: F.concat(F.lit("extra:"), k))
    faults = F.concat(
        F.when(F.col("call_id").isNull(), F.array(F.lit("no_id"))).otherwise(none),
        F.when(F.col("wanted").isNull(), F.array(F.lit("unknown_tool"))).otherwise(none),
        F.when(F.col("kinds").isNull(), F.array(F.lit("not_an_object"))).otherwise(none),
        F.when(ok, F.concat(missing, wrong, extra)).otherwise(none))
    return out.withColumn("faults", faults).drop("kinds", "wanted")


def ordered(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(levels, reference faults) of calls with ``after`` (array of call ids).

    A reference to a call of an earlier turn holds by the order of turns.
    References within a turn give levels: a call's level is one more than
    the largest of those it refers to, others have level 0 and no row here.
    Calls in or behind a cycle get level -1 and fault ``cycle``; a reference
    to a later turn is the fault ``later_reference`` and one to no call
    ``unknown_reference``, and neither orders anything.  Rounds go on until
    one resolves nothing, as many as the longest chain within a turn."""
    refs = calls.select(*_KEYS, F.explode("after").alias("ref")).distinct()
    named = calls.where(F.col("call_id").isNotNull()).groupBy("conv_id", F.col("call_id").alias("ref"), F.col("turn").alias("ref_turn")).agg(
        F.min("idx").alias("ref_idx"))
    # a conversation may be any size: the joins are keyed by conversation and call id together
    met = refs.join(named, ["conv_id", "ref"], "left")
    nearest = met.groupBy(*_KEYS, "ref").agg(
        F.max("ref_turn").isNull().alias("unknown"), F.min("ref_turn").alias("first_turn"),
        F.min(F.when(F.col("ref_turn") == F.col("turn"), F.col("ref_idx"))).alias("same"))
    nearest = written(nearest, "chat-references")
    faults = nearest.where(F.col("unknown") | (F.col("first_turn") > F.col("turn"))).select(
        *_KEYS, F.when(F.col("unknown"), "unknown_reference").otherwise("later_reference").alias("fault")).distinct()
    # a call of an earlier turn with the same id satisfies the reference already
    pending = nearest.where((F.col("first_turn") == F.col("turn")) & F.col("same").isNotNull()).select(
        *_KEYS, F.col("same").alias("parent"))
    pending = written(pending, "chat-pending")
    up = ["conv_id", "turn", "parent"]
    parents = pending.select("conv_id", "turn", F.col("parent").alias("idx")).distinct()
    solved = written(parents.join(pending.select(*_KEYS).distinct(), _KEYS, "left_anti"), "chat-level")
    levels = solved.select(*_KEYS, F.lit(0).alias("level"))
    level = 0
    while not solved.isEmpty():
        level += 1
        rest = written(pending.join(solved.withColumnRenamed("idx", "parent"), up, "left_anti"), "chat-pending")
        solved = written(pending.select(*_KEYS).distinct().join(rest.select(*_KEYS).distinct(), _KEYS, "left_anti"), "chat-level")
        levels = levels.unionByName(solved.select(*_KEYS, F.lit(level).alias("level")))
        pending = rest
    stuck = pending.select(*_KEYS).distinct()
    levels = levels.unionByName(stuck.select(*_KEYS, F.lit(-1).alias("level")))
    return levels, faults.unionByName(stuck.select(*_KEYS, F.lit("cycle").alias("fault")))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row per call, and one per result id without a call.

    ``calls``: conv_id, turn, idx (place within the turn), call_id, name,
    arguments (JSON text), after (array of call ids).  ``results``: conv_id,
    turn, call_id, content.  Other columns are not read.  Output: conv_id,
    turn, level, idx (sorting by these four is the topological order; calls
    of a cycle have level -1 and come first in their turn), call_id, name,
    status, n_results, faults (text, joined by commas), record.

    ``status``: linked, no_result, or orphan_result (no call: turn of the
    result, NULL idx and name).  Of several results for an id the first by
    turn, then by content, is linked and ``n_results`` counts all; an id used
    by several calls adds the fault ``repeated_id`` to each, and each is
    linked.  Repeated rows (equal conv_id, turn, idx) count once, the
    smallest stays.  A NULL call id links to nothing; a NULL conv_id or turn
    is a value of its own; NULL or empty arguments are not an object; empty
    tables give an empty result.  ``record`` is canonical JSON of arguments
    (null unless valid JSON), call_id, name and result."""
    cols = ["call_id", "name", "arguments", "after"]
    calls = calls.select(*_KEYS, *cols).groupBy(*_KEYS).agg(F.min(F.struct(*cols)).alias("c")).select(*_KEYS, "c.*")
    # NULL keys join as values: a flag beside a filled key
    calls = calls.select(F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id"), F.lit(0)).alias("id")).alias("conv_id"),
                         F.struct(F.col("turn").isNull().alias("none"), F.coalesce(F.col("turn"), F.lit(0)).alias("id")).alias("turn"),
                         "idx", *cols)
    calls = written(calls, "chat-calls")
    levels, order_faults = ordered(calls)
    ids = calls.where(F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.count(F.lit(1)).alias("n_calls"))
    found = results.select(
        F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id"), F.lit(0)).alias("id")).alias("conv_id"),
        "call_id", F.struct(F.col("turn").isNull().alias("none"), F.coalesce(F.col("turn"), F.lit(0)).alias("id")).alias("turn"), "content")
    found = found.groupBy("conv_id", "call_id").agg(
        F.min(F.struct("turn", "content")).alias("r"), F.count(F.lit(1)).alias("n_results"))
    found = found.join(ids, ["conv_id", "call_id"], "left")
    out = validated(calls, schemas)
    out = out.join(levels, _KEYS, "left").join(
        order_faults.groupBy(*_KEYS).agg(F.sort_array(F.collect_set("fault")).alias("of")), _KEYS, "left")
    out = out.join(found.select("conv_id", "call_id", "r", "n_results", "n_calls"), ["conv_id", "call_id"], "left")
    out = out.join(ids.select("conv_id", "call_id", F.col("n_calls").alias("same_id")), ["conv_id", "call_id"], "left")
    none = F.expr("cast(array() as array<string>)")
    faults = F.concat("faults", F.when(F.col("same_id") > 1, F.array(F.lit("repeated_id"))).otherwise(none), F.coalesce("of", none))
    linked = out.select(
        F.when(~F.col("conv_id.none"), F.col("conv_id.id")).alias("conv_id"), F.when(~F.col("turn.none"), F.col("turn.id")).alias("turn"),
        F.coalesce("level", F.lit(0)).alias("level"), "idx", "call_id", "name",
        F.when(F.col("r").isNotNull(), "linked").otherwise("no_result").alias("status"),
        F.coalesce("n_results", F.lit(0)).alias("n_results"), F.array_join(faults, ",").alias("faults"),
        F.to_json(F.struct(F.col("args").alias("arguments"), "call_id", "name", F.col("r.content").alias("result")),
                  {"ignoreNullFields": "false"}).alias("record"))
    orphans = found.where(F.col("n_calls").isNull()).select(
        F.when(~F.col("conv_id.none"), F.col("conv_id.id")).alias("conv_id"), F.when(~F.col("r.turn.none"), F.col("r.turn.id")).alias("turn"),
        F.lit(0).alias("level"), F.lit(None).cast("int").alias("idx"), "call_id", F.lit(None).cast("string").alias("name"),
        F.lit("orphan_result").alias("status"), "n_results", F.lit("").alias("faults"),
        F.to_json(F.struct(F.lit(None).cast("string").alias("arguments"), "call_id", F.lit(None).cast("string").alias("name"),
                           F.col("r.content").alias("result")), {"ignoreNullFields": "false"}).alias("record"))
    return linked.unionByName(orphans)


#: Tools of the calls that ``from_conversations`` derives.
TOOLS: Schemas = {
    "lookup": {"query": ("string", True), "limit": ("integer", True), "exact": ("boolean", False)},
    "count": {"text": ("string", True), "words": ("integer", True), "share": ("number", False)},
    "compare": {"left": ("string", True), "right": ("string", True)},
}


def from_conversations(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results stated by a table of plain turns.

    Every sentence of a user turn is a call; its md5 chooses the tool, the
    arguments' form (some break the tool's schema) and the sentences or turns
    it refers to.  The lines of the next turn by the assistant answer the
    calls in order; lines beyond the calls answer ids that no call has."""
    user = conversations.where(F.col("role") == "user").select("conv_id", "turn", F.posexplode(
        F.filter(F.split("text", r"[.!?]+\s*"), lambda s: F.trim(s) != "")).alias("idx", "sentence"), F.size(
            F.filter(F.split("text", r"[.!?]+\s*"), lambda s: F.trim(s) != "")).alias("n"))
    h = F.md5("sentence")
    digit = lambda i: F.conv(F.substring(h, i, 1), 16, 10).cast("int")
    call_id = lambda turn, idx: F.concat(F.lit("call-"), turn.cast("string"), F.lit("-"), idx.cast("string"))
    words = F.size(F.split(F.trim("sentence"), r"\s+"))
    lookup = F.to_json(F.struct(F.col("sentence").alias("query"), words.alias("limit"), (digit(2) < 8).alias("exact")))
    broken = F.to_json(F.struct(F.col("sentence").alias("query"), words.cast("string").alias("limit"), F.lit(1).alias("page")))
    count = F.to_json(F.struct(words.alias("words"), F.col("sentence").alias("text"), (words / F.lit(7.0)).alias("share")))
    compare = F.to_json(F.struct(F.col("sentence").alias("left"), F.reverse("sentence").alias("right")))
    calls = user.select(
        "conv_id", "turn", "idx", call_id(F.col("turn"), F.col("idx")).alias("call_id"),
        F.when(digit(1) < 7, "lookup").when(digit(1) < 11, "count").when(digit(1) < 15, "compare").otherwise("search").alias("name"),
        F.when(digit(1) < 2, broken).when(digit(1) < 7, lookup).when(digit(1) < 11, count).when(digit(1) == 15, F.lit("{"))
        .otherwise(compare).alias("arguments"),
        F.when(digit(3) < 8, F.array(call_id(F.col("turn"), F.pmod(digit(4), F.col("n")))))
        .when(digit(3) < 12, F.array(call_id(F.col("turn") - 2, F.lit(0)))).otherwise(F.expr("cast(array() as array<string>)")).alias("after"))
    answers = conversations.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("idx", "content"))
    results = answers.select("conv_id", "turn", call_id(F.col("turn") - 1, F.col("idx")).alias("call_id"), "content")
    return calls, results
