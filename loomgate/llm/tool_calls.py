"""Chat formatting: tool calls linked to their results, in order, checked and serialised.

Calls and results are joined by hash on (conversation, call identifier), after results of one call are
reduced to the first. A call may name the call whose result it uses; depths along these links come from pointer doubling, in rounds
that grow with the logarithm of the longest chain, and the place of each call in the topological order of its conversation (by depth,
then seq) from running counts over sorted ranges, so a conversation is never gathered in one task. Arguments are checked against
the tool's schema as VARIANT, and each call is written as JSON in canonical form (keys sorted, no blanks). Only built-in
DataFrame functions.

Defined results: a result whose identifier is null or meets no call is `no_call` (a row for each such identifier in a conversation); a call
with null identifier is `no_id` and linked to nothing; arguments that aren't a JSON object are `bad_json`; a tool without schema is
`unknown_tool`; a missing, mistyped or unlisted field is `bad_arguments`; a link to a call that
isn't there is `lost_parent` (depth 0), a link along a circle `cyclic` (depth and place null); a call
without result is `pending`; all else `ok`, and the first that holds counts in this order. Of
calls that repeat an identifier in a conversation the first (by seq) counts; of repeated results the first is shown and all are
counted. A null conversation is one of its own; null contents are JSON null; other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgate.llm.common import materialise
from loomgate.operators import ordered

#: tool -> field -> (types: BIGINT, DOUBLE, STRING, BOOLEAN, VOID, ARRAY, OBJECT; required)
Schemas = dict[str, dict[str, tuple[tuple[str, ...], bool]]]


def _quoted(text: Column) -> Column:
    """text as a JSON string, null as null."""
    listed = F.to_json(F.array(text))
    return F.substr(listed, F.lit(2), F.length(listed) - 2)


def depths(calls: DataFrame) -> DataFrame:
    """calls (conv, id, parent), ids distinct in a conv -> (conv, id, depth, lost): depth 0 for roots, null on or behind a circle."""
    known = calls.select("conv", F.col("id").alias("parent"), F.lit(True).alias("there"))
    state = calls.join(known.hint("shuffle_hash"), ["conv", "parent"], "left").select(
        "conv", "id", F.when(F.col("there"), F.col("parent")).alias("up"), F.when(F.col("there"), 1).otherwise(0).cast("long").alias("depth"), (F.col("parent").isNotNull() & F.col("there").isNull()).alias("lost")
    )
    state = materialise(state, "depths")
    longest = state.groupBy("conv").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    for _ in range(longest.bit_length()):  # then every chain has ended that ends at all
        if state.where("up IS NOT NULL").isEmpty():
            break
        above = state.select("conv", F.col("id").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        state = materialise(state.join(above.hint("shuffle_hash"), ["conv", "up"], "left").select("conv", "id", F.col("up2").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), "lost"), "depths")
    return state.select("conv", "id", F.when(F.col("up").isNull(), F.col("depth")).alias("depth"), "lost")


def argument_faults(tool: Column, arguments: Column, schemas: Schemas) -> Column:
    """Null, `bad_json`, `unknown_tool` or `bad_arguments`."""
    value = F.try_parse_json(arguments)
    is_object = F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False))
    fits: Column = F.lit(None).cast("boolean")
    for name, fields in schemas.items():
        good = F.size(F.array_except(F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>")), F.array(*map(F.lit, fields)))) == 0
        for field, (types, required) in fields.items():
            whole = F.regexp_extract(F.schema_of_variant(F.try_variant_get(value, f"$['{field}']", "variant")), "^[A-Z]+", 0)
            kind = F.when(whole == "DECIMAL", "DOUBLE").otherwise(whole)
            good = good & F.coalesce(kind.isin(*types), F.lit(not required))
        fits = F.when(tool == name, good).otherwise(fits)
    return F.when(~is_object, "bad_json").when(fits.isNull(), "unknown_tool").when(~fits, "bad_arguments")


def placed(calls: DataFrame) -> DataFrame:
    """calls (conv, id, seq, parent), ids distinct in a conv -> depths of them with place, from 1, in the order of depth, seq, id; null where the depth is."""
    found = depths(calls).join(calls.select("conv", "id", "seq").hint("shuffle_hash"), ["conv", "id"])
    numbers = ordered.numbered(found.where("depth IS NOT NULL").select("conv", "id", "depth", "seq"), ["conv"], ["depth", "seq", "id"], "place")
    return found.drop("seq").join(numbers.select("conv", "id", "place").hint("shuffle_hash"), ["conv", "id"], "left")


def linked(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """calls (conv, id, seq, tool, arguments, parent) and results (conv, id, seq, content) ->
    conv, call_id, seq, depth, place, status, n_results, json."""
    own = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit("")).alias("own")  # a null conversation has a key too
    rest = ["seq", "tool", "arguments", "parent"]
    first = calls.where("id IS NOT NULL").groupBy(own, "id").agg(F.min(F.struct(*rest)).alias("c"), F.min("conv").alias("conv")).select("own", "id", "conv", "c.*", F.lit(True).alias("called"))
    nameless = calls.where("id IS NULL").select(own, "id", "conv", *rest, F.lit(True).alias("called"))
    answers = results.groupBy(own, "id").agg(F.min_by("content", F.struct("seq", "content")).alias("content"), F.count("*").alias("n_results"), F.min("seq").alias("answer_seq"), F.min("conv").alias("answer_conv"))
    order = placed(first.select(F.col("own").alias("conv"), "id", "seq", "parent")).withColumnRenamed("conv", "own")
    whole = first.unionByName(nameless).join(answers.hint("shuffle_hash"), ["own", "id"], "full").join(order.hint("shuffle_hash"), ["own", "id"], "left")
    linking = F.when(F.col("lost"), "lost_parent").when(F.col("depth").isNull(), "cyclic").when(F.col("n_results").isNull(), "pending").otherwise("ok")
    status = F.when(F.col("called").isNull(), "no_call").when(F.col("id").isNull(), "no_id").otherwise(F.coalesce(argument_faults(F.col("tool"), F.col("arguments"), schemas), linking))
    shown = lambda c: F.coalesce(c, F.lit("null"))
    json = F.concat(
        F.lit('{"arguments":'), shown(F.to_json(F.try_parse_json("arguments"))), F.lit(',"call_id":'), _quoted(F.col("id")), F.lit(',"depth":'), shown(F.col("depth").cast("string")),
        F.lit(',"name":'), _quoted(F.col("tool")), F.lit(',"result":'), _quoted(F.col("content")), F.lit("}"),
    )
    return whole.select(F.coalesce("conv", "answer_conv").alias("conv"), F.col("id").alias("call_id"), F.coalesce("seq", "answer_seq").alias("seq"), "depth", "place", status.alias("status"), F.coalesce("n_results", F.lit(0)).alias("n_results"), json.alias("json"))
