"""Lookups by place: ranges, next section, positional pairs, trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgate.operators.ordered import carried, running_offsets
from loomgate.operators.ranges import materialise


def in_range(points: DataFrame, at: str, ranges: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Pairs with start <= at < end. Both sides are cut into stretches of `width` and joined by
    equality on the stretch, so the join shuffles or broadcasts like any other; choose width near the usual range."""
    cells = ranges.where(F.col(end) > F.col(start)).withColumn("__cell", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    return points.withColumn("__cell", F.floor(F.col(at) / width)).join(cells, "__cell").where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("__cell")


def overlapping(left: DataFrame, left_span: tuple[str, str], right: DataFrame, right_span: tuple[str, str], keys: list[str], width: int) -> DataFrame:
    """Pairs of equal keys whose half-open spans overlap. Both sides are cut into stretches of `width`; a pair counts in the
    stretch where its overlap begins, so it comes once, and rows that are far apart in a group never meet."""
    cut = lambda df, span: df.where(F.col(span[1]) > F.col(span[0])).withColumn("__cell", F.explode(F.sequence(F.floor(F.col(span[0]) / width), F.floor((F.col(span[1]) - 1) / width))))
    begin = F.greatest(left_span[0], right_span[0])
    met = cut(left, left_span).join(cut(right, right_span), [*keys, "__cell"])
    return met.where((begin < F.least(left_span[1], right_span[1])) & (F.floor(begin / width) == F.col("__cell"))).drop("__cell")


def next_section(points: DataFrame, key: str, at: str, sections: DataFrame, end: str, payload: list[str]) -> DataFrame:
    """points with the payload of the first section whose end is beyond `at`, null if there is none.

    Points and sections of a key are put in one order, and the next section is carried backwards: a sort, no pairs."""
    kind = sections.schema
    left = points.select(F.struct("*").alias("p"), F.col(key).alias("__k"), F.col(at).cast("double").alias("__at"), F.lit(0).alias("__side"), F.lit(None).cast(f"struct<{','.join(f'`{c}`:{kind[c].dataType.simpleString()}' for c in payload)}>").alias("s"))
    right = sections.select(F.lit(None).cast(left.schema["p"].dataType).alias("p"), F.col(key).alias("__k"), F.col(end).cast("double").alias("__at"), F.lit(-1).alias("__side"), F.struct(*payload).alias("s"))
    both = left.unionByName(right).withColumns({"__at": -F.col("__at"), "__side": -F.col("__side")})
    found = carried(both, ["__k"], ["__at", "__side"], F.col("s"), "found").where("p IS NOT NULL")
    return found.select("p.*", *[F.col(f"found.{c}").alias(c) for c in payload])


def dealt_by_count(heads: DataFrame, head_order: str, count: str, items: DataFrame, item_place: str, keys: list[str]) -> DataFrame:
    """Each head takes the next `count` items of its key: pairs of heads and items. Items are numbered from 0 in item_place."""
    spans = running_offsets(heads, keys, [head_order], count).where(f"{count} > 0")
    each = spans.withColumn(item_place, F.explode(F.expr("sequence(start, end - 1)"))).drop("start", "end")
    return each.join(items, [*keys, item_place])


def tree_depths(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """node, depth of all nodes below the roots (null parent); nodes behind a lost parent or on a circle are left out.

    By pointer doubling: in each round a node takes over the pointer of the one that it points to, so rounds grow with the
    logarithm of the depth. A circle never ends; the doubling stops when only nodes on or behind circles point on."""
    state = nodes.select(F.col(node).alias("node"), F.col(parent).alias("up"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("depth"))
    state = materialise(state.where("node IS NOT NULL"), "tree")
    open_nodes = state.where("up IS NOT NULL").count()
    rounds = max(1, state.count()).bit_length()  # enough for a single chain of all nodes
    for _ in range(rounds):
        if not open_nodes:
            break
        above = state.select(F.col("node").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("more"))
        state = materialise(state.where("up IS NOT NULL").join(above.hint("merge"), "up").select("node", F.col("up2").alias("up"), (F.col("depth") + F.col("more")).alias("depth")).unionByName(state.where("up IS NULL")), "tree")
        open_nodes = state.where("up IS NOT NULL").count()
    return state.where("up IS NULL").select(F.col("node").alias(node), F.col("depth").cast("int").alias("depth"))


def with_defaults(df: DataFrame, table: DataFrame, keys: list[str], defaults: dict[str, object]) -> DataFrame:
    """df with the columns of a small table (a style sheet, a registry) by its keys; what isn't there gets the default."""
    found = df.join(F.broadcast(table.select(*keys, *defaults)), keys, "left")
    return found.withColumns({n: F.coalesce(n, F.lit(v)) for n, v in defaults.items()})
