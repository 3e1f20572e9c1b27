"""Merkle manifest of a dataset: a tree of hashes for each group of rows, a tree over their roots, and a proof for every row.

Levels are DataFrames. Leaves are numbered in the order of group and identifier (sampled ranges, numbers inside a range and
the totals of the ranges before it), so a group of any size is spread. Numbers are divided by a power of the fanout (BLOCK at most); what
falls together is a block, which is collected in order, and whose own levels are hashed in its row up to one node. Blocks are the next
round's nodes, so there is a round for every eight halvings, and each is 256 times smaller than the one before. Proofs go down the same
rounds: a joined block hands its own proof to its nodes, each of which puts its siblings in the block's levels in front. So a join reads one round only, not all leaves.

The hash of digests is taken over their hexadecimal text; digests are kept as 32 bytes.

Defined results: null fields are hashed as `-`; a null group is a group of its own, before all others; null identifiers come
first in their group and are never tampered with; rows with equal identifiers are ordered by their leaf, and rows equal in all fields take
neighbouring places; a group of one row has its leaf as subroot, a dataset of one group its subroot as root; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgate.llm.common import bounded_broadcast, materialise

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FANOUT = 2
#: Nodes of a round for each task and written file; nodes of a block at most, whatever the fanout (but no less than that).
NODES_A_TASK, BLOCK = 20_000, 256
#: The place of a row in its range, in the lower bits of Spark's increasing numbers.
_IN_RANGE = (1 << 33) - 1


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def hex_text(digests: Column) -> Column:
    return F.lower(F.hex(digests))


def in_order(df: DataFrame, by: list[Column]) -> DataFrame:
    """df with rank, from 0, in the order of `by`; rows that are equal there spread over ranges too."""
    keyed = df.select("*", *[c.alias(f"__by{i}") for i, c in enumerate(by)], F.monotonically_increasing_id().alias("__tie"))
    order = [*[F.col(f"__by{i}").asc_nulls_first() for i in range(len(by))], F.col("__tie")]
    ranged = keyed.repartitionByRange(*order).sortWithinPartitions(*order).select(*df.columns, F.monotonically_increasing_id().alias("__at"))
    placed = materialise(ranged, "ordered").withColumn("__part", F.shiftright("__at", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    starts = placed.groupBy("__part").count().select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__before"))
    return placed.join(F.broadcast(starts), "__part").select(*df.columns, (F.col("__before") + F.col("__at").bitwiseAND(_IN_RANGE)).alias("rank"))


def _in_block(fanout: int) -> int:
    """The levels of a block."""
    steps = 1
    while fanout ** (steps + 1) <= BLOCK:
        steps += 1
    return steps


def _joined(digests: Column, start: Column, n: Column) -> Column:
    return F.array_join(F.transform(F.slice(digests, start, n), hex_text), "")


def grown(nodes: DataFrame, most: int, rows: int, fanout: int = FANOUT) -> list[DataFrame]:
    """nodes (tree, idx, m, digest, row), m nodes in a tree -> its rounds above, each (tree, idx, m, levels, digest).

    most: the nodes of the largest tree; rows: of all. A tree goes on while it has more than one node. levels are the digests of a block's nodes
    in order, then those of each level above to the block's own; the first round has the leaves' rows in order too."""
    steps = _in_block(fanout)
    size, rounds, at = fanout**steps, [], nodes
    runs_of = lambda level: F.transform(F.sequence(F.lit(0), F.ceil(F.size(level) / fanout).cast("int") - 1), lambda i: digest(_joined(level, i * fanout + 1, F.lit(fanout))))
    while most > 1:
        kid = F.struct("idx", "digest", "row") if not rounds else F.struct("idx", "digest")
        blocks = at.where("m > 1").groupBy("tree", F.expr(f"idx DIV {size}").alias("up")).agg(F.first("m").alias("m"), F.collect_list(kid).alias("kids"))
        kids = F.array_sort("kids", lambda x, y: F.signum(x["idx"] - y["idx"]).cast("int"))
        heights = sum(((F.col("m") > fanout**j).cast("int") for j in range(1, steps)), F.lit(1))  # all blocks of a tree have the same
        ordered = blocks.select("tree", F.col("up").alias("idx"), "m", heights.alias("n"), kids.alias("kids"))
        levels = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.array(F.transform("kids", lambda x: x["digest"])), lambda done, _: F.concat(done, F.array(runs_of(F.element_at(done, -1)))))
        own = [] if rounds else [F.transform("kids", lambda x: x["row"]).alias("rows")]
        up = ordered.select("tree", "idx", F.expr(f"(m + {size - 1}) DIV {size}").alias("m"), levels.alias("levels"), *own)
        up = up.withColumn("digest", F.element_at(F.element_at("levels", -1), 1))
        rounds.append(at := materialise(up.coalesce(rows // NODES_A_TASK + 1), "level"))
        most, rows = -(-most // size), rows // size + 1
    return rounds


def _sibling(level: Column, at: Column, fanout: int) -> Column:
    """What stands beside a node of a level in its run, left and right."""
    place = at % fanout
    return F.struct(F.unhex(_joined(level, at - place + 1, place)).alias("left"), F.unhex(_joined(level, at + 2, F.lit(fanout - 1) - place)).alias("right"))


def with_paths(nodes: DataFrame, rounds: list[DataFrame], tops: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """tops (tree, path, ...) -> row, digest, path and the other columns of tops for each of the nodes that rounds were grown from.

    path: for each level from the leaf up, then as in tops, the siblings on the left and on the right, as their digests side by side."""
    others = [c for c in tops.columns if c not in ("tree", "path")]
    size, at = fanout ** _in_block(fanout), None
    below = F.slice("levels", F.lit(1), F.size("levels") - 1)
    beside = lambda i: F.transform(below, lambda level, j: _sibling(level, F.floor(i / F.pow(F.lit(fanout), j)).cast("int"), fanout))
    for first, up in reversed([(i == 0, up) for i, up in enumerate(rounds)]):
        known = up.where("m = 1").select("tree", "idx").join(tops, "tree")
        known = known if at is None else at.unionByName(known)
        row = (lambda i: [F.get("rows", i).alias("row")]) if first else (lambda _: [])
        nodes_of = F.transform(F.get("levels", F.lit(0)), lambda x, i: F.struct(x.alias("digest"), beside(i).alias("own"), *row(i)))  # noqa: B023
        one = up.join(known, ["tree", "idx"]).select("tree", F.col("idx").alias("block"), "path", *others, F.posexplode(nodes_of).alias("pos", "node"))
        path = F.concat("node.own", "path").alias("path")
        if first:
            at = one.select("node.row", "node.digest", path, *others)
        else:
            at = one.select("tree", (F.col("block") * size + F.col("pos")).alias("idx"), path, *others)
    alone = nodes.where("m = 1").join(tops, "tree").select("row", "digest", "path", *others)
    return alone if at is None else at.unionByName(alone)


def folded(leaf: Column, path: Column) -> Column:
    """The root's hexadecimal text, from a leaf and its path."""
    return F.aggregate(path, hex_text(leaf), lambda own, s: F.sha2(F.concat(hex_text(s["left"]), own, hex_text(s["right"])), 256))


def proof_text(path: Column) -> Column:
    """All siblings of a path, left to right, as hexadecimal text."""
    return F.array_join(F.transform(path, lambda s: F.concat(hex_text(s["left"]), hex_text(s["right"]))), "")


def manifest(leaves: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, str | None]:
    """leaves (id, tree, digest, and more columns) -> row (a struct of all its columns), digest, subroot, path for each; and the root's text.

    Trees are the values of the column tree, ordered bytewise with null first; leaves ascend by id in their tree."""
    ranked = in_order(leaves, [F.col("tree"), F.col("id"), F.col("digest")])
    trees = ranked.groupBy("tree").agg(F.min("rank").alias("first"), F.count("*").alias("m"))
    trees = materialise(in_order(trees, [F.col("tree")]).select(F.col("tree").alias("name"), "first", "m", F.col("rank").alias("no")), "trees")
    n_trees, most, rows = trees.agg(F.count("*"), F.max("m"), F.sum("m")).first()
    placed = ranked.join(bounded_broadcast(trees), F.col("tree").eqNullSafe(F.col("name")))
    nodes = placed.select(F.col("no").alias("tree"), (F.col("rank") - F.col("first")).alias("idx"), "m", "digest", F.struct(*leaves.columns).alias("row"))
    levels = grown(nodes, most or 0, rows or 0, fanout)

    roots = nodes.where("m = 1").select("tree", "digest")
    for up in levels:
        roots = roots.unionByName(up.where("m = 1").select("tree", "digest"))
    upper = materialise(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(n_trees).cast("long").alias("m"), "digest", F.struct("tree", "digest").alias("row")), "subroots")
    above = grown(upper, n_trees, n_trees, fanout)
    start = upper.limit(1).select("tree", F.array().cast("array<struct<left:binary,right:binary>>").alias("path"))
    tops = materialise(with_paths(upper, above, start, fanout).select("row.tree", "path", F.col("digest").alias("subroot")), "tops")
    root = (above[-1] if above else upper).select(hex_text(F.col("digest"))).first()
    return with_paths(nodes, levels, tops, fanout), root[0] if root else None


def document_manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", tree_col: str = "lang", size_col: str = "n_chars", fanout: int = FANOUT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row.

    folded_root is made of the row as it would be read after tampering (one more in size_col wherever 7 divides the checksum of the
    identifier) and the siblings of the untampered tree."""
    touched = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 7 == 0, F.lit(False)) & F.col(size_col).isNotNull()
    plain = F.concat(*[field(F.col(c)) for c in fields])
    more = F.concat(*[field(F.col(c).cast("decimal(20,0)") + 1 if c == size_col else F.col(c)) for c in fields])
    leaves = docs.select(F.col(id_col).alias("id"), F.col(tree_col).alias("tree"), digest(plain).alias("digest"), F.when(touched, digest(more)).alias("other"))
    found, root = manifest(materialise(leaves, "leaves"), fanout)
    out = found.select(
        F.col("row.id").alias("doc_id"), hex_text(F.col("digest")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"), F.lit(root).cast("string").alias("root"),
        F.sha2(proof_text(F.col("path")), 256).alias("proof_sha256"), folded(F.coalesce("row.other", "digest"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
