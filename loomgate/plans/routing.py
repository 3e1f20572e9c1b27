"""Routes of several stages: shortest paths over the graph of formats, and their conversions one behind the other.

An edge is a conversion that has a reader and a writer here. Paths are found for all pairs at once by joining the frontier with the edges, round by round; edges are
some hundred rows by construction, and so are paths. Of paths of one length the one through formats that keep more (KEEPS) is taken, then the first by name, so plans are always the same.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgate.operators.ranges import fresh_path
from loomgate.plans import registry
from loomgate.plans.convert import UnsupportedEngine, convert, inspect
from loomgate.sinks import store

#: Stages of a route at most.
STAGES = 4
#: Formats of documents, books and tables that have no reader here, and targets without a writer.
UNREAD = frozenset("rtf epub doc docm dotx dotm odt ott fodt ppt pptm pps ppsx potx potm odp otp fodp xls xlsb rar 7z pdf".split())
UNWRITTEN = registry.UNSUPPORTED | {"ods"}
#: Formats that keep most of what a file has, the best first.
KEEPS = ("html", "json", "csv")
KINDS = ("document", "ebook", "data", "database", "subtitle", "archive")


def edge_list() -> list[tuple[str, str]]:
    """(source, target) of the single conversions between different formats."""
    sources = sorted({registry.canonical(e) for e, kind in registry.KIND.items() if kind in KINDS} - UNREAD)
    return [(s, t) for s in sources for t in registry.targets(registry.KIND[s], s) if t not in UNWRITTEN]


def edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(edge_list(), "source string, target string")


def shortest(graph: DataFrame, stages: int = STAGES) -> DataFrame:
    """graph (source, target) -> source, target, stages (array of formats behind the source): the shortest path of each pair of different formats.

    Plans grow with the square of the formats, not with data; the graph is broadcast."""
    step = F.broadcast(graph.select(F.col("source").alias("via"), F.col("target").alias("to")))
    rank = lambda x: functools.reduce(lambda c, i: c.when(x == KEEPS[i], i), range(1, len(KEEPS)), F.when(x == KEEPS[0], 0)).otherwise(len(KEEPS))
    known = graph.where("source <> target").select("source", "target", F.array("target").alias("stages")).distinct()
    frontier = known
    for _ in range(stages - 1):
        longer = frontier.join(step, F.col("target") == F.col("via")).where("source <> to").select("source", F.col("to").alias("target"), F.concat("stages", F.array("to")).alias("stages"))
        frontier = longer.join(known, ["source", "target"], "left_anti").groupBy("source", "target").agg(F.min(F.struct(F.transform("stages", rank), "stages")).alias("best")).select("source", "target", "best.stages")
        known = known.unionByName(frontier)
    return known


def plan_for(spark: SparkSession, path: str, target: str) -> list[str]:
    """The formats that path goes through to become target, the last of them target itself."""
    found = inspect(path)
    wanted = registry.canonical(target.strip().lower())
    if not found["kind"]:
        raise ValueError(f"Unsupported file: {path.rpartition('/')[2]}")
    row = shortest(edges(spark)).where((F.col("source") == found["ext"]) & (F.col("target") == wanted)).first()
    if row is None:
        raise UnsupportedEngine(f"No route from {found['ext']} to {wanted}")
    return list(row["stages"])


def convert_by(spark: SparkSession, path: str, stages: list[str]) -> DataFrame:
    """name, content of the files that path becomes through the stages. What a stage writes lies in the shared folder for the next one.

    A stage that gives several files (a table each, say) hands on its only one, or fails."""
    for i, target in enumerate(stages):
        made = convert(spark, path, target)
        if i == len(stages) - 1:
            return made
        folder = fresh_path(spark, "stage")
        files = store.stored(made, folder).collect()  # names and sizes
        if len(files) != 1:
            raise ValueError(f"{target} is {len(files)} files, of which only one can go on")
        path = f"{folder}/{files[0]['name']}"
    raise ValueError("A route has stages")


def convert_far(spark: SparkSession, path: str, target: str) -> DataFrame:
    """name, content: like convert(), through as many stages as the target needs."""
    return convert_by(spark, path, plan_for(spark, path, target))
