"""Registered queries of the converter and their SQL."""

from __future__ import annotations

import importlib
import pkgutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgate import plans
from loomgate.operators.records import flattened
from loomgate.plans.tables import table
from loomgate.sinks import rows


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with properties flattened to dotted columns, summed by type, a JSON line for each type."""
    events = table(spark, sf_dir, "events").withColumn("props", F.from_json("props", "k long"))
    sums = flattened(events).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("`props.k`").alias("sum_k"), F.max("`props.k`").alias("max_k"))
    return rows.lines(sums, "ndjson", ["event_type"]).select(F.col("__o0").alias("event_type"), "line")


FLAGSHIP_SQL = """
SELECT event_type, '{"event_type":"' || event_type || '","n":' || count(*) || ',"sum_k":' || sum((props->>'k')::BIGINT) || ',"max_k":' || max((props->>'k')::BIGINT) || '}' AS line
FROM events GROUP BY event_type
"""


def _modules():
    return [importlib.import_module(f"loomgate.plans.{m.name}") for m in pkgutil.iter_modules(plans.__path__) if m.name.startswith("q_")]


def queries() -> dict:
    found = {"events_ndjson_lines": flagship}
    for m in _modules():
        found |= m.QUERIES
    return found


def oracle_sql() -> dict:
    found = {"events_ndjson_lines": FLAGSHIP_SQL}
    for m in _modules():
        found |= m.SQL
    return found
