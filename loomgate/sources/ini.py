"""INI texts to (keys, section, key, value, kind) by column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgate.functions.text import strip_bom, strip_quotes, trim


def entries(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """One row for each key of a document: section (dotted, '' before the first), key, value as text, kind.

    Comments are lines that start with ; or #, sections [a.b], the first : or = parts key and value, the last of
    equal keys counts, a line without a separator doesn't. kind is boolean, number or string."""
    lines = docs.select(*keys, F.posexplode(F.split(strip_bom(F.col(text)), r"\r?\n")).alias("at", "line")).withColumn("line", trim(F.col("line")))
    lines = lines.where((F.col("line") != "") & ~F.col("line").rlike("^[;#]"))
    w = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = F.when(F.col("line").rlike(r"^\[[^\]]+\]$"), F.array_join(F.filter(F.transform(F.split(F.regexp_extract("line", r"^\[([^\]]+)\]$", 1), r"\."), trim), lambda s: s != ""), "."))
    placed = lines.withColumn("heading", heading).withColumn("section", F.coalesce(F.last("heading", ignorenulls=True).over(w), F.lit(""))).where("heading IS NULL AND line RLIKE '[:=]'")
    raw = trim(F.regexp_extract("line", r"(?s)^[^:=]*[:=](.*)$", 1))
    number, boolean = raw.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), raw.rlike(r"(?i)^(true|false)$")
    found = placed.select(
        *keys, "section", trim(F.regexp_extract("line", r"^([^:=]*)[:=]", 1)).alias("key"), "at",
        F.when(boolean, F.lower(raw)).when(number, raw).otherwise(strip_quotes(raw)).alias("value"), F.when(boolean, "boolean").when(number, "number").otherwise("string").alias("kind"),
    )
    return found.groupBy(*keys, "section", "key").agg(F.max_by(F.struct("value", "kind"), "at").alias("v")).select(*keys, "section", "key", "v.value", "v.kind")
