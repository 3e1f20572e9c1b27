"""SRT, WebVTT and ASS texts to cues (keys, idx, start_ms, end_ms, text), by column expressions.

A document is cut into lines inside its row; a bad time fails the query, as it fails the file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgate.functions.text import SPACE, strip_bom, trim
from loomgate.functions.times import parse_time

# The columns of ASS events without a Format line.
ASS_FIELDS = ("layer", "start", "end", "style", "name", "marginl", "marginr", "marginv", "effect", "text")
_ARROW = "-->"


def _first_word(x: Column) -> Column:
    return F.split(trim(x), f"[{SPACE}]+")[0]


def _span(line: Column) -> tuple[Column, Column]:
    sides = F.split(line, _ARROW)
    return parse_time(_first_word(sides[0])), parse_time(_first_word(sides[1]))


def _numbered(found: DataFrame, keys: list[str], at: str) -> DataFrame:
    from pyspark.sql import Window

    return found.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy(at)).alias("idx"), "start_ms", "end_ms", "text")


def srt(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Blocks between blank lines; in each the first line with an arrow, and the lines after it."""
    blocks = docs.select(*keys, F.posexplode(F.split(trim(strip_bom(F.col(text))), f"\\r?\\n[{SPACE}]*\\r?\\n")).alias("at", "block")).withColumn("lines", F.split("block", r"\r?\n"))
    place = F.array_position(F.transform("lines", lambda x: F.contains(x, F.lit(_ARROW))), True)
    timed = blocks.withColumn("place", place.cast("int")).where("place > 0")
    start, end = _span(F.get("lines", F.col("place") - 1))
    body = F.array_join(F.slice("lines", F.col("place") + 1, F.size("lines")), "\n")
    return _numbered(timed.select(*keys, "at", start.alias("start_ms"), end.alias("end_ms"), body.alias("text")), keys, "at")


def vtt(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Each line with an arrow that isn't text of a cue; its text goes up to the next blank line."""
    lines = F.split(strip_bom(F.col(text)), r"\r?\n")

    def step(state: Column, line: Column) -> Column:
        # open: a cue takes lines; cues: [timing line, text lines]
        blank, arrow = trim(line) == "", F.contains(line, F.lit(_ARROW))
        begins = ~state["open"] & arrow
        takes = state["open"] & ~blank
        last = F.size(state["cues"])
        longer = F.transform(state["cues"], lambda c, i: F.when((i == last - 1) & takes, F.concat(c, F.array(line))).otherwise(c))
        return F.struct((begins | takes).alias("open"), F.when(begins, F.concat(state["cues"], F.array(F.array(line)))).otherwise(longer).alias("cues"))

    zero = F.struct(F.lit(False).alias("open"), F.array().cast("array<array<string>>").alias("cues"))
    cues = docs.select(*keys, F.posexplode(F.aggregate(lines, zero, step, lambda s: s["cues"])).alias("at", "cue"))
    start, end = _span(F.get("cue", F.lit(0)))
    return _numbered(cues.select(*keys, "at", start.alias("start_ms"), end.alias("end_ms"), F.array_join(F.slice("cue", F.lit(2), F.size("cue")), "\n").alias("text")), keys, "at")


def ass(docs: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Dialogue lines of [Events], under the columns of the last Format line before them."""
    from pyspark.sql import Window

    lines = docs.select(*keys, F.posexplode(F.split(strip_bom(F.col(text)), r"\r?\n")).alias("at", "line"))
    w = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    heading = F.when(F.col("line").rlike(r"^\s*\["), F.col("line").rlike(r"(?i)^\s*\[events\]\s*$"))
    lines = lines.withColumn("inside", F.coalesce(F.last(heading, ignorenulls=True).over(w), F.lit(False)))
    listed = F.when(F.col("inside") & F.col("line").rlike(r"(?i)^\s*Format\s*:\s*.+$"), F.transform(F.split(F.regexp_extract("line", r"(?i)^\s*Format\s*:\s*(.+)$", 1), ","), lambda x: F.lower(trim(x))))
    lines = lines.withColumn("fields", F.coalesce(F.last(listed, ignorenulls=True).over(w), F.array(*map(F.lit, ASS_FIELDS))))
    spoken = lines.where(F.col("inside") & F.col("line").rlike(r"(?i)^\s*Dialogue\s*:")).withColumn("rest", F.regexp_extract("line", r"(?i)^\s*Dialogue\s*:\s*(.*)$", 1))
    # the last field keeps its commas
    cut = F.expr("split(rest, ',')")
    n = F.size("fields")
    values = F.when(F.size(cut) <= n, F.concat(cut, F.array_repeat(F.lit(""), n - F.size(cut)))).otherwise(F.concat(F.slice(cut, 1, n - 1), F.array(F.array_join(F.slice(cut, n, F.size(cut)), ","))))
    record = spoken.withColumn("record", F.map_from_arrays("fields", values))
    said = F.coalesce(F.try_element_at("record", F.lit("text")), F.lit(""))
    said = F.regexp_replace(F.regexp_replace(F.regexp_replace(said, r"(?i)\\n", "\n"), r"(?i)\\h", " "), r"\{[^}]*\}", "")
    time = lambda name: parse_time(trim(F.try_element_at("record", F.lit(name))))
    return _numbered(record.select(*keys, "at", time("start").alias("start_ms"), time("end").alias("end_ms"), said.alias("text")), keys, "at")
