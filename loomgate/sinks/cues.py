"""Cue lists as SRT, WebVTT, ASS, text and HTML. Cues: keys, idx (from 1), start_ms, end_ms, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgate.functions.text import escape_html, html_document
from loomgate.functions.times import ass_timestamp, timestamp

# What stands before the events of an ASS file.
ASS_HEAD = (
    "[Script Info]\nScriptType: v4.00+\nPlayResX: 1920\nPlayResY: 1080\n\n[V4+ Styles]\n"
    "Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding\n"
    "Style: Default,Arial,48,&H00FFFFFF,&H000000FF,&H00000000,&H64000000,0,0,0,0,100,100,0,0,1,2,0,2,40,40,40,1\n\n"
    "[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n"
)


def block(target: str) -> Column:
    """One cue as the target has it."""
    start, end, text = F.col("start_ms"), F.col("end_ms"), F.col("text")
    span = lambda mark: F.concat(timestamp(start, mark), F.lit(" --> "), timestamp(end, mark), F.lit("\n"), text)
    if target == "srt":
        return F.concat(F.col("idx").cast("string"), F.lit("\n"), span(","))
    if target == "vtt":
        return span(".")
    if target == "ass":
        return F.concat(F.lit("Dialogue: 0,"), ass_timestamp(start), F.lit(","), ass_timestamp(end), F.lit(",Default,,0,0,0,,"), F.replace(text, F.lit("\n"), F.lit("\\N")))
    if target == "txt":
        return F.concat(F.lit("["), timestamp(start, "."), F.lit("] "), text)
    if target == "html":
        return F.concat(F.lit("<section><time>"), timestamp(start, "."), F.lit(" – "), timestamp(end, "."), F.lit("</time><p>"), F.replace(escape_html(text), F.lit("\n"), F.lit("<br>")), F.lit("</p></section>"))
    raise ValueError(f"Unsupported subtitle target: {target}")


def document(cues: DataFrame, target: str, keys: list[str], title: Column | None = None) -> DataFrame:
    """keys, text: one document for each cue list."""
    between = {"ass": "\n", "html": ""}.get(target, "\n\n")
    each = cues.select(*keys, "idx", block(target).alias("b"))
    body = each.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "b"))), lambda x: x["b"]), between).alias("text"))
    if target == "html":
        name = F.lit("Subtitles") if title is None else title
        return body.withColumn("text", html_document(F.concat(F.lit("<main><h1>"), escape_html(name), F.lit("</h1>"), F.col("text"), F.lit("</main>")), name))
    return body.withColumn("text", F.concat(F.lit({"vtt": "WEBVTT\n\n", "ass": ASS_HEAD}.get(target, "")), F.col("text"), F.lit("\n")))
