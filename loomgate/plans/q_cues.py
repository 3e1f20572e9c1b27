"""Queries of cue lists, and their SQL. Conversations are read as cues: a turn starts at turn x 5 s."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgate.plans.tables import table
from loomgate.sinks import cues as out
from loomgate.sources import cues as into


def _cues(spark, d):
    turns = table(spark, d, "conversations")
    idx = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    start = F.col("turn") * 5003
    return turns.select("conv_id", idx.alias("idx"), start.alias("start_ms"), (start + 500 + F.length("text")).alias("end_ms"), F.regexp_replace("text", r"\s*\n\s*", "\n").alias("text"))


def cues_from_conversations(spark, d):
    return _cues(spark, d)


def _render(target):
    def query(spark, d):
        return _cues(spark, d).select("conv_id", "idx", out.block(target).alias("block"))

    return query


def srt_documents(spark, d):
    return out.document(_cues(spark, d), "srt", ["conv_id"])


def vtt_documents(spark, d):
    return out.document(_cues(spark, d), "vtt", ["conv_id"])


def _round_trip(target, parse):
    def query(spark, d):
        return parse(out.document(_cues(spark, d), target, ["conv_id"]), "text", ["conv_id"])

    return query


QUERIES = {
    "cues_from_conversations": cues_from_conversations, "srt_render": _render("srt"), "vtt_render": _render("vtt"), "ass_render": _render("ass"), "cue_text": _render("txt"), "cue_html": _render("html"),
    "srt_documents": srt_documents, "vtt_documents": vtt_documents,
    "srt_roundtrip_parse": _round_trip("srt", into.srt), "vtt_roundtrip_parse": _round_trip("vtt", into.vtt), "ass_roundtrip_parse": _round_trip("ass", into.ass),
}

_CUES = r"""WITH c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS idx, turn * 5003 AS start_ms, turn * 5003 + 500 + length(text) AS end_ms, regexp_replace(text, '\s*\n\s*', chr(10), 'g') AS text FROM conversations)"""


def _ts(x: str, mark: str) -> str:
    return f"format('{{:02d}}:{{:02d}}:{{:02d}}{mark}{{:03d}}', {x} // 3600000, {x} // 60000 % 60, {x} // 1000 % 60, {x} % 1000)"


def _span(mark: str) -> str:
    return f"{_ts('start_ms', mark)} || ' --> ' || {_ts('end_ms', mark)} || chr(10) || text"


def _ass(x: str) -> str:
    cs = f"floor({x} / 10 + 0.5)::BIGINT"
    return f"format('{{}}:{{:02d}}:{{:02d}}.{{:02d}}', {cs} // 360000, {cs} // 6000 % 60, {cs} // 100 % 60, {cs} % 100)"


_ESC = "replace(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#039;'), chr(10), '<br>')"
SQL = {
    "cues_from_conversations": f"{_CUES} SELECT * FROM c",
    "srt_render": f"{_CUES} SELECT conv_id, idx, idx || chr(10) || {_span(',')} AS block FROM c",
    "vtt_render": f"{_CUES} SELECT conv_id, idx, {_span('.')} AS block FROM c",
    "ass_render": f"{_CUES} SELECT conv_id, idx, 'Dialogue: 0,' || {_ass('start_ms')} || ',' || {_ass('end_ms')} || ',Default,,0,0,0,,' || replace(text, chr(10), '\\N') AS block FROM c",
    "cue_text": f"{_CUES} SELECT conv_id, idx, '[' || {_ts('start_ms', '.')} || '] ' || text AS block FROM c",
    "cue_html": f"{_CUES} SELECT conv_id, idx, '<section><time>' || {_ts('start_ms', '.')} || ' – ' || {_ts('end_ms', '.')} || '</time><p>' || {_ESC} || '</p></section>' AS block FROM c",
    "srt_documents": f"{_CUES} SELECT conv_id, string_agg(idx || chr(10) || {_span(',')}, chr(10) || chr(10) ORDER BY idx) || chr(10) AS text FROM c GROUP BY conv_id",
    "vtt_documents": f"{_CUES} SELECT conv_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({_span('.')}, chr(10) || chr(10) ORDER BY idx) || chr(10) AS text FROM c GROUP BY conv_id",
    "srt_roundtrip_parse": f"{_CUES} SELECT * FROM c",
    "vtt_roundtrip_parse": f"{_CUES} SELECT * FROM c",
    "ass_roundtrip_parse": f"{_CUES} SELECT conv_id, idx, floor(start_ms / 10 + 0.5)::BIGINT * 10 AS start_ms, floor(end_ms / 10 + 0.5)::BIGINT * 10 AS end_ms, text FROM c",
}
