"""Page layout: pieces of text to lines, colours of stretches of text, sizes of images, cells of tables."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgate.functions.markup import Node, Tree
from loomgate.functions.text import trim
from loomgate.operators import aggregates, lookups, ordered

#: Largest turn in degrees, largest turn against the line, baselines apart in points and in heights, ratio of
#: heights, overlap in heights, gap in heights and as a share of the page.
TURN, TURN_STEP, BASE, BASE_HEIGHTS, RATIO, BACK, GAP_HEIGHTS, GAP_PAGE = 2.0, 1.0, 1.5, 0.35, (0.72, 1.38), 0.2, 1.6, 0.008
#: Characters in a stretch in which pieces and colour runs meet.
STRETCH = 256
PIECE = ("x", "baseline", "width", "height", "rotation", "family", "bold", "italic", "colour", "eol")


STYLE = ("family", "bold", "italic", "colour")


def _measures(means: dict, last: dict, piece: dict, page_width: float) -> Iterator[tuple[str, float, float, float]]:
    """What is measured of a piece against a line, by name: (name, value, least, most) with the span it may lie in.

    means holds the line's running means of baseline, height and rotation; last is its last piece."""
    unit = min(means["height"], piece["height"])
    far = float("inf")
    reach = max(BASE, unit * BASE_HEIGHTS)
    yield "turn of the piece", piece["rotation"], -TURN, TURN
    yield "turn of the line", means["rotation"], -TURN, TURN
    yield "turn against the line", piece["rotation"] - means["rotation"], -TURN_STEP, TURN_STEP
    yield "baseline", piece["baseline"] - means["baseline"], -reach, reach
    yield "size", piece["height"] / means["height"], *RATIO
    yield "start", piece["x"] - last["x"], -unit * BACK, far
    yield "gap", piece["x"] - last["x"] - last["width"], -unit * BACK, max(unit * GAP_HEIGHTS, page_width * GAP_PAGE)


def break_before(means: dict, last: dict, piece: dict, page_width: float) -> str | None:
    """Why a piece begins a new line: an end of line, a style, or the first measure out of its span; None if it goes on."""
    if last["eol"]:
        return "end of line"
    for name in STYLE:
        if (last[name] or None) != (piece[name] or None):
            return name
    return next((name for name, value, least, most in _measures(means, last, piece, page_width) if not least <= value <= most), None)


def line_numbers(pieces: DataFrame, keys: list[str], order: str, page_width: float) -> DataFrame:
    """pieces with `line`: the number of the line on its page, from 0.

    A piece joins the line before it or begins one. As the line's means move with every piece, this is no window but a
    fold; pages are dealt to tasks and sorted there, and the fold keeps the state of one line, however long a page is."""
    at = {c: pieces.columns.index(c) for c in (*keys, *PIECE)}

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, line, last, number = None, None, None, 0
        for b in batches:
            numbers = []
            for values in zip(*(b.column(at[c]).to_pylist() for c in (*keys, *PIECE)), strict=True):
                own, piece = values[: len(keys)], dict(zip(PIECE, values[len(keys) :], strict=True))
                if page is None or own != page[0]:
                    page, line, number = (own,), None, -1
                if line is not None and break_before(line, last, piece, page_width) is None:
                    n = line["n"] + 1
                    line = {"n": n, **{k: line[k] + (piece[k] - line[k]) / n for k in ("baseline", "height", "rotation")}}
                else:
                    number += 1
                    line = {"n": 1, **{k: piece[k] for k in ("baseline", "height", "rotation")}}
                numbers.append(number)
                last = piece
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(numbers, pa.int32())], names=[*b.schema.names, "line"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema), "line int"])
    return pieces.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(fold, schema)


def piece_colours(pieces: DataFrame, runs: DataFrame, keys: list[str], order: str, length: str, colour: str) -> DataFrame:
    """keys, order, colour: of each piece the colour of most of its characters, of equal ones the first.

    Pieces and colour runs are two cuts of one text: both get offsets and are joined where they overlap."""
    spans = ordered.running_offsets(runs, keys, [order], length).select(*keys, F.col(order).alias("run"), colour, "start", "end")
    cut = ordered.running_offsets(pieces, keys, [order], length).select(*keys, order, F.col("start").alias("from"), F.col("end").alias("to"))
    met = lookups.overlapping(cut, ("from", "to"), spans, ("start", "end"), keys, STRETCH).withColumn("shared", F.least("to", "end") - F.greatest("from", "start"))
    return aggregates.weighted_mode(met, [*keys, order], colour, F.col("shared"), "run").select(*keys, order, F.col("mode").alias(colour))


def _big(content: Column, at: int, size: int) -> Column:
    return F.conv(F.hex(F.substring(content, at + 1, size)), 16, 10).cast("long")


def _little(content: Column, at: int) -> Column:
    return _big(content, at, 1) + _big(content, at + 1, 1) * 256


def image_size(content: Column) -> Column:
    """struct width, height of PNG and GIF bytes from their headers; null for anything else."""
    png = F.substring(content, 1, 8) == F.lit(bytearray(b"\x89PNG\r\n\x1a\n"))
    gif = F.substring(content, 1, 4) == F.lit(bytearray(b"GIF8"))
    sized = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    return F.when(png, sized(_big(content, 16, 4), _big(content, 20, 4))).when(gif, sized(_little(content, 6), _little(content, 8)))


def jpeg_dimensions(data: bytes) -> tuple[int, int] | None:
    """Width and height from the first frame header."""
    at = 2
    while data[:2] == b"\xff\xd8" and at + 9 <= len(data) and data[at] == 0xFF:
        mark, size = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + size
    return None


def cells_of(page: str) -> list[list[str]]:
    """Rows of cells (td, th) of all tables of a page, in order."""

    def walk(node: Node) -> Iterator[list[str]]:
        for child in node:
            if isinstance(child, Node):
                if child.tag == "tr":
                    yield [" ".join(_words(c).split()) for c in child if isinstance(c, Node) and c.tag in ("td", "th")]
                yield from walk(child)

    def _words(node: Node) -> str:
        return "".join(c if isinstance(c, str) else _words(c) for c in node)

    return list(walk(Tree(page).root))


def table_cells(page: Column) -> Column:
    """array<array<string>> of a page's table rows."""

    @F.pandas_udf("array<array<string>>")
    def found(pages: pd.Series) -> pd.Series:
        return pages.map(lambda p: cells_of(p or ""))

    return found(page)


def metadata_text(json: Column) -> Column:
    """A metadata value as text: arrays joined by comma and blank, objects by their `en` or first member."""
    value = F.try_parse_json(json)
    listed = F.array_join(F.from_json(json, "array<string>"), ", ")
    named = F.from_json(json, "map<string,string>")
    member = F.coalesce(F.try_element_at(named, F.lit("en")), F.get(F.map_values(named), F.lit(0)))
    kind = F.schema_of_variant(value)
    return F.when(kind.startswith("ARRAY"), listed).when(kind.startswith("OBJECT"), member).otherwise(F.try_variant_get(value, "$", "string"))


def shown(text: Column, rotation: Column) -> Column:
    """Whether a piece of text is laid out at all: it isn't blank and hardly turned (degrees)."""
    return F.coalesce(trim(text) != "", F.lit(False)) & (F.abs(rotation) <= TURN)


def glyph_text(glyphs: Column) -> Column:
    """The text of an array<struct<str, unicode, fontChar>>: of each glyph the first of these that isn't empty."""
    own = lambda g: F.coalesce(*[F.nullif(g[k], F.lit("")) for k in ("str", "unicode", "fontChar")], F.lit(""))
    return F.array_join(F.transform(glyphs, own), "")


def colour_states(steps: Column) -> Column:
    """The colour after each of array<struct<op, colour>>: set takes a colour, save keeps the one at hand, restore takes it back
    (without one kept, nothing changes); other steps change nothing."""
    texts = "array<string>"
    zero = F.struct(F.lit(None).cast("string").alias("now"), F.array().cast(texts).alias("kept"), F.array().cast(texts).alias("out"))

    def step(s: Column, x: Column) -> Column:
        depth = F.size(s["kept"])
        back = (x["op"] == "restore") & (depth > 0)
        now = F.when(x["op"] == "set", x["colour"]).when(back, F.try_element_at(s["kept"], F.lit(-1))).otherwise(s["now"])
        kept = F.when(x["op"] == "save", F.concat(s["kept"], F.array(s["now"]))).when(back, F.slice(s["kept"], F.lit(1), depth - 1)).otherwise(s["kept"])
        return F.struct(now.alias("now"), kept.alias("kept"), F.concat(s["out"], F.array(now)).alias("out"))

    return F.aggregate(steps, zero, step, lambda s: s["out"])
