"""Page layout by hand."""

import struct

import pytest
from pyspark.sql import functions as F

from loomgate.operators import aggregates, layout


def test_lines(spark):
    piece = lambda ord, x, y, **more: {"page": 1, "ord": ord, "x": float(x), "baseline": float(y), "width": 10.0, "height": 10.0, "rotation": 0.0, "family": "Arial", "bold": False, "italic": False, "colour": "", "eol": False} | more
    pieces = [piece(0, 0, 100), piece(1, 12, 101), piece(2, 60, 100), piece(3, 72, 100, bold=True), piece(4, 84, 100, bold=True, eol=True), piece(5, 96, 100, bold=True), piece(6, 108, 110, bold=True), piece(7, 0, 200, rotation=90.0), piece(8, 12, 200, rotation=90.0)]
    df = spark.createDataFrame([tuple(p.values()) for p in pieces] + [tuple((piece(0, 0, 100) | {"page": 2}).values())], "page int, ord int, x double, baseline double, width double, height double, rotation double, family string, bold boolean, italic boolean, colour string, eol boolean")
    found = layout.line_numbers(df, ["page"], "ord", 600.0).orderBy("page", "ord").collect()
    assert [r["line"] for r in found] == [0, 0, 1, 2, 2, 3, 4, 5, 6, 0]


def test_jpeg_and_cells():
    frame = b"\xff\xd8" + b"\xff\xe0" + struct.pack(">H", 4) + b"xx" + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 20, 30) + bytes(10)
    assert layout.jpeg_dimensions(frame) == (30, 20) and layout.jpeg_dimensions(b"x") is None
    assert layout.cells_of("<table><tr><th>a<td> b  c <tr><td><table><tr><td>d</table></table>") == [["a", "b c"], ["d"], ["d"]]


def test_break_reasons():
    piece = {"x": 10.0, "baseline": 5.0, "width": 8.0, "height": 10.0, "rotation": 0.0, "family": "a", "bold": False, "italic": False, "colour": "", "eol": False}
    means = {"baseline": 5.0, "height": 10.0, "rotation": 0.0}
    why = lambda last=None, own=None, means=means: layout.break_before(means, {**piece, **(last or {})}, {**piece, "x": 20.0, **(own or {})}, 600.0)
    assert why() is None and why(own={"colour": None}) is None
    assert why(last={"eol": True}) == "end of line" and why(own={"bold": True}) == "bold" and why(own={"colour": "f00"}) == "colour"
    assert why(own={"rotation": 2.5}) == "turn of the piece" and why(own={"rotation": 1.5}) == "turn against the line"
    assert why(own={"baseline": 8.6}) == "baseline" and why(own={"height": 14.0}) == "size" and why(own={"x": 7.9}) == "start" and why(own={"x": 35.0}) == "gap"


def test_at_most(spark):
    assert aggregates.at_most(spark.range(3), 3, "slides").count() == 3
    with pytest.raises(ValueError, match="More than 2 slides"):
        aggregates.at_most(spark.range(3), 2, "slides")
