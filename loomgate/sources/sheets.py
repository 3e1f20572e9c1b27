"""Workbooks (XLSX, ODS, FODS), DBF, DIF and SYLK: the first sheet as rows of text cells.

Files come from binaryFile; a task yields the rows of its file: path, ord, cells (array of text, null where a cell
is missing). `table` gives the cells of one layout their header's names."""

from __future__ import annotations

import io
import re
import struct
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = "path string, ord int, cells array<string>"
#: Columns and rows of a sheet at most, as the formats have it.
_LARGEST, _ROWS = 1 << 14, 1 << 20


def _local(e: ElementTree.Element) -> str:
    return e.tag.rpartition("}")[2]


def _first_sheet(z: zipfile.ZipFile, names: list[str]) -> str:
    """The part of the sheet that the workbook lists first; without such a list, the one of the lowest number."""
    get = lambda e, name: next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)
    if {"xl/workbook.xml", "xl/_rels/workbook.xml.rels"} <= set(names):
        target = {get(r, "Id"): get(r, "Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        for sheet in (e for e in ElementTree.fromstring(z.read("xl/workbook.xml")).iter() if _local(e) == "sheet"):
            part = target.get(get(sheet, "id")) or ""
            part = part[1:] if part.startswith("/") else f"xl/{part}"
            if part in names:
                return part
    return min((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.search(r"\d+", n.rpartition("/")[2])[0]))


def _xlsx(data: bytes) -> Iterator[list[str | None]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _local(si) == "si"] if "xl/sharedStrings.xml" in names else []
        sheet = _first_sheet(z, names)
        for row in (e for e in ElementTree.fromstring(z.read(sheet)).iter() if _local(e) == "row"):
            cells: list[str | None] = []
            for c in row:
                if at := re.match("[A-Z]+", c.get("r", "")):
                    place = 0
                    for letter in at[0]:
                        place = place * 26 + ord(letter) - 64
                    cells += [None] * (min(place, _LARGEST) - 1 - len(cells))
                value = next((v.text for v in c.iter() if _local(v) == "v"), None)
                if c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = "".join(t.text or "" for t in c.iter() if _local(t) == "t")
                elif c.get("t") == "b":
                    value = {"1": "true", "0": "false"}.get(value, value)
                cells.append(value)
            yield cells


def _ods(data: bytes) -> Iterator[list[str | None]]:
    source = zipfile.ZipFile(io.BytesIO(data)).read("content.xml") if data[:2] == b"PK" else data
    table = next(e for e in ElementTree.fromstring(source).iter() if _local(e) == "table")
    get = lambda e, name: next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), None)
    for row in (e for e in table.iter() if _local(e) == "table-row"):
        cells: list[str | None] = []
        for c in row:
            text = "\n".join("".join(p.itertext()) for p in c if _local(p) == "p") or None
            value = get(c, "value") or get(c, "date-value") or get(c, "boolean-value") or text
            cells += [value] * min(_LARGEST, int(get(c, "number-columns-repeated") or 1))
        while cells and cells[-1] is None:
            cells.pop()
        if cells:
            for _ in range(min(_ROWS, int(get(row, "number-rows-repeated") or 1))):
                yield list(cells)


def _dbf(data: bytes) -> Iterator[list[str | None]]:
    count, start, size = struct.unpack("<IHH", data[4:12])
    fields = []
    for at in range(32, start - 1, 32):
        if data[at] == 0x0D:
            break
        fields.append((data[at : at + 11].split(b"\0")[0].decode("latin-1"), chr(data[at + 11]), data[at + 16]))
    yield [n for n, _, _ in fields]
    for i in range(count):
        at = start + i * size
        if data[at : at + 1] == b"*":  # a deleted record
            continue
        at, cells = at + 1, []
        for _, kind, width in fields:
            raw = data[at : at + width].decode("latin-1").strip()
            at += width
            if kind == "L":
                raw = {"T": "true", "Y": "true", "F": "false", "N": "false"}.get(raw.upper(), "")
            elif kind == "D" and len(raw) == 8:
                raw = f"{raw[:4]}-{raw[4:6]}-{raw[6:]}"
            cells.append(raw or None)
        yield cells


def _dif(data: bytes) -> Iterator[list[str | None]]:
    lines = data.decode("utf-8-sig", "replace").splitlines()
    at, row = next((i for i, x in enumerate(lines) if x.strip().upper() == "DATA"), len(lines)) + 3, None
    for head, text in zip(lines[at::2], lines[at + 1 :: 2], strict=False):
        kind, _, value = head.partition(",")
        if kind.strip() == "-1":
            if row is not None:
                yield row
            if text.strip().upper() == "EOD":
                return
            row = []
        elif row is not None:
            row.append(value.strip() if kind.strip() == "0" else text.strip().removeprefix('"').removesuffix('"').replace('""', '"'))


def _sylk(data: bytes) -> Iterator[list[str | None]]:
    grid: dict[int, dict[int, str]] = {}
    x = y = 1
    for line in data.decode("utf-8", "replace").splitlines():
        if not line.startswith("C;"):
            continue
        for part in re.split(r"(?<!;);(?!;)", line)[1:]:
            if part[:1] == "X":
                x = int(part[1:])
            elif part[:1] == "Y":
                y = int(part[1:])
            elif part[:1] == "K":
                grid.setdefault(y, {})[x] = part[2:-1].replace(";;", ";") if part[1:2] == '"' else part[1:]
    for row in sorted(grid):
        yield [grid[row].get(c) for c in range(1, max(grid[row]) + 1)]


READERS = {"xlsx": _xlsx, "xlsm": _xlsx, "xltx": _xlsx, "xltm": _xlsx, "ods": _ods, "ots": _ods, "fods": _ods, "dbf": _dbf, "dif": _dif, "sylk": _sylk}


def rows(files: DataFrame, ext: str) -> DataFrame:
    """files (path, content) -> path, ord, cells of the first sheet of each."""
    if ext not in READERS:
        raise ValueError(f"No reader for {ext}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0), b.column(1), strict=True):
                held: list[dict] = []
                for i, cells in enumerate(READERS[ext](data.as_py())):
                    held.append({"path": path.as_py(), "ord": i, "cells": cells})
                    if len(held) == 5000:
                        yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)
                        held = []
                yield pa.RecordBatch.from_pylist(held, schema=_SCHEMA)

    return files.select("path", "content").mapInArrow(run, ROWS)


_SCHEMA = pa.schema([("path", pa.string()), ("ord", pa.int32()), ("cells", pa.list_(pa.string()))])


def table(cells: DataFrame) -> DataFrame:
    """Rows of one layout under the names of the first row of its first file; unnamed and repeated columns are numbered."""
    head = cells.where("ord = 0").orderBy("path").first()
    if head is None:
        raise ValueError("The sheet is empty")
    names: list[str] = []
    for i, n in enumerate(head["cells"]):
        label = n or f"column{i + 1}"
        names.append(label if label not in names else f"{label}_{i + 1}")
    return cells.where("ord > 0").orderBy("path", "ord").select(*[F.get("cells", F.lit(i)).alias(n) for i, n in enumerate(names)])


def read(spark: SparkSession, path: str, ext: str) -> DataFrame:
    return table(rows(spark.read.format("binaryFile").load(path), ext))
