"""Entries of ZIP, TAR, TGZ and GZ files, and documents inside packages: one row for each entry.

The files come from Spark's binaryFile reader, so they are dealt to executors; a file is opened in the task
that has it and its entries leave it one by one."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRIES = "path string, ord int, name string, content binary"
MAX_SLIDES = 500


def clean_name(name: str) -> str:
    return "/".join(s for s in name.replace("\\", "/").split("/") if s not in ("", ".", "..")) or "file"


def unique(name: str, used: set[str]) -> str:
    """name, or name-2, name-3, … before the extension, whichever isn't in used; it is put there."""
    stem, dot, ext = name.rpartition(".")
    stem, ext = (stem, f".{ext.lower()}") if dot and stem and ext.isalnum() else (name, "")
    found, n = name, 2
    while found in used:
        found, n = f"{stem}-{n}{ext}", n + 1
    used.add(found)
    return found


def entries_of(name: str, data: bytes) -> Iterator[tuple[str, bytes]]:
    """Regular entries of an archive, by its content: ZIP, TAR, or GZ (of a TAR or of one file)."""
    if data[:2] == b"\x1f\x8b":
        data = gzip.decompress(data)
        if data[257:262] != b"ustar":
            yield re.sub(r"\.gz$", "", name, flags=re.I) or "file", data
            return
    if data[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for e in z.infolist():
                if not e.is_dir():
                    yield e.filename, z.read(e)
    elif data[257:262] == b"ustar":
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for e in t:
                if e.isreg():
                    yield e.name, t.extractfile(e).read()
    else:
        raise ValueError(f"Unsupported archive: {name}")


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, data in zip(b.column(0), b.column(1), strict=True):
            used: set[str] = set()
            found = False
            for i, (name, content) in enumerate(entries_of(path.as_py().rpartition("/")[2], data.as_py())):
                found = True
                yield pa.RecordBatch.from_pylist([{"path": path.as_py(), "ord": i, "name": unique(clean_name(name), used), "content": content}], schema=pa.schema([("path", pa.string()), ("ord", pa.int32()), ("name", pa.string()), ("content", pa.binary())]))
            if not found:
                raise ValueError(f"The archive is empty: {path.as_py()}")


def entries(files: DataFrame) -> DataFrame:
    """files (path, content) -> path, ord, name, content; names are clean and unique in their archive."""
    return files.select("path", "content").mapInArrow(_explode, ENTRIES)


def read(spark: SparkSession, path: str) -> DataFrame:
    return entries(spark.read.format("binaryFile").load(path))


def is_tar_in_gzip(content: Column) -> Column:
    """Of unpacked bytes: whether they are a TAR, by the mark in its first header."""
    return F.substring(content, 258, 5) == F.lit(bytearray(b"ustar"))


def _texts(xml: bytes, unit: str, piece: str) -> list[str]:
    """Texts of the elements named unit, each its pieces joined, trimmed; empty ones left out."""
    local = lambda e: e.tag.rpartition("}")[2]
    joined = ("".join(t.text or "" for t in p.iter() if local(t) == piece).strip() for p in ElementTree.fromstring(xml).iter() if local(p) == unit)
    return [x for x in joined if x]


def document_parts(entries: DataFrame) -> DataFrame:
    """Of package entries: (path, number, lines) of each slide of a PPTX, and of the text of a DOCX, ODT or ODP (number 1)."""
    wanted = entries.where(F.col("name").rlike(r"(?i)^ppt/slides/slide\d+\.xml$") | F.col("name").isin("word/document.xml", "content.xml"))
    many = wanted.where(F.col("name").startswith("ppt/")).groupBy("path").count().where(f"count > {MAX_SLIDES}")
    if not many.isEmpty():
        raise ValueError(f"A presentation has more than {MAX_SLIDES} slides")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                n = re.search(r"slide(\d+)\.xml$", r["name"], re.I)
                lines = _texts(r["content"], "p", "t") if r["name"] != "content.xml" else ["".join(p.itertext()).strip() for p in ElementTree.fromstring(r["content"]).iter() if p.tag.rpartition("}")[2] in ("p", "h")]
                rows.append({"path": r["path"], "number": int(n[1]) if n else 1, "lines": [x for x in lines if x]})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("path", pa.string()), ("number", pa.int32()), ("lines", pa.list_(pa.string()))]))

    return wanted.select("path", "name", "content").mapInArrow(run, "path string, number int, lines array<string>")


def slides(entries: DataFrame) -> DataFrame:
    """path, number (from 1, in numeric order), title, body, lines of PPTX packages."""
    from pyspark.sql import Window

    parts = document_parts(entries.where(F.col("name").startswith("ppt/")))
    n = F.row_number().over(Window.partitionBy("path").orderBy("number"))
    title = F.coalesce(F.get("lines", F.lit(0)), F.concat(F.lit("Slide "), n.cast("string")))
    return parts.select("path", n.alias("number"), title.alias("title"), F.array_join(F.slice("lines", F.lit(2), F.greatest(F.size("lines"), F.lit(1))), "\n").alias("body"), "lines")
