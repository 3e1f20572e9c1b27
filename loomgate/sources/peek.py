"""First and last bytes of files, as a Python data source that reads no more of a file than it is asked for.

    spark.dataSource.register(PeekSource)
    spark.read.format("loomgate_peek").option("path", folder).load()

Columns: path, name, ext (in lower case, empty if there is none), size, first (up to `head` bytes), last (up to `tail` bytes) and bytes_read. Name some of them in schema() and the others cost nothing:
without first and last no file is opened. With the option `signature` (hexadecimal) only files that begin with it have their first and last
bytes read. Comparisons of size, and equalities, lists, starts and ends of name and ext, also negated, are pushed down: what they leave out isn't opened.

Any file system that Arrow knows is read (a path, or a URI as file://, hdfs://, s3://, gs://); the driver lists the folder, tasks open its files.
Hidden files (dot, underscore) are left out; a folder that isn't there is an error; an empty folder gives no rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

SCHEMA = "path string, name string, ext string, size long, first binary, last binary, bytes_read long"
HEAD, TAIL = 2048, 2 << 20
#: Files of a partition, and bytes of their ends that are held at once.
FILES, BATCH_BYTES = 500, 32 << 20

_TESTS: dict[type[Filter], Callable[[object, object], bool]] = {
    EqualTo: lambda v, x: v == x, GreaterThan: lambda v, x: v > x, GreaterThanOrEqual: lambda v, x: v >= x, LessThan: lambda v, x: v < x, LessThanOrEqual: lambda v, x: v <= x,
    In: lambda v, x: v in x, StringStartsWith: str.startswith, StringEndsWith: str.endswith, StringContains: str.__contains__,
}


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), os.path.abspath(path))


def _names(path: str, size: int) -> dict[str, object]:
    name = path.rpartition("/")[2]
    ext = re.search(r"\.([a-z0-9]+)$", name.lower())
    return {"path": path, "name": name, "ext": ext[1] if ext else "", "size": size}


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int]]):
        self.files = files


class PeekReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.head, self.tail = int(options.get("head", HEAD)), int(options.get("tail", TAIL))
        self.signature = bytes.fromhex(options.get("signature", ""))
        self.tests: list[tuple[str, type[Filter], object, bool]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            own, kept = (f.child, False) if isinstance(f, Not) else (f, True)
            if type(own) in _TESTS and own.attribute in (("name",), ("ext",), ("size",)):
                self.tests.append((own.attribute[0], type(own), own.value, kept))
            elif not (isinstance(own, IsNotNull) and kept and own.attribute in (("path",), ("name",), ("ext",), ("size",))):  # those are never null
                yield f

    def partitions(self) -> list[InputPartition]:
        system, base = opened(self.path)
        found = [x for x in system.get_file_info(fs.FileSelector(base, recursive=True)) if x.type == fs.FileType.File and x.base_name[0] not in "._"]
        kept = [(x.path, x.size) for x in found if all(_TESTS[kind](_names(x.path, x.size)[column], value) == wanted for column, kind, value, wanted in self.tests)]
        kept.sort()
        return [Files(kept[i : i + FILES]) for i in range(0, len(kept), FILES)]

    def _ends(self, system: fs.FileSystem, path: str, size: int) -> tuple[bytes, bytes, int]:
        wants_first, wants_last = (c in self.schema.names for c in ("first", "last"))
        if not (wants_first or wants_last or "bytes_read" in self.schema.names) or not size:
            return b"", b"", 0
        with system.open_input_file(path) as f:
            mark = f.read_at(min(size, len(self.signature)), 0) if self.signature else b""
            if mark != self.signature:
                return b"", b"", len(mark)
            first = f.read_at(min(size, self.head), 0) if wants_first else b""
            last = f.read_at(min(size, self.tail), size - min(size, self.tail)) if wants_last else b""
            return first, last, len(mark) + len(first) + len(last)

    def read(self, partition: Files | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing to read
            return
        system, _ = opened(self.path)
        scheme = self.path.split("://")[0] + "://" if "://" in self.path else "file:"
        schema = to_arrow_schema(self.schema)
        rows, held = [], 0
        for path, size in partition.files:
            first, last, n = self._ends(system, path, size)
            row = _names(path, size) | {"path": scheme + path, "first": first, "last": last, "bytes_read": n}
            rows.append({c: row[c] for c in self.schema.names})
            held += n
            if held > BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class PeekSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loomgate_peek"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return PeekReader(schema, dict(self.options))


def read(spark: SparkSession, path: str, columns: list[str] | None = None, **options: object) -> DataFrame:
    """The columns (all of SCHEMA if none are named) of the files below path; options: head, tail, signature."""
    spark.dataSource.register(PeekSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    wanted = [c for c in SCHEMA.split(", ") if columns is None or c.split()[0] in columns]
    return spark.read.format("loomgate_peek").schema(", ".join(wanted)).options(path=path, **options).load()
