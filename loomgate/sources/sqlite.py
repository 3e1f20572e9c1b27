"""SQLite files as a Python data source: ranges of row ids as partitions, Arrow batches, filters pushed into the query.

    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.read.format("loomgate_sqlite").option("path", file).option("table", name).load()

The file has to be readable at the same path on every executor."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import BinaryType, DoubleType, LongType, StringType, StructField, StructType

_TYPES = (("INT", LongType()), ("CHAR", StringType()), ("CLOB", StringType()), ("TEXT", StringType()), ("BLOB", BinaryType()), ("REAL", DoubleType()), ("FLOA", DoubleType()), ("DOUB", DoubleType()))
_OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
ROWS_PER_PARTITION, MAX_PARTITIONS, BATCH = 500_000, 1000, 10_000


def quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def tables(path: str) -> list[str]:
    """User tables by name; an error if there is none."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        names = [r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
    if not names:
        raise ValueError("No readable tables were found")
    return names


class Rows(InputPartition):
    def __init__(self, low: int | None, high: int | None):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.table = schema, options["path"], options["table"]
        self.where: list[str] = []
        self.values: list[object] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons and null tests on plain columns go into the query; the rest stays with Spark."""
        for f in filters:
            name = quoted(f.attribute[0]) if len(getattr(f, "attribute", ())) == 1 else None
            if name and type(f) in _OPERATORS and isinstance(f.value, (int, float, str)):
                self.where.append(f"{name} {_OPERATORS[type(f)]} ?")
                self.values.append(f.value)
            elif name and isinstance(f, (IsNull, IsNotNull)):
                self.where.append(f"{name} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL")
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        try:
            with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
                low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quoted(self.table)}").fetchone()
        except sqlite3.OperationalError:  # a table without row ids, or a view
            return [Rows(None, None)]
        if low is None:
            return [Rows(None, None)]
        step = max(ROWS_PER_PARTITION, -(-(high - low + 1) // MAX_PARTITIONS))  # scattered ids make wide ranges, not many
        return [Rows(a, min(high, a + step - 1)) for a in range(low, high + 1, step)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        where, values = list(self.where), list(self.values)
        if partition.low is not None:
            where += ["rowid >= ?", "rowid <= ?"]
            values += [partition.low, partition.high]
        kinds = [f.dataType for f in self.schema]
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            names = ", ".join(quoted(f.name) for f in self.schema)
            found = db.execute(f"SELECT {names} FROM {quoted(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else ""), values)
            while rows := found.fetchmany(BATCH):
                columns = [[_fit(v, k) for v in column] for column, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(k)) for c, k in zip(columns, kinds, strict=True)], names=[f.name for f in self.schema])


def _fit(v: object, kind) -> object:
    """SQLite checks no types: a value of another kind than its column's is converted if that loses nothing, else null."""
    if v is None:
        return None
    if isinstance(kind, StringType):
        return v.decode("utf-8", "replace") if isinstance(v, bytes) else v if isinstance(v, str) else str(v)
    if isinstance(kind, DoubleType):
        return float(v) if isinstance(v, (int, float)) else None
    if isinstance(kind, LongType):
        return v if isinstance(v, int) else int(v) if isinstance(v, float) and v.is_integer() else None
    return v if isinstance(v, bytes) else str(v).encode()


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loomgate_sqlite"

    def schema(self) -> StructType:
        """By declared types; equal names that differ in case only keep the last."""
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            columns = db.execute(f"PRAGMA table_info({quoted(self.options['table'])})").fetchall()
        found: dict[str, StructField] = {}
        for _, name, declared, *_ in columns:
            found.pop(name.lower(), None)
            found[name.lower()] = StructField(name, next((t for word, t in _TYPES if word in (declared or "").upper()), StringType()))
        return StructType(list(found.values()))

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(schema, dict(self.options))


def read(spark: SparkSession, path: str, table: str | None = None) -> dict[str, DataFrame]:
    """Tables of a database file by name."""
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    load = lambda t: spark.read.format("loomgate_sqlite").option("path", path).option("table", t).load()
    return {t: load(t) for t in ([table] if table else tables(path))}
