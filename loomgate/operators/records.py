"""Records out of nested data: discovery, flattening, rows."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StructType

from loomgate.functions.text import blob_text

#: How deep below the root an array of records is looked for.
DEPTH = 5


def _leaves(kind: DataType, at: Column, name: str) -> list[tuple[str, Column]]:
    if isinstance(kind, StructType):
        return [leaf for f in kind for leaf in _leaves(f.dataType, at.getField(f.name), f"{name}.{f.name}" if name else f.name)]
    if isinstance(kind, (ArrayType, MapType)):
        return [(name, F.to_json(at, {"ignoreNullFields": "false"}))]
    return [(name, at)]


def flattened(df: DataFrame) -> DataFrame:
    """Structs become dotted columns, arrays JSON text, empty structs nothing; of equal names the last one stays.

    Only the schema is walked, on the driver; the rows are a plain projection."""
    found: dict[str, Column] = {}
    for f in df.schema:
        for name, column in _leaves(f.dataType, F.col(f"`{f.name}`"), f.name):
            found.pop(name, None)
            found[name] = column
    return df.select(*[c.alias(n) for n, c in found.items()])


def null_to_empty(df: DataFrame) -> DataFrame:
    """Nulls of all columns as empty texts; the columns become text."""
    return df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in df.columns])


def blobs_as_text(df: DataFrame) -> DataFrame:
    return df.select(*[blob_text(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, BinaryType) else F.col(f"`{f.name}`") for f in df.schema])


def union_of_keys(*frames: DataFrame) -> DataFrame:
    """All rows under the union of the columns, in the order of their first appearance."""
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def _record_paths(kind: DataType, path: tuple[str, ...]) -> list[tuple[tuple[str, ...], bool]]:
    """Arrays in depth-first order, down to DEPTH: (path, whether its elements are records)."""
    if isinstance(kind, ArrayType):
        return [(path, isinstance(kind.elementType, (StructType, MapType, ArrayType)))]
    if isinstance(kind, StructType) and len(path) <= DEPTH:
        return [x for f in kind for x in _record_paths(f.dataType, (*path, f.name))]
    return []


def rows(df: DataFrame) -> DataFrame:
    """Rows of documents of one known schema: the elements of the first array of records, its siblings dropped;
    without one, each document is a row. Flattened in either case."""
    for path, records in _record_paths(StructType([f for f in df.schema]), ()):
        if records:
            at = F.col("`" + "`.`".join(path) + "`")
            item = df.select(F.explode(at).alias("value"))
            return flattened(item.select("value.*") if isinstance(item.schema["value"].dataType, StructType) else item)
    return flattened(df)


def _number(text: str) -> int | float:
    """A JSON number as ECMAScript keeps it: a double, shown without a fraction it hasn't."""
    x = float(text)
    return int(x) if x.is_integer() and abs(x) < 1e21 else x


def _shown(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))


def first_records(value: object, depth: int = 0) -> list | None:
    """The first array, depth first and down to DEPTH, all of whose entries are objects or arrays."""
    if isinstance(value, list):
        return value if all(isinstance(x, (dict, list)) for x in value) else None
    if isinstance(value, dict) and depth < DEPTH + 1:
        for child in value.values():
            if depth < DEPTH and (found := first_records(child, depth + 1)) is not None:
                return found
    return None


def rows_of(text: str | None) -> list[str] | None:
    """JSON texts of the rows of a document; null if it isn't JSON."""
    try:
        value = json.loads(text, parse_int=_number, parse_float=_number) if text is not None else None
    except ValueError:
        return None
    if text is None:
        return None
    found = first_records(value)
    return [_shown(x) for x in (found if found is not None else value if isinstance(value, list) else [value])]


def record_values(doc: Column) -> Column:
    """Of a document as JSON text, the JSON texts of its rows, for documents whose schemas differ: array<string>.

    The first array of records gives the rows (none if it is empty); an array without one gives its entries, anything
    else one row; what isn't JSON gives null. A walk along keys in their order has no expression on the JVM (VARIANT sorts
    keys), so this is an Arrow-batched function; for a known schema use `rows`."""

    @F.pandas_udf("array<string>")
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(rows_of)

    return found(doc)
