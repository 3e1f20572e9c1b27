"""Palm databases (MOBI, AZW): records by offset arithmetic on the JVM, text by record.

The record table, header fields and slices are column expressions; only the byte codec of compressed
text records (LZ77) runs in Python, record by record, so a large book is spread over tasks."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def number(content: Column, at: int | Column, size: int) -> Column:
    """The big-endian number of size bytes at place at (from 0)."""
    start = F.lit(at + 1) if isinstance(at, int) else (at + 1).cast("int")
    return F.conv(F.hex(F.substring(content, start, F.lit(size))), 16, 10).cast("long")


def is_mobi(content: Column) -> Column:
    return F.coalesce(F.substring(content, 61, 8) == F.lit(bytearray(b"BOOKMOBI")), F.lit(False))


def records(books: DataFrame, content: str, keys: list[str]) -> DataFrame:
    """keys, place (from 0), data: the records of each book; a record ends where the next begins."""
    data = F.col(content)
    offsets = F.transform(F.sequence(F.lit(0), number(data, 76, 2).cast("int") - 1), lambda i: number(data, i * 8 + 78, 4))
    # a row holds its book once: records are cut from it before they are dealt to rows of their own
    cut = F.transform("offsets", lambda at, i: F.substring(data, (at + 1).cast("int"), (F.coalesce(F.get("offsets", i + 1), F.length(data).cast("long")) - at).cast("int")))
    listed = books.where(is_mobi(data) & (number(data, 76, 2) > 0)).withColumn("offsets", offsets)
    return listed.select(*keys, F.posexplode(cut).alias("place", "data"))


def unpacked(data: bytes) -> bytes:
    """PalmDOC LZ77: literals, runs of literals, pairs back into what was written, and a space with a letter."""
    out, i = bytearray(), 0
    while i < len(data):
        b, i = data[i], i + 1
        if 1 <= b <= 8:
            out += data[i : i + b]
            i += b
        elif b < 0x80:
            out.append(b)
        elif b >= 0xC0:
            out += bytes((32, b ^ 0x80))
        elif i < len(data):
            pair, i = (b << 8 | data[i]) & 0x3FFF, i + 1
            back, n = pair >> 3, (pair & 7) + 3
            if not 0 < back <= len(out):
                raise ValueError("A text record points before its start")
            for _ in range(n):
                out.append(out[-back])
    return bytes(out)


def texts(books: DataFrame, content: str, keys: list[str]) -> DataFrame:
    """keys, place, text: the text records (1 to n) of each book; compression none or PalmDOC, anything else is an error."""
    each = records(books, content, keys)
    heads = each.where("place = 0").select(*keys, number(F.col("data"), 0, 2).alias("codec"), number(F.col("data"), 8, 2).alias("n"), number(F.col("data"), 28, 4).alias("charset"))

    @F.pandas_udf("string")
    def decoded(data: pd.Series, codec: pd.Series, charset: pd.Series) -> pd.Series:
        def one(d: bytes, c: int, s: int) -> str:
            if c not in (1, 2):
                raise ValueError(f"Unsupported compression: {c}")
            return (unpacked(d) if c == 2 else d).decode("utf-8" if s == 65001 else "cp1252", "replace")

        return pd.Series([one(d, c, s) for d, c, s in zip(data, codec, charset, strict=True)])

    return each.join(heads, keys).where("place BETWEEN 1 AND n").select(*keys, "place", decoded("data", "codec", "charset").alias("text"))


#: Types of metadata records, their names, and whether they may repeat.
METADATA = {100: ("creator", True), 101: ("publisher", False), 103: ("description", False), 104: ("isbn", False), 105: ("subject", True), 106: ("date", False), 108: ("contributor", True), 109: ("rights", False), 503: ("title", False), 524: ("language", True)}


def metadata_records(header: Column) -> Column:
    """array<struct<type, data>> of a metadata header (EXTH): each record has its type, its length with both numbers, and its bytes."""
    kind = "array<struct<type:bigint,data:binary>>"
    wrong = lambda what: F.raise_error(F.lit(what)).cast("long")
    told = F.when(F.substring(header, 1, 4) == F.lit(bytearray(b"EXTH")), number(header, 8, 4)).otherwise(wrong("Invalid metadata header"))
    count = F.when(told <= (F.length(header) - 12) / 8, told).otherwise(wrong("A metadata header has fewer bytes than its records need"))
    zero = F.struct(F.lit(12).cast("long").alias("at"), F.array().cast(kind).alias("out"))

    def step(s: Column, _: Column) -> Column:
        size = number(header, s["at"] + 4, 4)
        size = F.when((size >= 8) & (s["at"] + size <= F.length(header)), size).otherwise(wrong("A metadata record has an impossible length"))
        data = F.substring(header, (s["at"] + 9).cast("int"), (size - 8).cast("int"))
        return F.struct((s["at"] + size).alias("at"), F.concat(s["out"], F.array(F.struct(number(header, s["at"], 4).alias("type"), data.alias("data")))).alias("out"))

    each = F.when(count > 0, F.sequence(F.lit(1).cast("long"), count)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(each, zero, step, lambda s: s["out"])


def metadata(books: DataFrame, header: str, keys: list[str]) -> DataFrame:
    """keys, name, value: metadata in order; of a name that may not repeat the last counts. Text is read as UTF-8."""
    names = F.create_map(*[F.lit(x) for t, (name, _) in METADATA.items() for x in (t, name)])
    many = [name for name, repeats in METADATA.values() if repeats]
    each = books.select(*keys, F.posexplode(metadata_records(F.col(header))).alias("place", "r"))
    named = each.select(*keys, "place", F.element_at(names, F.col("r.type").cast("int")).alias("name"), F.decode("r.data", "UTF-8").alias("value")).where("name IS NOT NULL")
    slot = F.when(F.col("name").isin(many), F.col("place")).otherwise(-1).alias("slot")
    return named.groupBy(*keys, "name", slot).agg(F.max_by("value", "place").alias("value")).select(*keys, "name", "slot", "value")
