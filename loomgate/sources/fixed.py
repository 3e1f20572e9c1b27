"""Files of records of one width, as a Python data source: byte ranges as partitions, and rows that are slices of what was read.

    spark.dataSource.register(FixedSource)
    spark.read.format("loomgate_fixed").option("path", file).option("width", 512).load()

Columns: row (from 0) and data. Options: path (a path or the URI of any file system that Arrow knows; a folder's files are read as one, in the order of
their names, and each has to end with a whole record), width, start (bytes before the first record, 0) and count
(records at most, as many whole ones as there are). Comparisons of row are pushed down: a range of rows is read from its place, the rest isn't.

On it stand two formats. `read_dbf` takes the places of fields from the file's header and cuts them by column expressions, so one file is read by many tasks.
`tar_entries` finds the entries of a TAR without going through it from its start: any block that checks as a header points to the
block behind its content; pointers are doubled, and what the first block reaches are the headers. A TAR inside the
TAR has headers too, but nothing outside it points to them. Contents stay rows of blocks, so entries and archives may have any size.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from loomgate.operators import lookups, ordered
from loomgate.operators.ranges import materialise
from loomgate.sources.peek import opened

#: Bytes of a partition, and of a batch.
PART_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
BLOCK = 512


class Rows(InputPartition):
    def __init__(self, path: str, place: int, low: int, high: int):
        self.path, self.place, self.low, self.high = path, place, low, high


def files_of(path: str) -> tuple[fs.FileSystem, list[tuple[str, int]]]:
    """The file, or the folder's files that aren't hidden, with their sizes, by name."""
    system, base = opened(path)
    info = system.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [x for x in system.get_file_info(fs.FileSelector(base)) if x.type == fs.FileType.File and x.base_name[0] not in "._"]
    return system, sorted((x.path, x.size) for x in found)


class FixedReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path, self.width = schema, options["path"], int(options["width"])
        self.start, self.count = int(options.get("start", 0)), int(options.get("count", -1))
        self.part = max(1, int(options.get("partbytes", PART_BYTES)) // self.width)
        self.low, self.high = 0, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("row",):
                yield f
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo, LessThan, LessThanOrEqual)):
                v = int(f.value)
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, v + isinstance(f, GreaterThan))
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    end = v + (not isinstance(f, LessThan))
                    self.high = end if self.high is None else min(self.high, end)
            elif not isinstance(f, IsNotNull):
                yield f

    def partitions(self) -> list[InputPartition]:
        out, row, skip = [], 0, self.start
        limit = self.high if self.count < 0 else self.count if self.high is None else min(self.count, self.high)
        for path, size in files_of(self.path)[1]:
            n = max(0, size - skip) // self.width
            low, high = max(row, self.low), row + n if limit is None else min(row + n, limit)
            out += [Rows(path, skip + (at - row) * self.width, at, min(high, at + self.part)) for at in range(low, max(low, high), self.part)]
            row, skip = row + n, max(0, skip - size)
        return out

    def read(self, partition: Rows | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # nothing to read
            return
        system, _ = opened(self.path)
        step = max(1, BATCH_BYTES // self.width)
        with system.open_input_file(partition.path) as f:
            for at in range(partition.low, partition.high, step):
                n = min(step, partition.high - at)
                columns = {"row": pa.array(np.arange(at, at + n))}
                if "data" in self.schema.names:
                    data = pa.py_buffer(f.read_at(n * self.width, partition.place + (at - partition.low) * self.width))
                    places = pa.py_buffer(np.arange(n + 1, dtype=np.int32) * self.width)
                    columns["data"] = pa.Array.from_buffers(pa.binary(), n, [None, places, data])
                yield pa.RecordBatch.from_arrays([columns[c] for c in self.schema.names], names=self.schema.names)


class FixedSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "loomgate_fixed"

    def schema(self) -> str:
        return "row long, data binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        return FixedReader(schema, dict(self.options))


def read(spark: SparkSession, path: str, width: int, **options: object) -> DataFrame:
    """row, data of a file's records; options: start, count, partbytes."""
    spark.dataSource.register(FixedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("loomgate_fixed").options(path=path, width=width, **options).load()


def dbf_fields(path: str) -> tuple[int, int, int, list[tuple[str, str, int, int]]]:
    """(records, bytes before them, width, fields as name, kind, place, width) of a DBF file's header, which alone is read."""
    system, files = files_of(path)
    with system.open_input_file(files[0][0]) as f:
        count, start, width = struct.unpack("<IHH", f.read_at(12, 0)[4:])
        head = f.read_at(start, 0)
    fields, at = [], 1
    for i in range(32, len(head) - 31, 32):
        if head[i] == 0x0D:
            break
        fields.append((head[i : i + 11].split(b"\0")[0].decode("latin-1"), chr(head[i + 11]), at, head[i + 16]))
        at += head[i + 16]
    return count, start, width, fields


def _dbf_cell(kind: str, at: int, width: int) -> Column:
    text = F.trim(F.regexp_replace(F.decode(F.substring("data", at + 1, width), "ISO-8859-1"), r"^[\s\x1c-\x1f\x85\xa0]+|[\s\x1c-\x1f\x85\xa0]+$", ""))
    if kind == "L":
        text = F.when(F.upper(text).isin("T", "Y"), "true").when(F.upper(text).isin("F", "N"), "false")
    elif kind == "D":
        text = F.when(F.length(text) == 8, F.concat_ws("-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2))).otherwise(text)
    return F.nullif(text, F.lit(""))


def read_dbf(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """The rows of one DBF file as texts, in order by the column `row`, under the names of its fields; deleted records are left out.

    Names that repeat or are empty are numbered, as sheets.table does."""
    count, start, width, fields = dbf_fields(path)
    names: list[str] = []
    for i, (name, *_) in enumerate(fields):
        label = name or f"column{i + 1}"
        names.append(label if label not in names else f"{label}_{i + 1}")
    kept = read(spark, path, width, start=start, count=count, **options).where(F.substring("data", 1, 1) != F.lit(bytearray(b"*")))
    return kept.select("row", *[_dbf_cell(kind, at, w).alias(n) for n, (_, kind, at, w) in zip(names, fields, strict=True)])


def _octal(data: Column, at: int, n: int) -> Column:
    """A number in octal digits, or in bytes where its first bit is set."""
    digits = F.regexp_extract(F.decode(F.substring(data, at + 1, n), "ISO-8859-1"), r"^[\x00 ]*([0-7]+)", 1)
    in_bytes = F.conv(F.hex(F.substring(data, at + n - 7, 8)), 16, 10).cast("long")
    return F.when(F.conv(F.hex(F.substring(data, at + 1, 1)), 16, 10).cast("int") >= 128, in_bytes).otherwise(F.conv(F.nullif(digits, F.lit("")), 8, 10).cast("long"))


def _text(data: Column, at: int, n: int) -> Column:
    return F.make_valid_utf8(F.unhex(F.regexp_extract(F.hex(F.substring(data, at + 1, n)), r"^((?:(?!00)..)*)", 1)).cast("string"))


def _checks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, data) -> those whose bytes add up to the checksum that they hold, as a TAR header's do (its own digits count as blanks)."""
    for b in batches:
        if not b.num_rows:
            continue
        blocks = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, BLOCK)
        sums = blocks.sum(1, dtype=np.int64) - blocks[:, 148:156].sum(1, dtype=np.int64) + 8 * 32
        digits = blocks[:, 148:156].astype(np.int64) - 48
        told, open_ = np.zeros(len(blocks), np.int64), np.ones(len(blocks), bool)
        begun = np.zeros(len(blocks), bool)
        for i in range(8):  # blanks, then digits to the first other byte
            digit = (digits[:, i] >= 0) & (digits[:, i] < 8)
            told = np.where(open_ & digit, told * 8 + digits[:, i], told)
            begun |= digit
            open_ &= digit | (~begun & (digits[:, i] == -16))
        yield b.take(pa.array(np.flatnonzero(begun & (told == sums))))


def tar_headers(spark: SparkSession, path: str, **options: object) -> DataFrame:
    """ord (from 0), row (the header's block), name, kind, size of the entries of a TAR file, all kinds of them. Written."""
    blocks = read(spark, path, BLOCK, **options)
    data = F.col("data")
    found = blocks.mapInArrow(_checks, "row long, data binary")
    prefix = F.when(F.substring(data, 258, 6) == F.lit(bytearray(b"ustar\0")), _text(data, 345, 155)).otherwise("")
    name = F.concat(F.when(prefix != "", F.concat(prefix, F.lit("/"))).otherwise(""), _text(data, 0, 100))
    heads = materialise(found.select("row", name.alias("name"), F.decode(F.substring(data, 157, 1), "ISO-8859-1").alias("kind"), _octal(data, 124, 12).alias("size")), "headers")
    state = heads.select("row", (F.col("row") + 1 + F.ceil(F.coalesce("size", F.lit(0)) / BLOCK)).alias("to"), (F.col("row") == 0).alias("reached"))
    while True:
        # what a reached header points to is reached; each pointer then takes over that of where it points
        hit = state.where("reached").select(F.col("to").alias("row"), F.lit(True).alias("hit")).distinct()
        above = state.select(F.col("row").alias("to"), F.col("to").alias("next"))
        joined = state.join(hit.hint("merge"), "row", "left").join(above.hint("merge"), "to", "left")  # not by the driver: a table in every round
        before = state.where("reached").count()
        state = materialise(joined.select("row", F.coalesce("next", "to").alias("to"), (F.col("reached") | F.coalesce("hit", F.lit(False))).alias("reached")), "reached")
        if state.where("reached").count() == before:
            break
    kept = heads.join(state.where("reached").select("row"), "row", "left_semi")
    return materialise(ordered.numbered(kept, [], ["row"], "ord").select((F.col("ord") - 1).alias("ord"), "row", "name", "kind", "size"), "entries")


def tar_blocks(spark: SparkSession, path: str, **options: object) -> tuple[DataFrame, DataFrame]:
    """(entries: ord, name, size; blocks: ord, part, data) of the regular files of a TAR: their contents in blocks, the last one cut to its size.

    Names that are longer than a header's field stand in an entry of their own before it, and are taken from there."""
    heads = tar_headers(spark, path, **options)
    spans = heads.select("ord", "name", "kind", "size", (F.col("row") + 1).alias("low"), (F.col("row") + 1 + F.ceil(F.col("size") / BLOCK)).alias("high"))
    inside = lookups.in_range(read(spark, path, BLOCK, **options), "row", spans.where("kind IN ('0', '\\0', '', '7', 'L', 'x')"), "low", "high", 4096)
    part = F.col("row") - F.col("low")
    cut = F.substring(F.col("data"), F.lit(1), F.least(F.lit(BLOCK), F.col("size") - part * BLOCK).cast("int"))
    blocks = inside.select("ord", "kind", part.alias("part"), cut.alias("data"))
    text = ordered.joined_text(blocks.where("kind IN ('L', 'x')").withColumn("hex", F.hex("data")), ["ord", "kind"], "hex", ["part"], "")
    body = F.make_valid_utf8(F.unhex("hex").cast("string"))
    long = F.when(F.col("kind") == "L", F.regexp_replace(body, r"\x00.*$", "")).otherwise(F.nullif(F.regexp_extract(body, r"(?s)(?:^|\n)\d+ path=([^\n]*)\n", 1), F.lit("")))
    named = text.select((F.col("ord") + 1).alias("ord"), long.alias("long")).where("long IS NOT NULL")
    files = heads.where("kind IN ('0', '\\0', '', '7')").join(named, "ord", "left")
    return files.select("ord", F.coalesce("long", "name").alias("name"), "size"), blocks.where("kind NOT IN ('L', 'x')").select("ord", "part", "data")


def tar_layout(entries: DataFrame) -> DataFrame:
    """entries (ord, name, size) -> ord, name, size, row (the block of its header), header (binary): a TAR as rows, placed by running offsets.

    Names of more than 100 bytes are cut at a slash into a prefix of at most 155 bytes and a name; one that can't be is an error."""
    sized = entries.withColumn("__n", 1 + F.ceil(F.col("size") / BLOCK))
    placed = ordered.running_offsets(sized, [], ["ord"], "__n").withColumnRenamed("start", "row").drop("end", "__n")
    short = F.octet_length("name") <= 100
    cut = F.regexp_extract_all("name", F.lit("/"), 0)
    tails = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(cut))), lambda i: F.call_function("substring_index", F.col("name"), F.lit("/"), -i))
    fits = F.filter(tails, lambda t: (F.octet_length(t) <= 100) & (F.octet_length("name") - F.octet_length(t) - 1 <= 155) & (F.octet_length(t) > 0))
    tail = F.when(short, F.col("name")).otherwise(F.coalesce(F.get(fits, F.lit(0)), F.raise_error(F.concat(F.lit("A name is too long for TAR: "), "name"))))
    head = F.when(short, "").otherwise(F.substring(F.col("name"), F.lit(1), F.length("name") - F.length(tail) - 1))
    padded = lambda text, n: F.substring(F.concat(text.cast("binary"), F.unhex(F.lit("00" * n))), 1, n)
    octal = lambda x, n: F.concat(F.lpad(F.conv(x.cast("string"), 10, 8), n - 1, "0").cast("binary"), F.unhex(F.lit("00")))
    zero = F.lit(0).cast("long")
    before = F.concat(padded(tail, 100), octal(F.lit(0o644), 8), octal(zero, 8), octal(zero, 8), octal(F.col("size"), 12), octal(zero, 12))
    after = F.concat(F.lit("0").cast("binary"), F.unhex(F.lit("00" * 100)), F.lit("ustar").cast("binary"), F.unhex(F.lit("00")), F.lit("00").cast("binary"), F.unhex(F.lit("00" * 80)), padded(head, 155), F.unhex(F.lit("00" * 12)))
    blank = F.concat(before, F.lit(" " * 8).cast("binary"), after)
    pairs = F.regexp_extract_all(F.hex(blank), F.lit("(..)"), 1)
    total = F.aggregate(pairs, zero, lambda s, x: s + F.conv(x, 16, 10).cast("long"))
    check = F.concat(F.lpad(F.conv(total.cast("string"), 10, 8), 6, "0").cast("binary"), F.unhex(F.lit("0020")))
    return placed.withColumn("header", F.concat(before, check, after))


def tar_rows(entries: DataFrame, contents: DataFrame) -> DataFrame:
    """entries (ord, name, size) and contents (ord, part, data: pieces of whole blocks but for the last of an entry) -> row, data: the blocks of a TAR file
    in the order of row, as pieces of whole blocks, two empty ones at the end. Written one behind the other they are the file.

    part counts in pieces, all but the last of an entry of the same size."""
    placed = materialise(tar_layout(entries), "layout")
    width = contents.groupBy("ord").agg(F.max(F.length("data")).alias("width"))
    padding = (F.lit(BLOCK) - F.length("data") % BLOCK) % BLOCK
    filled = F.concat("data", F.substring(F.unhex(F.lit("00" * BLOCK)), F.lit(1), padding.cast("int")))
    body = contents.where(F.length("data") > 0).join(placed.select("ord", F.col("row").alias("head")), "ord").join(width, "ord")
    pieces = body.select((F.col("head") + 1 + F.col("part") * F.ceil(F.col("width") / BLOCK)).alias("row"), filled.alias("data"))
    end = placed.agg(F.coalesce(F.max(F.col("row") + 1 + F.ceil(F.col("size") / BLOCK)), F.lit(0)).alias("row")).select("row", F.unhex(F.lit("00" * 2 * BLOCK)).alias("data"))
    return placed.select("row", F.col("header").alias("data")).unionByName(pieces).unionByName(end)
