"""Queries of large files that many tasks read, over files written from the tables, and their SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgate.operators import ordered
from loomgate.operators.ranges import fresh_path
from loomgate.plans import registry
from loomgate.plans.tables import table
from loomgate.sinks import packages, store
from loomgate.sources import fixed, split, split_json


#: What stands for null where all cells are quoted; texts that begin with a backslash get one more.
_NULL = r"\N"


def csv_quoted_lines(spark, d):
    """All documents as quoted cells of CSV files, line ends and quotes included, and back."""
    path = fresh_path(spark, "csv")
    cell = lambda c: F.when(F.startswith(c, F.lit("\\")), F.concat(F.lit("\\"), c)).otherwise(F.col(c)).alias(c)
    table(spark, d, "documents").select("doc_id", cell("lang"), cell("text"), F.lit('end "of" row').alias("last")).write.options(header=True, quoteAll=True, nullValue=_NULL, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    own = lambda c: F.when(F.startswith(c, F.lit("\\")), F.substr(c, F.lit(2))).otherwise(F.col(c)).alias(c)
    rows = split.read_quoted(spark, path, infer=False, null=_NULL).select("doc_id", own("lang"), own("text"), "last")
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.length("text").cast("long").alias("n"), F.md5(F.col("text").cast("binary")).alias("digest"), "last")


def _as_documents(rows: DataFrame, before: str, after: str) -> DataFrame:
    """rows (value) -> lines of text: in each partition the rows with commas between, and a line before and after them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = lambda lines: pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])
        first = True
        yield batch([before])
        for b in batches:
            if b.num_rows:
                yield batch([x if first and i == 0 else f",{x}" for i, x in enumerate(b.column(0).to_pylist())])
                first = False
        yield batch([after])

    return rows.mapInArrow(run, "value string")


def json_large(spark, d):
    """All documents as members of the record array of JSON documents, one to each task that writes, and back."""
    path = fresh_path(spark, "json")
    member = F.to_json(F.struct("doc_id", "text", F.struct(F.array(F.lit(1), F.lit(2)).alias("tags"), F.lit(']},{"[').alias("mark")).alias("more")))
    _as_documents(table(spark, d, "documents").select(member.alias("value")), '{"meta": {"tags": [1, [2]], "n": "[{"}, "items" : [', '], "rest": [{"no": 1}]}').write.text(path)
    rows = split_json.record_rows(spark, path)
    text = F.get_json_object("row", "$.text")
    return rows.select(F.get_json_object("row", "$.doc_id").cast("long").alias("doc_id"), F.length(text).cast("long").alias("n"), F.md5(text.cast("binary")).alias("digest"), F.get_json_object("row", "$.more.mark").alias("mark"))


_MARKS = ["word/document.xml", "xl/workbook.xml", "ppt/presentation.xml", "other.xml", "a.xml", "b.xml"]
_NAMES = ["", "", "", "", ".zip", ".TXT"]


def package_identify(spark, d):
    """A package for each fifty documents, named or not, by what the source of first and last bytes sees of it."""
    group = F.floor(F.col("doc_id") / 50)
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), (group % len(values) + 1).cast("int"))
    docs = table(spark, d, "documents").select(F.concat(F.lit("p"), group.cast("string"), of(_NAMES)).alias("path"), F.col("doc_id").cast("int").alias("ord"), of(_MARKS).alias("name"), F.col("text").cast("binary").alias("content"))
    folder = fresh_path(spark, "packages")
    store.stored(packages.archives(docs, "zip").select(F.col("path").alias("name"), "content"), folder).count()
    found = registry.identified_files(spark, folder)
    return found.select("name", "raw_ext", "ext", "kind", (F.col("bytes_read") > 0).alias("opened"))


def tar_scan(spark, d):
    """All documents as one TAR, written as part files in order and read again by its headers' pointers."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("ord"), F.concat(F.lit("d/"), F.col("source"), F.lit("/"), F.col("doc_id").cast("string")).alias("name"), F.col("text").cast("binary").alias("data"))
    rows = fixed.tar_rows(docs.select("ord", "name", F.length("data").cast("long").alias("size")), docs.select("ord", F.lit(0).cast("long").alias("part"), "data"))
    folder = fresh_path(spark, "tar")
    store.stored_parts(rows, folder).count()
    files, blocks = fixed.tar_blocks(spark, folder)
    whole = ordered.joined_text(blocks.withColumn("hex", F.hex("data")), ["ord"], "hex", ["part"], "")
    return files.join(whole, "ord", "left").select("name", "size", F.md5(F.unhex(F.coalesce("hex", F.lit("")))).alias("digest"))


def dbf_scan(spark, d):
    """Orders as one DBF file, some of its records deleted, written as part files and read by ranges of records."""
    orders = table(spark, d, "orders")
    widths = {"KEY": ("N", 12), "STATUS": ("C", 3), "OPEN": ("L", 1), "DAY": ("D", 8)}
    little = lambda x, n: F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(x), 2 * n, "0"), F.lit("(..)"), 1)), ""))
    text = F.concat(F.when(F.col("o_orderkey") % 7 == 0, "*").otherwise(" "), F.lpad(F.col("o_orderkey").cast("string"), 12, " "), F.rpad("o_orderstatus", 3, " "), F.when(F.col("o_orderstatus") == "O", "T").otherwise("F"), F.date_format("o_orderdate", "yyyyMMdd"))
    records = orders.select(F.col("o_orderkey").alias("row"), text.cast("binary").alias("data"))
    fields = [F.concat(F.rpad(F.lit(n), 11, "\0").cast("binary"), F.lit(k).cast("binary"), F.unhex(F.lit("00" * 4)), F.unhex(F.lit(f"{w:02x}")), F.unhex(F.lit("00" * 15))) for n, (k, w) in widths.items()]
    start, width = 32 + 32 * len(widths) + 1, 1 + sum(w for _, w in widths.values())
    head = orders.agg(F.count("*").alias("n")).select(F.lit(-1).cast("long").alias("row"), F.concat(F.unhex(F.lit("03180101")), little(F.col("n"), 4), little(F.lit(start), 2), little(F.lit(width), 2), F.unhex(F.lit("00" * 20)), *fields, F.unhex(F.lit("0D"))).alias("data"))
    folder = fresh_path(spark, "dbf")
    store.stored_parts(head.unionByName(records), folder).count()
    return fixed.read_dbf(spark, folder).select(F.col("KEY").cast("long").alias("key"), F.col("STATUS").alias("status"), F.col("OPEN").alias("open"), F.col("DAY").alias("day"))


QUERIES = {f.__name__: f for f in (csv_quoted_lines, json_large, package_identify, tar_scan, dbf_scan)}
SQL = {
    "csv_quoted_lines": "SELECT doc_id, lang, length(text) AS n, md5(text) AS digest, 'end \"of\" row' AS last FROM documents",
    "json_large": """SELECT doc_id, length(text) AS n, md5(text) AS digest, ']},{"[' AS mark FROM documents""",
    "tar_scan": "SELECT 'd/' || source || '/' || doc_id AS name, strlen(text) AS size, md5(text) AS digest FROM documents",
    "dbf_scan": "SELECT o_orderkey AS key, o_orderstatus AS status, CASE WHEN o_orderstatus = 'O' THEN 'true' ELSE 'false' END AS open, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE o_orderkey % 7 <> 0",
    "package_identify": """WITH g AS (SELECT DISTINCT doc_id // 50 AS g FROM documents)
        SELECT 'p' || g || ['', '', '', '', '.zip', '.TXT'][g % 6 + 1] AS name, ['docx', 'xlsx', 'pptx', '', 'zip', 'txt'][g % 6 + 1] AS raw_ext, ['docx', 'xlsx', 'pptx', '', 'zip', 'txt'][g % 6 + 1] AS ext,
        ['document', 'data', 'document', '', 'archive', 'document'][g % 6 + 1] AS kind, g % 6 < 4 AS opened FROM g""",
}
