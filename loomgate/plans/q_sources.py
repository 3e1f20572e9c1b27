"""Queries of document grammars, packages and archives, round trips over the tables, and their SQL."""

from __future__ import annotations

import os
import sqlite3
import uuid

from pyspark.sql import functions as F

from loomgate.functions.text import escape_xml, json_string
from loomgate.operators import ranges
from loomgate.plans.tables import table
from loomgate.sinks import packages
from loomgate.sources import archives, sheets, sqlite, structured


def _parts(spark, d, text):
    return table(spark, d, "part").select("p_partkey", text.alias("doc"))


def _name_and_size(rows):
    return rows.select("p_partkey", "ord", F.get_json_object("row", "$.name").alias("name"), F.get_json_object("row", "$.size").cast("long").alias("size"), F.get_json_object("row", "$['at.x']").alias("flat"), F.json_array_length(F.get_json_object("row", "$.tags")).alias("tags"))


def json_parse(spark, d):
    doc = F.concat(F.lit('{"meta":{"n":1},"items":[{"name":'), json_string(F.col("p_name")), F.lit(',"size":'), F.col("p_size").cast("string"), F.lit(',"tags":[1,2]},{"name":"z","size":1.0}]}'))
    return _name_and_size(structured.row_texts(_parts(spark, d, doc), "doc", "json", ["p_partkey"]))


def ndjson_parse(spark, d):
    doc = F.concat(F.lit('{"name":'), json_string(F.col("p_name")), F.lit(',"size":'), F.col("p_size").cast("string"), F.lit('}\r\n\n{"name":"z","size":1}\n'))
    return _name_and_size(structured.row_texts(_parts(spark, d, doc), "doc", "ndjson", ["p_partkey"]))


def toml_parse(spark, d):
    doc = F.concat(F.lit("[[items]]\nname = "), json_string(F.col("p_name")), F.lit("\nsize = "), F.col("p_size").cast("string"), F.lit('\ntags = [1, 2]\n[[items]]\nname = "z"\nsize = 1\n'))
    return _name_and_size(structured.row_texts(_parts(spark, d, doc), "doc", "toml", ["p_partkey"]))


def yaml_parse(spark, d):
    doc = F.concat(F.lit("- name: "), json_string(F.col("p_name")), F.lit("\n  size: "), F.col("p_size").cast("string"), F.lit("\n  tags: [1, 2]\n- {name: z, size: 1}\n"))
    return _name_and_size(structured.row_texts(_parts(spark, d, doc), "doc", "yaml", ["p_partkey"]))


def xml_tree_parse(spark, d):
    doc = F.concat(F.lit('<r xmlns="u"><i size="'), F.col("p_size").cast("string"), F.lit('"><name> '), escape_xml(F.col("p_name")), F.lit(" </name></i><i><name>z</name></i></r>"))
    rows = structured.row_texts(_parts(spark, d, doc), "doc", "xml", ["p_partkey"])
    return rows.select("p_partkey", "ord", F.get_json_object("row", "$.name").alias("name"), F.get_json_object("row", "$['@size']").alias("size"))


def _archive(target):
    def query(spark, d):
        docs = table(spark, d, "documents").select(F.floor(F.col("doc_id") / 50).cast("string").alias("path"), F.col("doc_id").cast("int").alias("ord"), F.concat(F.lit("../d/"), (F.col("doc_id") % 7).cast("string"), F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"))
        made = packages.archives(docs, target)
        return archives.entries(made).select("path", "ord", "name", F.length("content").cast("long").alias("size"), F.md5("content").alias("digest"))

    return query


def workbook_roundtrip(spark, d):
    book = F.concat_ws("-", F.col("c_nationkey").cast("string"), F.floor(F.col("c_custkey") / 1000).cast("string"))  # of one size, however many customers
    made = packages.workbooks(table(spark, d, "customer").select(book.alias("path"), "c_custkey", "c_name", "c_mktsegment"), ["path"], ["c_custkey"])
    cells = sheets.rows(made, "xlsx").where("ord > 0")
    return cells.select(F.col("path").alias("book"), "ord", F.col("cells")[0].cast("long").alias("custkey"), F.col("cells")[1].alias("name"), F.col("cells")[2].alias("segment"))


def sqlite_scan(spark, d):
    """The countries as a database file in the shared folder, read back with a pushed comparison."""
    nation = table(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = f"{ranges.shared_dir(spark)}/loomgate-{uuid.uuid4().hex}.db"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE nation (n_nationkey INTEGER PRIMARY KEY, n_name TEXT, n_regionkey INT)")
        db.executemany("INSERT INTO nation VALUES (?, ?, ?)", [tuple(r) for r in nation.collect()])  # 25 rows at any scale
    return sqlite.read(spark, path, "nation")["nation"].where("n_regionkey > 0")


def slide_package_roundtrip(spark, d):
    """A deck for each fifty turns of a conversation, a slide for each turn."""
    deck = F.concat_ws("-", F.col("conv_id").cast("string"), F.floor(F.col("turn") / 50).cast("string"))
    slide = F.struct("turn", F.concat(F.lit("Turn "), F.col("turn").cast("string"), F.lit(" & more")).alias("title"), F.concat(F.col("role"), F.lit("\n"), F.col("text")).alias("body"))
    decks = table(spark, d, "conversations").groupBy(deck.alias("path")).agg(F.array_sort(F.collect_list(slide)).alias("s"))
    decks = decks.select("path", packages.slide_packages(F.transform("s", lambda x: F.struct(x["title"].alias("title"), x["body"].alias("body")))).alias("content"))
    return archives.slides(archives.entries(decks)).select("path", "number", "title", "body")


QUERIES = {f.__name__: f for f in (json_parse, ndjson_parse, toml_parse, yaml_parse, xml_tree_parse, workbook_roundtrip, slide_package_roundtrip, sqlite_scan)} | {"zip_roundtrip": _archive("zip"), "tar_roundtrip": _archive("tar"), "tgz_roundtrip": _archive("tgz")}


def _two(tags: str) -> str:
    return f"SELECT p_partkey, 0 AS ord, p_name AS name, p_size::BIGINT AS size, NULL::VARCHAR AS flat, {tags} AS tags FROM part UNION ALL SELECT p_partkey, 1, 'z', 1, NULL, NULL FROM part"


_ENTRIES = """WITH e AS (SELECT (doc_id // 50)::VARCHAR AS path, doc_id, doc_id % 7 AS n, text, row_number() OVER (PARTITION BY doc_id // 50, doc_id % 7 ORDER BY doc_id) AS k FROM documents)
    SELECT path, (row_number() OVER (PARTITION BY path ORDER BY doc_id) - 1)::INT AS ord, 'd/' || n || CASE WHEN k > 1 THEN '-' || k ELSE '' END || '.txt' AS name, strlen(text) AS size, md5(text) AS digest FROM e"""
SQL = {
    "json_parse": _two("2"), "ndjson_parse": _two("NULL::INT"), "toml_parse": _two("2"), "yaml_parse": _two("2"),
    "xml_tree_parse": "SELECT p_partkey, 0 AS ord, p_name AS name, p_size::VARCHAR AS size FROM part UNION ALL SELECT p_partkey, 1, 'z', NULL FROM part",
    "sqlite_scan": "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, n_regionkey::BIGINT AS n_regionkey FROM nation WHERE n_regionkey > 0",
    "zip_roundtrip": _ENTRIES, "tar_roundtrip": _ENTRIES, "tgz_roundtrip": _ENTRIES,
    "workbook_roundtrip": "SELECT c_nationkey || '-' || c_custkey // 1000 AS book, (row_number() OVER (PARTITION BY c_nationkey, c_custkey // 1000 ORDER BY c_custkey))::INT AS ord, c_custkey AS custkey, c_name AS name, c_mktsegment AS segment FROM customer",
    "slide_package_roundtrip": r"""SELECT conv_id || '-' || turn // 50 AS path, (row_number() OVER (PARTITION BY conv_id, turn // 50 ORDER BY turn))::INT AS number, 'Turn ' || turn || ' & more' AS title,
        array_to_string(list_filter(list_transform(string_split(role || chr(10) || text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10)) AS body FROM conversations""",
}
