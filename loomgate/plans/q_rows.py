"""Queries of record shaping and row sinks, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgate.functions.text import add_bom
from loomgate.operators import records
from loomgate.plans.q_text import _js
from loomgate.plans.tables import table
from loomgate.sinks import rows
from loomgate.sources import ini


def events_flatten_props(spark, d):
    events = table(spark, d, "events").withColumn("props", F.from_json("props", "k long")).withColumn("tags", F.array("event_type", F.lit("x")))
    flat = records.flattened(events.select("event_id", "props", "tags", F.struct(F.struct("user_id", "value").alias("who")).alias("meta")))
    return flat.select("event_id", F.col("`props.k`").alias("props_k"), "tags", F.col("`meta.who.user_id`").alias("meta_who_user_id"), F.col("`meta.who.value`").alias("meta_who_value"))


def record_discovery(spark, d):
    """Documents of different shapes, one for each event: the rows that each gives."""
    doc = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit('{"meta":{"v":1},"items":[{"x":'), F.col("event_id").cast("string"), F.lit('},{"x":2}]}')))
    doc = doc.when(F.col("event_id") % 4 == 1, F.concat(F.lit('{"a":'), F.col("event_id").cast("string"), F.lit(',"b":{"c":[]},"z":[{"y":1}]}')))
    doc = doc.when(F.col("event_id") % 4 == 2, F.lit('[1,{"a":2},null]')).otherwise(F.col("props"))
    each = table(spark, d, "events").select("event_id", F.posexplode(records.record_values(doc)).alias("place", "row"))
    return each


def rows_to_csv(spark, d):
    lines = rows.document(table(spark, d, "nation"), "csv", ["n_nationkey"], ["n_regionkey"])
    return lines.withColumnRenamed("n_regionkey", "region")


def rows_to_csv_lines(spark, d):
    odd = table(spark, d, "part").withColumn("p_name", F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit('a "b", '), "p_name")).otherwise(F.col("p_name")))
    return rows.lines(odd, "csv", ["p_partkey"]).select(F.col("__o0").alias("p_partkey"), "line")


def rows_to_xml(spark, d):
    return rows.document(table(spark, d, "nation"), "xml", ["n_nationkey"], ["n_regionkey"]).withColumnRenamed("n_regionkey", "region")


def rows_to_ini(spark, d):
    return rows.document(table(spark, d, "nation"), "ini", ["n_nationkey"], ["n_regionkey"]).withColumnRenamed("n_regionkey", "region")


def rows_to_toml(spark, d):
    return rows.document(table(spark, d, "supplier"), "toml", ["s_suppkey"], ["s_nationkey"]).withColumnRenamed("s_nationkey", "nation")


def rows_to_json(spark, d):
    return rows.document(table(spark, d, "supplier"), "json", ["s_suppkey"], ["s_nationkey"]).withColumnRenamed("s_nationkey", "nation")


def rows_to_ndjson(spark, d):
    return rows.lines(table(spark, d, "customer"), "ndjson", ["c_custkey"]).select(F.col("__o0").alias("c_custkey"), "line")


def rows_to_html_table(spark, d):
    return rows.document(table(spark, d, "nation"), "html", ["n_nationkey"], ["n_regionkey"]).withColumnRenamed("n_regionkey", "region")


def rows_to_yaml(spark, d):
    return rows.document(table(spark, d, "nation"), "yaml", ["n_nationkey"], ["n_regionkey"]).withColumnRenamed("n_regionkey", "region")


def database_bundle_json(spark, d):
    return rows.database_bundle({"region": table(spark, d, "region"), "nation": table(spark, d, "nation")}, {"region": ["r_regionkey"], "nation": ["n_nationkey"]})


def key_union(spark, d):
    a = table(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("name"))
    b = table(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_regionkey").alias("parent"))
    return records.null_to_empty(records.union_of_keys(a, b))


def ini_parse_rows(spark, d):
    lines = F.concat(
        add_bom(F.lit("; part\nsize = ")), F.col("p_size").cast("string"), F.lit("\n[p.main]\nname: '"), "p_name", F.lit("'\nprice="), F.col("p_retailprice").cast("decimal(12,2)").cast("string"),
        F.lit("\n# c\non=TRUE\non=False\nbare\n[ p . other ]\r\nnote=a=b:c\r\n"),
    )
    return ini.entries(table(spark, d, "part").select("p_partkey", lines.alias("ini")), "ini", ["p_partkey"])


QUERIES = {f.__name__: f for f in (events_flatten_props, record_discovery, rows_to_csv, rows_to_csv_lines, rows_to_xml, rows_to_ini, rows_to_toml, rows_to_json, rows_to_ndjson, rows_to_html_table, rows_to_yaml, database_bundle_json, key_union, ini_parse_rows)}

_NL = "chr(10)"


def _nations(row: str, before: str, between: str, after: str) -> str:
    return f"SELECT n_regionkey AS region, {before} || string_agg({row}, {between} ORDER BY n_nationkey) || {after} AS text FROM (SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM nation) GROUP BY n_regionkey"


def _suppliers(row: str, before: str, between: str, after: str) -> str:
    return f"SELECT s_nationkey AS nation, {before} || string_agg({row}, {between} ORDER BY s_suppkey) || {after} AS text FROM supplier GROUP BY s_nationkey"


SQL = {
    "events_flatten_props": """SELECT event_id, (props->>'k')::BIGINT AS props_k, '["' || event_type || '","x"]' AS tags, user_id AS meta_who_user_id, value AS meta_who_value FROM events""",
    "record_discovery": """SELECT event_id, unnest([0, 1])::INT AS place, unnest(['{"x":' || event_id || '}', '{"x":2}']) AS row FROM events WHERE event_id % 4 = 0
        UNION ALL SELECT event_id, unnest([0, 1, 2])::INT, unnest(['1', '{"a":2}', 'null']) FROM events WHERE event_id % 4 = 2
        UNION ALL SELECT event_id, 0, replace(props, ' ', '') FROM events WHERE event_id % 4 = 3""",
    "rows_to_csv": _nations("n_nationkey || ',' || n_name", f"chr(65279) || 'n_nationkey,n_name' || {_NL}", _NL, "''"),
    "rows_to_csv_lines": f"""SELECT p_partkey, concat_ws(',', p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '"a ""b"", ' || p_name || '"' ELSE p_name END, p_brand, p_type, p_size, {_js('p_retailprice')}) AS line FROM part""",
    "rows_to_xml": _nations("""'<row><field name="n_nationkey">' || n_nationkey || '</field><field name="n_name">' || n_name || '</field></row>'""", f"""'<?xml version="1.0" encoding="UTF-8"?>' || {_NL} || '<data>'""", "''", f"'</data>' || {_NL}"),
    "rows_to_ini": _nations(f"'[row' || rn || ']' || {_NL} || 'n_nationkey=' || n_nationkey || {_NL} || 'n_name=' || n_name", "''", f"{_NL} || {_NL}", _NL),
    "rows_to_toml": _suppliers(f"""'[[data]]' || {_NL} || 's_suppkey = ' || s_suppkey || {_NL} || 's_name = "' || s_name || '"' || {_NL} || 's_acctbal = ' || {_js('s_acctbal')}""", "''", f"{_NL} || {_NL}", _NL),
    "rows_to_json": _suppliers(f"""'  {{' || {_NL} || '    "s_suppkey": ' || s_suppkey || ',' || {_NL} || '    "s_name": "' || s_name || '",' || {_NL} || '    "s_acctbal": ' || {_js('s_acctbal')} || {_NL} || '  }}'""", f"'[' || {_NL}", f"',' || {_NL}", f"{_NL} || ']'"),
    "rows_to_ndjson": f"""SELECT c_custkey, '{{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || ',"c_acctbal":' || {_js('c_acctbal')} || ',"c_mktsegment":"' || c_mktsegment || '"}}' AS line FROM customer""",
    "rows_to_html_table": _nations("'<tr><td>' || n_nationkey || '</td><td>' || n_name || '</td></tr>'", """'<table id="converted-table"><tbody><tr><td>n_nationkey</td><td>n_name</td></tr>'""", "''", "'</tbody></table>'"),
    "rows_to_yaml": _nations(f"'- n_nationkey: ' || n_nationkey || {_NL} || '  n_name: ' || n_name", "''", _NL, _NL),
    "database_bundle_json": r"""WITH n AS (SELECT string_agg(E'    {\n      "n_nationkey": ' || n_nationkey || E',\n      "n_name": "' || n_name || E'",\n      "n_regionkey": ' || n_regionkey || E'\n    }', E',\n' ORDER BY n_nationkey) AS t FROM nation),
        r AS (SELECT string_agg(E'    {\n      "r_regionkey": ' || r_regionkey || E',\n      "r_name": "' || r_name || E'"\n    }', E',\n' ORDER BY r_regionkey) AS t FROM region)
        SELECT E'{\n  "nation": [\n' || n.t || E'\n  ],\n  "region": [\n' || r.t || E'\n  ]\n}' AS text FROM n, r""",
    "key_union": "SELECT r_regionkey::VARCHAR AS key, r_name AS name, '' AS parent FROM region UNION ALL SELECT n_nationkey::VARCHAR, '', n_regionkey::VARCHAR FROM nation",
    "ini_parse_rows": """WITH p AS (SELECT p_partkey, p_size, p_name, p_retailprice::DECIMAL(12,2)::VARCHAR AS price FROM part)
        SELECT p_partkey, '' AS section, 'size' AS key, p_size::VARCHAR AS value, 'number' AS kind FROM p UNION ALL SELECT p_partkey, 'p.main', 'name', p_name, 'string' FROM p UNION ALL SELECT p_partkey, 'p.main', 'price', price, 'number' FROM p
        UNION ALL SELECT p_partkey, 'p.main', 'on', 'false', 'boolean' FROM p UNION ALL SELECT p_partkey, 'p.other', 'note', 'a=b:c', 'string' FROM p""",
}
