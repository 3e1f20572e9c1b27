"""Queries of ordered operations, lookups by place and aggregates, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomgate.functions.numbers import octal
from loomgate.operators import aggregates, contents, lookups, ordered
from loomgate.plans.tables import table


#: The order of the items of an order; line numbers repeat.
_PLACE = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def user_event_islands(spark, d):
    events = table(spark, d, "events")
    found = ordered.islands(events, ["user_id"], ["ts", "event_id"], lambda before: F.col("ts") - before["ts"] > F.expr("INTERVAL 6 HOURS"), ["ts"])
    return ordered.joined_text(found, ["user_id", "island"], "event_type", ["ts", "event_id"], " ")


def text_lines_by_gap(spark, d):
    """Pieces of a page to lines: a new one where the height changes by more than 4. Line items are pieces, quantity the height."""
    items = table(spark, d, "lineitem")
    found = ordered.islands(items, ["l_orderkey"], _PLACE, lambda before: F.abs(F.col("l_quantity") - before["l_quantity"]) > 4, ["l_quantity"], "line")
    return ordered.joined_text(found.withColumn("text", F.concat("l_returnflag", "l_linestatus")), ["l_orderkey", "line"], "text", _PLACE, " ")


def running_offsets(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    return ordered.running_offsets(docs, ["source"], ["doc_id"], "n_chars")


def lead_ranges(spark, d):
    starts = ordered.running_offsets(table(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], "n_chars").select("source", "doc_id", F.col("start").alias("offset"))
    return ordered.lead_ranges(starts, ["source"], "offset", ("doc_id",))  # documents without a text begin where the next one does


def carried_section(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", *_PLACE, "l_returnflag")
    return ordered.carried(lines, ["l_orderkey"], _PLACE, F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")), "section")


def running_means(spark, d):
    lines = table(spark, d, "lineitem").select("l_orderkey", *_PLACE, "l_quantity")
    return ordered.running_mean(lines, ["l_orderkey"], _PLACE, "l_quantity").withColumn("mean", F.round("mean", 6))


def gap_spaces(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy(*_PLACE)
    gap = F.col("l_quantity") - F.lag("l_quantity").over(w)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.length(F.coalesce(ordered.gap_spaces(gap, F.lit(10.0)), F.lit(""))).alias("spaces"))


def range_join_offsets(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id", "n_chars")
    spans = ordered.running_offsets(docs, [], ["doc_id"], "n_chars").select("doc_id", "start", "end")
    points = table(spark, d, "events").select("event_id", (F.col("event_id") * 211).alias("at"))
    return lookups.in_range(points, "at", spans, "start", "end", 4096).select("event_id", "at", "doc_id")


def asof_section(spark, d):
    ends = table(spark, d, "orders").select(F.col("o_custkey").alias("cust"), F.col("o_totalprice").alias("end"), "o_orderkey")
    points = table(spark, d, "orders").select("o_custkey", (F.col("o_orderkey")).alias("point"), (F.col("o_totalprice") * 0.9 + 20000).alias("at"))
    sections = ends.groupBy("cust", "end").agg(F.min("o_orderkey").alias("o_orderkey"))
    found = lookups.next_section(points, "o_custkey", "at", sections.withColumnRenamed("cust", "o_custkey"), "end", ["o_orderkey"])
    return found.select("point", F.col("o_orderkey").alias("section"))


def skeleton_fragment_positions(spark, d):
    heads = table(spark, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("head"), (F.col("o_orderkey") % 3).alias("wants"))
    items = table(spark, d, "lineitem").select(F.col("l_partkey").alias("key"), "l_orderkey", "l_linenumber")
    items = ordered.numbered(items, ["key"], ["l_orderkey", "l_linenumber"], "place").withColumn("place", F.col("place") - 1)
    return lookups.dealt_by_count(heads, "head", "wants", items, "place", ["key"]).select("key", "head", "place", "l_orderkey", "l_linenumber")


def section_tree(spark, d):
    nodes = table(spark, d, "orders").select(F.col("o_orderkey").alias("node"), F.when(F.col("o_orderkey") >= 10, F.floor(F.col("o_orderkey") / 3)).alias("parent"))
    return lookups.tree_depths(nodes, "node", "parent")


def contents_levels(spark, d):
    """The clauses of all documents as entries of tables of contents, their lengths modulo five as indents."""
    clauses = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", ", ")).alias("at", "clause"))
    return contents.levels(clauses.select("doc_id", "at", (F.length("clause") % 5).alias("indent")), ["doc_id"], ["at"], "indent")


def weighted_mode(spark, d):
    return aggregates.weighted_mode(table(spark, d, "lineitem").withColumn("w", F.col("l_quantity").cast("long")).withColumn("ord", F.col("l_orderkey") * 8 + F.col("l_linenumber")), ["l_suppkey"], "l_returnflag", F.col("w"), "ord")


def upper_median(spark, d):
    return aggregates.upper_median(table(spark, d, "lineitem"), ["l_suppkey"], "l_extendedprice")


def weighted_mean(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.round(aggregates.weighted_mean(F.col("l_extendedprice"), F.col("l_quantity")), 4).alias("mean"))


def bbox_extents(spark, d):
    c = F.col
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(*[x for x in aggregates.extents(c("l_quantity"), c("l_linenumber"), c("l_tax"), F.lit(1))], F.bool_or(c("l_returnflag") == "R").alias("bold"))


def topk_share(spark, d):
    items = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_extendedprice")
    return aggregates.top_share(items, ["l_suppkey"], F.col("l_extendedprice"), ["l_orderkey", "l_linenumber"])


def size_guard(spark, d):
    return aggregates.size_guard(table(spark, d, "documents"), "n_chars")


def unique_names(spark, d):
    named = table(spark, d, "part").select("p_partkey", F.concat(F.col("p_brand"), F.lit(".txt")).alias("name"))
    return ordered.numbered_names(named, [], "name", ["p_partkey"])


def padded_labels(spark, d):
    docs = table(spark, d, "documents").select("source", "doc_id")
    placed = ordered.numbered(docs, ["source"], ["doc_id"]).join(docs.groupBy("source").agg(F.count("*").alias("n")), "source")
    return placed.select("doc_id", ordered.padded_label(F.col("place"), F.col("n"), "-page-").alias("label"))


def tar_header_fields(spark, d):
    head = F.concat(F.rpad(F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt")), 100, "\0"), octal(F.lit(0o644), 8), octal(F.lit(0), 8), octal(F.lit(0), 8), octal(F.octet_length("text"), 12))
    return table(spark, d, "documents").select("doc_id", F.replace(octal(F.octet_length("text"), 12), F.lit("\0"), F.lit("")).alias("size"), F.replace(octal(F.lit(0o644), 8), F.lit("\0"), F.lit("")).alias("mode"), F.length(head).alias("length"), (F.ceil(F.octet_length("text") / 512) * 512 + 512).alias("padded"))


def numeric_suffix_sort(spark, d):
    """Names of slides and of their relations; slides only, in the order of their numbers."""
    names = table(spark, d, "documents").select(F.explode(F.array(*[F.concat(F.lit("ppt/slides/"), F.lit(start), F.col("doc_id").cast("string"), F.lit(end)) for start, end in (("slide", ".xml"), ("_rels/slide", ".xml.rels"))])).alias("name"))
    kept = names.where(F.col("name").rlike(r"(?i)^ppt/slides/slide\d+\.xml$"))
    return ordered.numbered(kept.withColumn("number", F.regexp_extract("name", r"slide(\d+)", 1).cast("long")), [], ["number"]).select("name", "place")


QUERIES = {f.__name__: f for f in (user_event_islands, text_lines_by_gap, running_offsets, lead_ranges, carried_section, running_means, gap_spaces, range_join_offsets, asof_section, skeleton_fragment_positions, section_tree, contents_levels, weighted_mode, upper_median, weighted_mean, bbox_extents, topk_share, size_guard, unique_names, padded_labels, tar_header_fields, numeric_suffix_sort)}

_OFFS = "SELECT source, doc_id, n_chars, (sum(n_chars) OVER w)::BIGINT AS \"end\", (sum(n_chars) OVER w - n_chars)::BIGINT AS start FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)"
_HAD = ", ".join(f"CASE WHEN indent = {i} THEN level ELSE m{i} END AS m{i}" for i in range(5))
SQL = {
    "contents_levels": f"""WITH RECURSIVE c AS (SELECT doc_id, string_split(text, ', ') AS parts FROM documents), e AS (SELECT doc_id, generate_subscripts(parts, 1) - 1 AS pos, length(unnest(parts)) % 5 AS indent FROM c),
        walk AS (SELECT doc_id, pos, indent, level, {_HAD} FROM (SELECT *, CASE WHEN indent > 0 THEN 1 ELSE 0 END AS level, {", ".join(f"NULL::INT AS m{i}" for i in range(5))} FROM e WHERE pos = 0)
        UNION ALL SELECT doc_id, pos, indent, level, {_HAD} FROM (SELECT e.doc_id, e.pos, e.indent, m0, m1, m2, m3, m4, CASE WHEN e.indent > w.indent THEN w.level + 1 WHEN e.indent = w.indent THEN w.level
          ELSE coalesce(CASE e.indent WHEN 0 THEN m0 WHEN 1 THEN m1 WHEN 2 THEN m2 WHEN 3 THEN m3 ELSE m4 END, greatest(0, w.level - 1)) END AS level FROM walk w JOIN e ON e.doc_id = w.doc_id AND e.pos = w.pos + 1))
        SELECT doc_id, pos::INT AS "at", indent::INT AS indent, level::INT AS level FROM walk""",
    "user_event_islands": """WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER w > INTERVAL 6 HOURS, false) AS brk FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        i AS (SELECT *, (sum(brk::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS island FROM g) SELECT user_id, island, string_agg(event_type, ' ' ORDER BY ts, event_id) AS event_type FROM i GROUP BY ALL""",
    "text_lines_by_gap": """WITH g AS (SELECT *, coalesce(abs(l_quantity - lag(l_quantity) OVER w) > 4, false) AS brk FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
        i AS (SELECT *, (sum(brk::INT) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))::BIGINT AS line FROM g) SELECT l_orderkey, line, string_agg(l_returnflag || l_linestatus, ' ' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS text FROM i GROUP BY ALL""",
    "running_offsets": _OFFS,
    "lead_ranges": f"SELECT source, doc_id, start AS \"offset\", lead(start) OVER (PARTITION BY source ORDER BY start) AS \"end\" FROM ({_OFFS})",
    "carried_section": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_returnflag, last_value(CASE WHEN l_returnflag <> 'N' THEN l_returnflag END IGNORE NULLS) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING) AS section FROM lineitem",
    "running_means": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, round(avg(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS UNBOUNDED PRECEDING), 6) AS mean FROM lineitem",
    "gap_spaces": "WITH g AS (SELECT *, l_quantity - lag(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS gap FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN gap IS NULL OR gap <= 0.8 THEN 0 ELSE greatest(1, least(6, floor(gap / 4.2 + 0.5)))::INT END AS spaces FROM g",
    "range_join_offsets": "WITH s AS (SELECT doc_id, sum(n_chars) OVER (ORDER BY doc_id) - n_chars AS start, sum(n_chars) OVER (ORDER BY doc_id) AS e FROM documents) SELECT event_id, event_id * 211 AS at, doc_id FROM events JOIN s ON event_id * 211 >= start AND event_id * 211 < e",
    "asof_section": "WITH s AS (SELECT o_custkey, o_totalprice AS e, min(o_orderkey) AS k FROM orders GROUP BY ALL) SELECT o.o_orderkey AS point, (SELECT arg_min(k, e) FROM s WHERE s.o_custkey = o.o_custkey AND s.e > o.o_totalprice * 0.9 + 20000) AS section FROM orders o",
    "skeleton_fragment_positions": """WITH h AS (SELECT o_custkey AS key, o_orderkey AS head, o_orderkey % 3 AS wants, sum(o_orderkey % 3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS e FROM orders),
        i AS (SELECT l_partkey AS key, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) - 1 AS place FROM lineitem) SELECT h.key, head, place, l_orderkey, l_linenumber FROM h JOIN i ON h.key = i.key AND place >= e - wants AND place < e""",
    "section_tree": "WITH RECURSIVE n AS (SELECT o_orderkey AS node, CASE WHEN o_orderkey >= 10 THEN o_orderkey // 3 END AS parent FROM orders), w AS (SELECT node, 0 AS depth FROM n WHERE parent IS NULL UNION ALL SELECT n.node, depth + 1 FROM w JOIN n ON n.parent = w.node) SELECT node, depth FROM w",
    "weighted_mode": "WITH s AS (SELECT l_suppkey, l_returnflag, sum(l_quantity::BIGINT)::BIGINT AS weight, min(l_orderkey * 8 + l_linenumber) AS f FROM lineitem GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY weight DESC, f) AS rn FROM s) SELECT l_suppkey, l_returnflag AS mode, weight FROM r WHERE rn = 1",
    "upper_median": "SELECT l_suppkey, list_sort(list(l_extendedprice))[count(*) // 2 + 1] AS median FROM lineitem GROUP BY l_suppkey",
    "weighted_mean": "SELECT l_suppkey, round(sum(l_extendedprice * l_quantity) / sum(l_quantity), 4) AS mean FROM lineitem GROUP BY l_suppkey",
    "bbox_extents": "SELECT l_orderkey, min(l_quantity) AS \"left\", min(l_linenumber) AS top, max(l_quantity + l_tax) AS \"right\", max(l_linenumber + 1) AS bottom, bool_or(l_returnflag = 'R') AS bold FROM lineitem GROUP BY l_orderkey",
    "topk_share": """WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice, (row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber))::INT AS place, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem) SELECT * EXCLUDE n FROM r WHERE place <= least(256, greatest(8, ceil(n * 0.2)))""",
    "size_guard": "SELECT count(*) AS n, sum(n_chars)::BIGINT AS bytes FROM documents",
    "unique_names": "WITH n AS (SELECT p_partkey, p_brand || '.txt' AS name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part) SELECT p_partkey, name, CASE WHEN k = 1 THEN name ELSE replace(name, '.txt', '') || '-' || k || '.txt' END AS unique_name FROM n",
    "padded_labels": "SELECT doc_id, '-page-' || lpad((row_number() OVER (PARTITION BY source ORDER BY doc_id))::VARCHAR, length((count(*) OVER (PARTITION BY source))::VARCHAR)::INT, '0') AS label FROM documents",
    "tar_header_fields": "SELECT doc_id, lpad(to_base(strlen(text), 8), 11, '0') AS size, '0000644' AS mode, 136 AS length, (ceil(strlen(text) / 512.0) * 512 + 512)::BIGINT AS padded FROM documents",
    "numeric_suffix_sort": "SELECT 'ppt/slides/slide' || doc_id || '.xml' AS name, row_number() OVER (ORDER BY doc_id) AS place FROM documents",
}
