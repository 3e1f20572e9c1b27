"""Queries of page layout, package headers and small lookups, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgate.operators import layout
from loomgate.plans import registry
from loomgate.plans.tables import table
from loomgate.sources import palm


def page_lines(spark, d):
    """Line items as pieces of text on a page for each order."""
    c = F.col
    pieces = table(spark, d, "lineitem").select(
        "l_orderkey", (c("l_linenumber") * 100_000 + c("l_partkey")).alias("ord"), (c("l_linenumber") * 9.0).alias("x"), F.floor(c("l_quantity") / 25).cast("double").alias("baseline"), F.lit(8.0).alias("width"), F.lit(10.0).alias("height"), F.lit(0.0).alias("rotation"),
        c("l_linestatus").alias("family"), F.lit(False).alias("bold"), F.lit(False).alias("italic"), F.lit("").alias("colour"), (c("l_returnflag") == "R").alias("eol"),
    )
    return layout.line_numbers(pieces, ["l_orderkey"], "ord", 600.0).groupBy("l_orderkey").agg(F.max("line").alias("last_line"), F.count("*").alias("pieces"))


def piece_colours(spark, d):
    pieces = table(spark, d, "conversations").select("conv_id", "turn", F.length("text").cast("long").alias("n"))
    runs = table(spark, d, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("all"), F.count("*").alias("turns"))
    runs = runs.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("turn"), F.floor(F.col("all") / 3).alias("third"), "all").select("conv_id", "turn", F.when(F.col("turn") < 2, F.col("third")).otherwise(F.col("all") - F.col("third") * 2).alias("n"), F.concat(F.lit("c"), F.col("turn").cast("string")).alias("colour"))
    return layout.piece_colours(pieces, runs, ["conv_id"], "turn", "n", "colour")


def image_sizes(spark, d):
    """Headers as wide as the event's number. A GIF has two bytes for a width, so of larger numbers they are PNG, whose four take any below 2^32."""
    size = lambda x: F.lpad(F.hex(x), 8, "0")
    png = lambda height: F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), size(F.col("event_id")), size(height)))
    gif = F.unhex(F.concat(F.lit("474946383961"), F.lpad(F.hex(F.col("event_id") % 256), 2, "0"), F.lpad(F.hex(F.floor(F.col("event_id") / 256)), 2, "0"), F.lpad(F.hex(F.col("user_id") % 256), 2, "0"), F.lit("01")))
    small = F.when(F.col("event_id") < 65_536, gif).otherwise(png(F.col("user_id") % 256 + 256))
    content = F.when(F.col("event_id") % 3 == 0, png(F.col("user_id"))).when(F.col("event_id") % 3 == 1, small).otherwise(F.lit("BM").cast("binary"))
    found = layout.image_size(content)
    return table(spark, d, "events").select("event_id", found["width"].alias("width"), found["height"].alias("height"))


def palm_records(spark, d):
    """Books of two records made of part rows, cut again."""
    number = lambda x, n: F.unhex(F.lpad(F.hex(x), 2 * n, "0"))
    body = F.col("p_name").cast("binary")
    head = F.concat(F.lit("0001000000000001"), F.lpad(F.hex(F.lit(1)), 4, "0"), F.lit("1000"), F.lit("00" * 16), F.lit("0000FDE9"))
    head = F.unhex(head)
    book = F.concat(F.lit("t".ljust(60, "\0")).cast("binary"), F.lit("BOOKMOBI").cast("binary"), F.unhex(F.lit("00" * 8 + "0002")), number(F.lit(94), 4), F.unhex(F.lit("00000000")), number(F.lit(94) + F.length(head), 4), F.unhex(F.lit("00000000")), head, body)
    books = table(spark, d, "part").select("p_partkey", book.alias("content"))
    return palm.texts(books, "content", ["p_partkey"])


def table_rows(spark, d):
    page = F.concat(F.lit("<table><tr><th>id<th>url</tr><tr><td> "), F.col("page_id").cast("string"), F.lit(" <td>"), F.regexp_replace("url", "[&<]", ""), F.lit("</table>"))
    each = table(spark, d, "pages").select("page_id", F.posexplode(layout.table_cells(page)).alias("place", "cells"))
    return each.select("page_id", "place", F.get("cells", F.lit(0)).alias("a"), F.get("cells", F.lit(1)).alias("b"))


def metadata_texts(spark, d):
    json = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('["'), "event_type", F.lit('","x"]'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"fr":"y","en":"'), "event_type", F.lit('"}'))).otherwise(F.concat(F.lit('"'), "event_type", F.lit('"')))
    return table(spark, d, "events").select("event_id", layout.metadata_text(json).alias("text"))


def default_targets(spark, d):
    """For each extension the first wanted target that it may have."""
    routes = registry.routes(spark)
    wanted = F.array(*map(F.lit, registry.PREFERRED))
    chosen = routes.groupBy("kind", "ext").agg(F.collect_set("target").alias("t"))
    return chosen.select("kind", "ext", F.get(F.filter(wanted, lambda w: F.array_contains("t", w)), F.lit(0)).alias("target"))


def bit_operations(spark, d):
    c = F.col("event_id")
    return table(spark, d, "events").select("event_id", F.bit_count(c).alias("ones"), F.shiftright(c, 3).bitwiseAND(F.lit(7)).alias("three"), F.call_function("bit_get", c, F.lit(1)).cast("int").alias("second"), F.length(F.regexp_extract(F.bin(c), "0*$", 0)).alias("zeros_behind"))


QUERIES = {f.__name__: f for f in (page_lines, piece_colours, image_sizes, palm_records, table_rows, metadata_texts, default_targets, bit_operations)}

_ROUTES = "(VALUES " + ", ".join(f"('{k}', '{e}', '{t}')" for k, e in sorted({(k, registry.canonical(e)) for e, k in registry.KIND.items()}) for t in registry.targets(k, e)) + ") r(kind, ext, target)"
SQL = {
    "piece_colours": """WITH p AS (SELECT conv_id, turn, sum(length(text)) OVER w AS t, sum(length(text)) OVER w - length(text) AS f FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        a AS (SELECT conv_id, sum(length(text)) AS n, sum(length(text)) // 3 AS k FROM conversations GROUP BY 1), r AS (SELECT conv_id, i AS run, i * k AS s, CASE WHEN i = 2 THEN n ELSE (i + 1) * k END AS e FROM a, range(3) x(i)),
        m AS (SELECT p.conv_id, turn, run, least(t, e) - greatest(f, s) AS shared FROM p JOIN r USING (conv_id) WHERE least(t, e) > greatest(f, s)) SELECT conv_id, turn, 'c' || arg_min(run, (-shared, run)) AS colour FROM m GROUP BY 1, 2""",
    "image_sizes": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN event_id END AS width, CASE event_id % 3 WHEN 0 THEN user_id WHEN 1 THEN user_id % 256 + 256 END AS height FROM events",
    "palm_records": "SELECT p_partkey, 1 AS place, p_name AS text FROM part",
    "table_rows": "SELECT page_id, 0 AS place, 'id' AS a, 'url' AS b FROM pages UNION ALL SELECT page_id, 1, page_id::VARCHAR, regexp_replace(url, '[&<]', '', 'g') FROM pages",
    "metadata_texts": "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type || ', x' ELSE event_type END AS text FROM events",
    "default_targets": f"SELECT kind, ext, coalesce({', '.join(f'''max(CASE WHEN target = '{t}' THEN target END)''' for t in registry.PREFERRED)}) AS target FROM {_ROUTES} GROUP BY kind, ext",
    "bit_operations": "SELECT event_id, bit_count(event_id)::INT AS ones, (event_id >> 3) & 7 AS three, ((event_id >> 1) & 1)::INT AS second, length(regexp_extract(CASE WHEN event_id = 0 THEN '0' ELSE to_base(event_id, 2) END, '0*$')) AS zeros_behind FROM events",
}
