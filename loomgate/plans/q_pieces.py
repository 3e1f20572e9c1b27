"""Queries of colour models, text geometry, packed numbers, metadata records and small filters, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgate.functions import numbers as N
from loomgate.functions import text as T
from loomgate.operators import layout, lookups
from loomgate.plans.tables import table
from loomgate.sources import palm

_STYLES = {"click": ("Arial", 700), "view": ("Courier New", 400), "error": ("Times New Roman", 400)}


def colour_models(spark, d):
    q, tenth = F.col("l_quantity"), F.col("l_discount") * 10
    hexed = lambda c: N.colour_hex([c[i] for i in range(3)])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", hexed(N.gray_rgb(F.array(q))).alias("gray"), hexed(N.gray_rgb(F.array(tenth))).alias("share"), hexed(N.rgb_channels(F.array(q, q * 5, q * 7))).alias("rgb"), hexed(N.rgb_channels(F.array(tenth, tenth / 2, tenth / 4))).alias("shares"), hexed(N.cmyk_rgb(F.array(tenth, tenth / 2, q * 5, F.col("l_tax")))).alias("cmyk"))


def colour_states(spark, d):
    """Of each order's items: R saves the colour, A restores it, N sets it to the way of shipping."""
    op = F.when(F.col("l_returnflag") == "R", "save").when(F.col("l_returnflag") == "A", "restore").otherwise("set")
    steps = F.array_sort(F.collect_list(F.struct("l_linenumber", op.alias("op"), F.col("l_linestatus").alias("colour"))))
    each = table(spark, d, "lineitem").groupBy("l_orderkey").agg(layout.colour_states(steps).alias("c"))
    return each.select("l_orderkey", F.posexplode("c").alias("place", "colour"))


def text_places(spark, d):
    q, p = F.col("l_quantity"), F.col("l_discount") * 10
    place = N.text_place(F.array(q, p, -p, q / 2, F.col("l_extendedprice"), F.col("l_tax")), F.when(F.col("l_linenumber") > 1, q * 3), F.when(F.col("l_linenumber") > 2, F.lit(0.8)))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[F.round(place[k], 6).alias(k) for k in ("angle", "height", "left", "top", "width")])


def shown_pieces(spark, d):
    text = F.when(F.col("l_returnflag") == "R", " \u00a0\t").when(F.col("l_returnflag") == "A", F.col("l_linestatus"))
    pieces = table(spark, d, "lineitem").withColumns({"piece": text, "turn": F.col("l_quantity") - 25})
    return pieces.where(layout.shown(F.col("piece"), F.col("turn"))).select("l_orderkey", "l_linenumber", "piece", "turn")


def glyph_texts(spark, d):
    empty = F.when(F.col("event_id") % 2 == 0, "").otherwise(F.lit(None))
    glyph = lambda a, b, c: F.struct(a.alias("str"), b.alias("unicode"), c.alias("fontChar"))
    glyphs = F.array(glyph(F.col("event_type"), F.lit("x"), F.lit("y")), glyph(empty, F.lit("-"), F.lit("y")), glyph(empty, empty, F.lit("+")), glyph(empty, empty, empty))
    return table(spark, d, "events").select("event_id", layout.glyph_text(glyphs).alias("text"))


def piece_styles(spark, d):
    styles = spark.createDataFrame([(k, *v) for k, v in _STYLES.items()], "event_type string, family string, weight int")
    return lookups.with_defaults(table(spark, d, "events").select("event_id", "event_type"), styles, ["event_type"], {"family": "Arial", "weight": 100})


def variable_lengths(spark, d):
    """Each event's number in one to four bytes, marked at the last and at the first, read back."""
    n = F.col("event_id") % 268_435_456
    digit = lambda i: F.shiftright(n, 7 * i).bitwiseAND(F.lit(127))
    size = F.when(n < 128, 1).when(n < 16_384, 2).when(n < 2_097_152, 3).otherwise(4)
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    ahead = F.concat(*[F.when(size > i, byte(digit(i) + (128 if i == 0 else 0))).otherwise("") for i in (3, 2, 1, 0)])
    back = F.concat(*[F.when(size > i, byte(digit(i) + F.when(size == i + 1, 128).otherwise(0))).otherwise("") for i in (3, 2, 1, 0)])
    found = N.variable_length(F.unhex(F.concat(F.lit("FF"), ahead, F.lit("00"))), 1)
    return table(spark, d, "events").select("event_id", found["value"].alias("value"), found["length"].alias("length"), N.variable_length_back(F.unhex(F.concat(F.lit("0000000000"), back))).alias("back"))


def data_url_roundtrip(spark, d):
    parts = T.data_url_parts(T.data_url(F.col("text").cast("binary"), "text/plain"))
    return table(spark, d, "documents").select("doc_id", parts["mime"].alias("mime"), F.md5(parts["content"]).alias("digest"), T.data_url_parts(F.col("text")).isNull().alias("other"))


def numbers_in_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.array_join(T.numbers_in(F.col("html"), "([0-9]{1,9})").cast("array<string>"), " ").alias("numbers"))


def truthy_words(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(T.truthy(F.split("text", " ")), "|").alias("words"))


def name_sort_keys(spark, d):
    return table(spark, d, "part").select("p_partkey", T.utf16_key(F.col("p_name")).alias("key"))


def locale_sorted(spark, d):
    """Suppliers in the order of the Unicode collation."""
    return table(spark, d, "supplier").select("s_suppkey", "s_name").orderBy(F.collate("s_name", "UNICODE"), "s_suppkey")


def book_metadata(spark, d):
    """Metadata headers made of part rows: a title given twice, two creators, a record of an unknown type."""
    number = lambda x: F.unhex(F.lpad(F.hex(x), 8, "0"))
    record = lambda kind, text: F.concat(number(F.lit(kind)), number(F.length(text.cast("binary")) + 8), text.cast("binary"))
    body = F.concat(record(503, F.lit("draft")), record(100, F.col("p_brand")), record(999, F.lit("?")), record(100, F.col("p_type")), record(503, F.col("p_name")))
    header = F.concat(F.lit("EXTH").cast("binary"), number(F.length(body) + 12), number(F.lit(5)), body)
    return palm.metadata(table(spark, d, "part").select("p_partkey", header.alias("header")), "header", ["p_partkey"])


QUERIES = {f.__name__: f for f in (colour_models, colour_states, text_places, shown_pieces, glyph_texts, piece_styles, variable_lengths, data_url_roundtrip, numbers_in_text, truthy_words, name_sort_keys, locale_sorted, book_metadata)}


def _hex(*channels: str) -> str:
    limited = ", ".join(f"floor(greatest(0, least(255, {c})) + 0.5)::BIGINT" for c in channels)
    return f"upper(format('{{:02x}}{{:02x}}{{:02x}}', {limited}))"


_INK = lambda x: f"greatest(0, least(1, CASE WHEN {x} > 1 THEN {x} / 255 ELSE {x} END))"
SQL = {
    "colour_models": f"""WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount * 10 AS t, l_tax AS k FROM lineitem), s AS (SELECT *, CASE WHEN q <= 1 THEN q * 255 ELSE q END AS g, CASE WHEN t <= 1 THEN t * 255 ELSE t END AS h FROM v)
        SELECT l_orderkey, l_linenumber, {_hex('g', 'g', 'g')} AS gray, {_hex('h', 'h', 'h')} AS share, {_hex('q', 'q * 5', 'q * 7')} AS rgb, CASE WHEN t <= 1 THEN {_hex('t * 255', 't / 2 * 255', 't / 4 * 255')} ELSE {_hex('t', 't / 2', 't / 4')} END AS shares,
        {_hex(*(f"255 * (1 - least(1, {_INK(x)} + {_INK('k')}))" for x in ('t', '(t / 2)', '(q * 5)')))} AS cmyk FROM s""",
    "colour_states": """WITH RECURSIVE o AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END, l_linestatus) - 1 AS place, l_returnflag AS f, l_linestatus AS c FROM lineitem),
        w AS (SELECT l_orderkey, place, CASE WHEN f = 'N' THEN c END AS now, CASE WHEN f = 'R' THEN [NULL::VARCHAR] ELSE []::VARCHAR[] END AS kept FROM o WHERE place = 0
          UNION ALL SELECT o.l_orderkey, o.place, CASE WHEN f = 'N' THEN c WHEN f = 'A' AND len(kept) > 0 THEN kept[len(kept)] ELSE now END, CASE WHEN f = 'R' THEN list_append(kept, now) WHEN f = 'A' THEN kept[1:len(kept) - 1] ELSE kept END
          FROM w JOIN o ON o.l_orderkey = w.l_orderkey AND o.place = w.place + 1) SELECT l_orderkey, place::INT AS place, now AS colour FROM w""",
    "text_places": """WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity AS q, l_discount * 10 AS p, l_extendedprice AS e, l_tax AS f, CASE WHEN l_linenumber > 1 THEN l_quantity * 3 END AS w, CASE WHEN l_linenumber > 2 THEN 0.8 ELSE 1 END AS up FROM lineitem),
        g AS (SELECT *, atan2(p, q) AS a, greatest(1, sqrt(p * p + q / 2 * (q / 2))) AS h FROM v)
        SELECT l_orderkey, l_linenumber, round(a, 6) AS angle, round(h, 6) AS height, round(e + up * h * sin(a), 6) AS left, round(f - up * h * cos(a), 6) AS top, round(greatest(coalesce(w, h * 0.5), h * 0.25), 6) AS width FROM g""",
    "shown_pieces": "SELECT l_orderkey, l_linenumber, l_linestatus AS piece, l_quantity - 25 AS turn FROM lineitem WHERE l_returnflag = 'A' AND l_quantity BETWEEN 23 AND 27",
    "glyph_texts": "SELECT event_id, event_type || '-+' AS text FROM events",
    "piece_styles": f"SELECT event_id, event_type, coalesce(family, 'Arial') AS family, coalesce(weight, 100)::INT AS weight FROM events LEFT JOIN (VALUES {', '.join(repr((k, *v)) for k, v in _STYLES.items())}) s(event_type, family, weight) USING (event_type)",
    "variable_lengths": "SELECT event_id, event_id % 268435456 AS value, CASE WHEN event_id % 268435456 < 128 THEN 1 WHEN event_id % 268435456 < 16384 THEN 2 WHEN event_id % 268435456 < 2097152 THEN 3 ELSE 4 END AS length, event_id % 268435456 AS back FROM events",
    "data_url_roundtrip": "SELECT doc_id, 'text/plain' AS mime, md5(text) AS digest, NOT starts_with(text, 'data:') AS other FROM documents",
    "numbers_in_text": "SELECT page_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(html, '[0-9]{1,9}'), lambda x: x::BIGINT))), ' ') AS numbers FROM pages",
    "truthy_words": "SELECT doc_id, array_to_string(list_filter(string_split(text, ' '), lambda x: x <> ''), '|') AS words FROM documents",
    "name_sort_keys": "SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ''), lambda c: upper(format('{:04x}', unicode(c)))), '') AS key FROM part",
    "locale_sorted": "SELECT s_suppkey, s_name FROM supplier",
    "book_metadata": "SELECT p_partkey, 'title' AS name, -1 AS slot, p_name AS value FROM part UNION ALL SELECT p_partkey, 'creator', 1, p_brand FROM part UNION ALL SELECT p_partkey, 'creator', 3, p_type FROM part",
}
