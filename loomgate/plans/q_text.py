"""Queries of text, number and time functions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgate.functions import numbers as N
from loomgate.functions import text as T
from loomgate.functions import times as D
from loomgate.plans import registry
from loomgate.plans.tables import table

_SP = r"[\t\n\v\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"


def _trim(x: str) -> str:
    return rf"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"


def _case(table: dict[str, str], x: str, default: str) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items()) + f" ELSE {default} END"


def _js(x: str) -> str:
    def tail(y: str) -> str:
        return rf"regexp_replace(regexp_replace({y}, '(\.[0-9]*?)0+$', '\1'), '\.$', '')"

    return f"CASE WHEN {x} = 0 THEN '0' WHEN abs({x}) < 1 THEN {tail(f'{x}::VARCHAR::DECIMAL(38,37)::VARCHAR')} ELSE {tail(f'{x}::VARCHAR::DECIMAL(38,16)::VARCHAR')} END"


def _far(x: str) -> str:
    """Numbers that may need an exponent: this engine's own print of them has two digits of it at least."""
    return f"CASE WHEN abs({x}) >= 1e-6 AND abs({x}) < 1e21 THEN {_js(x)} ELSE regexp_replace(regexp_replace({x}::VARCHAR, 'e([+-])0', 'e\\1'), '\\.0e', 'e') END"


def _escape(x: str, pairs: list[tuple[str, str]]) -> str:
    for old, new in pairs:
        x = f"replace({x}, '{old}', '{new}')"
    return x


_HTML = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#039;")]
_URL_NAME = r"regexp_replace(url, '[?#].*$', '')"


def url_extension(spark, d):
    name = F.regexp_replace("url", "[?#].*$", "")
    return table(spark, d, "pages").select("page_id", T.extension(name).alias("ext"), T.base_name(name).alias("base"))


def format_identify(spark, d):
    named = table(spark, d, "documents").select("doc_id", F.concat(F.lit("Report "), F.col("doc_id").cast("string"), F.lit("."), F.element_at(F.array(*map(F.lit, _EXTS)), (F.col("doc_id") % len(_EXTS) + 1).cast("int"))).alias("name"))
    return registry.identified(named).select("doc_id", "name", "raw_ext", "ext", "kind")


_EXTS = ["JPEG", "srt", "md", "yml", "db", "mobi", "csv", "tgz", "m4b", "nope", "PPTX", "htm", "log", "pdf", "toml", "slk"]


def safe_name_titles(spark, d):
    title = F.concat(F.col("text"), F.lit(".v2/draft.txt"))
    return table(spark, d, "documents").select("doc_id", T.safe_name(title).alias("safe"), T.safe_table_name(title).alias("table_name"))


def output_names(spark, d):
    name = F.concat(F.col("p_name"), F.lit("/"), F.col("p_type"), F.lit(".csv"))
    return table(spark, d, "part").select("p_partkey", T.output_name(name, F.lit("json")).alias("out"), T.output_name(name, F.lit("png"), "-page").alias("page_out"))


def escape_html_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.escape_html(F.concat(F.col("text"), F.lit("<a href=\"x\">'&"))).alias("html"))


def escape_xml_text(spark, d):
    x = F.concat(F.col("text"), F.lit("<a b=\"c\">'&\u0001"))
    return table(spark, d, "documents").select("doc_id", T.escape_xml_text(x).alias("text_form"), T.escape_xml(x).alias("attribute_form"))


def html_document_wrap(spark, d):
    return table(spark, d, "documents").select("doc_id", T.html_document(F.concat(F.lit("<pre>"), T.escape_html(F.col("text")), F.lit("</pre>")), F.concat(F.lit("Doc & "), F.col("doc_id").cast("string"))).alias("html"))


def human_bytes(spark, d):
    size = F.col("n_chars") * F.col("n_chars") * F.element_at(F.array(*map(F.lit, (0, 1, 37, 4099))), (F.col("doc_id") % 4 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", size.alias("size"), T.human_bytes(size).alias("shown"))


def line_classify(spark, d):
    doc = F.concat(F.col("text"), F.lit("\n\n## Head\n- item\n* star\n#no"))
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split(doc, "\n")).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", T.line_class(F.col("line")).alias("class"))


def plain_text_tidy(spark, d):
    return table(spark, d, "documents").select("doc_id", T.tidy(F.concat(F.lit("\n a b \t\n\n\n\n"), F.col("text"), F.lit(" \n "))).alias("tidy"))


def bom_strip_roundtrip(spark, d):
    both = T.add_bom(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(both).alias("with_bom"), (T.strip_bom(both) == F.col("text")).alias("same"), F.md5(T.strip_bom(both)).alias("digest"))


def blob_base64(spark, d):
    return table(spark, d, "documents").select("doc_id", T.blob_text(F.col("text").cast("binary")).alias("blob"), T.data_url(F.lit("x").cast("binary"), "text/plain").alias("url"))


def format_error_case(spark, d):
    said = F.element_at(F.array(*map(F.lit, _ERRORS)), (F.col("event_id") % len(_ERRORS) + 1).cast("int"))
    return table(spark, d, "events").select("event_id", T.error_label(F.concat(said, F.lit(" for "), F.col("event_type"), F.lit(" "), F.col("props"))).alias("label"))


_ERRORS = ["Out of Memory", "bad codec", "File is encrypted", "it was NOT FOUND here", "x", "a rather long message that goes on and on"]


def font_families(spark, d):
    name = F.concat(F.lit("ABCDEF+'"), F.col("p_type"), F.lit(" "), F.element_at(F.array(*map(F.lit, _FONTS)), (F.col("p_partkey") % len(_FONTS) + 1).cast("int")), F.lit("'"))
    return table(spark, d, "part").select("p_partkey", T.font_family(name).alias("family"))


_FONTS = ["Courier-Bold", "sans-serif", "Times", "Georgia", "Menlo Mono", "Serif"]


def path_cleaning(spark, d):
    path = F.concat(F.lit("../"), F.replace(F.col("p_name"), F.lit(" "), F.lit("\\")), F.lit("//./"), F.col("p_brand"), F.lit("/..\\x.txt"))
    return table(spark, d, "part").select("p_partkey", T.clean_path(path).alias("path"))


def split_event_fields(spark, d):
    line = F.concat_ws(",", "event_type", F.col("user_id").cast("string"), "props", F.lit("a"), F.lit("b"))
    cut = T.split_fields(line, 4)
    return table(spark, d, "events").select("event_id", *[F.get(cut, F.lit(i)).alias(f"f{i}") for i in range(4)], T.ini_value(F.concat(F.col("event_type"), F.when(F.col("event_id") % 2 == 0, "=#\"x\n").otherwise(""))).alias("ini"), T.strip_quotes(F.concat(F.lit("\""), F.col("event_type"), F.lit("'"))).alias("bare"))


def js_numbers(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.js_number(F.col("l_extendedprice")).alias("price"), N.js_number(F.col("l_quantity")).alias("quantity"), N.js_number(F.col("l_discount") / 7).alias("share"), N.js_number(F.col("l_quantity") * 1e21).alias("large"), N.js_number(F.col("l_quantity") / -1e9).alias("small"), N.js_number(F.when(F.col("l_linenumber") == 1, F.col("l_tax") * float("inf")).otherwise(F.col("l_quantity"))).alias("beyond"))


def time_formats(spark, d):
    ms = F.col("event_id") * 86_399 + 7
    return table(spark, d, "events").select("event_id", D.timestamp(ms).alias("srt"), D.timestamp(ms, ".").alias("vtt"), D.ass_timestamp(ms).alias("ass"), D.parse_time(D.timestamp(ms)).alias("back"), D.iso_utc(F.col("ts")).alias("iso"))


def color_distance(spark, d):
    a, b = (F.array(*[F.floor(F.col("value") * k) % 256 for k in ks]) for ks in ((3, 5, 7), (11, 13, 17)))
    rgb = [F.floor(F.col("value") * k) % 256 for k in (3, 5, 7)]
    return table(spark, d, "events").select("event_id", N.colour_distance(a, b).alias("distance"), N.colour_hex(rgb).alias("hex"), N.readable_on(rgb).alias("ink"), N.channel((F.col("event_id") % 11) / 10).cast("long").alias("channel"))


def fit_to_slide(spark, d):
    fit = N.fit_page(F.col("l_quantity") + 10, F.col("l_extendedprice") / 100 + 1, 960.0, 540.0)
    r = lambda c: F.round(c, 6)
    scaled = N.scaled_size(F.col("l_quantity") * 100, F.col("l_extendedprice"), 2000)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[r(fit[x]).alias(x) for x in ("x", "y", "width", "height")], r(N.rotation(F.col("l_quantity"))).alias("turn"), N.twips(F.col("l_quantity") / 7).alias("twips"), N.emu(F.col("l_quantity") / 7).alias("emu"), scaled["width"].alias("scaled_width"), scaled["height"].alias("scaled_height"), N.half_points(F.concat(F.col("l_quantity").cast("long").cast("string"), F.element_at(F.array(*map(F.lit, ("px", "pt", "em", "rem", "%", "vw"))), (F.col("l_orderkey") % 6 + 1).cast("int")))).alias("half_points"))


QUERIES = {f.__name__: f for f in (url_extension, format_identify, safe_name_titles, output_names, escape_html_text, escape_xml_text, html_document_wrap, human_bytes, line_classify, plain_text_tidy, bom_strip_roundtrip, blob_base64, format_error_case, font_families, path_cleaning, split_event_fields, js_numbers, time_formats, color_distance, fit_to_slide)}


def _clean(x: str, size: int, default: str) -> str:
    dashed = rf"""regexp_replace({x}, '[\\/:*?"<>|\x00-\x1f]', '-', 'g')"""
    inner = _trim(f"regexp_replace({dashed}, '{_SP}+', ' ', 'g')")
    return f"coalesce(nullif(substr({inner}, 1, {size}), ''), '{default}')"


def _base(x: str) -> str:
    return rf"coalesce(nullif(regexp_replace({x}, '\.[^.]+$', ''), ''), 'converted-file')"


def _pick(values: list[str], x: str) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"][({x}) % {len(values)} + 1]"


_TIME = "format('{:02d}:{:02d}:{:02d}MARK{:03d}', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000)"
SQL = {
    "url_extension": rf"SELECT page_id, regexp_extract(lower({_trim(_URL_NAME)}), '\.([a-z0-9]+)$', 1) AS ext, {_base(_URL_NAME)} AS base FROM pages",
    "format_identify": f"""WITH n AS (SELECT doc_id, 'Report ' || doc_id || '.' || {_pick(_EXTS, 'doc_id')} AS name FROM documents),
        e AS (SELECT *, regexp_extract(lower(name), '\\.([a-z0-9]+)$', 1) AS raw_ext FROM n), c AS (SELECT *, {_case(registry.ALIASES, 'raw_ext', 'raw_ext')} AS ext FROM e)
        SELECT *, {_case(registry.KIND, 'ext', "''")} AS kind FROM c""",
    "safe_name_titles": f"WITH t AS (SELECT doc_id, text || '.v2/draft.txt' AS t FROM documents) SELECT doc_id, {_clean(_base('t'), 120, 'converted-file')} AS safe, {_clean('t', 80, 'table')} AS table_name FROM t",
    "output_names": f"WITH t AS (SELECT p_partkey, p_name || '/' || p_type || '.csv' AS t FROM part), s AS (SELECT p_partkey, {_clean(_base('t'), 120, 'converted-file')} AS s FROM t) SELECT p_partkey, s || '.json' AS out, s || '-page.png' AS page_out FROM s",
    "escape_html_text": f"SELECT doc_id, {_escape('''text || '<a href="x">''&' ''', _HTML)} AS html FROM documents",
    "escape_xml_text": f"""WITH t AS (SELECT doc_id, text || '<a b="c">''&' || chr(1) AS t FROM documents) SELECT doc_id, {_escape('t', _HTML[:4])} AS text_form, {_escape(r"regexp_replace(t, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')", [*_HTML[:4], ("''", "&apos;")])} AS attribute_form FROM t""",
    "html_document_wrap": f"""SELECT doc_id, '{T._HEAD.replace(chr(10), "' || chr(10) || '")}' || 'Doc &amp; ' || doc_id || '</title></head><body><pre>' || {_escape('text', _HTML)} || '</pre></body></html>' AS html FROM documents""",
    "human_bytes": """WITH s AS (SELECT doc_id, n_chars * n_chars * [0, 1, 37, 4099][doc_id % 4 + 1] AS size FROM documents),
        u AS (SELECT *, CASE WHEN size < 1024 THEN 0 WHEN size < 1048576 THEN 1 WHEN size < 1073741824 THEN 2 ELSE 3 END AS step FROM s), v AS (SELECT *, size / pow(1024, step) AS value FROM u)
        SELECT doc_id, size, CASE WHEN size < 1 THEN '0 B' ELSE CASE WHEN value >= 10 OR step = 0 THEN floor(value + 0.5)::BIGINT::VARCHAR ELSE (floor(value * 10 + 0.5)::BIGINT // 10) || '.' || (floor(value * 10 + 0.5)::BIGINT % 10) END || ' ' || ['B', 'KB', 'MB', 'GB'][step + 1] END AS shown FROM v""",
    "line_classify": rf"""WITH l AS (SELECT doc_id, unnest(range(len(a))) AS line_no, unnest(a) AS line FROM (SELECT doc_id, string_split(text || chr(10) || chr(10) || '## Head' || chr(10) || '- item' || chr(10) || '* star' || chr(10) || '#no', chr(10)) AS a FROM documents))
        SELECT doc_id, line_no, CASE WHEN {_trim('line')} = '' THEN 'blank' WHEN regexp_matches(line, '^#{{1,6}}{_SP}') THEN 'heading' WHEN regexp_matches(line, '^[-*]{_SP}+') THEN 'bullet' ELSE 'paragraph' END AS class FROM l""",
    "plain_text_tidy": rf"""WITH t AS (SELECT doc_id, chr(10) || ' a' || chr(160) || 'b ' || chr(9) || repeat(chr(10), 4) || text || ' ' || chr(10) || ' ' AS t FROM documents)
        SELECT doc_id, {_trim(r"regexp_replace(regexp_replace(replace(t, chr(160), ' '), '[ \t]+\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')")} AS tidy FROM t""",
    "bom_strip_roundtrip": "SELECT doc_id, length(text) + 1 AS with_bom, true AS same, md5(text) AS digest FROM documents",
    "blob_base64": "SELECT doc_id, 'base64:' || base64(encode(text)) AS blob, 'data:text/plain;base64,eA==' AS url FROM documents",
    "format_error_case": f"""WITH m AS (SELECT event_id, {_pick(_ERRORS, 'event_id')} || ' for ' || event_type || ' ' || props AS m FROM events) SELECT event_id, CASE {" ".join(f"WHEN regexp_matches(m, '(?i){a}') THEN '{b}'" for a, b in T.ERRORS)} WHEN length(m) > 40 THEN substr(m, 1, 37) || '...' ELSE m END AS label FROM m""",
    "font_families": f"WITH n AS (SELECT p_partkey, p_type || ' ' || {_pick(_FONTS, 'p_partkey')} AS n FROM part) SELECT p_partkey, CASE WHEN regexp_matches(n, '(?i)mono|courier') THEN 'Courier New' WHEN regexp_matches(n, '(?i)sans|arial|helvetica') THEN 'Arial' WHEN regexp_matches(n, '(?i)serif|times') THEN 'Times New Roman' ELSE trim(n) END AS family FROM n",
    "path_cleaning": "SELECT p_partkey, array_to_string(list_filter(string_split(replace(p_name, ' ', '/') || '/' || p_brand || '/x.txt', '/'), lambda s: s NOT IN ('', '.', '..')), '/') AS path FROM part",
    "split_event_fields": """SELECT event_id, event_type AS f0, user_id::VARCHAR AS f1, regexp_extract(props, '^[^,]*') AS f2, substr(props || ',a,b', length(regexp_extract(props, '^[^,]*')) + 2) AS f3,
        CASE WHEN event_id % 2 = 0 THEN to_json(event_type || '=#"x' || chr(10))::VARCHAR ELSE event_type END AS ini, event_type AS bare FROM events""",
    "js_numbers": f"""SELECT l_orderkey, l_linenumber, {_js('l_extendedprice')} AS price, {_js('l_quantity')} AS quantity, {_js('(l_discount / 7)')} AS share, {_far('(l_quantity * 1e21)')} AS large, {_far('(l_quantity / -1e9)')} AS small,
        CASE WHEN l_linenumber > 1 THEN {_js('l_quantity')} WHEN l_tax = 0 THEN 'NaN' ELSE 'Infinity' END AS beyond FROM lineitem""",
    "time_formats": f"""WITH m AS (SELECT *, event_id * 86399 + 7 AS ms FROM events), c AS (SELECT *, floor(ms / 10 + 0.5)::BIGINT AS cs FROM m)
        SELECT event_id, {_TIME.replace('MARK', ',')} AS srt, {_TIME.replace('MARK', '.')} AS vtt, format('{{}}:{{:02d}}:{{:02d}}.{{:02d}}', cs // 360000, cs // 6000 % 60, cs // 100 % 60, cs % 100) AS ass, ms AS back, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS iso FROM c""",
    "color_distance": """WITH c AS (SELECT *, list_transform([3, 5, 7], lambda k: floor(value * k)::BIGINT % 256) AS a, list_transform([11, 13, 17], lambda k: floor(value * k)::BIGINT % 256) AS b FROM events)
        SELECT event_id, list_sum(list_transform([1, 2, 3], lambda i: ((a[i] - b[i]) * (a[i] - b[i]))::DOUBLE)) AS distance, upper(format('{:02x}{:02x}{:02x}', a[1], a[2], a[3])) AS hex, CASE WHEN a[1] * 0.2126 + a[2] * 0.7152 + a[3] * 0.0722 >= 128 THEN '000000' ELSE 'FFFFFF' END AS ink,
        CASE WHEN event_id % 11 <= 10 THEN floor(event_id % 11 / 10.0 * 255 + 0.5)::BIGINT END AS channel FROM c""",
    "fit_to_slide": """WITH p AS (SELECT *, l_quantity + 10 AS w, l_extendedprice / 100 + 1 AS h FROM lineitem), s AS (SELECT *, least(960 / w, 540 / h) AS k, least(1, 2000 / greatest(l_quantity * 100, l_extendedprice)) AS m, degrees(l_quantity) - 360 * floor(degrees(l_quantity) / 360) AS deg, l_quantity::BIGINT AS q FROM p)
        SELECT l_orderkey, l_linenumber, round((960 - w * k) / 2, 6) + 0 AS x, round((540 - h * k) / 2, 6) + 0 AS y, round(w * k, 6) AS width, round(h * k, 6) AS height, round(CASE WHEN deg > 180 THEN deg - 360 ELSE deg END, 6) AS turn,
        floor(l_quantity / 7 * 20 + 0.5)::BIGINT AS twips, floor(l_quantity / 7 * 12700 + 0.5)::BIGINT AS emu, greatest(1, floor(l_quantity * 100 * m + 0.5))::BIGINT AS scaled_width, greatest(1, floor(l_extendedprice * m + 0.5))::BIGINT AS scaled_height,
        CASE l_orderkey % 6 WHEN 5 THEN NULL ELSE greatest(2, least(192, floor(CASE l_orderkey % 6 WHEN 0 THEN q * 1.5 WHEN 1 THEN q * 2 WHEN 2 THEN q * 22 WHEN 3 THEN q * 24 ELSE q / 100.0 * 22 END + 0.5)))::BIGINT END AS half_points FROM s""",
}
