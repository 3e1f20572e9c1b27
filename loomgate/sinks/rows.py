"""Rows as text: CSV, TSV, JSON, NDJSON, XML, INI, TOML, YAML, HTML.

A format is a line (or block) for each row, made by column expressions, with something before, between and
after. `lines` keeps the rows distributed; `write` stores them as ordered part files; `document` joins them
into one text per group, for groups that fit a document.
"""

from __future__ import annotations

from html import escape

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DateType, DecimalType, DoubleType, FloatType, MapType, StringType, StructField, StructType, TimestampNTZType, TimestampType

from loomgate.functions.numbers import js_number
from loomgate.functions.text import BOM, blob_text, escape_html, escape_xml_text, ini_value, json_string
from loomgate.functions.times import iso_utc
from loomgate.operators.ordered import numbered
from loomgate.sinks import toml


def as_text(f: StructField) -> Column:
    """A flat value as text; null stays null."""
    c = F.col(f"`{f.name}`")
    if isinstance(f.dataType, (DoubleType, FloatType)):
        return js_number(c.cast("double"))
    if isinstance(f.dataType, (TimestampType, TimestampNTZType)):
        return iso_utc(c)
    if isinstance(f.dataType, BinaryType):
        return blob_text(c)
    if isinstance(f.dataType, (ArrayType, MapType, StructType)):
        return F.to_json(c)
    return c.cast("string")


def _is_quoted(f: StructField) -> bool:
    return not isinstance(f.dataType, (DoubleType, FloatType, BooleanType, DecimalType)) and f.dataType.typeName() not in ("byte", "short", "integer", "long")


def as_json(f: StructField) -> Column:
    """A flat value as JSON; null, NaN and the infinities are null."""
    text = json_string(as_text(f)) if _is_quoted(f) else as_text(f)
    if isinstance(f.dataType, (DoubleType, FloatType)):
        text = F.when(~text.isin("NaN", "Infinity", "-Infinity"), text)
    return F.coalesce(text, F.lit("null"))


def _own(df: DataFrame, but: list[str]) -> list[StructField]:
    return [f for f in df.schema if f.name not in but]


def csv_line(fields: list[StructField], separator: str = ",") -> Column:
    def cell(f: StructField) -> Column:
        text = F.coalesce(as_text(f), F.lit(""))
        return F.when(text.rlike(f'["\\n\\r{separator}]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.concat_ws(separator, *map(cell, fields))


def json_line(fields: list[StructField]) -> Column:
    pairs = [F.concat(json_string(F.lit(f.name)), F.lit(":"), as_json(f)) for f in fields]
    return F.concat(F.lit("{"), F.concat_ws(",", *pairs), F.lit("}"))


def json_block(fields: list[StructField], level: int = 1) -> Column:
    """An object on lines of its own, level steps of two blanks in."""
    pairs = [F.concat(F.lit("  " * (level + 1)), json_string(F.lit(f.name)), F.lit(": "), as_json(f)) for f in fields]
    return F.concat(F.lit("  " * level + "{\n"), F.concat_ws(",\n", *pairs), F.lit("\n" + "  " * level + "}"))


def xml_row(fields: list[StructField]) -> Column:
    cells = [F.concat(F.lit('<field name="'), escape_xml_text(F.lit(f.name)), F.lit('">'), escape_xml_text(as_text(f)), F.lit("</field>")) for f in fields]
    return F.concat(F.lit("<row>"), *cells, F.lit("</row>"))


def ini_section(fields: list[StructField], place: Column) -> Column:
    cell = lambda f: ini_value(as_text(f)) if isinstance(f.dataType, StringType) else F.coalesce(as_text(f), F.lit(""))
    return F.concat(F.lit("[row"), place.cast("string"), F.lit("]\n"), F.concat_ws("\n", *[F.concat(F.lit(f"{f.name}="), cell(f)) for f in fields]))


def toml_table(fields: list[StructField]) -> Column:
    return toml.row(StructType(fields))


def yaml_item(fields: list[StructField]) -> Column:
    """A list item in block style; texts that could be read as something else are quoted."""

    def cell(f: StructField) -> Column:
        text = as_text(f)
        plain = text.rlike(r"^[A-Za-z_\p{L}][\p{L}\p{N} _./()+-]*$") & ~text.rlike(r"(?i)^(true|false|null|yes|no|on|off|y|n)$") & ~text.rlike(r" $")
        return F.coalesce(F.when(plain, text).otherwise(json_string(text)) if _is_quoted(f) else text, F.lit("null"))

    return F.concat(F.lit("- "), F.concat_ws("\n  ", *[F.concat(F.lit(f"{f.name}: "), cell(f)) for f in fields]))


def html_row(fields: list[StructField]) -> Column:
    return F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), escape_html(F.coalesce(as_text(f), F.lit(""))), F.lit("</td>")) for f in fields], F.lit("</tr>"))


#: format -> (before, between, after)
FRAMES = {
    "csv": (BOM, "\n", ""),
    "tsv": (BOM, "\n", ""),
    "json": ("[\n", ",\n", "\n]"),
    "ndjson": ("", "\n", "\n"),
    "xml": ('<?xml version="1.0" encoding="UTF-8"?>\n<data>', "", "</data>\n"),
    "ini": ("", "\n\n", "\n"),
    "toml": ("", "\n\n", "\n"),
    "yaml": ("", "\n", "\n"),
    "html": ('<table id="converted-table"><tbody>', "", "</tbody></table>"),
}


def header(df: DataFrame, target: str, but: list[str]) -> str:
    """What stands before the first row, the line of column names included."""
    names = [f.name for f in _own(df, but)]
    before = FRAMES[target][0]
    if target in ("csv", "tsv"):
        mark = "," if target == "csv" else "\t"
        before += mark.join('"' + n.replace('"', '""') + '"' if any(c in n for c in f'"\n\r{mark}') else n for n in names) + "\n"
    if target == "html":
        before += "<tr>" + "".join(f"<td>{escape(n)}</td>" for n in names) + "</tr>"
    return before


def lines(df: DataFrame, target: str, order: list[str], keys: list[str] = [], place: Column | None = None) -> DataFrame:
    """keys, order and `line`: each row as the target format has it. INI numbers the rows of each group."""
    fields = _own(df, [*keys, *(c for c in order if c.startswith("__"))])
    if target == "ini" and place is None:
        df, place = numbered(df, keys, order, "__place"), F.col("__place")
    made = {"csv": csv_line, "tsv": lambda f: csv_line(f, "\t"), "json": json_block, "ndjson": json_line, "xml": xml_row, "ini": lambda f: ini_section(f, place), "toml": toml_table, "yaml": yaml_item, "html": html_row}
    return df.select(*keys, *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], made[target](fields).alias("line"))


def document(df: DataFrame, target: str, order: list[str], keys: list[str] = []) -> DataFrame:
    """keys, text: all rows of a group, in order, as one document."""
    _, between, after = FRAMES[target]
    before = header(df, target, [*keys, *(c for c in order if c.startswith("__"))])
    each = lines(df, target, order, keys)
    places = [f"__o{i}" for i in range(len(order))]
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*places, "line"))), lambda x: x["line"]), between)
    return each.groupBy(*keys).agg(F.concat(F.lit(before), joined, F.lit(after)).alias("text"))


def write(df: DataFrame, path: str, target: str, order: list[str], compression: str | None = None) -> None:
    """The rows as text files in path, part files in order; nothing is brought together.

    Line formats only: what stands before and after all rows is left to `document`."""
    if target not in ("csv", "tsv", "ndjson"):
        raise ValueError(f"{target} is one document; use document()")
    each = lines(df, target, order)
    ranged = each.repartitionByRange(*[f"__o{i}" for i in range(len(order))]).sortWithinPartitions(*[f"__o{i}" for i in range(len(order))])
    ranged.select("line").write.option("compression", compression or "none").text(path)


def database_bundle(tables: dict[str, DataFrame], orders: dict[str, list[str]]) -> DataFrame:
    """One JSON document {table: [rows]}, indented, tables by name."""
    parts = None
    for name in sorted(tables):
        order = orders[name]
        fields = _own(tables[name], [c for c in order if c.startswith("__")])
        rows = tables[name].select(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], json_block(fields, 2).alias("line"))
        listed = F.array_sort(F.collect_list(F.struct(*(f"__o{i}" for i in range(len(order))), "line")))
        body = F.when(F.size(listed) == 0, "[]").otherwise(F.concat(F.lit("[\n"), F.array_join(F.transform(listed, lambda x: x["line"]), ",\n"), F.lit("\n  ]")))
        one = rows.agg(F.concat(F.lit("  "), json_string(F.lit(name)), F.lit(": "), body).alias("t")).select(F.lit(name).alias("name"), "t")
        parts = one if parts is None else parts.unionByName(one)
    return parts.agg(F.concat(F.lit("{\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "t"))), lambda x: x["t"]), ",\n"), F.lit("\n}")).alias("text"))
