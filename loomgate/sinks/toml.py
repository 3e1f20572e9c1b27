"""Nested values as TOML, by column expressions made from the schema.

A struct or a map becomes a table, an array of them an array of tables, anything else a value behind its key. Values of a table stand before
its tables, so that each is read into the right one. A table has a heading only if it has values or is empty. Inside arrays of other
values structs and maps are inline tables.

Defined results: nulls are left out, or empty texts with nulls="empty"; a null in an array or an inline table is an error unless it is such a text; not a number and the infinities are nan, inf and -inf;
whole doubles have no fraction while they are exact, beyond that they have one; an empty array is [], an empty struct or map a heading or {}.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, MapType, StructType, TimestampNTZType, TimestampType

from loomgate.functions.numbers import js_number
from loomgate.functions.text import blob_text, json_string
from loomgate.functions.times import iso_utc

#: Whole numbers up to here are exact as doubles.
_EXACT = float(2**53 - 1)


def _quoted(text: Column) -> Column:
    return F.replace(json_string(text), F.lit("\x7f"), F.lit("\\u007f"))


def key(name: Column) -> Column:
    return F.when(name.rlike("^[A-Za-z0-9_-]+$"), name).otherwise(_quoted(name))


def _is_table(kind: DataType) -> bool:
    return isinstance(kind, (StructType, MapType))


def _is_tables(kind: DataType) -> bool:
    return isinstance(kind, ArrayType) and _is_table(kind.elementType)


def _members(c: Column, kind: StructType | MapType) -> list[tuple[Column, Column, DataType]]:
    return [(F.lit(f.name), c.getField(f.name), f.dataType) for f in kind]


class Writer:
    def __init__(self, nulls: str = "skip"):
        self.empty = nulls == "empty"

    def _held(self, text: Column, value: Column) -> Column:
        """The text, or what stands for a null where one can't be left out."""
        lost = F.lit('""') if self.empty else F.raise_error(F.lit("TOML has no null inside arrays and inline tables")).cast("string")
        return F.when(value.isNull(), lost).otherwise(text)

    def value(self, c: Column, kind: DataType) -> Column:
        if isinstance(kind, (DoubleType, FloatType)):
            d = c.cast("double")
            special = F.when(F.isnan(d), "nan").when(d == float("inf"), "inf").when(d == float("-inf"), "-inf")
            large = (F.abs(d) > _EXACT) & (F.abs(d) < 1e21) & (d == F.floor(d).cast("double"))
            return F.coalesce(special, F.when(large, d.cast("decimal(38,1)").cast("string")), js_number(d))
        if isinstance(kind, (TimestampType, TimestampNTZType)):
            return iso_utc(c)
        if isinstance(kind, BinaryType):
            return _quoted(blob_text(c))
        if isinstance(kind, ArrayType):
            each = F.transform(c, lambda x: self._held(self.value(x, kind.elementType), x))
            return F.when(F.size(c) == 0, "[]").otherwise(F.concat(F.lit("[ "), F.array_join(each, ", "), F.lit(" ]")))
        if isinstance(kind, StructType):
            pairs = [F.concat(key(n), F.lit(" = "), self._held(self.value(x, k), x)) for n, x, k in _members(c, kind)]
            return F.concat(F.lit("{ "), F.concat_ws(", ", *pairs), F.lit(" }")) if pairs else F.lit("{}")
        if isinstance(kind, MapType):
            pairs = F.transform(F.map_entries(c), lambda e: F.concat(key(e["key"].cast("string")), F.lit(" = "), self._held(self.value(e["value"], kind.valueType), e["value"])))
            return F.when(F.size(c) == 0, "{}").otherwise(F.concat(F.lit("{ "), F.array_join(pairs, ", "), F.lit(" }")))
        if isinstance(kind, (BooleanType, DecimalType, DateType)) or kind.typeName() in ("byte", "short", "integer", "long"):
            return c.cast("string")
        return _quoted(c.cast("string"))

    def _line(self, name: Column, c: Column, kind: DataType) -> Column:
        """The line of a member that is a value; empty if it is left out."""
        text = F.concat(key(name), F.lit(" = "), self.value(c, kind), F.lit("\n"))
        lost = F.concat(key(name), F.lit(' = ""\n')) if self.empty else F.lit("")
        line = F.when(c.isNull(), lost).otherwise(text)
        if _is_tables(kind):
            return F.when(c.isNull(), lost).when(F.size(c) == 0, F.concat(key(name), F.lit(" = []\n"))).otherwise("")
        return F.when(c.isNull(), lost).otherwise("") if _is_table(kind) else line

    def _tables(self, name: Column, c: Column, kind: DataType, prefix: Column | None) -> Column:
        """The tables of a member, null if it has none."""
        path = key(name) if prefix is None else F.concat(prefix, F.lit("."), key(name))
        if _is_table(kind):
            return F.when(c.isNotNull(), self.table(c, kind, path, True))
        each = F.transform(c, lambda x: F.concat(F.lit("[["), path, F.lit("]]\n"), self.table(x, kind.elementType, path, False)))
        return F.when(F.size(c) > 0, F.array_join(each, "\n"))

    def table(self, c: Column, kind: StructType | MapType, path: Column | None, heading: bool) -> Column:
        """The text of a table, without its heading unless asked for."""
        if isinstance(kind, MapType):
            entries = F.map_entries(c)
            values = F.array_join(F.transform(entries, lambda e: self._line(e["key"].cast("string"), e["value"], kind.valueType)), "")
            nested = F.transform(entries, lambda e: self._tables(e["key"].cast("string"), e["value"], kind.valueType, path)) if _is_table(kind.valueType) or _is_tables(kind.valueType) else F.array().cast("array<string>")
        else:
            members = _members(c, kind)
            values = F.concat(F.lit(""), *[self._line(*m) for m in members])
            nested = F.array(*[self._tables(*m, path) for m in members if _is_table(m[2]) or _is_tables(m[2])]).cast("array<string>")
        tables = F.array_join(nested, "\n")  # nulls are passed over
        if heading:
            head = F.concat(F.lit("["), path, F.lit("]"))
            values = F.when(values != "", F.concat(head, F.lit("\n"), values)).when(tables == "", head).otherwise("")
        return F.concat(values, F.when((values != "") & (tables != ""), "\n").otherwise(""), tables)


def document(c: Column, kind: StructType | MapType, nulls: str = "skip") -> Column:
    """A struct or map as a TOML document, with a line end at its end."""
    text = Writer(nulls).table(c, kind, None, False)
    return F.when(text.endswith("\n"), text).otherwise(F.concat(text, F.lit("\n")))


def row(fields: StructType, prefix: str = "data", nulls: str = "empty") -> Column:
    """The columns of a row as one of an array of tables, without a line end at its end."""
    whole = F.struct(*[F.col(f"`{f.name}`").alias(f.name) for f in fields])
    text = Writer(nulls).table(whole, fields, F.lit(prefix), False)
    return F.concat(F.lit(f"[[{prefix}]]\n"), F.regexp_replace(text, r"\n$", ""))
