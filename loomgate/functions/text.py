"""Text functions on columns: names, escapes, classification. All stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as ECMAScript's \s has it, as the inside of a character class.
SPACE = r"\t\n\x0B\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
BOM = "﻿"


def trim(x: Column) -> Column:
    return F.regexp_replace(x, f"^[{SPACE}]+|[{SPACE}]+$", "")


def or_default(x: Column, default: str) -> Column:
    """x, or default where x is null or empty."""
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def extension(name: Column) -> Column:
    """Lower-case letters and digits after the last dot at the end of the name, else empty."""
    return F.regexp_extract(F.lower(trim(name)), r"\.([a-z0-9]+)$", 1)


def base_name(name: Column) -> Column:
    return or_default(F.regexp_replace(name, r"\.[^.]+$", ""), "converted-file")


def _clean(x: Column, size: int, default: str) -> Column:
    """As a run of blanks becomes one, and one at the start none, so many characters and runs of blanks from the start decide the result, however long x is."""
    blank = rf"[{SPACE}&&[^\x00-\x1f]]"
    decisive = F.regexp_extract(x, rf"^{blank}*+(?:[\s\S&&[^{SPACE}]]|[\x00-\x1f]|{blank}++){{0,{size + 1}}}+", 0)
    dashed = F.regexp_replace(decisive, r'[\\/:*?"<>|\x00-\x1f]', "-")
    return or_default(F.substring(trim(F.regexp_replace(dashed, f"[{SPACE}]+", " ")), 1, size), default)


def safe_name(name: Column) -> Column:
    """The base name without characters that file systems refuse, at most 120 characters."""
    return _clean(base_name(name), 120, "converted-file")


def safe_table_name(name: Column) -> Column:
    return _clean(name, 80, "table")


def output_name(name: Column, target: Column, suffix: str = "") -> Column:
    return F.concat(safe_name(name), F.lit(f"{suffix}."), target)


def _replace_all(x: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        x = F.replace(x, F.lit(old), F.lit(new))
    return x


def escape_html(x: Column) -> Column:
    """Null becomes the word null, as a string conversion makes it."""
    return _replace_all(F.coalesce(x, F.lit("null")), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")))


def escape_xml_text(x: Column) -> Column:
    return _replace_all(F.coalesce(x, F.lit("")), (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")))


def clean_xml(x: Column) -> Column:
    """Without the control characters that XML 1.0 forbids."""
    return F.regexp_replace(F.coalesce(x, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def escape_xml(x: Column) -> Column:
    return _replace_all(escape_xml_text(clean_xml(x)), (("'", "&apos;"),))


#: The document around converted content.
_HEAD = '<!doctype html>\n<html lang="en"><head><meta charset="utf-8"><meta name="viewport" content="width=device-width,initial-scale=1"><title>'


def html_document(content: Column, title: Column) -> Column:
    return F.concat(F.lit(_HEAD), escape_html(title), F.lit("</title></head><body>"), content, F.lit("</body></html>"))


def strip_bom(x: Column) -> Column:
    return F.regexp_replace(x, "^﻿", "")


def add_bom(x: Column) -> Column:
    return F.concat(F.lit(BOM), x)


def strip_quotes(x: Column) -> Column:
    """Without one leading and one trailing quote, of either kind."""
    return F.regexp_replace(F.regexp_replace(x, r"""^["']""", ""), r"""["']$""", "")


def json_string(x: Column) -> Column:
    """x as a JSON string; null stays null."""
    listed = F.to_json(F.array(x))
    return F.when(x.isNotNull(), F.substr(listed, F.lit(2), F.length(listed) - 2))


def ini_value(x: Column) -> Column:
    return F.when(x.isNull(), "").when(x.rlike(r"[\n;#=]"), json_string(x)).otherwise(x)


def line_class(line: Column) -> Column:
    """blank, heading, bullet or paragraph."""
    return F.when(trim(line) == "", "blank").when(line.rlike(f"^#{{1,6}}[{SPACE}]"), "heading").when(line.rlike(f"^[-*][{SPACE}]+"), "bullet").otherwise("paragraph")


def tidy(x: Column) -> Column:
    """Plain text after HTML was taken away: no-break spaces, blanks at line ends, runs of blank lines, outer blanks."""
    x = F.regexp_replace(x, r"\x{a0}", " ")
    return trim(F.regexp_replace(F.regexp_replace(x, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n"))


def human_bytes(n: Column) -> Column:
    """B, KB, MB or GB of 1024; one decimal below 10 unless bytes; less than one byte is `0 B`."""
    step = F.when(n < 1024, 0).when(n < 1024**2, 1).when(n < 1024**3, 2).otherwise(3)
    value = n / F.element_at(F.array(*(F.lit(float(1024**k)) for k in range(4))), step + 1)
    tenths = F.floor(value * 10 + 0.5)
    shown = F.when((value >= 10) | (step == 0), F.floor(value + 0.5).cast("string")).otherwise(F.concat((tenths / 10).cast("long").cast("string"), F.lit("."), (tenths % 10).cast("string")))
    return F.when(n < 1, "0 B").otherwise(F.concat(shown, F.lit(" "), F.element_at(F.array(*map(F.lit, ("B", "KB", "MB", "GB"))), step + 1)))


def shorten(x: Column, size: int = 40) -> Column:
    return F.when(F.length(x) > size, F.concat(F.substring(x, 1, size - 3), F.lit("..."))).otherwise(x)


def font_family(name: Column) -> Column:
    """Courier New, Arial or Times New Roman if the font's name says so, else the name itself, at last Arial."""
    plain = trim(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), "[\"']", ""), r"^[A-Z]{6}\+", ""))
    named = lambda words: plain.rlike(f"(?i){words}")
    return F.when(named("mono|courier"), "Courier New").when(named("sans|arial|helvetica"), "Arial").when(named("serif|times"), "Times New Roman").otherwise(or_default(plain, "Arial"))


#: What is told about an error, by words in its message; the first that fits.
ERRORS = (
    ("memory|abort|out of bounds|infinity", "Out of memory or aborted"),
    ("codec|encoder|decoder|invalid data", "Unsupported format"),
    ("password|encrypted", "Protected file"),
    ("could not be found|not found", "File not found"),
)


def error_label(message: Column) -> Column:
    label = shorten(message)
    for words, text in reversed(ERRORS):
        label = F.when(message.rlike(f"(?i){words}"), text).otherwise(label)
    return label


def clean_path(path: Column) -> Column:
    """With forward slashes, without empty, `.` and `..` steps."""
    return F.array_join(F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda s: ~s.isin("", ".", "..")), "/")


def split_fields(line: Column, n: int) -> Column:
    """Array of n fields: cut at the first n-1 commas, filled up with empty ones."""
    cut = F.split(line, ",", n)
    return F.concat(cut, F.array_repeat(F.lit(""), n - F.size(cut)))


def base64_line(content: Column) -> Column:
    """Base64 without line ends, whatever the session's setting."""
    return F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))


def data_url(content: Column, mime: str) -> Column:
    return F.concat(F.lit(f"data:{mime};base64,"), base64_line(content))


def blob_text(content: Column) -> Column:
    """Bytes as text: `base64:` and their base64 form."""
    return F.concat(F.lit("base64:"), base64_line(content))


def data_url_parts(url: Column) -> Column:
    """struct mime, content of a data URL in base64; null for anything else."""
    form = r"(?s)^data:([^;,]*);base64,(.*)$"
    return F.when(url.rlike(form), F.struct(F.regexp_extract(url, form, 1).alias("mime"), F.try_to_binary(F.regexp_extract(url, form, 2), F.lit("base64")).alias("content")))


def truthy(values: Column) -> Column:
    """The array without nulls and empty texts."""
    return F.filter(values, lambda x: x.isNotNull() & (x != ""))


def utf16_key(x: Column) -> Column:
    """A sort key: texts by UTF-16 units, which differs from the order of UTF-8 bytes above the basic plane."""
    return F.hex(F.encode(x, "UTF-16BE"))


def numbers_in(text: Column, pattern: str) -> Column:
    """The different numbers that the pattern's group finds, ascending."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: x.cast("long"))))
