"""Books in Palm databases: header fields, metadata, text, index tables and sections, as columns and joins over records.

A book is its records, rows of some kilobytes. Header fields lie at fixed places, the title and the metadata at places that
the header tells. Text records lose their trailing entries, whose lengths are written backwards, and are unpacked one by one (the only step in Python).
From there on a book is a line of bytes: each record has a start and an end, and everything else is a stretch of that line.

- Older books are cut into sections at page-break tags, and get anchors where links point to byte places. Records that end inside a tag are
  glued to the next first, so no tag is missed at a record's end.
- Newer books have skeletons and fragments in index tables. A fragment is inserted in its skeleton at a place that counts what was inserted before
  it; prefix sums of the inserted lengths turn these into cuts of the skeleton, so that a section is an ordered list of stretches,
  which are joined with the records that hold them. Skeletons without fragments are no sections.

Defined results: a file that isn't such a database has no rows; a first record without the mark MOBI, an unknown compression, an index record without its mark, and a
metadata header that doesn't fit its length are errors; bytes that aren't valid in the book's character set become U+FFFD.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgate.operators import lookups, ordered, ranges
from loomgate.operators.ranges import materialise
from loomgate.sources.palm import metadata_records, number, records, unpacked

#: Header fields by place and size.
FIELDS = {
    "codec": (0, 2), "n_texts": (8, 2), "size": (20, 4), "charset": (28, 4), "version": (36, 4), "title_at": (84, 4), "title_size": (88, 4),
    "flags": (128, 4), "trailing": (240, 4), "fragments": (248, 4), "skeletons": (252, 4),
}
NONE = 0xFFFFFFFF
#: What bytes 0x80 to 0x9F are in the older character set, where they are anything.
_OLDER = {0x80: "€", 0x82: "‚", 0x83: "ƒ", 0x84: "„", 0x85: "…", 0x86: "†", 0x87: "‡", 0x88: "ˆ", 0x89: "‰", 0x8A: "Š", 0x8B: "‹", 0x8C: "Œ", 0x8E: "Ž", 0x91: "‘", 0x92: "’", 0x93: "“", 0x94: "”", 0x95: "•", 0x96: "–", 0x97: "—", 0x98: "˜", 0x99: "™", 0x9A: "š", 0x9B: "›", 0x9C: "œ", 0x9E: "ž", 0x9F: "Ÿ"}
_BREAK_TAG = r"<\s*(?:mbp:)?pagebreak[^>]*>"
_LINK = r"""(?i)<[^<>]+filepos=['"]?(\d+)[^<>]*>"""


def bytes_as_text(data: Column) -> Column:
    """A character for each byte."""
    return F.decode(data, "ISO-8859-1")


def decoded(data: Column, charset: Column) -> Column:
    older = F.translate(bytes_as_text(data), "".join(map(chr, _OLDER)), "".join(_OLDER.values()))
    return F.when(charset == 65001, F.make_valid_utf8(data.cast("string"))).otherwise(older)


def _fields(each: DataFrame, keys: list[str], start: Column) -> DataFrame:
    """Records with the mark of a header -> keys, start, the fields, the metadata records and the book's title and author."""
    wide = each.select(*keys, start.alias("start"), "data", *[number(F.col("data"), at, n).alias(name) for name, (at, n) in FIELDS.items()])
    header = F.when(F.col("flags").bitwiseAND(64) != 0, F.expr("substring(data, CAST(size + 17 AS INT))"))
    wide = wide.withColumn("meta", F.coalesce(F.when(header.isNotNull(), metadata_records(header)), F.array().cast("array<struct<type:bigint,data:binary>>")))
    texts = lambda kind: F.transform(F.filter("meta", lambda m: m["type"] == kind), lambda m: decoded(m["data"], F.col("charset")))
    own_title = decoded(F.expr("substring(data, CAST(title_at + 1 AS INT), CAST(title_size AS INT))"), F.col("charset"))
    title = F.coalesce(F.nullif(F.get(F.reverse(texts(503)), F.lit(0)), F.lit("")), own_title)
    return wide.select(*keys, "start", *FIELDS, "meta", F.trim(title).alias("title"), F.array_join(F.filter(F.transform(texts(100), lambda a: F.trim(a)), lambda a: a != ""), ", ").alias("author"))


def headers(each: DataFrame, keys: list[str]) -> DataFrame:
    """records (keys, place, data) -> a row for each book: keys, start (the place of its header), FIELDS, meta, title, author.

    A file may hold an older and a newer form of one book; the metadata of the first then tells where the second begins, which is taken if it is there."""
    marked = F.substring("data", 17, 4) == F.lit(bytearray(b"MOBI"))
    checked = materialise(each.where("place = 0"), "firsts").withColumn("data", F.when(marked, F.col("data")).otherwise(F.raise_error(F.lit("Missing header of a book")).cast("binary")))
    first = _fields(checked, keys, F.lit(0).cast("long"))
    boundary = F.transform(F.filter("meta", lambda m: m["type"] == 121), lambda m: number(m["data"], 0, 4))
    newer = first.where("version < 8").select(*keys, F.get(F.reverse(boundary), F.lit(0)).alias("place")).where(F.col("place") < NONE)
    second = _fields(each.where(marked).join(newer, [*keys, "place"], "left_semi"), keys, F.col("place").cast("long"))
    return materialise(first.join(second.select(*keys), keys, "left_anti").unionByName(second), "headers")


def _from_end(data: Column) -> Column:
    """The number of variable length at the end of data: of its last four bytes, seven bits of each from the last one with its high bit set."""
    last = F.least(F.length(data), F.lit(4))
    byte = lambda i: number(data, F.length(data) - last + i - 1, 1)
    return F.when(last > 0, F.aggregate(F.sequence(F.lit(1), last), F.lit(0).cast("long"), lambda v, i: F.when(byte(i) >= 128, F.lit(0)).otherwise(v) * 128 + byte(i) % 128)).otherwise(F.lit(0).cast("long"))


def _without_end(data: Column, n: Column) -> Column:
    return F.substring(data, F.lit(1), F.greatest(F.lit(0), (F.length(data) - n).cast("int")))


def without_trailing(data: Column, flags: Column) -> Column:
    """A text record without its trailing entries: one for each bit of flags but the lowest, and the rest of a character if that is set."""
    entries = F.bit_count(F.shiftrightunsigned(flags, 1))
    cut = F.when(entries > 0, F.aggregate(F.sequence(F.lit(1), entries), data, lambda d, _: _without_end(d, _from_end(d)))).otherwise(data)
    return F.when(flags.bitwiseAND(1) != 0, _without_end(cut, number(cut, F.length(cut) - 1, 1) % 4 + 1)).otherwise(cut)


def raw_texts(each: DataFrame, heads: DataFrame, keys: list[str]) -> DataFrame:
    """keys, version, charset (of the book), place (from 0), raw, n: the text of each record as bytes, and their number. Written."""

    known = heads.select(*keys, "version", "charset", F.col("start").alias("head"), "n_texts", "codec", F.coalesce("trailing", F.lit(0)).alias("trailing"))
    own = each.join(known, keys).withColumn("place", F.col("place") - F.col("head") - 1).where("place >= 0 AND place < n_texts")
    keys = [*keys, "version", "charset"]
    packed = own.select(*keys, "place", "codec", without_trailing(F.col("data"), F.col("trailing")).alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            plain = []
            for data, codec in zip(b.column("data").to_pylist(), b.column("codec").to_pylist(), strict=True):
                if codec not in (1, 2):
                    raise ValueError(f"Unsupported compression: {codec}")
                plain.append(unpacked(data) if codec == 2 else data)
            sizes = [len(x) for x in plain]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), b.column("place"), pa.array(plain, pa.binary()), pa.array(sizes, pa.int64())], names=[*keys, "place", "raw", "n"])

    kinds = {f.name: f.dataType.simpleString() for f in packed.schema}
    raw = packed.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"place {kinds['place']}, raw binary, n long"]))
    return materialise(raw, "raw")


def on_line(raw: DataFrame, keys: list[str]) -> DataFrame:
    """raw_texts -> keys, place, raw, start, end: where each text lies on the book's line."""
    return ordered.running_offsets(raw.select(*keys, "place", "raw", "n"), keys, ["place"], "n").drop("n")


def _joined(pieces: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, text: the pieces (text) of each group in order."""
    return ordered.joined_text(pieces, keys, "text", order, "")


def page_sections(texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, section (from 0), text (a character for each byte): older books, cut at page breaks, with anchors where links point.

    A section begins with its page break, which is left out of the text; the first begins with the book."""
    as_text = texts.select(*keys, "start", bytes_as_text(F.col("raw")).alias("text"))
    opens, closes = (F.length(F.substring_index("text", c, -1)) for c in "<>")  # what stands behind the last of them
    has = F.col("text").contains("<") | F.col("text").contains(">")
    lined = ordered.carried(as_text, keys, ["start"], F.when(has, opens < closes), "in_tag")
    glued = ordered.islands(lined, keys, ["start"], lambda before: ~F.coalesce(before["in_tag"], F.lit(False)), ["in_tag"], "chunk")
    chunks = glued.groupBy(*keys, "chunk").agg(F.min("start").alias("start"), F.array_sort(F.collect_list(F.struct("start", "text"))).alias("parts"))
    chunks = materialise(chunks.select(*keys, "start", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text")), "chunks")

    cut = F.split(F.col("text"), f"(?i)(?={_BREAK_TAG})")
    pieces = chunks.select(*keys, "start", F.posexplode(cut).alias("i", "text")).where("text <> ''").withColumn("n", F.length("text").cast("long"))
    placed = ordered.running_offsets(pieces.withColumnRenamed("start", "of"), keys, ["of", "i"], "n").drop("n")
    new = F.regexp_like("text", F.lit(f"(?i)^{_BREAK_TAG}"))
    numbered = ranges.sums_to_here(ranges.ranged(placed, keys, ["start"]), keys, {"section": new.cast("long")}).drop(ranges.PART, ranges.AT)
    numbered = materialise(numbered.select(*keys, "section", "start", "end", "text"), "pieces")

    links = chunks.select(*keys, "start", F.posexplode(F.regexp_extract_all("text", F.lit(_LINK), 1)).alias("i", "digits")).groupBy(*keys, "digits").agg(F.min(F.struct("start", "i")).alias("first"))
    points = links.select(*[F.col(k).alias(f"__{k}") for k in keys], "digits", "first", F.expr("try_cast(digits AS BIGINT)").alias("point")).where("point IS NOT NULL")
    near = F.col(f"__{keys[0]}").eqNullSafe(F.col(keys[0]))
    for k in keys[1:]:
        near = near & F.col(f"__{k}").eqNullSafe(F.col(k))
    hit = lookups.in_range(points, "point", numbered.drop("text"), "start", "end", 1 << 16).where(near)
    anchors = hit.groupBy(*keys, "section", "start").agg(F.array_sort(F.collect_list(F.struct("point", "first", "digits"))).alias("anchors"))
    # pieces meet their anchors where their sections are put together, so that texts are shuffled once for both
    none = lambda df, c: F.lit(None).cast(df.schema[c].dataType).alias(c)
    both = numbered.select(*keys, "section", "start", "text", none(anchors, "anchors")).unionByName(anchors.select(*keys, "section", "start", none(numbered, "text"), "anchors"))
    wide = both.repartition(*keys, "section").groupBy(*keys, "section", "start").agg(F.first("text", ignorenulls=True).alias("text"), F.first("anchors", ignorenulls=True).alias("anchors"))
    at = lambda i: (F.get("anchors", i)["point"] - F.col("start")).cast("int")
    until = lambda i: F.coalesce(at(i), F.length("text"))
    inserted = F.transform("anchors", lambda a, i: F.concat(F.lit('<a id="filepos'), a["digits"], F.lit('"></a>'), F.substring(F.col("text"), at(i) + 1, until(i + 1) - at(i))))
    text = F.when(F.col("anchors").isNull(), F.col("text")).otherwise(F.concat(F.substring(F.col("text"), F.lit(1), at(F.lit(0))), F.array_join(inserted, "")))
    return _joined(wide.withColumn("text", F.regexp_replace(text, f"(?i){_BREAK_TAG}", "")), [*keys, "section"], ["start"])


def index_entries(each: DataFrame, mains: DataFrame, keys: list[str]) -> DataFrame:
    """mains (keys, at: the place of an index's main record) -> keys, idx, name, tags (array<struct<tag, values>>): its entries in order.

    An entry has a name and control bytes. The tag table says for each tag which bits of which control byte count its values; where all of
    several bits are set, the number of bytes that its values take is written instead. All numbers are of variable length."""
    magic = lambda mark: F.substring("data", 1, 4) == F.lit(bytearray(mark))
    need = lambda holds, x, what: F.when(holds, x).otherwise(F.raise_error(F.lit(what)).cast("binary"))
    # written before they are checked: what Spark infers from a check may be tried on records that aren't these
    main = materialise(each.withColumnRenamed("place", "at").join(mains, [*keys, "at"]), "main").withColumn("data", need(magic(b"INDX"), F.col("data"), "Invalid index record"))
    data, table = F.col("data"), F.col("tagx")
    main = main.select(*keys, "at", number(data, 24, 4).alias("n_records"), F.expr("substring(data, CAST(conv(hex(substring(data, 5, 4)), 16, 10) AS INT) + 1)").alias("tagx"))
    rows = F.when(number(table, 4, 4) > 12, F.transform(F.sequence(F.lit(0).cast("long"), ((number(table, 4, 4) - 12) / 4 - 1).cast("long")), lambda i: F.transform(F.array(*map(F.lit, range(4))), lambda j: number(table, i * 4 + 12 + j, 1))))
    main = main.select(*keys, "at", "n_records", F.when(F.substring(table, 1, 4) == F.lit(bytearray(b"TAGX")), number(table, 8, 4)).otherwise(F.raise_error(F.lit("Invalid tag table")).cast("long")).alias("n_control"), F.coalesce(rows, F.array().cast("array<array<bigint>>")).alias("table"))
    main = materialise(main, "tags")
    held = materialise(each.join(main, keys).where("place > at AND place <= at + n_records"), "index").withColumn("data", need(magic(b"INDX"), F.col("data"), "Invalid index record"))
    at = number(data, 20, 4)
    count = number(data, 24, 4)
    starts = F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), count - 1), lambda j: number(data, at + 4 + j * 2, 2)))
    cut = F.transform("starts", lambda s, i: F.substring(data, (s + 1).cast("int"), (F.coalesce(F.get("starts", i + 1), at) - s).cast("int")))
    each_entry = held.withColumn("starts", starts).select(*keys, "at", "place", "n_control", "table", F.posexplode(cut).alias("j", "entry"))
    numbered = ordered.numbered(each_entry, [*keys, "at"], ["place", "j"], "idx").withColumn("idx", F.col("idx") - 1)
    size = number(F.col("entry"), 0, 1)
    body = numbered.select(*keys, "at", "idx", "n_control", "table", F.expr("decode(substring(entry, 2, CAST(conv(hex(substring(entry, 1, 1)), 16, 10) AS INT)), 'UTF-8')").alias("name"), F.substring(F.col("entry"), (size + 2).cast("int"), F.length("entry")).alias("body"))
    return body.select(*keys, "at", "idx", "name", entry_tags(F.col("body"), F.col("table"), F.col("n_control")).alias("tags"))


def entry_tags(body: Column, table: Column, n_control: Column) -> Column:
    """array<struct<tag, values>> of the control bytes and numbers behind an entry's name; table: rows of tag, numbers to a value, mask, end."""
    texts = F.regexp_extract_all(F.hex(F.substring(body, (n_control + 1).cast("int"), F.length(body))), F.lit("(?:[0-7][0-9A-F]){0,3}[89A-F][0-9A-F]|(?:[0-7][0-9A-F]){4}|(?:[0-7][0-9A-F]){1,3}$"), 0)
    value = lambda h: F.aggregate(F.sequence(F.lit(1), F.length(h), F.lit(2)), F.lit(0).cast("long"), lambda v, i: v * 128 + F.conv(F.substring(h, i, F.lit(2)), 16, 10).cast("long") % 128)
    numbers = F.transform(texts, lambda h: F.struct(value(h).alias("value"), (F.length(h) / 2).cast("int").alias("size")))
    bits = lambda mask: F.bit_count(mask)
    shift = lambda mask: F.bit_count(mask.bitwiseAND(-mask) - 1)

    planned = "array<struct<tag:bigint,count:bigint,bytes:bigint>>"

    def plan(s: Column, row: Column) -> Column:
        tag, per, mask, end = (F.get(row, F.lit(i)) for i in range(4))
        held = number(body, s["control"], 1).bitwiseAND(mask)
        by_size = (held == mask) & (bits(mask) > 1)
        own = F.struct(tag.alias("tag"), F.when(~by_size, F.call_function("shiftright", held, shift(mask).cast("int")) * per).alias("count"), F.when(by_size, F.get(s["numbers"], s["k"])["value"]).alias("bytes"))
        ends = end.bitwiseAND(1) != 0
        return F.struct((s["control"] + F.when(ends, 1).otherwise(0)).alias("control"), (s["k"] + F.when(~ends & by_size, 1).otherwise(0)).cast("int").alias("k"), F.when(ends, s["out"]).otherwise(F.concat(s["out"], F.array(own))).alias("out"), s["numbers"].alias("numbers"))

    start = F.struct(F.lit(0).cast("long").alias("control"), F.lit(0).alias("k"), F.array().cast(planned).alias("out"), numbers.alias("numbers"))

    def take(s: Column, own: Column) -> Column:
        rest = F.slice(s["numbers"], s["k"] + 1, F.greatest(F.lit(0), F.size(s["numbers"]) - s["k"]))
        before = lambda i: F.aggregate(F.slice(rest, F.lit(1), i), F.lit(0), lambda t, x: t + x["size"])
        n = F.coalesce(own["count"], F.size(F.filter(rest, lambda x, i: before(i) < own["bytes"])).cast("long")).cast("int")
        return F.struct((s["k"] + n).cast("int").alias("k"), F.concat(s["out"], F.array(F.struct(own["tag"].alias("tag"), F.transform(F.slice(rest, F.lit(1), n), lambda x: x["value"]).alias("values")))).alias("out"), s["numbers"].alias("numbers"))

    def read(done: Column) -> Column:
        zero = F.struct(done["k"].alias("k"), F.array().cast("array<struct<tag:bigint,values:array<bigint>>>").alias("out"), done["numbers"].alias("numbers"))
        return F.aggregate(done["out"], zero, take, lambda s: s["out"])

    return read(F.aggregate(table, start, plan))


def tag_value(tag: int, place: int = 0) -> Column:
    """A value of an entry's tag; of a tag that stands twice the last counts."""
    return F.get(F.get(F.reverse(F.filter("tags", lambda t: t["tag"] == tag)), F.lit(0))["values"], F.lit(place))


def spliced(skeletons: DataFrame, fragments: DataFrame, keys: list[str]) -> DataFrame:
    """skeletons (keys, skel, n_fragments, offset, length) and fragments (keys, frag, insert_at, start, length), both numbered in order ->
    keys, section, piece, start, end: the stretches of the book's bytes that make up each section, in order.

    Each skeleton takes the next n_fragments fragments; those without are left out. A fragment lies behind the skeleton at its start; it is inserted at a place of the book
    that counts what was inserted in the skeleton before it."""
    taken = lookups.dealt_by_count(skeletons, "skel", "n_fragments", fragments.withColumnsRenamed({"length": "size", "start": "at"}), "frag", keys)
    placed = ordered.running_offsets(taken, [*keys, "skel"], ["frag"], "size")  # start: the lengths inserted before
    wide = placed.withColumn("cut", F.greatest(F.lit(0), F.least(F.col("insert_at") - F.col("offset") - F.col("start"), F.col("length")))).drop("start", "end")
    wide = ordered.with_neighbours(wide, [*keys, "skel"], "frag", "cut")
    odd = F.coalesce(F.col("before") > F.col("cut"), F.lit(False)) | (F.col("insert_at") < F.col("offset"))
    wide = wide.withColumn("before", F.coalesce("before", F.lit(0)))
    wide = materialise(wide.withColumn("odd", odd), "splices")
    inside = wide.where("odd").select(*keys, "skel").distinct()  # fragments that aren't in the order of their places
    plain = wide.join(inside, [*keys, "skel"], "left_anti")
    stretch = lambda start, end: F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"))
    base, behind = F.col("offset"), F.col("offset") + F.col("length")
    parts = F.array(stretch(base + F.col("before"), base + F.col("cut")), stretch(behind + F.col("at"), behind + F.col("at") + F.col("size")), F.when(F.col("next").isNull(), stretch(base + F.col("cut"), behind)))
    cut = plain.select(*keys, F.col("skel").alias("section"), "frag", F.posexplode(parts).alias("i", "s")).where("s IS NOT NULL")
    cut = cut.select(*keys, "section", (F.col("frag") * 3 + F.col("i")).alias("piece"), "s.start", "s.end")

    def one(group: pd.DataFrame) -> pd.DataFrame:
        """A skeleton into whose inserted text more is inserted: stretches in order, cut where a fragment comes."""
        group = group.sort_values("frag")
        r = group.iloc[0]
        line = [(r["offset"], r["offset"] + r["length"])]
        for f in group.to_dict("records"):
            to, at, out = f["insert_at"] - r["offset"], 0, []
            to = max(0, to) if to >= 0 else max(0, sum(e - s for s, e in line) + to)  # a negative place counts from the end
            own = (r["offset"] + r["length"] + f["at"], r["offset"] + r["length"] + f["at"] + f["size"])
            for s, e in line:
                if own is not None and at + e - s >= to:
                    out += [(s, s + to - at), own, (s + to - at, e)]
                    own = None
                else:
                    out.append((s, e))
                at += e - s
            line = out + ([own] if own else [])
        return pd.DataFrame([{**{k: r[k] for k in keys}, "section": r["skel"], "piece": i, "start": s, "end": e} for i, (s, e) in enumerate(line)])

    kinds = {f.name: f.dataType.simpleString() for f in wide.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), f"section {kinds['skel']}", "piece long", "start long", "end long"])
    nested = wide.join(inside, [*keys, "skel"], "left_semi").groupBy(*keys, "skel").applyInPandas(one, schema)
    return cut.withColumn("piece", F.col("piece").cast("long")).unionByName(nested).where("end > start")


def stretches(spans: DataFrame, texts: DataFrame, keys: list[str], width: int = 1 << 16) -> DataFrame:
    """spans (keys, section, piece, start, end) of books -> keys, section, text (a character for each byte), from the records that hold them."""
    held = texts.select(*keys, F.col("start").alias("t0"), F.col("end").alias("t1"), "raw")
    met = lookups.overlapping(spans, ("start", "end"), held, ("t0", "t1"), keys, width)
    low, high = F.greatest("start", "t0"), F.least("end", "t1")
    part = bytes_as_text(F.substring(F.col("raw"), (low - F.col("t0") + 1).cast("int"), (high - low).cast("int")))
    return _joined(met.select(*keys, "section", "piece", low.alias("low"), part.alias("text")), [*keys, "section"], ["piece", "low"])


def skeleton_sections(each: DataFrame, heads: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, charset, section, text of newer books."""
    mains = lambda field: heads.where(F.col(field) < NONE).select(*keys, (F.col("start") + F.col(field)).alias("at"))
    skeletons = index_entries(each, mains("skeletons"), keys).select(*keys, F.col("idx").alias("skel"), tag_value(1).alias("n_fragments"), tag_value(6).alias("offset"), tag_value(6, 1).alias("length"))
    fragments = index_entries(each, mains("fragments"), keys).select(*keys, F.col("idx").alias("frag"), F.regexp_extract("name", r"^\s*([+-]?\d+)", 1).cast("long").alias("insert_at"), tag_value(6).alias("start"), tag_value(6, 1).alias("length"))
    spans = spliced(materialise(skeletons, "skeletons"), materialise(fragments, "fragments"), keys)
    return stretches(spans.join(heads.select(*keys, "charset"), keys), texts, [*keys, "charset"])


def sections(books: DataFrame, content: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, title, author) and (keys, section, text) of books: their heads and their sections in the book's character set."""
    each = materialise(records(books, content, keys), "records")
    heads = headers(each, keys)
    raw, own = raw_texts(each, heads, keys), [*keys, "charset"]  # a book's character set goes with its keys, so that nothing is joined for it
    old, new = (on_line(raw.where(w), own) for w in ("version < 8", "version >= 8"))
    newer = materialise(heads.where("version >= 8"), "newer")  # its size is known, so that few such books don't have all records shuffled
    found = page_sections(old, own).unionByName(skeleton_sections(each, newer, new, keys))
    text = decoded(F.encode("text", "ISO-8859-1"), F.col("charset"))
    return heads.select(*keys, "title", "author"), found.select(*keys, "section", text.alias("text"))
