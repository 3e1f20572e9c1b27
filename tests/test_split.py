"""Files that many tasks read: quoted line ends, JSON documents, first and last bytes, records of one width, TAR by pointers."""

import csv
import io
import json
import random
import struct
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgate.plans import registry
from loomgate.plans.convert import convert_rows
from loomgate.sources import fixed, peek, sheets, split, split_json, structured

rng = random.Random(11)


@pytest.fixture(params=[40, 1 << 27])
def cut(spark, request):
    """Blocks of so many bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    yield request.param
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


# CSV -------------------------------------------------------------------------------------------------------------
def cells(n):
    parts = ["a", "é", '"', ",", "\n", "\r\n", " ", "x" * 9, "1"]
    return [["".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) or "z" for _ in range(3)] for _ in range(n)]


def written(rows, path, end="\n", bom=""):
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end, quoting=csv.QUOTE_ALL).writerows(rows)
    path.write_text(bom + out.getvalue(), encoding="utf-8", newline="")


def found(spark, path, **options):
    return [[r[c] for c in ("a", "b", "c")] for r in split.read_quoted(spark, str(path), **options).collect()]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_rows(spark, tmp_path, cut, end):
    """Rows, and their numbers, wherever blocks begin: in quotes, between quotes, at row ends."""
    rows = [["a", "b", "c"], *cells(25)]
    written(rows, tmp_path / "x.csv", end, "﻿")
    texts = split.quoted_rows(spark, str(tmp_path)).orderBy("row").collect()
    assert [r["row"] for r in texts] == list(range(26))
    assert [next(csv.reader(io.StringIO(r["value"], newline=""))) for r in texts] == rows
    assert sorted(map(str, found(spark, tmp_path, infer=False))) == sorted(map(str, rows[1:]))
    if cut == 40:
        assert split.blocks(spark, str(tmp_path), "\n").select(split.BLOCK).distinct().count() > 5


def test_quoted_as_spark_reads(spark, tmp_path, cut):
    """The same types and rows as Spark's reader of whole files."""
    (tmp_path / "x.csv").write_text('id,name,"full ""x""",id\n1,"a\nb",2.5,9\n2,,"3",\n\n3,"last, ""one""",-1,8')
    ours, theirs = split.read_quoted(spark, str(tmp_path)), spark.read.csv(str(tmp_path), header=True, inferSchema=True, escape='"', multiLine=True)
    assert [f.dataType for f in ours.schema] == [f.dataType for f in theirs.schema] and ours.columns == theirs.columns
    assert sorted(map(tuple, ours.collect()), key=str) == sorted(map(tuple, theirs.collect()), key=str)


def test_quoted_several_files(spark, tmp_path, cut):
    rows = {n: [["a", "b", "c"], *cells(n)] for n in (3, 12, 5)}
    for n, r in rows.items():
        written(r, tmp_path / f"{n}.csv")
    (tmp_path / "empty.csv").write_text("")
    assert sorted(map(str, found(spark, tmp_path, infer=False))) == sorted(str(x) for r in rows.values() for x in r[1:])


def test_converted_rows(spark, tmp_path, cut):
    """Rows of large files to rows, in order."""
    rows = [["a", "b", "c"], *cells(25)]
    written(rows, tmp_path / "x.csv")
    convert_rows(spark, str(tmp_path / "x.csv"), "ndjson", str(tmp_path / "out"))
    lines = [json.loads(x) for part in sorted((tmp_path / "out").glob("part-*")) for x in part.read_text().splitlines()]
    assert [[str(v) for v in x.values()] for x in lines] == rows[1:]
    (tmp_path / "x.json").write_text(json.dumps({"n": 1, "rows": [{"a": i, "b": {"c": "x,]"}} for i in range(30)]}))
    convert_rows(spark, str(tmp_path / "x.json"), "csv", str(tmp_path / "more"))
    lines = [x for part in sorted((tmp_path / "more").glob("part-*")) for x in part.read_text().splitlines()]
    assert lines == [f'{i},"x,]"' for i in range(30)]


def test_quoted_odd(spark, tmp_path, cut):
    (tmp_path / "x.csv").write_text('a,b\n1,"open\nquote, and more\n')
    assert [r["value"] for r in split.quoted_rows(spark, str(tmp_path)).orderBy("row").collect()] == ["a,b", '1,"open\nquote, and more']
    (tmp_path / "x.csv").write_text("")
    assert split.quoted_rows(spark, str(tmp_path)).count() == 0 and split.read_quoted(spark, str(tmp_path)).count() == 0


def test_other_blocks_are_an_error(spark, tmp_path):
    """Blocks that change between passes fail instead of giving other rows."""
    written([["a", "b", "c"], *cells(30)], tmp_path / "x.csv")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 60)
    try:
        rows = split.quoted_rows(spark, str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", 90)
        with pytest.raises(Exception, match="other blocks"):
            rows.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


# JSON ------------------------------------------------------------------------------------------------------------
MARKS = 'a"\\{}[],: \né'


def value(depth=0):
    kind = rng.randrange(7 if depth < 3 else 4)
    if kind < 2:
        return "".join(rng.choice(MARKS) for _ in range(rng.randint(0, 8)))
    if kind < 4:
        return rng.choice([1, -2.5, True, None])
    if kind < 6:
        return {f"{rng.choice(MARKS)}{i}": value(depth + 1) for i in range(rng.randint(0, 3))}
    return [value(depth + 1) for _ in range(rng.randint(0, 3))]


def records(doc, depth=0):
    """The first array without members but objects and arrays, at most five objects deep."""
    if isinstance(doc, list):
        return doc if all(isinstance(x, (dict, list)) for x in doc) else None
    if isinstance(doc, dict) and depth <= 5:
        for x in doc.values():
            if isinstance(x, (dict, list)) and depth < 5 and (got := records(x, depth + 1)) is not None:
                return got
    return None


DOCS = [
    [{"a": i, "b": value()} for i in range(12)],
    {"meta": {"n": 1, "tags": [1, 2, {}]}, "items": [{"a": value()} for _ in range(9)], "more": [{"no": 1}]},
    {"x": {"y": {"z": {"w": {"v": [{"deep": 1}]}}}}},
    {"x": {"y": {"z": {"w": {"v": {"u": [{"too": "deep"}]}}}}}, "s": "t"},
    {"none": [], "items": [{"not": "taken"}]},
    [1, 2, [3], "x,y"],
    [[1, 2], {"a": [{"b": "]"}]}, []],
    {"only": "an object", "with": {"list": [1, "a"]}},
    {"k": [None, {}], "l": [{}, {}]},
    [],
]


@pytest.mark.parametrize("indent", [None, 1])
def test_json_records(spark, tmp_path, cut, indent):
    for i, doc in enumerate(DOCS):
        (tmp_path / f"{i}.json").write_text(json.dumps(doc, ensure_ascii=i % 2 == 0, indent=indent), encoding="utf-8")
    rows = split_json.record_rows(spark, str(tmp_path)).collect()
    for i, doc in enumerate(DOCS):
        mine = sorted((r for r in rows if r[split.FILE].endswith(f"/{i}.json")), key=lambda r: r["ord"])
        own = [(r["ord"], json.loads(r["row"])) for r in mine]
        got = records(doc)
        wanted = got if got is not None else doc if isinstance(doc, list) else [doc]
        assert own == list(enumerate(wanted)), doc


def test_json_as_the_whole_reader(spark, tmp_path, cut):
    """The rows of structured.row_texts, which holds a document in one row."""
    docs = [{"m": [value()], "rows": [{"v": value(), "w": value()} for _ in range(rng.randint(1, 8))]} for _ in range(3)]
    for i, doc in enumerate(docs):
        (tmp_path / f"{i}.json").write_text(json.dumps(doc))
    whole = structured.row_texts(spark.read.text(str(tmp_path), wholetext=True).select(F.col("_metadata.file_path").alias(split.FILE), "value"), "value", "json", [split.FILE])
    plain = lambda rows: sorted((r[split.FILE], r["ord"], json.dumps(json.loads(r["row"]), sort_keys=True)) for r in rows.collect())
    assert plain(split_json.record_rows(spark, str(tmp_path))) == plain(whole)


@pytest.mark.parametrize("text", ['[{"a": 1}', '[{"a": "x]', "[1]]"])
def test_json_broken(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="ends inside|isn't open"):
        split_json.record_rows(spark, str(tmp_path)).collect()


def test_lexed():
    """Places outside strings, with escapes, from both states."""
    for text in ('{"a\\"]": [1, {"b": "\\\\"}], "c": "\\\\\\""}', 'x"]", [{'):
        for inside in (0, 1):
            want, quoted, i = [], bool(inside), 0
            while i < len(text):
                if quoted and text[i] == "\\":
                    i += 2
                    continue
                if text[i] == '"':
                    quoted = not quoted
                elif not quoted and text[i] in "{}[],":
                    want.append(i)
                i += 1
            places, kinds, depths, end = split_json.lexed(text.encode(), inside)
            if "\\" not in text or not inside:
                assert places.tolist() == want and end == quoted
                assert depths.tolist() == np.cumsum([{"{": 1, "[": 1, "}": -1, "]": -1}.get(text[p], 0) for p in want]).tolist()


# first and last bytes --------------------------------------------------------------------------------------------
def package(*names, stored=None, size=10):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if stored:
            z.writestr("mimetype", stored, zipfile.ZIP_STORED)
        for n in names:
            z.writestr(n, rng.randbytes(size))
    return out.getvalue()


def test_identified_files(spark, tmp_path):
    """Only files whose names tell nothing are opened, and of those no more is read than asked for."""
    (tmp_path / "sub").mkdir()
    files = {
        "a.CSV": b"x,y", "b": package("word/document.xml"), "sub/c": package("xl/workbook.xml", size=5 << 20), "d.unknown": package("ppt/presentation.xml"), "e": package("other"),
        "f": package(stored="application/vnd.oasis.opendocument.text"), "g": package(stored="application/vnd.oasis.opendocument.spreadsheet"), "h": b"PK", "i": b"", "j": b"no package at all", "k.docx": b"not opened", ".hidden": b"x", "_skipped": b"x",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    rows = {r["name"]: r for r in registry.identified_files(spark, str(tmp_path)).collect()}
    assert {n: (r["ext"], r["kind"]) for n, r in rows.items()} == {
        "a.CSV": ("csv", "data"), "b": ("docx", "document"), "c": ("xlsx", "data"), "d.unknown": ("pptx", "document"), "e": ("", ""), "f": ("odt", "document"), "g": ("ods", "data"),
        "h": ("", ""), "i": ("", ""), "j": ("", ""), "k.docx": ("docx", "document"),
    }
    read = {n: r["bytes_read"] for n, r in rows.items()}
    assert read["a.CSV"] == read["k.docx"] == read["i"] == 0 and read["j"] == 2
    assert read["c"] == 2 + peek.HEAD + peek.TAIL < rows["c"]["size"]


def test_peek_columns_and_filters(spark, tmp_path):
    for i in range(5):
        (tmp_path / f"{i}.bin").write_bytes(bytes([i]) * (100 * i))
    assert peek.read(spark, str(tmp_path), ["name", "size"]).columns == ["name", "size"]
    some = peek.read(spark, str(tmp_path), head=10, tail=20).where("size >= 200 AND name <> '3.bin' AND NOT name LIKE '4%'")
    assert [(r["name"], bytes(r["first"]), len(r["last"]), r["bytes_read"]) for r in some.collect()] == [("2.bin", b"\2" * 10, 20, 30)]
    (tmp_path / "none").mkdir()
    assert peek.read(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="[Nn]o such|not exist|found"):
        peek.read(spark, str(tmp_path / "lost")).count()


# records of one width --------------------------------------------------------------------------------------------
def test_fixed(spark, tmp_path):
    path = tmp_path / "x"
    path.write_bytes(b"head" + b"".join(struct.pack(">I", i) for i in range(1000)) + b"zz")
    df = fixed.read(spark, str(path), 4, start=4, partbytes=40)
    assert df.rdd.getNumPartitions() == 100
    assert [(r["row"], int.from_bytes(r["data"])) for r in df.orderBy("row").collect()] == [(i, i) for i in range(1000)]
    some = df.where("row >= 10 AND row < 15")
    assert some.rdd.getNumPartitions() == 1 and [int.from_bytes(r["data"]) for r in some.collect()] == [10, 11, 12, 13, 14]
    assert df.where("row = 999").count() == 1 and df.where("row > 2000").count() == 0
    assert fixed.read(spark, str(path), 4, start=4, count=7).count() == 7 and fixed.read(spark, str(path), 4, start=1 << 20).count() == 0


def dbf(rows):
    fields = [("NAME", "C", 8), ("N", "N", 6), ("OK", "L", 1), ("DAY", "D", 8)]
    width = 1 + sum(f[2] for f in fields)
    head = struct.pack("<BBBBIHH20x", 3, 24, 1, 1, len(rows), 32 + 32 * len(fields) + 1, width)
    for name, kind, size in fields:
        head += name.encode().ljust(11, b"\0") + kind.encode() + bytes(4) + bytes([size]) + bytes(15)
    return head + b"\r" + b"".join(mark + b"".join(str(v).encode("latin-1").ljust(f[2]) if f[1] == "C" else str(v).encode().rjust(f[2]) for v, f in zip(row, fields, strict=True)) for mark, *row in rows) + b"\x1a"


def test_dbf(spark, tmp_path):
    """As the reader of whole files has it, from many partitions."""
    rows = [(rng.choice([b" ", b" ", b"*"]), rng.choice(["é", "name", "", " a b"]), rng.choice([i, -i, ""]), rng.choice("TFyn? "), rng.choice(["20240131", "", "2024"])) for i in range(200)]
    path = tmp_path / "x.dbf"
    path.write_bytes(dbf(rows))
    df = fixed.read_dbf(spark, str(path), partbytes=100)
    head, *wanted = list(sheets.READERS["dbf"](dbf(rows)))
    assert df.columns == ["row", *head] and df.rdd.getNumPartitions() > 40
    assert [list(r)[1:] for r in df.orderBy("row").collect()] == wanted


# TAR -------------------------------------------------------------------------------------------------------------
def archive(entries, form=tarfile.USTAR_FORMAT):
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=form) as t:
        for name, data in entries:
            info = tarfile.TarInfo(name)
            if data is None:
                info.type = tarfile.DIRTYPE
                t.addfile(info)
            else:
                info.size = len(data)
                t.addfile(info, io.BytesIO(data))
    return out.getvalue()


def unpacked(spark, path, **options):
    files, blocks = fixed.tar_blocks(spark, str(path), **options)
    parts = {}
    for r in blocks.orderBy("ord", "part").collect():
        parts[r["ord"]] = parts.get(r["ord"], b"") + bytes(r["data"])
    rows = files.orderBy("ord").collect()
    assert all(len(parts.get(r["ord"], b"")) == r["size"] for r in rows)
    return [(r["name"], parts.get(r["ord"], b"")) for r in rows]


@pytest.mark.parametrize("form", [tarfile.USTAR_FORMAT, tarfile.GNU_FORMAT, tarfile.PAX_FORMAT])
def test_tar(spark, tmp_path, form):
    """Entries in order, a TAR inside the TAR among them, names longer than their field, empty and whole-block entries."""
    inner = archive([("in/side", b"x" * 700), ("other", b"")])
    entries = [("a.txt", b"hello"), ("dir/", None), ("dir/" + "n" * 90 + "/" + "m" * 60, b"long"), ("inner.tar", inner), ("empty", b""), ("whole", b"w" * 1024), ("é", b"utf")]
    entries += [(f"many/{i}", rng.randbytes(rng.randint(0, 1500))) for i in range(60)]
    path = tmp_path / "x.tar"
    path.write_bytes(archive(entries, form))
    assert unpacked(spark, path, partbytes=4096) == [(n, d) for n, d in entries if d is not None]


def test_tar_odd(spark, tmp_path):
    for data in (b"", bytes(1024), b"no archive " * 200):
        (tmp_path / "x.tar").write_bytes(data)
        assert unpacked(spark, tmp_path / "x.tar") == []


def test_tar_rows(spark, tmp_path):
    """Blocks as rows, one behind the other, are a file that others read."""
    entries = [(f"d{i}/" + "n" * rng.choice([3, 95, 98]), rng.randbytes(rng.choice([0, 1, 512, 1300, 4096]))) for i in range(25)] + [("p" * 60 + "/" + "q" * 60 + "/" + "r" * 80, b"prefix")]
    sizes = spark.createDataFrame([(i, n, len(d)) for i, (n, d) in enumerate(entries)], "ord long, name string, size long").repartition(3)
    parts = [(i, k, bytearray(d[at : at + 1024])) for i, (_, d) in enumerate(entries) for k, at in enumerate(range(0, len(d), 1024))]
    rows = fixed.tar_rows(sizes, spark.createDataFrame(parts, "ord long, part long, data binary"))
    data = b"".join(bytes(r["data"]) for r in rows.orderBy("row").collect())
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        assert [(e.name, t.extractfile(e).read()) for e in t] == entries
    (tmp_path / "x.tar").write_bytes(data)
    assert unpacked(spark, tmp_path / "x.tar") == entries
    none = fixed.tar_rows(sizes.where("false"), spark.createDataFrame([], "ord long, part long, data binary"))
    assert b"".join(bytes(r["data"]) for r in none.collect()) == bytes(1024)
    with pytest.raises(Exception, match="too long"):
        fixed.tar_rows(spark.createDataFrame([(0, "x" * 200, 0)], "ord long, name string, size long"), spark.createDataFrame([], "ord long, part long, data binary")).collect()
