"""Small inputs with results worked out by hand, and guards."""

import io
import json
import re
import sqlite3
import struct
import tarfile
import time
import zipfile

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomgate.functions import markup, numbers, text, times
from loomgate.operators import aggregates, lookups, ordered, records
from loomgate.plans import convert, registry
from loomgate.sinks import packages, store
from loomgate.sinks import rows as row_sink
from loomgate.sources import archives, cues, palm, sheets, sqlite, structured


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("doc", "rows"),
    [
        ('[{"a":1,"b":{"c":2,"d":[1,2]}}]', ['{"a":1,"b":{"c":2,"d":[1,2]}}']),
        ('{"meta":{"v":1},"items":[{"x":1},{"x":2}]}', ['{"x":1}', '{"x":2}']),
        ('{"a":1,"b":{"c":2}}', ['{"a":1,"b":{"c":2}}']),
        ('[1,"x",null]', ["1", '"x"', "null"]),
        ("[[1,2],[3]]", ["[1,2]", "[3]"]),
        ('[1,{"a":2}]', ["1", '{"a":2}']),
        ('{"e":[],"items":[{"x":1}]}', []),
        ("7", ["7"]),
        ("7.0", ["7"]),
        ('{"a":{"b":{"c":{"d":{"e":{"f":[{"x":1}]}}}}}}', ['{"a":{"b":{"c":{"d":{"e":{"f":[{"x":1}]}}}}}}']),
        ('{"a":{"b":{"c":{"d":{"e":[{"x":1}]}}}}}', ['{"x":1}']),
        ("{bad", None),
        (None, None),
    ],
)
def test_record_discovery(doc, rows):
    assert records.rows_of(doc) == rows


def test_flatten(spark):
    df = spark.createDataFrame([((1, (2, [1, 2])), None)], "s struct<a:int,b:struct<c:int,d:array<int>>>, e struct<>")
    flat = records.flattened(df)
    assert flat.columns == ["s.a", "s.b.c", "s.b.d"]
    assert list(flat.first()) == [1, 2, "[1,2]"]
    clash = records.flattened(spark.createDataFrame([((1,), 5)], "a struct<b:int>, `a.b` int"))
    assert clash.columns == ["a.b"] and clash.first()[0] == 5
    docs = spark.createDataFrame([({"v": 1}, [{"x": 1}, {"x": 2}])], "meta map<string,int>, items array<struct<x:int>>")
    assert [r["x"] for r in records.rows(docs).collect()] == [1, 2]


def test_names(spark):
    cases = [(text.extension, " A.TXT ", "txt"), (text.extension, "noext", ""), (text.base_name, "a.tar.gz", "a.tar"), (text.base_name, ".gitignore", "converted-file"), (text.safe_name, "a/b:c  d.csv", "a-b-c d"), (text.clean_path, "../b\\c", "b/c")]
    cases += [(text.escape_html, "<a href=\"x\">'&", "&lt;a href=&quot;x&quot;&gt;&#039;&amp;"), (text.font_family, "ABCDEF+Courier-Bold", "Courier New"), (text.font_family, "sans-serif", "Arial"), (text.font_family, "Times", "Times New Roman"), (text.font_family, "", "Arial")]
    for f, given_, wanted in cases:
        assert one(spark, f(F.lit(given_))) == wanted, (f.__name__, given_)
    named = spark.createDataFrame([(i, n) for i, n in enumerate(["a.txt", "a.txt", "a.txt", "b"])], "i int, n string")
    assert [r["unique_name"] for r in ordered.numbered_names(named, [], "n", ["i"]).orderBy("i").collect()] == ["a.txt", "a-2.txt", "a-3.txt", "b"]


def test_times(spark):
    assert one(spark, times.parse_time(F.lit("01:02:03,5"))) == 3723500
    assert one(spark, times.parse_time(F.lit("02:03.045"))) == 123045
    assert one(spark, times.timestamp(F.lit(3723500))) == "01:02:03,500"
    assert one(spark, times.timestamp(F.lit(-5))) == "00:00:00,000"
    assert one(spark, times.ass_timestamp(F.lit(3723505))) == "1:02:03.51"
    with pytest.raises(Exception, match="Invalid subtitle time"):
        one(spark, times.parse_time(F.lit("1:2:3")))


@settings(max_examples=20, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 10**10), min_size=1, max_size=30))
def test_time_round_trip(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v long")
    assert df.where(times.parse_time(times.timestamp(F.col("v"))) != F.col("v")).count() == 0


def test_numbers(spark):
    assert one(spark, numbers.js_number(F.lit(20.0))) == "20"
    assert one(spark, numbers.js_number(F.lit(1.5e8))) == "150000000"
    fit = one(spark, numbers.fit_page(F.lit(100.0), F.lit(50.0), 10.0, 10.0))
    assert (fit["x"], fit["y"], fit["width"], fit["height"]) == (0, 2.5, 10, 5)
    assert one(spark, text.human_bytes(F.lit(1536))) == "1.5 KB" and one(spark, text.human_bytes(F.lit(0))) == "0 B"
    assert one(spark, numbers.from_octal(numbers.octal(F.lit(420), 12))) == 420


def test_cues(spark):
    docs = lambda s: spark.createDataFrame([("f", s)], "file string, t string")
    get = lambda df: [(r["start_ms"], r["end_ms"], r["text"]) for r in df.orderBy("idx").collect()]
    assert get(cues.srt(docs("﻿1\r\n00:00:00,000 --> 00:00:01,000 x\r\na\r\n \r\nno time\n\n2\n00:00:01,000 --> 00:00:02,500\nb\nc\n"), "t", ["file"])) == [(0, 1000, "a"), (1000, 2500, "b\nc")]
    assert get(cues.vtt(docs("WEBVTT\n\n00:01.000 --> 00:02.000 align:start\nx\n\nNOTE y\n00:03.000 --> 00:04.000\n"), "t", ["file"])) == [(1000, 2000, "x"), (3000, 4000, "")]
    ass = "[Script Info]\nDialogue: no\n[Events]\nFormat: Start, End, Text\nDialogue: 0:00:01.00,0:00:02.00,{\\i1}a, b\\Nc\n[Fonts]\nDialogue: 0:00:01.00,0:00:02.00,z"
    assert get(cues.ass(docs(ass), "t", ["file"])) == [(1000, 2000, "a, b\nc")]


def test_markup():
    assert markup.plain("<h1>T</h1><p>a<br>b&nbsp;c</p>") == "T\na\nb c"
    assert markup.sanitise('<p onclick="x">a</p><script>b</script>') == "<p>a</p>"
    assert markup.sanitise('<a href="JavaScript:x" id="i">a</a><meta http-equiv="r">') == '<a id="i">a</a>'
    assert markup.slides("# A\n- x\n# B\ny", "D") == [{"title": "A", "body": "• x"}, {"title": "B", "body": "y"}]
    assert markup.slides("", "D") == [{"title": "D", "body": ""}]
    assert len(markup.slides("t\n" + "x\n" * 30, "D")) == 3
    assert markup.to_markdown("<h2>T</h2><p>a <b>b</b> <i>c</i></p><pre>x\n y</pre>") == "## T\n\na **b** _c_\n\n```\nx\n y\n```"
    assert markup.from_markdown("# T\n\na **b**\n") == "<h1>T</h1>\n<p>a <strong>b</strong></p>\n"
    assert "<script" not in markup.sanitise_svg('<svg onload="x"><script>y</script><a href="http://z">t</a></svg>')
    markup.plain("<div>" * 50_000)


def test_aggregates(spark):
    df = spark.createDataFrame([("g", i, v) for i, v in enumerate([4, 1, 3, 2])], "g string, i int, v int")
    assert aggregates.upper_median(df, ["g"], "v").first()["median"] == 3
    ties = spark.createDataFrame([("g", i, v) for i, v in enumerate("RBRB")], "g string, i int, v string")
    assert aggregates.weighted_mode(ties, ["g"], "v", F.lit(1), "i").first()["mode"] == "R"
    with pytest.raises(Exception, match="size limit"):
        aggregates.size_guard(spark.createDataFrame([(3,)], "n long"), "n", largest=2).collect()
    with pytest.raises(ValueError, match="none"):
        aggregates.not_empty(df.where("false"), "none")


def test_range_join(spark):
    points = spark.createDataFrame([(p,) for p in range(0, 60, 7)], "p long")
    ranges = spark.createDataFrame([(0, 10), (10, 11), (20, 50), (5, 5)], "s long, e long")
    found = {(r["p"], r["s"]) for r in lookups.in_range(points, "p", ranges, "s", "e", 8).collect()}
    assert found == {(p, s) for p in range(0, 60, 7) for s, e in ((0, 10), (10, 11), (20, 50), (5, 5)) if s <= p < e}


def test_overlapping(spark):
    a = [("p", s, s + n) for s, n in ((0, 3), (2, 30), (40, 0), (41, 2), (31, 1))] + [("q", 0, 9)]
    b = [("p", s, s + n) for s, n in ((0, 1), (1, 50), (7, 8), (32, 9))] + [("r", 0, 9)]
    left, right = spark.createDataFrame(a, "k string, s long, e long"), spark.createDataFrame(b, "k string, f long, t long")
    found = [tuple(r) for r in lookups.overlapping(left, ("s", "e"), right, ("f", "t"), ["k"], 8).collect()]
    assert sorted(found) == sorted((k, s, e, f, t) for k, s, e in a for j, f, t in b if k == j and max(s, f) < min(e, t))


def test_rows_to_text(spark):
    df = spark.createDataFrame([(1, 1, None), (2, None, "x=y")], "o int, a int, b string")
    get = lambda target: row_sink.document(df.select("a", "b", F.col("o").alias("__o")), target, ["__o"]).first()["text"]
    assert get("ini") == '[row1]\na=1\nb=\n\n[row2]\na=\nb="x=y"\n'
    assert get("ndjson") == '{"a":1,"b":null}\n{"a":null,"b":"x=y"}\n'
    assert json.loads(get("json")) == [{"a": 1, "b": None}, {"a": None, "b": "x=y"}]
    assert get("csv") == "﻿a,b\n1,\n,x=y"
    assert get("xml") == '<?xml version="1.0" encoding="UTF-8"?>\n<data><row><field name="a">1</field><field name="b"></field></row><row><field name="a"></field><field name="b">x=y</field></row></data>\n'
    assert get("toml") == '[[data]]\na = 1\nb = ""\n\n[[data]]\na = ""\nb = "x=y"\n'


def test_structured(spark, tmp_path):
    get = lambda s, ext: [r["row"] for r in structured.row_texts(spark.createDataFrame([(s,)], "t string"), "t", ext, []).orderBy("ord").collect()]
    ini = '; comment\ntop = 1\n[db.main]\nhost: "h"\nport=07\non=TRUE\nnote=a=b\nbare'
    assert [json.loads(x) for x in get(ini, "ini")] == [{"top": 1, "db": {"main": {"host": "h", "port": 7, "on": True, "note": "a=b"}}}]
    assert [json.loads(x) for x in get('<r><i k="1">t</i><i>u</i></r>', "xml")] == [{"r": {"i": [{"@k": "1", "#text": "t"}, "u"]}}]
    assert get("a: yes\nb: true\nc: 2020-01-02", "yaml") == ['{"a":"yes","b":true,"c":"2020-01-02"}']
    with pytest.raises(Exception, match="Invalid NDJSON on line 2"):
        get('{"a":1}\n\n{bad', "ndjson")
    (tmp_path / "x.toml").write_text('[[r]]\na = 1\n[[r]]\na = 2\nb = ["q"]\n')
    assert {tuple(r) for r in structured.read(spark, str(tmp_path / "x.toml"), "toml").select("a", "b").collect()} == {(1, None), (2, '["q"]')}


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id INTEGER, r REAL, s TEXT, b BLOB, n)")
        db.execute("INSERT INTO t VALUES (9007199254740993, 1.5, 'x', X'DEADBEEF', NULL)")
        db.execute("INSERT INTO t VALUES (2, 2.5, 'y', NULL, 'z')")
        db.execute("CREATE TABLE empty (a INTEGER)")
    found = sqlite.read(spark, path)
    assert list(found) == ["empty", "t"] and found["empty"].columns == ["a"]
    row = records.blobs_as_text(found["t"].where("id > 100")).first()
    assert tuple(row) == (9007199254740993, 1.5, "x", "base64:3q2+7w==", None)
    assert found["t"].where("s = 'y' AND n IS NOT NULL").count() == 1
    empty = str(tmp_path / "none.db")
    sqlite3.connect(empty).execute("VACUUM")
    with pytest.raises(ValueError, match="No readable tables"):
        sqlite.tables(empty)


def test_archives():
    tar = packages.pack("tar", [("a.txt", b"x" * 420)])
    assert len(tar) == 1024 + 1024 and tar[124:136] == b"00000000644\0" and tar[100:108] == b"0000644\0"
    assert tarfile.open(fileobj=io.BytesIO(tar)).extractfile("a.txt").read() == b"x" * 420
    assert zipfile.ZipFile(io.BytesIO(packages.pack("zip", [("a", b"1"), ("a", b"2"), ("../a", b"3")]))).namelist() == ["a", "a-2", "a-3"]
    with pytest.raises(ValueError, match="containing one file"):
        packages.pack("gz", [("a", b"1"), ("b", b"2")])
    assert list(archives.entries_of("x.txt.gz", packages.pack("gz", [("x", b"1")]))) == [("x.txt", b"1")]
    with pytest.raises(ValueError):
        packages.pack("zip", [])


def test_sheets():
    fields = b"".join(struct.pack("<11sc4xB15x", n, t, w) for n, t, w in ((b"N", b"N", 5), (b"D", b"D", 8)))
    dbf = struct.pack("<BBBBIHH20x", 3, 24, 1, 1, 2, 32 + 64 + 1, 1 + 5 + 8) + fields + b"\r" + b"    4220240131" + b"*    120240131"
    assert list(sheets.READERS["dbf"](dbf)) == [["N", "D"], ["42", "2024-01-31"]]
    dif = 'TABLE\n0,1\n"E"\nDATA\n0,0\n""\n-1,0\nBOT\n1,0\n"a"\n0,5\nV\n-1,0\nEOD\n'
    assert list(sheets.READERS["dif"](dif.encode())) == [["a", "5"]]
    assert list(sheets.READERS["sylk"](b'ID;P\nC;Y1;X1;K"a;;b"\nC;X3;K5\nE\n')) == [["a;b", None, "5"]]
    book = packages.workbook([("Data", ["a", "b"], iter([(1, "x<"), (None, True)]))])
    assert list(sheets.READERS["xlsx"](book)) == [["a", "b"], ["1", "x<"], [None, "true"]]


def test_palm(spark):
    packed = b"abcabc"
    head = struct.pack(">HHIHHIIIII", 1, 0, 6, 1, 4096, 0, 0, 0, 0, 65001)
    offsets = [78 + 16 + 2, 78 + 16 + 2 + len(head)]
    data = b"t".ljust(60, b"\0") + b"BOOKMOBI" + bytes(8) + struct.pack(">H", 2) + b"".join(struct.pack(">II", o, 0) for o in offsets) + b"\0\0" + head + packed
    books = spark.createDataFrame([("b", bytearray(data)), ("no", bytearray(b"x"))], "k string, content binary")
    assert [(r["place"], r["text"]) for r in palm.texts(books, "content", ["k"]).collect()] == [(1, "abcabc")]
    assert palm.unpacked(b"abc" + struct.pack(">H", 0x8000 | 3 << 3 | 0)) == b"abcabc"
    with pytest.raises(ValueError):
        palm.unpacked(struct.pack(">H", 0x8000 | 3 << 3))


def test_registry():
    assert registry.KIND["srt"] == "subtitle" and registry.KIND["db"] == "database" and registry.KIND["mobi"] == "ebook"
    assert registry.targets("data", "csv") == ["tsv", "json", "ndjson", "yaml", "xml", "toml", "ini", "xlsx", "ods", "html"]
    assert registry.targets("document", "odt") == ["pdf"] and registry.targets("data", "xlsx")[-1] == "pdf"
    assert registry.default_target(["csv", "json"]) == "json"


def test_convert(spark, tmp_path):
    (tmp_path / "a.csv").write_text('x,y\n1,"p, q"\n2,r\n')
    (tmp_path / "s.srt").write_text("1\n00:00:00,000 --> 00:00:01,000\na\n")
    (tmp_path / "m.md").write_text("# T\n\n- a\n")
    (tmp_path / "bad.json").write_text("{")
    get = lambda name, target: convert.convert(spark, str(tmp_path / name), target).first()
    assert json.loads(get("a.csv", "json")["content"]) == [{"x": 1, "y": "p, q"}, {"x": 2, "y": "r"}]
    assert get("a.csv", "xlsx")["name"] == "a.xlsx"
    assert bytes(get("s.srt", "vtt")["content"]) == b"WEBVTT\n\n00:00:00.000 --> 00:00:01.000\na\n"
    assert b"<h1>T</h1>" in get("m.md", "html")["content"]
    assert zipfile.is_zipfile(io.BytesIO(get("m.md", "pptx")["content"]))
    with pytest.raises(ValueError, match="can't be converted"):
        convert.plan(convert.Request("a.csv", "mp3"))
    with pytest.raises(convert.UnsupportedEngine):
        convert.convert(spark, str(tmp_path / "m.md"), "pdf")
    results = convert.convert_batch(spark, [convert.Request(str(tmp_path / "a.csv"), "ndjson"), convert.Request(str(tmp_path / "bad.json"), "csv")], str(tmp_path / "out")).orderBy("idx").collect()
    assert [r["status"] for r in results] == ["fulfilled", "rejected"]
    stored = results[0]["files"][0]
    assert stored["name"] == "a.ndjson" and open(stored["path"]).read() == '{"x":1,"y":"p, q"}\n{"x":2,"y":"r"}\n' and stored["size"] == 35
    assert store.deleted(str(tmp_path / "out" / "0")) and not store.deleted(str(tmp_path / "out" / "0"))


def test_separated_line_ends(spark, tmp_path):
    """Quoted cells hold line ends, also those that this library writes."""
    (tmp_path / "a.csv").write_text('a,b\n"x\ny",1\n"say ""hi""",2\n')
    rows = [{"a": "x\ny", "b": 1}, {"a": 'say "hi"', "b": 2}]
    assert json.loads(convert.convert(spark, str(tmp_path / "a.csv"), "json").first()["content"]) == rows
    back = convert.convert(spark, str(tmp_path / "a.csv"), "tsv").first()["content"]
    (tmp_path / "b.tsv").write_bytes(back)
    assert json.loads(convert.convert(spark, str(tmp_path / "b.tsv"), "json").first()["content"]) == rows
    convert.convert_rows(spark, str(tmp_path / "a.csv"), "ndjson", str(tmp_path / "rows"))
    assert [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "rows")).collect()] == rows


@pytest.mark.parametrize(
    ("value", "shown"),
    [(0.0, "0"), (-0.0, "0"), (20.0, "20"), (0.1, "0.1"), (1e-6, "0.000001"), (1e-7, "1e-7"), (-1.5e-9, "-1.5e-9"), (1e20, "100000000000000000000"), (1e21, "1e+21"), (1.25e22, "1.25e+22"), (1.2345678901234568e-300, "1.2345678901234568e-300"), (float("nan"), "NaN"), (float("inf"), "Infinity"), (float("-inf"), "-Infinity")],
)
def test_js_number(spark, value, shown):
    df = spark.createDataFrame([(value,)], "x double")
    assert df.select(numbers.js_number(F.col("x")).alias("x")).first()["x"] == shown
    line = row_sink.lines(df, "ndjson", ["x"]).first()["line"]
    assert line == '{"x":%s}' % ("null" if shown in ("NaN", "Infinity", "-Infinity") else shown)


def test_markdown_hard_cases():
    deep = markup.from_markdown(">" * 3000 + " x")
    assert "x" in deep and deep.count("<blockquote>") == 40
    assert "x" in markup.from_markdown("\n".join("  " * i + "- x" for i in range(500)))
    began = time.time()
    markup.from_markdown("*a " * 20_000 + "_b " * 20_000 + "~~c " * 20_000)
    assert time.time() - began < 5
    spans = lambda x: markup.from_markdown(x)[3:-5]
    assert spans("**a** *b* __c__ _d_ ~~e~~ snake_case_name 2 * 3 * 4") == "<strong>a</strong> <em>b</em> <strong>c</strong> <em>d</em> <del>e</del> snake_case_name 2 * 3 * 4"
    assert spans("***a*** **b *c* d** *open **two**") == "<strong><em>a</em></strong> <strong>b <em>c</em> d</strong> *open <strong>two</strong>"
    assert markup.to_markdown("<table><tr><td>a</td><td>b</td></tr></table>").split() == ["a", "b"]


def test_database(spark, tmp_path):
    """One workbook, one page and a file for each table; names are made clean and escaped; empty tables keep their columns."""
    path = str(tmp_path / "d.db")
    with sqlite3.connect(path) as db:
        db.execute('CREATE TABLE "a/b" (x INT, "y<z" TEXT, w BLOB)')
        db.execute("CREATE TABLE empty (k TEXT)")
        db.executemany('INSERT INTO "a/b" VALUES (?, ?, ?)', [(1, "p", b"\x01"), (2**60, None, None)])
    get = lambda target: convert.convert(spark, path, target).collect()
    (book,) = get("xlsx")
    files = spark.createDataFrame([("p", bytes(book["content"]))], "path string, content binary")
    assert book["name"] == "d.xlsx" and [r["cells"] for r in sheets.rows(files, "xlsx").orderBy("ord").collect()] == [["x", "y<z", "w"], ["1", "p", "base64:AQ=="], [str(2**60), None, None]]
    with zipfile.ZipFile(io.BytesIO(book["content"])) as z:
        listed = z.read("xl/workbook.xml").decode()
        assert listed.count("<sheet ") == 2 and 'name="a-b"' in listed and 'name="empty"' in listed
    (page,) = get("html")
    text = bytes(page["content"]).decode()
    assert page["name"] == "d.html" and text.count("<section>") == 2 and "<h2>a/b</h2>" in text and "y&lt;z" in text and "<td>k</td>" in text
    assert sorted(r["name"] for r in get("csv")) == ["d-a-b.csv", "d-empty.csv"]


def test_sqlite_scattered_ids(spark, tmp_path):
    """Row ids far apart make a bounded number of partitions, up to the largest id."""
    path = str(tmp_path / "far.db")
    with sqlite3.connect(path) as db:
        db.execute("CREATE TABLE t (id INTEGER PRIMARY KEY, v TEXT)")
        db.executemany("INSERT INTO t VALUES (?, ?)", [(-5, "a"), (1, "b"), (10**12, "c"), (2**63 - 1, "d")])
    found = sqlite.read(spark, path, "t")["t"]
    assert found.rdd.getNumPartitions() <= sqlite.MAX_PARTITIONS
    assert sorted(r["v"] for r in found.collect()) == ["a", "b", "c", "d"]


def test_first_sheet():
    """The workbook's own order of sheets counts, not the numbers of their files."""
    data = packages.workbook([("one", ["a"], iter([("x",)])), ("two", ["b"], iter([("y",)]))])
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(data)) as z, zipfile.ZipFile(out, "w") as made:
        for n in z.namelist():
            body = z.read(n).decode()
            if n == "xl/workbook.xml":
                first, second = re.findall("<sheet .*?/>", body)
                body = body.replace(first + second, second + first)
            made.writestr(n, body)
    assert list(sheets._xlsx(out.getvalue())) == [["b"], ["y"]]


def test_gap_spaces(spark):
    row = lambda before, after: one(spark, ordered.gap_spaces(F.lit(8.0), F.lit(10.0), F.lit(before), F.lit(after)))
    assert (row("a", "b"), row("a ", "b"), row("a", "\u00a0b")) == ("  ", "", "")


def test_watch(spark, tmp_path):
    from loomgate.streaming.watch import watch

    (tmp_path / "in").mkdir()
    seen = []
    each = lambda df, n: seen.extend(r["path"].rpartition("/")[2] for r in df.collect())
    for name in ("a.txt", "b.txt"):
        (tmp_path / "in" / name).write_text(name)
        watch(spark, str(tmp_path / "in"), str(tmp_path / "state"), each).awaitTermination()
    assert seen == ["a.txt", "b.txt"]


def test_deep_markup():
    """Pages nested far beyond the interpreter's stack."""
    page = "<div>" * 20_000 + "a <b>b</b>" + "</div>" * 20_000
    assert markup.to_markdown(page) == "a **b**" and markup.plain(page) == "a b"
    assert markup.sanitise(page + "<script>x</script>") == page
    assert markup.to_markdown("<ul><li>" * 200 + "x" + "</ul>" * 200).count("-   ") == 200
