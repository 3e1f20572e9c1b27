"""Books written byte by byte: headers, trailing entries, sections, index tables."""

import re
import struct

import pytest
from pyspark.sql import functions as F

from loomgate.plans.convert import convert
from loomgate.sources import books, palm


def varlen(n):
    """Forward: seven bits a byte, the high bit on the last."""
    out = [n & 127 | 128]
    while n := n >> 7:
        out.insert(0, n & 127)
    return bytes(out)


def backward(n):
    """The same, with the high bit on the first."""
    out = [n & 127]
    while n := n >> 7:
        out.insert(0, n & 127)
    return bytes([out[0] | 128, *out[1:]])


def exth(*records):
    body = b"".join(struct.pack(">II", kind, len(data) + 8) + data for kind, data in records)
    return b"EXTH" + struct.pack(">II", len(body) + 12, len(records)) + body


def header(n_texts, codec=1, charset=65001, version=6, title="", metadata=b"", trailing=0, fragments=books.NONE, skeletons=books.NONE):
    h = bytearray(256)
    name = title.encode("utf-8" if charset == 65001 else "cp1252")
    for at, form, value in ((0, ">H", codec), (8, ">H", n_texts), (20, ">I", 240), (28, ">I", charset), (36, ">I", version), (84, ">I", 256 + len(metadata)), (88, ">I", len(name)), (128, ">I", 64 if metadata else 0), (240, ">I", trailing), (248, ">I", fragments), (252, ">I", skeletons)):
        struct.pack_into(form, h, at, value)
    h[16:20] = b"MOBI"
    return bytes(h) + metadata + name


def database(records):
    at = 78 + 8 * len(records) + 2
    table = b""
    for r in records:
        table += struct.pack(">II", at, 0)
        at += len(r)
    return b"t".ljust(60, b"\0") + b"BOOKMOBI" + bytes(8) + struct.pack(">H", len(records)) + table + b"\0\0" + b"".join(records)


def index(tags, entries, per_record=3):
    """Index records of entries (name, control bytes, values): a main one, then the entries."""
    tagx = b"TAGX" + struct.pack(">II", 12 + 4 * len(tags), sum(t[3] for t in tags)) + b"".join(bytes(t) for t in tags)
    rows = []
    for i in range(0, len(entries), per_record):
        body, places = b"", []
        for name, control, values in entries[i : i + per_record]:
            places.append(192 + len(body))
            body += bytes([len(name)]) + name.encode() + bytes(control) + b"".join(map(varlen, values))
        h = bytearray(192)
        h[:4] = b"INDX"
        struct.pack_into(">I", h, 20, 192 + len(body))
        struct.pack_into(">I", h, 24, len(places))
        rows.append(bytes(h) + body + b"IDXT" + b"".join(struct.pack(">H", p) for p in places))
    h = bytearray(192)
    h[:4] = b"INDX"
    struct.pack_into(">I", h, 4, 192)
    struct.pack_into(">I", h, 24, len(rows))
    struct.pack_into(">I", h, 28, 65001)
    return [bytes(h) + tagx, *rows]


def frame(spark, **files):
    return spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "k string, content binary")


def cut(data, n):
    return [data[i : i + n] for i in range(0, len(data), n)]


def read(spark, data):
    heads, found = books.sections(frame(spark, b=data), "content", ["k"])
    return [tuple(r) for r in heads.select("title", "author").collect()], [r["text"] for r in found.orderBy("section").collect()]


def brute_pages(data):
    """Sections of an older book as its bytes are read in one piece."""
    text = data.decode("latin-1")
    starts = [0, *(m.start() for m in re.finditer(r"<\s*(?:mbp:)?pagebreak[^>]*>", text, re.I))]
    points = sorted({(int(d), text.index(d), d) for d in re.findall(r"<[^<>]+filepos=['\"]?(\d+)[^<>]*>", text, re.I)})
    out = []
    for s, e in zip(starts, [*starts[1:], len(text)], strict=True):
        part, last = "", s
        for n, _, d in points:
            if s <= n < e:
                part, last = part + text[last:n] + f'<a id="filepos{d}"></a>', n
        part += text[last:e]
        out.append(re.sub(r"<\s*(?:mbp:)?pagebreak[^>]*>", "", part, flags=re.I).encode("latin-1").decode("utf-8", "replace"))
    return [x for x in out if x]


BOOK = "<html><p>Über alles — 日本</p><a filepos=0000000160 href=x>one</a> <A class='k' FILEPOS=\"200\">two</A><mbp:pagebreak/>" + "<p>second é</p>" * 9 + "< MBP:pagebreak class='a' >" + "third <b>x</b> " * 12 + "<pagebreak></html>"


@pytest.mark.parametrize("size", [7, 4096])
def test_page_sections(spark, size):
    """The same sections wherever records end, inside tags and characters too."""
    data = BOOK.encode()
    heads, found = read(spark, database([header(len(cut(data, size)), title="Böok", metadata=exth((100, "A & B".encode()), (100, b" C "), (503, "Real Title".encode()))), *cut(data, size)]))
    assert heads == [("Real Title", "A & B, C")]
    assert found == brute_pages(data) and len(found) == 4 and 'id="filepos0000000160"' in "".join(found)


def test_trailing_entries_and_older_text(spark):
    parts = [b"caf\xe9 \x80 ", b"end\xff"]
    records = [p + b"\x01zz" + b"payload" + backward(8) + b"more" + backward(5) for p in parts]  # two entries, then three bytes of a character
    records = [p + b"\x02zz"[1:] + b"\x02" + b"payload" + backward(8) + b"more" + backward(5) for p in parts]
    assert read(spark, database([header(2, charset=1252, title="\x80uro".encode("latin-1").decode("cp1252"), trailing=0b111), *records])) == ([("€uro", "")], ["café € endÿ"])


def test_from_end(spark):
    rows = [(bytearray(b"abc" + backward(n)), n) for n in (1, 127, 128, 300, 70000)] + [(bytearray(), 0)]
    assert all(r["v"] == r["n"] for r in spark.createDataFrame(rows, "d binary, n long").select("n", books._from_end(F.col("d")).alias("v")).collect())


TAGS = [(1, 1, 3, 0), (6, 2, 12, 0), (9, 1, 48, 0), (7, 1, 64, 0), (0, 0, 0, 1), (8, 1, 1, 0), (0, 0, 0, 1)]


def test_index_entries(spark):
    """Counts in the control bytes, lengths in bytes where all of several bits are set, values of one to three bytes."""
    entries = [
        ("a", [1 | 4, 1], [7, 300, 20000, 5]),
        ("b", [2 | 8, 0], [1, 2, 3, 4, 5, 6]),
        ("c", [3 | 64, 1], [4, 300, 1, 1, 9, 8]),  # tag 1 takes four bytes: 300 (two), 1 and 1; then 9 for tag 7, 8 for tag 8
        ("", [0, 0], []),
        ("e", [3 | 12, 0], [1, 4, 5, 1, 2, 3, 4]),
    ]
    data = database([b"x", *index(TAGS, entries, 2)])
    each = palm.records(frame(spark, b=data), "content", ["k"])
    found = books.index_entries(each, spark.createDataFrame([("b", 1)], "k string, at long"), ["k"]).orderBy("idx").collect()
    assert [(r["idx"], r["name"]) for r in found] == [(i, e[0]) for i, e in enumerate(entries)]
    tags = [{t["tag"]: list(t["values"]) for t in r["tags"] if t["values"]} for r in found]
    assert tags == [{1: [7], 6: [300, 20000], 8: [5]}, {1: [1, 2], 6: [3, 4, 5, 6]}, {1: [300, 1, 1], 7: [9], 8: [8]}, {}, {1: [5], 6: [1, 2, 3, 4]}]


def brute_splice(skeletons, fragments, data):
    out, done = [], 0
    for n, offset, length in skeletons:
        text, own = data[offset : offset + length], fragments[done : done + n]
        done += n
        for insert_at, start, size in own:
            to = insert_at - offset
            piece = data[offset + length + start : offset + length + start + size]
            text = text[:to] + piece + text[to:]
        if own:
            out.append(text.decode())
    return out


@pytest.mark.parametrize("nested", [False, True])
@pytest.mark.parametrize("size", [5])
def test_skeleton_sections(spark, size, nested):
    """Fragments one behind the other, at several places of a skeleton, inside each other, and a skeleton without any."""
    data = b"<html><body></body></html>" + b"<p>one</p>" + b"<p>two</p>" + b"<i></i><b></b>" + b"xyz" + b"UVWX" + b"<lonely>" + b"<s></s>" + b"0123456789"
    skeletons = [(2, 0, 26), (2, 46, 14), (0, 67, 8), (3, 75, 7)]
    fragments = [(12, 0, 10), (22, 10, 10), (46 + 3, 0, 3), (46 + 3 + 3 + 7, 3, 4), (78, 0, 4), (80 if nested else 82, 4, 3), (78 if nested else 90, 7, 3)]
    tables = index([(1, 1, 1, 0), (6, 2, 2, 0), (0, 0, 0, 1)], [(f"SKEL{i}", [3], [n, o, size_]) for i, (n, o, size_) in enumerate(skeletons)], 2)
    frags = index([(2, 1, 1, 0), (4, 1, 2, 0), (6, 2, 4, 0), (0, 0, 0, 1)], [(f"{at:010d}", [7], [0, i, s, n]) for i, (at, s, n) in enumerate(fragments)], 3)
    texts = cut(data, size)
    first = 1 + len(texts)
    head = header(len(texts), version=8, title="New", skeletons=first, fragments=first + len(tables))
    heads, found = read(spark, database([head, *texts, *tables, *frags]))
    assert heads == [("New", "")] and found == brute_splice(skeletons, fragments, data)
    # the same book behind an older one, whose metadata tell where it begins
    older = [header(1, title="Old", metadata=exth((121, struct.pack(">I", 2)))), b"old text"]
    assert read(spark, database([*older, head, *texts, *tables, *frags])) == ([("New", "")], found)
    lost = [header(1, title="Old", metadata=exth((121, struct.pack(">I", 1)))), b"old text"]
    assert read(spark, database(lost)) == ([("Old", "")], ["old text"])


def test_errors(spark):
    for data, what in (
        (database([b"x" * 300, b"y"]), "Missing header"),
        (database([header(1, codec=17480), b"y"]), "Unsupported compression"),
        (database([header(1, metadata=exth((100, b"a"))[:8] + struct.pack(">I", 4_000_000_000)), b"y"]), "fewer bytes"),
        (database([header(1, metadata=b"EXTH" + struct.pack(">IIII", 28, 1, 100, 3) + bytes(8)), b"y"]), "impossible length"),
        (database([header(1, version=8, skeletons=1, fragments=1), b"y"]), "Invalid index record"),
    ):
        with pytest.raises(Exception, match=what):
            read(spark, data)
    assert read(spark, b"no database") == ([], [])


def test_convert_book(spark, tmp_path):
    body = b"<p>one <script>x</script></p><mbp:pagebreak/><p>two</p>"
    path = tmp_path / "my book.mobi"
    path.write_bytes(database([header(1, metadata=exth((503, b"T <1>"), (100, b"Me & you"))), body]))
    (name, content), = [tuple(r) for r in convert(spark, str(path), "html").collect()]
    html = bytes(content).decode()
    assert name == "my book.html" and "<title>T &lt;1&gt;</title>" in html
    assert "<header><h1>T &lt;1&gt;</h1><p>Me &amp; you</p></header>" in html and "script" not in html
    assert re.search(r"<section>\s*<p>one\s*</p>\s*</section><section>\s*<p>two</p>\s*</section>", html)
    (_, text), = [tuple(r) for r in convert(spark, str(path), "txt").collect()]
    assert "T <1>" in bytes(text).decode() and "two" in bytes(text).decode()
