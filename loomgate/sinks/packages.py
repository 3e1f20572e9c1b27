"""Binary targets: TAR, ZIP, GZ archives, and XLSX, DOCX and PPTX packages.

An archive is one file, so its entries meet in one task; they are grouped by archive and
written in order. Packages of rows are written one for each group. All of these hold a whole file in a task, so
groups must have a bounded size; tables of any size go to line formats (sinks.rows.write)."""

from __future__ import annotations

import gzip
import io
import re
import tarfile
import zipfile
from collections.abc import Iterator
from html import escape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgate.sources.archives import clean_name, unique

FORMATS = ("zip", "tar", "tgz", "gz")


def pack(target: str, entries: list[tuple[str, bytes]]) -> bytes:
    """An archive of entries: names made clean and unique, times fixed so that equal entries give equal bytes."""
    if not entries:
        raise ValueError("The archive has no entries")
    used: set[str] = set()
    named = [(unique(clean_name(n), used), c) for n, c in entries]
    out = io.BytesIO()
    if target == "gz":
        if len(named) != 1:
            raise ValueError("GZIP output requires an archive containing one file")
        return gzip.compress(named[0][1], mtime=0)
    if target == "zip":
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED, compresslevel=6) as z:
            for n, c in named:
                z.writestr(zipfile.ZipInfo(n), c, zipfile.ZIP_DEFLATED)
        return out.getvalue()
    for n, c in named:
        head = tarfile.TarInfo(n)
        head.size, head.mode = len(c), 0o644
        out.write(head.tobuf(tarfile.USTAR_FORMAT))
        out.write(c + bytes(-len(c) % 512))
    out.write(bytes(1024))
    return out.getvalue() if target == "tar" else gzip.compress(out.getvalue(), mtime=0)


def archives(entries: DataFrame, target: str, keys: list[str] = ["path"]) -> DataFrame:
    """entries (keys, ord, name, content) -> keys, content: an archive for each group."""
    if target not in FORMATS:
        raise ValueError(f"Unsupported archive target: {target}")
    kinds = {f.name: f.dataType.simpleString() for f in entries.schema}

    def one(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("ord")
        return pd.DataFrame({**{k: [ordered[k].iloc[0]] for k in keys}, "content": [pack(target, [(n, bytes(c or b"")) for n, c in zip(ordered["name"], ordered["content"], strict=True)])]})

    return entries.select(*keys, "ord", "name", "content").groupBy(*keys).applyInPandas(one, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "content binary"]))


def _zip(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(zipfile.ZipInfo(name), '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>' + text, zipfile.ZIP_DEFLATED)
    return out.getvalue()


#: Namespaces of office packages.
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _frame(main: str, main_type: str, parts: dict[str, str], links: list[tuple[str, str]], overrides: dict[str, str]) -> bytes:
    """A package: content types, the link to the main part, and the main part's links to others."""
    types = "".join(f'<Override PartName="/{n}" ContentType="application/vnd.openxmlformats-officedocument.{t}+xml"/>' for n, t in {main: main_type, **overrides}.items())
    related = "".join(f'<Relationship Id="rId{i}" Type="{_OFFICE}/{kind}" Target="{target}"/>' for i, (kind, target) in enumerate(links, 1))
    folder, _, name = main.rpartition("/")
    return _zip({
        "[Content_Types].xml": f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{types}</Types>',
        "_rels/.rels": f'<Relationships xmlns="{_PACKAGE}/relationships"><Relationship Id="rId1" Type="{_OFFICE}/officeDocument" Target="{main}"/></Relationships>',
        **({f"{folder}/_rels/{name}.rels": f'<Relationships xmlns="{_PACKAGE}/relationships">{related}</Relationships>'} if links else {}),
        **parts,
    })


def _bare(text: object) -> str:
    return escape(re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", str(text)))


def workbook(sheets: list[tuple[str, list[str], Iterator[tuple]]]) -> bytes:
    """An XLSX of (name, header, rows); numbers and booleans stay so, all else is text; sheet names unique, 31 characters."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    used: set[str] = set()
    names, parts = [], {}

    def cell(v: object) -> str:
        if v is None or v != v:
            return "<c/>"
        if isinstance(v, bool):
            return f'<c t="b"><v>{int(v)}</v></c>'
        return f"<c><v>{v}</v></c>" if isinstance(v, (int, float)) else f'<c t="inlineStr"><is><t xml:space="preserve">{_bare(v)}</t></is></c>'

    for i, (name, header, rows) in enumerate(sheets, 1):
        stem = (re.sub(r"[\\/*?:\[\]]", "-", name) or "Data")[:31]
        label, n = stem, 2
        while label.lower() in used:
            label, n = f"{stem[:27]}-{n}", n + 1
        used.add(label.lower())
        names.append(label)
        body = "".join("<row>" + "".join(map(cell, r)) + "</row>" for r in (header, *rows))
        parts[f"xl/worksheets/sheet{i}.xml"] = f'<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>'
    listed = "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1))
    parts["xl/workbook.xml"] = f'<workbook xmlns="{main}" xmlns:r="{_OFFICE}"><sheets>{listed}</sheets></workbook>'
    return _frame("xl/workbook.xml", "spreadsheetml.sheet.main", parts, [("worksheet", f"worksheets/sheet{i}.xml") for i in range(1, len(names) + 1)], {f"xl/worksheets/sheet{i}.xml": "spreadsheetml.worksheet" for i in range(1, len(names) + 1)})


def workbooks(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """keys, content: an XLSX for each group, sheet `Data`, rows in order."""
    fields = [c for c in df.columns if c not in keys]
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def one(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(order)
        rows = ([None if pd.isna(v) else v.item() if hasattr(v, "item") else v for v in r] for r in ordered[fields].itertuples(index=False))
        return pd.DataFrame({**{k: [ordered[k].iloc[0]] for k in keys}, "content": [workbook([("Data", fields, rows)])]})

    return df.groupBy(*keys).applyInPandas(one, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "content binary"]))


def word_document(text: str) -> bytes:
    """A DOCX of text lines: # headings, - bullets, paragraphs."""
    main = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"

    def paragraph(line: str) -> str:
        heading, bullet = re.match(r"(#{1,6})\s+(.*)", line), re.match(r"[-*]\s+(.*)", line)
        style = f'<w:pPr><w:pStyle w:val="Heading{len(heading[1])}"/></w:pPr>' if heading else ""
        said = heading[2] if heading else f"• {bullet[1]}" if bullet else line
        return f'<w:p>{style}<w:r><w:t xml:space="preserve">{_bare(said)}</w:t></w:r></w:p>' if said.strip() else "<w:p/>"

    body = "".join(map(paragraph, text.split("\n")))
    return _frame("word/document.xml", "wordprocessingml.document.main", {"word/document.xml": f'<w:document xmlns:w="{main}"><w:body>{body}</w:body></w:document>'}, [], {})


def word_documents(text: Column) -> Column:
    @F.pandas_udf("binary")
    def made(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: word_document(t or ""))

    return made(text)


def slide_package(slides: list[dict[str, str]]) -> bytes:
    """A PPTX of slides with title and body. The places and sizes of the boxes and of the slide are fixed values."""
    p, a = "http://schemas.openxmlformats.org/presentationml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/main"
    parts = {}
    for i, s in enumerate(slides, 1):
        boxes = "".join(
            f'<p:sp><p:nvSpPr><p:cNvPr id="{k + 2}" name="{name}"/><p:cNvSpPr/><p:nvPr/></p:nvSpPr><p:spPr><a:xfrm><a:off x="609600" y="{y}"/><a:ext cx="10972800" cy="{h}"/></a:xfrm><a:prstGeom prst="rect"/></p:spPr><p:txBody><a:bodyPr wrap="square"/>'
            + "".join(f"<a:p><a:r><a:t>{_bare(line)}</a:t></a:r></a:p>" for line in s[name].split("\n")) + "</p:txBody></p:sp>"
            for k, (name, y, h) in enumerate((("title", 381000, 914400), ("body", 1447800, 5029200))) if s[name]
        )
        parts[f"ppt/slides/slide{i}.xml"] = f'<p:sld xmlns:p="{p}" xmlns:a="{a}"><p:cSld><p:spTree><p:nvGrpSpPr><p:cNvPr id="1" name=""/><p:cNvGrpSpPr/><p:nvPr/></p:nvGrpSpPr><p:grpSpPr/>{boxes}</p:spTree></p:cSld></p:sld>'
    ids = "".join(f'<p:sldId id="{255 + i}" r:id="rId{i}"/>' for i in range(1, len(slides) + 1))
    parts["ppt/presentation.xml"] = f'<p:presentation xmlns:p="{p}" xmlns:r="{_OFFICE}"><p:sldIdLst>{ids}</p:sldIdLst><p:sldSz cx="12192000" cy="6858000"/></p:presentation>'
    return _frame("ppt/presentation.xml", "presentationml.presentation.main", parts, [("slide", f"slides/slide{i}.xml") for i in range(1, len(slides) + 1)], {f"ppt/slides/slide{i}.xml": "presentationml.slide" for i in range(1, len(slides) + 1)})


def slide_packages(slides: Column) -> Column:
    """PPTX bytes of an array<struct<title, body>>."""

    @F.pandas_udf("binary")
    def made(all_slides: pd.Series) -> pd.Series:
        return all_slides.map(lambda s: slide_package([dict(x) for x in s]))

    return made(slides)
