"""Conversions: a file or a batch of files to a target format.

A request is checked on the driver (name, kind, allowed targets); reading, shaping and writing are Spark jobs. In a
batch each request has its own job and its own result, failed or not, in the order of the requests; a request
that isn't allowed fails the batch before anything runs."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from html import escape

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgate.functions import markup
from loomgate.functions.text import escape_html, html_document
from loomgate.operators import ordered
from loomgate.operators.ranges import materialise
from loomgate.plans import registry
from loomgate.sinks import cues as cue_sink
from loomgate.sinks import packages
from loomgate.sinks import rows as row_sink
from loomgate.sinks import store
from loomgate.sources import archives, books, sheets, split, split_json, sqlite, structured
from loomgate.sources import cues as cue_source


@dataclass(frozen=True)
class Request:
    path: str
    target: str
    options: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Task:
    request: Request
    name: str
    ext: str
    kind: str


class UnsupportedEngine(ValueError):
    """The route exists, but it needs an image, media, PDF or office engine."""


def plan(request: Request) -> Task:
    """The checked task of a request; an error says what isn't allowed."""
    name = request.path.rstrip("/").rpartition("/")[2]
    found = re.search(r"\.([a-z0-9]+)$", name.strip().lower())
    ext = registry.canonical(found[1]) if found else ""
    kind = registry.KIND.get(ext, "")
    target = request.target.strip().lower()
    if not kind:
        raise ValueError(f"Unsupported file: {name}")
    if target not in registry.targets(kind, ext):
        raise ValueError(f"{ext} can't be converted to {target}")
    return Task(Request(request.path, target, request.options), name, ext, kind)


def read_rows(spark: SparkSession, task: Task) -> DataFrame:
    path, ext = task.request.path, task.ext
    if ext in ("csv", "tsv"):
        return structured.read_separated(spark, path, ext, bool(task.request.options.get("splittable")))
    if ext in sheets.READERS:
        return sheets.read(spark, path, ext)
    if ext in structured.PARSERS or ext in ("json", "ndjson"):
        return structured.read(spark, path, ext)
    raise UnsupportedEngine(f"No reader for {ext}")


def _stem(task: Task) -> str:
    return re.sub(r"\s+", " ", re.sub(r'[\\/:*?"<>|\x00-\x1f]', "-", re.sub(r"\.[^.]+$", "", task.name) or "converted-file")).strip()[:120] or "converted-file"


def _bundle(df: DataFrame, name: str, text: str = "text") -> DataFrame:
    return df.select(F.lit(name).alias("name"), F.col(text).cast("binary").alias("content"))


def _rows(spark: SparkSession, task: Task) -> DataFrame:
    found = read_rows(spark, task).withColumn("__ord", F.monotonically_increasing_id())
    out = f"{_stem(task)}.{task.request.target}"
    if task.request.target == "xlsx":
        return _workbook({"Data": found}, out)
    if task.request.target not in row_sink.FRAMES:
        raise UnsupportedEngine(f"No writer for {task.request.target}")
    doc = row_sink.document(found, task.request.target, ["__ord"])
    if task.request.target == "html":
        doc = doc.withColumn("text", html_document(F.col("text"), F.lit(_stem(task))))
    return _bundle(doc, out)


#: Fixed value: rows of a sheet at most, the header among them.
SHEET_ROWS = 1 << 20


def _workbook(tables: dict[str, DataFrame], out: str) -> DataFrame:
    """name, content: one workbook with a sheet for each table. It is one file, so it is made in one task; more than
    SHEET_ROWS rows in a sheet are an error before that."""
    import pandas as pd

    headers, parts = [], []
    for place, (name, df) in enumerate(tables.items()):
        fields = [f for f in df.schema if f.name != "__ord"]
        headers.append((name, [f.name for f in fields]))
        cells = [F.col(f"`{f.name}`") if f.dataType.typeName() in ("byte", "short", "integer", "long", "double", "boolean", "string") else row_sink.as_text(f) for f in fields]
        row = F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cells)]), {"ignoreNullFields": "false"}) if fields else F.lit("{}")
        parts.append(df.select(F.lit(place).alias("sheet"), "__ord", row.alias("row")))
    both = functools.reduce(DataFrame.unionByName, parts)
    full = both.groupBy("sheet").count().where(F.col("count") >= SHEET_ROWS).first()
    if full is not None:
        raise ValueError(f"{headers[full['sheet']][0]} has {full['count']} rows; a sheet holds {SHEET_ROWS - 1}")
    listed = both.sparkSession.range(1, numPartitions=1).select(F.lit(-1).alias("sheet"), F.lit(0).cast("long").alias("__ord"), F.lit("").alias("row")).unionByName(both)  # a table without rows has a sheet too

    def one(group: pd.DataFrame) -> pd.DataFrame:
        by_sheet = dict(list(group.sort_values("__ord").groupby("sheet")))
        rows = lambda k: (tuple(json.loads(r).values()) for r in by_sheet[k]["row"]) if k in by_sheet else iter(())
        return pd.DataFrame({"name": [out], "content": [packages.workbook([(name, fields, rows(k)) for k, (name, fields) in enumerate(headers)])]})

    return listed.groupBy().applyInPandas(one, "name string, content binary")


def safe_table_name(name: str) -> str:
    """A table's name as part of a file name."""
    return re.sub(r"\s+", " ", re.sub(r'[\\/:*?"<>|\x00-\x1f]', "-", name)).strip()[:80] or "table"


def _database(spark: SparkSession, task: Task) -> DataFrame:
    """JSON: one document; CSV: a file for each table; HTML: one page, a section for each table; XLSX: one workbook."""
    found = sqlite.read(spark, task.request.path)
    ordered = {n: df.withColumn("__ord", F.monotonically_increasing_id()) for n, df in found.items()}
    target, stem = task.request.target, _stem(task)
    if target == "json":
        return _bundle(row_sink.database_bundle(ordered, {n: ["__ord"] for n in ordered}), f"{stem}.json")
    if target == "csv":
        return functools.reduce(DataFrame.unionByName, [_bundle(row_sink.document(df, "csv", ["__ord"]), f"{stem}-{safe_table_name(n)}.csv") for n, df in ordered.items()])
    if target == "html":
        parts = [row_sink.document(df, "html", ["__ord"]).select(F.lit(i).alias("place"), F.concat(F.lit(f"<section><h2>{escape(n)}</h2>"), "text", F.lit("</section>")).alias("t")) for i, (n, df) in enumerate(ordered.items())]
        sections = functools.reduce(DataFrame.unionByName, parts).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "t"))), lambda x: x["t"]), "").alias("text"))
        return _bundle(sections.select(html_document(F.col("text"), F.lit(stem)).alias("text")), f"{stem}.html")
    return _workbook(ordered, f"{stem}.xlsx")


def _subtitle(spark: SparkSession, task: Task) -> DataFrame:
    parse = {"srt": cue_source.srt, "vtt": cue_source.vtt, "ass": cue_source.ass}[task.ext]
    cues = parse(spark.read.text(task.request.path, wholetext=True).withColumn("file", F.lit(task.name)), "value", ["file"])
    if cues.isEmpty():
        raise ValueError("No readable subtitle cues were found")
    return _bundle(cue_sink.document(cues, task.request.target, ["file"], F.lit(_stem(task))), f"{_stem(task)}.{task.request.target}")


def _archive(spark: SparkSession, task: Task) -> DataFrame:
    if task.ext in ("rar", "7z"):
        raise UnsupportedEngine(f"No reader for {task.ext}")
    made = packages.archives(archives.read(spark, task.request.path), task.request.target)
    return made.select(F.lit(f"{_stem(task)}.{task.request.target}").alias("name"), "content")


def _text(df: DataFrame, task: Task, is_html: bool, is_markdown: bool, title: Column | None = None) -> DataFrame:
    """Documents (column text) to a text, Markdown, HTML, DOCX or PPTX target; title: that of the file where none is given."""
    target, out = task.request.target, f"{_stem(task)}.{task.request.target}"
    title = F.lit(_stem(task)) if title is None else title
    body = markup.sanitise_html(F.col("text")) if is_html else markup.markdown_to_html(F.col("text")) if is_markdown else F.concat(F.lit("<pre>"), F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</pre>"))
    plain = markup.html_to_text(body) if is_html or is_markdown else F.col("text")
    if target == "html":
        return _bundle(df.select(html_document(body, title).alias("text")), out)
    if target == "md":
        return _bundle(df.select((markup.html_to_markdown(body) if is_html else F.col("text")).alias("text")), out)
    if target == "txt":
        return _bundle(df.select(plain.alias("text")), out)
    if target == "docx":
        return df.select(F.lit(out).alias("name"), packages.word_documents(plain).alias("content"))
    if target == "pptx":
        return df.select(F.lit(out).alias("name"), packages.slide_packages(markup.slides_of(plain, title)).alias("content"))
    raise UnsupportedEngine(f"No writer for {target}")


def _document(spark: SparkSession, task: Task) -> DataFrame:
    if task.request.target == "pdf" or task.ext in registry.PDF_ONLY:
        raise UnsupportedEngine("PDF output needs an office engine")
    if task.ext in ("docx", "pptx"):
        parts = archives.document_parts(archives.read(spark, task.request.path))
        heading = "# " if task.request.target in ("md", "pptx") and task.ext == "pptx" else ""
        lines = F.concat(F.lit(heading), F.array_join("lines", "\n"))
        joined = parts.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", lines.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))
        return _text(joined, task, False, False)
    docs = spark.read.text(task.request.path, wholetext=True).withColumnRenamed("value", "text")
    return _text(docs, task, task.ext == "html", task.ext == "md")


def _ebook(spark: SparkSession, task: Task) -> DataFrame:
    """The sections of a book, each sanitised by itself, under its title and author."""
    heads, found = books.sections(spark.read.format("binaryFile").load(task.request.path), "content", ["path"])
    parts = found.withColumn("text", markup.sanitise_html(F.col("text"))).where("trim(text) <> ''")
    body = ordered.joined_text(parts.withColumn("text", F.concat(F.lit("<section>"), "text", F.lit("</section>"))), ["path"], "text", ["section"], "")
    title = F.coalesce(F.nullif("title", F.lit("")), F.lit(_stem(task)))
    author = F.when(F.col("author") != "", F.concat(F.lit("<p>"), escape_html(F.col("author")), F.lit("</p>"))).otherwise("")
    whole = materialise(body.join(heads, "path").select(title.alias("title"), F.concat(F.lit("<header><h1>"), escape_html(title), F.lit("</h1>"), author, F.lit("</header>"), "text").alias("text")), "book")
    if whole.isEmpty():
        raise ValueError("No readable sections of a book were found")
    return _text(whole, task, True, False, F.col("title"))


HANDLERS: dict[str, Callable[[SparkSession, Task], DataFrame]] = {"data": _rows, "database": _database, "subtitle": _subtitle, "archive": _archive, "document": _document, "ebook": _ebook}


def register_handler(kind: str, handler: Callable[[SparkSession, Task], DataFrame]) -> None:
    """Add or replace the converter of a kind: (spark, task) -> DataFrame (name, content)."""
    HANDLERS[kind] = handler


def convert(spark: SparkSession, path: str, target: str, **options: object) -> DataFrame:
    """name, content of the files that path becomes."""
    task = plan(Request(path, target, options))
    if task.kind not in HANDLERS:
        raise UnsupportedEngine(f"{task.kind} files need an engine that isn't here")
    return HANDLERS[task.kind](spark, task)


def convert_rows(spark: SparkSession, path: str, target: str, out: str, **options: object) -> None:
    """The rows of path as CSV, TSV or NDJSON part files in the folder out, in order, for tables of any size: unlike
    convert(), which gives one file, nothing is brought together, and CSV, TSV and JSON files are read by many tasks each. Existing files there are an error."""
    task = plan(Request(path, target, options))
    if task.kind != "data":
        raise ValueError(f"{task.kind} files have no rows")
    if task.ext in ("csv", "tsv") and not options.get("splittable"):
        found = split.read_quoted(spark, path, "," if task.ext == "csv" else "\t", in_order=True)
    elif task.ext == "json":
        found = structured.typed(split_json.record_rows(spark, path).withColumnRenamed(split.FILE, "file"))
    else:
        found = read_rows(spark, task)
    row_sink.write(found.withColumn("__ord", F.monotonically_increasing_id()), out, task.request.target, ["__ord"])


def cancel(spark: SparkSession, group: str) -> None:
    """Stop the running jobs of a batch that was given this group; its items that aren't done are rejected."""
    spark.sparkContext.cancelJobGroup(group)


def convert_batch(spark: SparkSession, requests: list[Request], out: str, workers: int | None = None, group: str | None = None) -> DataFrame:
    """idx, status (fulfilled or rejected), files, reason of each request, in order; its files are written in the folder
    out/idx, which the executors have to share. As many requests run at once as the session has task slots, up to 8."""
    tasks = [plan(r) for r in requests]

    def run(pair: tuple[int, Task]) -> tuple[int, str, list, str | None]:
        i, task = pair
        try:
            if group:
                spark.sparkContext.setJobGroup(group, task.name, interruptOnCancel=True)
            made = store.stored(convert(spark, task.request.path, task.request.target, **task.request.options), f"{out}/{i}")
            return i, "fulfilled", [tuple(r) for r in made.collect()], None
        except Exception as e:  # one item's failure is its own result
            return i, "rejected", [], str(e).split("\n")[0][:200]

    with ThreadPoolExecutor(workers or max(1, min(8, spark.sparkContext.defaultParallelism))) as pool:
        results = list(pool.map(run, enumerate(tasks)))
    return spark.createDataFrame(results, f"idx int, status string, files array<struct<{store.MANIFEST.replace(' ', ':').replace(',:', ',')}>>, reason string")


def inspect(path: str) -> dict[str, object]:
    """Raw extension, extension, kind and targets of a name."""
    found = re.search(r"\.([a-z0-9]+)$", path.strip().lower())
    raw = found[1] if found else ""
    ext = registry.canonical(raw)
    kind = registry.KIND.get(ext, "")
    return {"raw_ext": raw, "ext": ext, "kind": kind, "targets": registry.targets(kind, ext)}
