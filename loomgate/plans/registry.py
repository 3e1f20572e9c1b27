"""The formats: kinds, extensions, aliases, media types, and which targets a source may have."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgate.functions.text import extension
from loomgate.sources import peek

# What each kind reads. Subtitles, databases and ebooks are kinds of their own here, so that
# they reach their converters.
READS = {
    "image": "png apng jpg jpeg jfif webp bmp gif svg ico avif tif tiff heic heif tga raw dng cr2 cr3 crw nef nrw arw srf sr2 raf orf rw2 pef rwl 3fr mrw x3f",
    "subtitle": "srt vtt ass ssa",
    "video": "mp4 webm mov mkv avi wmv flv m4v f4v mpeg mpg 3gp 3g2 ogv ts mts m2ts vob asf mxf rm rmvb divx",
    "audio": "mp3 mp2 wav ogg oga opus flac m4a m4b aac caf voc wma ac3 eac3 amr ape au mka aiff aif ra tta dsf dff",
    "document": "txt log md markdown html htm doc docx docm dotx dotm odt ott fodt rtf epub ppt pptx pptm pps ppsx potx potm odp otp fodp",
    "ebook": "mobi azw azw3",
    "pdf": "pdf",
    "database": "sqlite sqlite3 db",
    "data": "csv tsv json ndjson yaml yml xml toml ini dbf dif sylk slk xls xlsx xlsm xlsb xltx xltm ods ots fods",
    "archive": "zip rar 7z tar gz tgz",
}
# What each kind writes.
WRITES = {
    "image": "png jpg webp bmp tiff ico pdf pptx",
    "video": "mp4 webm mov mkv avi gif mp3 wav ogg opus flac aiff m4a aac",
    "audio": "mp3 wav ogg opus flac aiff m4a aac",
    "ebook": "txt html pdf docx pptx",
    "subtitle": "srt vtt ass txt html",
    "database": "json csv xlsx html",
    "archive": "zip tar tgz gz",
    "pdf": "txt docx pptx png jpg",
    "data": "csv tsv json ndjson yaml xml toml ini xlsx ods html",
    "document": "txt md html pdf docx pptx",
}
PDF_ONLY = frozenset("doc docm dotx dotm odt ott fodt rtf epub ppt pptm pps ppsx potx potm odp otp fodp".split())
SHEETS = frozenset("xls xlsx xlsm xlsb xltx xltm ods ots fods".split())
# Extensions that are other names of one format.
ALIASES = {
    "apng": "png", "jpeg": "jpg", "jpe": "jpg", "jfif": "jpg", "markdown": "md", "htm": "html", "yml": "yaml", "log": "txt",
    "tif": "tiff", "heif": "heic", "slk": "sylk", "aif": "aiff", "oga": "ogg", "ssa": "ass", "sqlite3": "sqlite", "db": "sqlite",
}
# Media types of files whose names tell nothing.
MEDIA_TYPES = {
    "application/vnd.ms-powerpoint": "ppt", "application/vnd.openxmlformats-officedocument.presentationml.presentation": "pptx",
    "application/vnd.oasis.opendocument.presentation": "odp", "application/msword": "doc",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/vnd.oasis.opendocument.text": "odt",
    "application/rtf": "rtf", "text/rtf": "rtf", "application/vnd.ms-excel": "xls",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "xlsx", "application/vnd.oasis.opendocument.spreadsheet": "ods",
    "application/pdf": "pdf", "text/csv": "csv", "application/json": "json", "application/x-ndjson": "ndjson", "image/jpeg": "jpg",
    "image/png": "png", "image/webp": "webp", "image/tiff": "tiff", "image/heic": "heic", "image/heif": "heic", "image/x-tga": "tga",
    "video/3gpp2": "3g2", "audio/x-caf": "caf", "application/xml": "xml", "text/xml": "xml", "application/toml": "toml",
    "text/vtt": "vtt", "application/x-subrip": "srt", "application/vnd.sqlite3": "sqlite", "application/x-sqlite3": "sqlite",
    "application/zip": "zip", "application/x-7z-compressed": "7z", "application/vnd.rar": "rar", "application/x-rar-compressed": "rar",
    "application/x-tar": "tar", "application/gzip": "gz", "application/x-gzip": "gz", "application/x-mobipocket-ebook": "mobi",
    "application/vnd.amazon.ebook": "azw3", "application/vnd.apple.keynote": "key", "application/vnd.apple.numbers": "numbers",
}
#: What a target list falls back to, most wanted first.
PREFERRED = ("pdf", "png", "mp4", "mp3", "xlsx", "json", "txt")
#: Targets that are built here; the others have no engine without image, media or office programs.
UNSUPPORTED = frozenset("png jpg webp bmp tiff ico gif mp4 webm mov mkv avi mp3 wav ogg opus flac aiff m4a aac pdf".split())


def canonical(ext: str) -> str:
    return ALIASES.get(ext, ext)


KIND = {e: kind for kind, names in READS.items() for e in names.split()} | {canonical(e): kind for kind, names in READS.items() for e in names.split()}


def targets(kind: str, ext: str) -> list[str]:
    """Targets that a source of this kind and canonical extension may have, in order, its own left out."""
    if kind == "document" and ext in PDF_ONLY:
        found = ["pdf"]
    else:
        found = WRITES.get(kind, "").split()
        if kind == "data" and ext in SHEETS:
            found = [*found, "pdf"]
    return [t for t in found if canonical(t) != canonical(ext)]


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def canonical_extension(ext: Column) -> Column:
    return F.coalesce(_lookup(ALIASES, ext), ext)


def kind_of(ext: Column) -> Column:
    """The kind of an extension, empty if there is none."""
    return F.coalesce(_lookup(KIND, canonical_extension(ext)), F.lit(""))


def package_extension(first: Column, last: Column) -> Column:
    """Of the first 2 KB and the last 2 MB of a ZIP package: odp, odt or ods by the media type at its start, pptx, docx or xlsx by its list of entries; else empty."""
    marks = [(first, f"application/vnd.oasis.opendocument.{name}", ext) for name, ext in (("presentation", "odp"), ("text", "odt"), ("spreadsheet", "ods"))]
    marks += [(last, "ppt/presentation.xml", "pptx"), (last, "word/document.xml", "docx"), (last, "xl/workbook.xml", "xlsx")]
    found: Column = F.lit("")
    for part, mark, ext in reversed(marks):
        found = F.when(F.contains(part, F.lit(bytearray(mark.encode()))), ext).otherwise(found)
    return F.when((F.length(first) >= 4) & (F.substring(first, 1, 2) == F.lit(bytearray(b"PK"))), found).otherwise("")


def identified(files: DataFrame, name: str = "name", media_type: str | None = None, content: str | None = None) -> DataFrame:
    """files with raw_ext, ext and kind: by name, else by media type, else by the content of a package."""
    raw = extension(F.col(name))
    if media_type:
        raw = F.when(kind_of(raw) != "", raw).otherwise(F.coalesce(_lookup(MEDIA_TYPES, F.lower(F.col(media_type))), raw))
    if content:
        package = package_extension(F.substring(content, 1, peek.HEAD), F.substring(content, -peek.TAIL, peek.TAIL))
        raw = F.when(kind_of(raw) != "", raw).otherwise(F.coalesce(F.nullif(package, F.lit("")), raw))
    return files.withColumn("raw_ext", raw).withColumn("ext", canonical_extension(F.col("raw_ext"))).withColumn("kind", kind_of(F.col("raw_ext")))


def identified_files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, size, raw_ext, ext, kind, bytes_read of the files below path.

    Names come from the listing. A file is opened only if its name tells nothing, and then its first four bytes are read; only
    packages have their first 2 KB and last 2 MB read."""
    listed = identified(peek.read(spark, path, ["path", "name", "size"]))
    named = listed.where("kind <> ''").withColumn("bytes_read", F.lit(0).cast("long"))
    opened = peek.read(spark, path, signature="504b").where(~F.col("ext").isin(sorted({*KIND, *ALIASES})))  # pushed down: the source doesn't open such files
    package = F.nullif(package_extension(F.col("first"), F.col("last")), F.lit(""))
    raw = extension(F.col("name"))
    unnamed = opened.where(kind_of(raw) == "").withColumn("raw_ext", F.coalesce(package, raw))
    found = unnamed.withColumn("ext", canonical_extension(F.col("raw_ext"))).withColumn("kind", kind_of(F.col("raw_ext")))
    columns = ["path", "name", "size", "raw_ext", "ext", "kind", "bytes_read"]
    return named.select(*columns).unionByName(found.select(*columns))


def routes(spark: SparkSession) -> DataFrame:
    """(kind, ext, target, place) of everything that is allowed: some hundred rows."""
    rows = sorted({(kind, canonical(e)) for e, kind in KIND.items()})
    return spark.createDataFrame([(k, e, t, i) for k, e in rows for i, t in enumerate(targets(k, e))], "kind string, ext string, target string, place int")


def default_target(allowed: list[str], preferred: str | None = None) -> str | None:
    return preferred if preferred in allowed else next((t for t in PREFERRED if t in allowed), None)
