"""JSON, NDJSON, XML, TOML, YAML and INI documents to rows.

Each document becomes a JSON text: JSON as it is, the other grammars by an Arrow-batched helper around
a parser of the standard library (or PyYAML). From there on everything is shared: record discovery, then
columns by Spark's own schema inference and flattening.
"""

from __future__ import annotations

import datetime
import functools
import json
import re
import tomllib
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgate.functions.text import json_string
from loomgate.operators.records import flattened, record_values


def xml_value(e: ElementTree.Element) -> object:
    """Attributes as @name, a leaf's trimmed text (#text beside attributes), repeated children as arrays; local names."""
    local = lambda name: name.rpartition("}")[2]
    found: dict[str, object] = {f"@{local(k)}": v for k, v in e.attrib.items()}
    if not len(e):
        text = (e.text or "").strip()
        return {**found, "#text": text} if found else text
    repeated: set[str] = set()
    for child in e:
        key, value = local(child.tag), xml_value(child)
        if key not in found:
            found[key] = value
        elif key in repeated or isinstance(found[key], list):
            found[key].append(value)
        else:
            found[key] = [found[key], value]
            repeated.add(key)
    return found


def _plain(value: object) -> object:
    if isinstance(value, (datetime.date, datetime.time)):
        return value.isoformat()
    if isinstance(value, (bytes, set)):
        return list(value)
    raise TypeError(type(value).__name__)


def _xml(source: str) -> object:
    root = ElementTree.fromstring(source)
    return {root.tag.rpartition("}")[2]: xml_value(root)}


@functools.cache
def _yaml_loaders() -> list[type]:
    """Loaders with the booleans and nulls of the YAML 1.2 core schema (yes, no, on and off are texts): on libyaml if it is there, and in Python."""
    import yaml

    made = []
    for base in (getattr(yaml, "CSafeLoader", None), yaml.SafeLoader):
        if base is not None:
            loader = type("Loader", (base,), {"yaml_implicit_resolvers": {k: [(t, r) for t, r in v if t != "tag:yaml.org,2002:bool"] for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items()}})
            loader.add_implicit_resolver("tag:yaml.org,2002:bool", re.compile(r"^(?:true|True|TRUE|false|False|FALSE)$"), list("tTfF"))
            made.append(loader)
    return made


def _yaml(source: str) -> object:
    import yaml

    *first, last = _yaml_loaders()
    for loader in first:
        try:
            return yaml.load(source, loader)
        except yaml.YAMLError:
            pass  # what libyaml refuses, the loader in Python decides
    return yaml.load(source, last)


def _ini(source: str) -> object:
    """Sections as nested objects; the same rules as sources.ini, which gives rows."""
    root: dict[str, object] = {}
    section = root
    for line in (x.strip() for x in source.removeprefix("﻿").splitlines()):
        if not line or line[0] in ";#":
            continue
        if m := re.fullmatch(r"\[([^\]]+)\]", line):
            section = root
            for step in filter(None, (s.strip() for s in m[1].split("."))):
                section = section[step] if isinstance(section.get(step), dict) else section.setdefault(step, {})
        elif m := re.match(r"([^:=]*)[:=](.*)", line):
            raw = m[2].strip()
            section[m[1].strip()] = raw.lower() == "true" if raw.lower() in ("true", "false") else json.loads(str(float(raw)) if "." in raw else str(int(raw))) if re.fullmatch(r"-?\d+(\.\d+)?", raw) else re.sub(r"^[\"']|[\"']$", "", raw)
    return root


PARSERS: dict[str, Callable[[str], object]] = {"xml": _xml, "toml": lambda s: tomllib.loads(s.removeprefix("﻿")), "yaml": _yaml, "ini": _ini}


def as_json(text: Column, ext: str) -> Column:
    """The document as JSON text. A document that can't be parsed fails the query, as it fails the file."""
    if ext == "json":
        return F.regexp_replace(text, "^﻿", "")
    if ext == "ndjson":
        kept = F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != "")
        checked = F.transform(kept, lambda x, i: F.when(F.try_parse_json(x).isNotNull(), x).otherwise(F.raise_error(F.concat(F.lit("Invalid NDJSON on line "), (i + 1).cast("string"))).cast("string")))
        return F.concat(F.lit("["), F.array_join(checked, ","), F.lit("]"))

    @F.pandas_udf("string")
    def parsed(texts: pd.Series) -> pd.Series:
        return texts.map(lambda s: None if s is None else json.dumps(PARSERS[ext](s), ensure_ascii=False, default=_plain))

    return parsed(text)


def row_texts(docs: DataFrame, text: str, ext: str, keys: list[str]) -> DataFrame:
    """keys, ord, row: a JSON text for each row of each document."""
    return docs.select(*keys, F.posexplode(record_values(as_json(F.col(text), ext))).alias("ord", "row"))


def read(spark: SparkSession, path: str, ext: str) -> DataFrame:
    """All files of path as flat rows, columns by inference over all of them; NDJSON is split and read in place."""
    if ext == "ndjson":
        return flattened(spark.read.option("mode", "FAILFAST").json(path))
    return typed(row_texts(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"), "value", ext, ["file"]))


def typed(each: DataFrame) -> DataFrame:
    """Rows (file, ord, row: a JSON text) in order, flat, under columns by inference over all of them."""
    value = F.when(F.col("row").startswith("["), json_string(F.col("row"))).otherwise(F.col("row"))
    objects = each.select(F.when(F.col("row").startswith("{"), F.col("row")).otherwise(F.concat(F.lit('{"value":'), value, F.lit("}"))).alias("value"), "file", "ord")
    variant = objects.agg(F.schema_of_variant_agg(F.parse_json("value")).alias("s")).first()["s"] or "OBJECT<>"
    schema = variant.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING").replace("VARIANT", "STRING")
    return flattened(objects.orderBy("file", "ord").select(F.from_json("value", schema).alias("v")).select("v.*"))


def read_separated(spark: SparkSession, path: str, ext: str, splittable: bool = False) -> DataFrame:
    """CSV or TSV with a header. Quoted cells may hold line ends, so a file is read by one task; where no
    cell of large files does, splittable=True lets Spark cut them."""
    return spark.read.csv(path, sep="," if ext == "csv" else "\t", header=True, inferSchema=True, escape='"', multiLine=not splittable)
