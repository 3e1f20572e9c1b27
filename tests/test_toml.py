"""Nested values as TOML, read again by the standard library's parser."""

import datetime
import json
import tomllib

import pytest
from pyspark.sql import functions as F

from loomgate.sinks import rows, toml

SCHEMA = """name string, n long, x double, ok boolean, day date, empty array<string>, list array<array<int>>, `odd key` string, lost string,
    one struct<a:int,b:struct<c:string>>, bare struct<t:struct<v:int>>, none struct<z:int>,
    many array<struct<k:string,sub:array<struct<v:int>>,m:map<string,int>>>, no array<struct<k:string>>,
    maps map<string,struct<a:int>>, plain map<string,double>, inline array<array<struct<p:int,q:string>>>, lists map<string,array<struct<w:int>>>"""
VALUE = {
    "name": 'q"\\\n\x7fé', "n": 2**60, "x": 1e300, "ok": False, "day": datetime.date(2024, 2, 29), "empty": [], "list": [[1], [], [2, 3]], "odd key": "v", "lost": None,
    "one": {"a": 1, "b": {"c": "x"}}, "bare": {"t": {"v": 1}}, "none": None,
    "many": [{"k": "a", "sub": [{"v": 1}, {"v": 2}], "m": {"x y": 1}}, {"k": "b", "sub": [], "m": {}}], "no": [],
    "maps": {"a.b": {"a": 1}, "": {"a": 2}}, "plain": {"nan": float("inf"), "d": -2.5}, "inline": [[{"p": 1, "q": "z"}], []], "lists": {"l": [{"w": 1}], "e": []},
}


def without_nulls(v):
    if isinstance(v, dict):
        return {k: without_nulls(x) for k, x in v.items() if x is not None}
    return [without_nulls(x) for x in v] if isinstance(v, list) else v


def text_of(spark, schema, value, **options):
    df = spark.createDataFrame([(value,)], f"v struct<{schema}>")
    return df.select(toml.document(F.col("v"), df.schema["v"].dataType, **options).alias("t")).first()["t"]


def test_nested(spark):
    fields = spark.createDataFrame([], SCHEMA).schema.simpleString().removeprefix("struct<").removesuffix(">")
    fields = fields.replace("odd key:", "`odd key`:")
    text = text_of(spark, fields, VALUE)
    assert tomllib.loads(text) == without_nulls(VALUE)
    assert "[bare.t]" in text and "[bare]" not in text and "[[many.sub]]" in text and "\\u007f" in text and text.endswith("\n")


@pytest.mark.parametrize(("value", "text"), [(1.0, "1"), (2.0**53, "9007199254740992.0"), (float("nan"), "nan"), (float("-inf"), "-inf"), (1e21, "1e+21"), (0.1, "0.1")])
def test_doubles(spark, value, text):
    assert text_of(spark, "x:double", {"x": value}) == f"x = {text}\n"
    assert isinstance(tomllib.loads(f"x = {text}")["x"], (int, float))


def test_empty(spark):
    assert text_of(spark, "a:struct<b:int>,c:map<string,int>", {"a": {"b": None}, "c": {}}) == "[a]\n[c]\n"
    assert text_of(spark, "a:int", {"a": None}) == "\n"
    assert text_of(spark, "a:int,b:array<int>", {"a": None, "b": [1, None]}, nulls="empty") == 'a = ""\nb = [ 1, "" ]\n'
    with pytest.raises(Exception, match="no null"):
        text_of(spark, "b:array<int>", {"b": [1, None]})


def test_rows(spark):
    """Rows with nested columns as one document."""
    values = [(1, {"b": [1, 2]}, [{"c": "x"}, {"c": None}]), (2, None, [])]
    df = spark.createDataFrame(values, "a int, s struct<b:array<int>>, l array<struct<c:string>>")
    text = rows.document(df, "toml", ["a"]).first()["text"]
    assert tomllib.loads(text) == {"data": [{"a": 1, "s": {"b": [1, 2]}, "l": [{"c": "x"}, {"c": ""}]}, {"a": 2, "s": "", "l": []}]}, json.dumps(text)
