"""What a review of round 3 found, held by small tests."""

import duckdb
import pytest

from loomgate.functions import markup
from loomgate.plans import catalogue
from loomgate.sources import structured


def _against_sql(spark, same, folder, name, **tables):
    """The query over the given tables (SQL texts) against its SQL."""
    con = duckdb.connect()
    for table, sql in tables.items():
        con.sql(f"COPY ({sql}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    same(catalogue.queries()[name](spark, str(folder)), con.sql(catalogue.oracle_sql()[name]))


def test_image_sizes_of_large_numbers(spark, same, tmp_path):
    """a number above 65,535 doesn't fit a GIF's width."""
    _against_sql(spark, same, tmp_path, "image_sizes", events="SELECT e::BIGINT AS event_id, (e * 7 % 5003)::BIGINT AS user_id FROM (SELECT unnest([0, 1, 2, 65533, 65534, 65535, 65536, 65537, 65538, 65539, 99999, 100000, 100001, 6000001, 6000002, 6000003, 4294967293, 4294967294, 4294967295]) AS e)")


def test_yaml_loaders():
    """loaders are made once, and libyaml's gives what the one in Python gives."""
    yaml = pytest.importorskip("yaml")
    assert structured._yaml_loaders() is structured._yaml_loaders() and (not yaml.__with_libyaml__ or issubclass(structured._yaml_loaders()[0], yaml.CSafeLoader))
    for text in ("- name: \"a\"\n  size: 1\n  tags: [1, 2]\n- {name: z, size: 1}\n", "a: yes\nb: true\nc: ~\nd: 0o7\ne: 1.5\nf: 2020-01-02\n", "x: &a [1, é, \U0001f600]\ny: *a\n", "a: |\n  b\n   c\n", ""):
        assert structured._yaml(text) == yaml.load(text, structured._yaml_loaders()[-1])
    with pytest.raises(yaml.YAMLError):
        structured._yaml("a: [1")


def test_markup_goes_out_in_small_batches(spark):
    """F4, F5, F6, F8: however many rows a batch brings, results leave after about a megabyte of texts, in order."""
    import pyarrow as pa

    texts = ["a" * 400_000, None, "", "b" * 700_000, *["c"] * 5, "d" * 2_000_000, "e"]
    out = list(markup._batched(lambda t: t, pa.string(), iter([(pa.array(texts),), (pa.array([], pa.string()),)])))
    assert [x for part in out for x in part.to_pylist()] == texts and [len(part) for part in out] == [4, 6, 1, 0]
    df = spark.createDataFrame([(0, "<p>a</p>"), (1, None), (2, "")], "id int, t string").select("id", markup.html_to_text("t").alias("x"), markup.slides_of("t", "t").alias("s"))
    assert [(r["x"], [tuple(s) for s in r["s"]]) for r in df.orderBy("id").collect()] == [("a", [("<p>a</p>", "")]), (None, [("", "")]), ("", [("", "")])]


def test_safe_names_of_long_texts(spark):
    """names are made of the start that decides them, with what the whole text gives."""
    from pyspark.sql import functions as F

    from loomgate.functions import text as T

    whole = lambda x, size, default: T.or_default(F.substring(T.trim(F.regexp_replace(F.regexp_replace(x, r'[\\/:*?"<>|\x00-\x1f]', "-"), f"[{T.SPACE}]+", " ")), 1, size), default)
    units = ["a", " ", "\t", "\u00a0", "\u3000 \u2003", "\n", ".", "/", "\U0001f600", "\ufeff", "é", "\u0085", "\x1f", "   ", "b.c", "\r\n"]
    texts = ["", " ", " " * 5000, " " * 5000 + "x", "x" + " " * 5000 + "y" * 300, "\n" * 200, "a." + "b" * 5000, "\U0001f600" * 130, "x" * 119 + "  y", "x" * 120 + " y", "x" * 119 + " ", " x" * 60 + " "]
    texts += ["".join(units[(i * k + i // 3 * j) % len(units)] for i in range(n)) for k in range(1, 12) for j in (1, 5) for n in (40, 81, 122, 400)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    found = df.select("t", T.safe_name("t").alias("a"), T.safe_table_name(F.col("t")).alias("b"), whole(T.base_name("t"), 120, "converted-file").alias("c"), whole(F.col("t"), 80, "table").alias("d")).collect()
    assert len(found) == len(texts) + 1 and [r["t"] for r in found if (r["a"], r["b"]) != (r["c"], r["d"])] == []
    plan = spark.range(1).select(T._clean(F.lit("x"), 80, "table"))._jdf.queryExecution().logical().toString()
    assert "{0,81}" in plan


def test_json_documents_are_cut_once(spark, tmp_path):
    """the parts of members are written, so that no later step cuts the documents again."""
    from loomgate.sources import split_json

    (tmp_path / "a.json").write_text('{"meta": [1, 2], "items": [{"a": "x,]"}, {"a": [1, {"b": 2}]}]}')
    found = split_json.record_rows(spark, str(tmp_path))
    assert sorted((r["ord"], r["row"]) for r in found.collect()) == [(0, '{"a": "x,]"}'), (1, '{"a": [1, {"b": 2}]}')]
    assert "MapInArrow" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_contents_of_bounded_tables(spark, monkeypatch):
    """tables that a task may hold are followed in one shuffle, and give what doubling gives for larger ones."""
    import random

    from loomgate.operators import contents, ranges

    rng = random.Random(7)
    odd = [0.0, 1.0, 2.0, 2.5, -1.0, float("inf"), float("nan"), None, -0.0]
    rows = [(k, i, rng.choice(odd)) for k, n in (("a", 300), (None, 40), ("b", 1)) for i in range(n)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "k string, i int, x double").repartition(3)
    written = []
    monkeypatch.setattr(contents, "materialise", lambda df, tag: written.append(tag) or ranges.materialise(df, tag))
    found = {}
    for limit in (200_000, 300, 20):
        monkeypatch.setattr(ranges, "WINDOW_ROWS", limit)
        before = len(written)
        found[limit] = sorted((r["k"] or "", r["i"], r["level"]) for r in contents.levels(df, ["k"], ["i"], "x").collect())
        assert (len(written) == before) == (limit >= 300)
    assert len(found[20]) == len(rows) and found[200_000] == found[300] == found[20]


def _moved(spark, run):
    """Bytes shuffled and written by the stages of run()."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, getattr(store, "stageList$default$4")(), getattr(store, "stageList$default$5")()))
    before = max((s.stageId() for s in stages()), default=-1)
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(s.shuffleWriteBytes() + s.outputBytes() for s in stages() if s.stageId() > before)


@pytest.mark.parametrize(("name", "times"), [("section_splices", 5), ("book_sections", 14)])
def test_texts_are_shuffled_few_times(spark, same, tmp_path, name, times):
    """what needs no bytes of a text shuffles none, and nothing is joined with texts that goes with their keys."""
    documents = "SELECT d::BIGINT AS doc_id, string_agg(md5((d * 1000 + i)::VARCHAR), ' ' ORDER BY i) AS text, 's' || d % 3 AS source, 'en' AS lang FROM range(120) t(d), range(400) u(i) GROUP BY d"
    documents += " UNION ALL SELECT 900 + n, repeat('a<b> ', n), 's', 'en' FROM (SELECT unnest([1, 2, 900]) AS n)"
    _against_sql(spark, same, tmp_path, name, documents=documents)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        moved = _moved(spark, lambda: catalogue.queries()[name](spark, str(tmp_path)).write.format("noop").mode("overwrite").save())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    texts = duckdb.sql(f"SELECT sum(strlen(text)) FROM '{tmp_path}/documents.parquet'").fetchall()[0][0]
    assert moved < times * texts


def test_pointers_are_joined_without_the_driver(spark, tmp_path, monkeypatch):
    """no round of pointer doubling broadcasts the entries."""
    from pyspark.sql import functions as F

    from loomgate.operators import ranges
    from loomgate.sinks import store
    from loomgate.sources import fixed

    docs = spark.range(40).select(F.col("id").alias("ord"), F.concat(F.lit("n"), "id").alias("name"), F.repeat(F.lit("x"), (F.col("id") * 40).cast("int")).cast("binary").alias("data"))
    rows = fixed.tar_rows(docs.select("ord", "name", F.length("data").cast("long").alias("size")), docs.select("ord", F.lit(0).cast("long").alias("part"), "data"))
    store.stored_parts(rows, f"{tmp_path}/tar").count()
    plans = []
    monkeypatch.setattr(fixed, "materialise", lambda df, tag: plans.append((tag, df._jdf.queryExecution().executedPlan().toString())) or ranges.materialise(df, tag))
    found = fixed.tar_headers(spark, f"{tmp_path}/tar").collect()
    assert sorted((r["ord"], r["name"], r["size"]) for r in found) == [(i, f"n{i}", 40 * i) for i in range(40)]
    rounds = [p for tag, p in plans if tag == "reached"]
    assert len(rounds) > 3 and not any("Broadcast" in p for p in rounds)
