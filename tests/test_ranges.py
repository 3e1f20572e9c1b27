"""Ordered operations over groups that lie over several ranges, against plain Python."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from loomgate.operators import contents, lookups, ordered, ranges

rng = random.Random(5)
#: Two thirds of the rows in one group, ties in the order, nulls in key and value.
ROWS = [(rng.choice(["hot", "hot", "hot", "hot", "a", "b", None]), i // 2, i, rng.choice([None, 1, 2, 3])) for i in range(600)]


@pytest.fixture(scope="module", autouse=True, params=["ranges", "windows"])
def way(spark, request):
    """Both ways of ordered work: in ranges, as for large groups (small ranges are not put together, so that groups do lie over several), and in windows."""
    usual = ranges.WINDOW_ROWS
    if request.param == "ranges":
        ranges.WINDOW_ROWS = 0
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield request.param
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ranges.WINDOW_ROWS = usual


@pytest.fixture(scope="module")
def rows(spark):
    mixed = rng.sample(ROWS, len(ROWS))
    return spark.createDataFrame(mixed, "k string, o int, i int, v int").repartition(3)


def groups():
    return [(k, list(g)) for k, g in itertools.groupby(sorted(ROWS, key=lambda r: (r[0] or "", r[1], r[2])), key=lambda r: r[0])]


def test_ranges_cut_groups(rows, way):
    if way == "windows":
        pytest.skip("no ranges")
    placed = ranges.ranged(rows, ["k"], ["o", "i"])
    assert placed.where("k = 'hot'").select(ranges.PART).distinct().count() > 1
    assert [r["i"] for r in placed.where("k = 'hot'").orderBy(ranges.AT).collect()] == sorted(r[2] for r in ROWS if r[0] == "hot")


def test_running(rows):
    want = {i: (sum(x[3] or 0 for x in g[: n + 1]), n + 1) for _, g in groups() for n, (_, _, i, _) in enumerate(g)}
    found = ordered.numbered(ordered.running_offsets(rows, ["k"], ["o", "i"], "v"), ["k"], ["o", "i"])
    assert {r["i"]: (r["end"], r["place"]) for r in found.collect()} == want
    every = ordered.numbered(rows, [], ["i"])
    assert all(r["place"] == r["i"] + 1 for r in every.collect())
    means = {r["i"]: r["mean"] for r in ordered.running_mean(rows, ["k"], ["o", "i"], "v").collect()}
    for _, g in groups():
        for n, row in enumerate(g):
            own = [x[3] for x in g[: n + 1] if x[3] is not None]
            assert means[row[2]] == pytest.approx(sum(own) / len(own)) if own else means[row[2]] is None


def test_carried_and_islands(rows):
    found = {r["i"]: r["last"] for r in ordered.carried(rows, ["k"], ["o", "i"], F.when(F.col("v") == 3, F.col("i")), "last").collect()}
    breaks = {r["i"]: r["island"] for r in ordered.islands(rows, ["k"], ["o", "i"], lambda b: F.col("i") - b["i"] > 2, ["i"]).collect()}
    for _, g in groups():
        last, island, before = None, 0, None
        for _, _, i, v in g:
            last = i if v == 3 else last
            island += before is not None and i - before > 2
            before = i
            assert (found[i], breaks[i]) == (last, island)


def test_lead(rows):
    ends = {(r["k"], r["i"]): r["end"] for r in ordered.lead_ranges(rows.select("k", "i"), ["k"], "i").collect()}
    for k, g in groups():
        assert [ends[k, x[2]] for x in g] == [*[x[2] for x in g[1:]], None]


def test_empty(rows):
    none = rows.where("false")
    assert ordered.running_offsets(none, ["k"], ["o"], "v").count() == ordered.carried(none, [], ["o"], F.col("v"), "l").count() == ordered.numbered_names(none, [], "k", ["o"]).count() == 0


@pytest.mark.parametrize(
    ("names", "wanted"),
    [
        (["a.txt", "a.txt", "a-2.txt", "a.txt"], ["a.txt", "a-3.txt", "a-2.txt", "a-4.txt"]),
        (["a-3.txt", "a.txt", "a.txt", "a.txt", "a-3.txt"], ["a-3.txt", "a.txt", "a-2.txt", "a-4.txt", "a-3-2.txt"]),
        (["a.TXT", "a.txt", "a.TXT", "a.txt"], ["a.TXT", "a.txt", "a-2.txt", "a-3.txt"]),
        (["x", "x", "x-2", "x-02"], ["x", "x-3", "x-2", "x-02"]),
    ],
)
def test_unique_names(spark, names, wanted):
    df = spark.createDataFrame(list(enumerate(names)), "i int, n string")
    assert [r["unique_name"] for r in ordered.numbered_names(df, [], "n", ["i"]).orderBy("i").collect()] == wanted


def test_unique_names_random(spark):
    names = [rng.choice(["a", "a-2", "a-3", "b", "a-2-2"]) + rng.choice([".txt", ".TXT", ""]) for _ in range(300)]
    found = ordered.numbered_names(spark.createDataFrame(list(enumerate(names)), "i int, n string"), [], "n", ["i"]).collect()
    assert len(found) == len({r["unique_name"] for r in found}) == 300


def test_tree(spark):
    chain = [(0, None), *((i, i - 1) for i in range(1, 200))]
    odd = [(900, 901), (901, 900), (902, 900), (903, 999), (904, 903)]  # a circle, one behind it, a lost parent
    found = lookups.tree_depths(spark.createDataFrame(chain + odd, "n long, p long"), "n", "p")
    assert sorted(tuple(r) for r in found.collect()) == [(i, i) for i in range(200)]


def fold_levels(indents):
    """Levels one entry after the other."""
    last, at, had, out = 0.0, 0, {}, []
    for x in indents:
        at = at + 1 if x > last else at if x == last else had.get(x, max(0, at - 1))
        last = x
        had[x] = at
        out.append(at)
    return out


def test_contents_levels(spark):
    books = {"a": [0.0, 10.0, 20.0, 20.0, 10.0, 0.0, 5.0, 3.0], "deep": [float(i) for i in range(150)], "back": [5.0, 3.0, 1.0, 0.0], None: [float(rng.choice([0, 2, 2, 4, 5])) for _ in range(300)]}
    assert fold_levels(books["a"]) == [0, 1, 2, 2, 1, 0, 1, 0]
    rows = [(k, i, x) for k, xs in books.items() for i, x in enumerate(xs)]
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "book string, i int, x double")
    found = {(r["book"], r["i"]): r["level"] for r in contents.levels(df, ["book"], ["i"], "x").collect()}
    assert found == {(k, i): v for k, xs in books.items() for i, v in enumerate(fold_levels(xs))}
    assert contents.levels(df.where("false"), ["book"], ["i"], "x").count() == 0
    assert [r["level"] for r in contents.levels(df.where("book = 'a'").withColumn("x", F.lit(None)), [], ["i"], "x").collect()] == [0] * 8


def test_neighbours(rows):
    found = {r["i"]: (r["before"], r["next"]) for r in ordered.with_neighbours(rows.select("k", "i"), ["k"], "i", "i").collect()}
    for _, g in groups():
        ids = [x[2] for x in g]
        assert [found[i] for i in ids] == list(zip([None, *ids], [*ids[1:], None], strict=False))


def test_ties_do_not_depend_on_size(spark, monkeypatch):
    """Rows that tie in the order get the same results in windows and in ranges."""
    df = spark.createDataFrame([("g", i % 3, i, i) for i in range(90)], "k string, o int, i int, v int").repartition(3)
    results = []
    for limit in (0, 5, 200_000):
        monkeypatch.setattr(ranges, "WINDOW_ROWS", limit)
        sums = {r["i"]: r["start"] for r in ordered.running_offsets(df, ["k"], ["o"], "v").collect()}
        last = {r["i"]: r["last"] for r in ordered.carried(df, ["k"], ["o"], F.when(F.col("v") % 2 == 0, F.col("i")), "last").collect()}
        cut = {r["i"]: r["island"] for r in ordered.islands(df, ["k"], ["o"], lambda b: b["i"] > F.col("i"), ["i"]).collect()}
        means = {r["i"]: r["mean"] for r in ordered.running_mean(df, ["k"], ["o"], "v").collect()}
        results.append((sums, last, cut, means))
    assert results[0] == results[1] == results[2]
