"""Operators 11 to 13 against brute-force versions, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgate.llm import merkle, minhash, spelling
from tests.llm.test_operators import near_copies

ROW = "doc_id long, source string, lang string, n_chars long, text string, row string, tree int, path string, node int, word string, idx int, first string, m int"


def rows_of(spark, rows):
    """rows (doc_id, source, lang, n_chars, text) with extra columns whose names the operators use themselves."""
    return spark.createDataFrame([(*r, "r", 1, "p", 2, "w", 3, "f", 4) for r in rows], ROW).repartition(3)


ODD = [
    (5, "a", "en", 3, "abc"), (5, "a", "en", 3, "abc"), (5, "b", "en", None, None), (None, None, None, None, None), (None, "a", "en", 1, "x"),
    (7, None, None, 0, ""), (-3, "ü", "é", 9223372036854775807, "🙂"), (9, "s", "", 1, "y" * 400_000), (10, "s", "Z", 1, "only one here"),
]


# 11 --------------------------------------------------------------------------------------------------------------
def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_leaf(row, more=0):
    values = [row[0], row[1], row[2], row[3] if row[3] is None else row[3] + more, row[4]]
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def brute_tree(nodes, fanout):
    """The root, and for each leaf its runs from below: (place in the run, the run)."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for leaf, i in enumerate(at):
            run = nodes[i // fanout * fanout : i // fanout * fanout + fanout]
            paths[leaf].append((i % fanout, run))
        nodes = [sha(*nodes[i : i + fanout]) for i in range(0, len(nodes), fanout)]
        at = [i // fanout for i in at]
    return nodes[0], paths


def brute_manifest(rows, fanout):
    langs = sorted({r[2] for r in rows}, key=lambda v: (v is not None, (v or "").encode()))
    trees = {x: sorted((r for r in rows if r[2] == x), key=lambda r: (r[0] is not None, r[0] or 0, brute_leaf(r))) for x in langs}
    made = {x: brute_tree([brute_leaf(r) for r in trees[x]], fanout) for x in langs}
    root, tops = brute_tree([made[x][0] for x in langs], fanout)
    out = Counter()
    for no, x in enumerate(langs):
        for r, path in zip(trees[x], made[x][1], strict=True):
            touched = r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            own = brute_leaf(r, int(touched))
            proof = []
            for place, run in [*path, *tops[no]]:
                proof += run[:place] + run[place + 1 :]
                own = sha(*run[:place], own, *run[place + 1 :])
            out[r[0], brute_leaf(r), made[x][0], root, sha(*proof), own, own == root] += 1
    return out


def found_manifest(df, fanout):
    return Counter(tuple(r) for r in merkle.document_manifest(df, fanout=fanout).collect())


@pytest.mark.parametrize("fanout", [2, 3])
def test_manifest(spark, fanout):
    rng = random.Random(fanout)
    rows = [*ODD, *((i, "s", rng.choice(["en"] * 4 + ["fr", None]), rng.choice([None, i]), f"text {i}") for i in range(100, 160))]
    wanted = brute_manifest(rows, fanout)
    assert found_manifest(rows_of(spark, rows), fanout) == wanted
    assert {r[-1] for r in wanted} == {True, False}


def test_manifest_small(spark):
    for rows in ([], ODD[:1], ODD[:2], [ODD[3]], ODD[6:9]):
        assert found_manifest(rows_of(spark, rows), 2) == (brute_manifest(rows, 2) if rows else Counter())


def test_manifest_finds_tampering(spark):
    """A proof fits its own row only."""
    rows = rows_of(spark, [(i, "s", "en", i, str(i)) for i in range(9)])
    leaves = rows.select(F.col("doc_id").alias("id"), F.col("lang").alias("tree"), merkle.digest(F.col("text")).alias("digest"))
    found, root = merkle.manifest(leaves)
    own = found.select("row.id", merkle.folded(F.col("digest"), F.col("path")).alias("own"), merkle.folded(merkle.digest(F.lit("5")), F.col("path")).alias("of_5")).collect()
    assert all(r["own"] == root and (r["of_5"] == root) == (r["id"] == 5) for r in own)


def test_order_in_ranges(spark):
    """Numbers follow the order over all ranges, whatever group holds most rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"), ((F.col("id") * 7919) % 3000).alias("i"))
        found = merkle.in_order(df, [F.col("k"), F.col("i")])
        rows = sorted((r["rank"], r["k"], r["i"]) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r[0] for r in rows] == list(range(3000)) and [r[1:] for r in rows] == sorted(r[1:] for r in rows)


# 12 --------------------------------------------------------------------------------------------------------------
def brute_sets(texts):
    out = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        out.append({" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))} if words else set())
    return out


def brute_near(rows):
    """rows (doc_id, text) -> Counter of (doc_id, n_shingles, component_id, kept), by comparing all pairs."""
    sets = brute_sets(t for _, t in rows)
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        p, q = sets[i], sets[j]
        if p and q and 100 * min(len(p), len(q)) >= 80 * max(len(p), len(q)) and 100 * len(p & q) >= 80 * len(p | q):
            up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    component = lambda i: least.get(root(i)) if sets[i] else rows[i][0]
    return Counter((d, len(sets[i]), component(i), d == component(i)) for i, (d, _) in enumerate(rows))


def found_near(spark, rows):
    df = spark.createDataFrame([(*r, 1, "s", 2, "k") for r in rows], "doc_id long, text string, node int, sig string, size int, component string").repartition(3)
    return Counter(tuple(r) for r in minhash.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect())


def planted(seed, n=60):
    """Pairs at similarities of 0.7 to 0.95, a family of drifting copies, texts that share a long passage, odd texts."""
    rng = np.random.default_rng(seed)
    word = lambda k: [f"w{x}" for x in rng.integers(0, 5000, k)]
    rows = []
    for k in range(n):
        words = word(int(rng.integers(30, 300)))
        rows += [(10 * k, " ".join(words)), (10 * k + 1, near_copies(words, rng, float(rng.uniform(0.02, 0.2))))]
    family = word(200)
    for i in range(n):
        family = near_copies(family, rng, 0.06).split()
        rows.append((5000 + i, " ".join(family)))
    passage = word(120)
    rows += [(7000 + i, " ".join(passage + word(int(rng.integers(20, 120))))) for i in range(n)]
    odd = ["", " ", None, "one two", "ONE  two", "one two three", "a b c d", "a b c d", "A b\tc d a b c d", "word " * 100_000, "word word word word", "x" * 200_000]
    rows += [(9000 + i, t) for i, t in enumerate(odd)] + [(9003, "one two"), (9003, "other"), (None, "one two"), (None, "nobody's"), (None, "nobody's"), (None, None)]
    return rows


@pytest.mark.parametrize(("block", "partners"), [(minhash.BLOCK, minhash.PARTNERS), (8, 4)])
def test_near_duplicates(spark, monkeypatch, block, partners):
    """Equal to comparing all pairs, also where buckets are cut into blocks and partners of a leader are dealt out."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "PARTNERS", partners)
    rows = planted(block)
    assert found_near(spark, rows) == brute_near(rows)


def test_near_duplicates_empty(spark):
    assert found_near(spark, []) == Counter()
    assert found_near(spark, [(1, None), (2, "")]) == Counter({(1, 0, 1, True): 1, (2, 0, 2, True): 1})


def test_near_duplicates_drop(spark):
    rows = [(1, "a b c d e f g"), (2, "A b c d e f g"), (3, "other words in this text"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("own"))
    out = minhash.drop_near_duplicates(df)
    assert out.columns == df.columns and sorted(r["doc_id"] for r in out.collect()) == [1, 3, 4, 5]


def test_signature_bounds():
    """The share of equal minima follows the similarity, and no pair at 0.8 comes near the bound or misses all bands."""
    rng = np.random.default_rng(3)
    for share in (0.8, 0.9):
        for _ in range(200):
            both = rng.integers(0, 2**64, 1000, np.uint64)
            own = rng.integers(0, 2**64, (2, round(1000 * (1 / share - 1) / 2)), np.uint64)
            p, q = (minhash.signature(np.concatenate([both, x])) for x in own)
            assert (p == q).sum() >= minhash.LEAST_EQUAL
            assert (minhash.band_keys(p[None]) == minhash.band_keys(q[None])).any()
            assert abs((p == q).mean() - share) < 0.2


# 13 --------------------------------------------------------------------------------------------------------------
def brute_words(rows):
    counts = Counter()
    for d, t in rows:
        for run in re.findall("[a-zÀ-ÿ]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")):
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def brute_edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def brute_variants(words):
    near = {w: [v for v in words if brute_edit(w, v)] for w in words}
    best = {w: min(near[w], key=lambda v: (-words[v], v)) if near[w] else None for w in words}
    form = {w: v if v is not None and words[v] >= 10 * words[w] else None for w, v in best.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), words[w], len(near[w]), form[w] and words[form[w]]) for w in words}


def found_variants(spark, rows):
    df = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], "doc_id long, text string, n int, word string, side int").repartition(3)
    return [tuple(r) for r in spelling.variants(df).collect()]


def slips(rng, word):
    at, letter = rng.randrange(len(word) + 1), rng.choice("abeéÿ")
    return rng.choice([word[:at] + letter + word[at:], word[:at] + word[at + 1 :], word[:at] + letter + word[at + 1 :]])


def word_rows(seed):
    """Frequent words, words one edit from them, chains of such, words that share halves; in a few documents."""
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdeéÀ") for _ in range(rng.randint(6, 11))) for _ in range(25)] + ["aaaaaaa", "aaaaaaaa", "abababab", "babababa"]
    words = [w for w in base for _ in range(rng.choice([1, 3, 40, 400]))]
    for w in base:
        for _ in range(12):
            v = slips(rng, w)
            words += [v] * rng.choice([1, 2, 3, 30]) + [slips(rng, v)] * 2
    rng.shuffle(words)
    rows = [(i, rng.choice([" ", "-", "5 "]).join(x.upper() if rng.random() < 0.2 and x.isascii() else x for x in words[i::7])) for i in range(7)]
    return rows + [(3, rows[3][1]), (None, rows[4][1]), (8, None), (9, ""), (10, "Wörterbuch×÷ÿ wörterbuch×÷ÿ " * 3), (11, "z" * 50_000 + " " + "z" * 50_000)]


@pytest.mark.parametrize("shard", [spelling.SHARD, 5])
def test_variants(spark, monkeypatch, shard):
    """Equal to comparing all pairs, also where the words of one key are dealt over many shards."""
    monkeypatch.setattr(spelling, "SHARD", shard)
    monkeypatch.setattr(spelling, "COUNTED", 50)
    rows = word_rows(shard)
    words = brute_words(rows)
    found = found_variants(spark, rows)
    assert len(found) == len(words) and set(found) == brute_variants(words)
    assert any(f is not None and f != r for _, f, r, *_ in found)  # a chain


def test_variants_empty(spark):
    assert found_variants(spark, []) == found_variants(spark, [(1, None), (2, "short one")]) == []


@pytest.mark.parametrize("long_rest", [spelling.LONG_REST, 2])
def test_rests(monkeypatch, long_rest):
    """What is one edit away, among rests with repeated code points and empty ones, kept by their cuts or compared."""
    monkeypatch.setattr(spelling, "LONG_REST", long_rest)
    texts = ["abc", "abd", "ab", "abcd", "bc", "acb", "aabc", "xabc", "axbc", "abxc", "", "a", "aa", "aaa"]
    rests = spelling._Rests(3)
    for x in texts:
        rests.add(x, f"---{x}", len(x))
    for x in texts:
        assert rests.one_edit(x, f"---{x}") == {f"---{y}": len(y) for y in texts if brute_edit(x, y)}


def test_long_texts_are_counted_whole(monkeypatch):
    import pyarrow as pa

    text = ("banana splitter " * 1000).encode()
    whole = [dict(zip(*b.to_pydict().values(), strict=True)) for b in spelling._counts(iter([pa.RecordBatch.from_arrays([pa.array(["1"]), pa.array([text])], names=["id", "text"])]))]
    monkeypatch.setattr(spelling, "LONG", 10)
    cut = [dict(zip(*b.to_pydict().values(), strict=True)) for b in spelling._counts(iter([pa.RecordBatch.from_arrays([pa.array(["1"]), pa.array([text])], names=["id", "text"])]))]
    assert whole == cut and whole[0]["splitter"] == 1000
