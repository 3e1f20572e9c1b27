"""Each training-data operator against a brute-force version, an exact round trip or held-out accuracy, and its edge cases."""

import hashlib
import json
import math
import re
import tracemalloc
import unicodedata
import zlib
from collections import Counter
from itertools import combinations, product

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomgate.llm import byte_bpe, decontamination, exact_dedup, gru, html_text, langid, language_model, licenses, queries, sharding, simhash, tool_calls

DOC = "doc_id long, text string, lang string, keep_id int, fp string, id string, size string, shard int, score int, __text string"
ODD = ["", None, " \n\t ", "a", "a b", "a  b", "A b c d e f g", "x" * 300_000, "word " * 60_000, "🙂 naïve ß İstanbul    z", "a b", "a b", "\x00 nul \x1f", "%%% 123"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and extra columns with clashing names."""
    rows = [(i, t, None if i % 3 else "en", 1, "f", "i", "s", 2, 3, "u") for i, t in enumerate(ODD)]
    rows += [(4, "a b", "en", 1, "f", "i", "s", 2, 3, "u"), (4, "other words", "fr", 1, "f", "i", "s", 2, 3, "u"), (None, "a b", None, 1, "f", "i", "s", 2, 3, "u"), (None, None, None, 1, "f", "i", "s", 2, 3, "u")]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def local(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


def none_of(spark):
    return spark.createDataFrame([], DOC)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, sf, duck, same, name):
    same(queries.queries()[name](spark, sf), duck.sql(queries.oracle_sql()[name]))


# 5 ---------------------------------------------------------------------------------------------------------------
def brute_exact(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    return Counter((i, least(groups[norm(t)]), len(groups[norm(t)]), hashlib.sha256(norm(t).encode()).hexdigest()) for i, t in rows)


def test_exact(spark, odd, docs):
    for df in (odd, docs, none_of(spark)):
        found = exact_dedup.exact_duplicates(df).collect()
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in found) == brute_exact(rows)
        kept = [r for r in found if r["kept"]]
        assert len(kept) == len({r["text_sha256"] for r in found}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_exact_group_over_ranges(spark):
    """A group that holds most rows is cut over several ranges and joined again."""
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 8 < 7, "same  text").otherwise(F.concat(F.lit("t"), "id")).alias("text")).repartition(6)
    found = exact_dedup.exact_duplicates(df)
    assert found.where("group_size = 3500 AND keep_id = 0").count() == 3500
    assert found.where("kept").count() == 501


def test_exact_drop(odd):
    out = exact_dedup.drop_exact_duplicates(odd)
    assert out.columns == odd.columns
    ids = Counter(r["doc_id"] for r in out.where("doc_id IS NOT NULL").collect())
    assert ids == Counter([0, 2, 3, 4, 4, 6, 7, 8, 9, 12, 13])  # id 4 stands with two texts


# 3 ---------------------------------------------------------------------------------------------------------------
def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """fps {doc: fingerprint} -> {doc: smallest reachable doc}, by comparing all pairs."""
    up = {d: d for d in fps}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    for a, b in combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {d: root(d) for d in fps}


def test_simhash(docs, local):
    found = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    fps = {d: brute_fingerprint(t) for d, t in local.items()}
    assert {d: int(r["fingerprint"], 16) for d, r in found.items()} == fps
    assert {d: r["component_id"] for d, r in found.items()} == brute_components(fps)


def test_simhash_links(spark):
    """Chains and dense clusters of fingerprints."""
    rng = np.random.default_rng(1)
    fps = []
    for _ in range(12):
        base = int(rng.integers(0, 2**64, dtype=np.uint64))
        fps += [base]
        for _ in range(25):
            base ^= 1 << int(rng.integers(64))
            base ^= 1 << int(rng.integers(64))
            fps.append(base)
    fps += [int(x) for x in rng.integers(0, 2**64, 100, np.uint64)] + [0, 1, 3, 7, 15]
    fps = list(dict.fromkeys(fps))
    by_doc = dict(enumerate(fps))
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), d) for d, f in by_doc.items()], "f0 long, rep long")
    label = {r["node"]: r["component"] for r in simhash.connected_components(simhash.near_links(nodes)).collect()}
    assert {d: label.get(d, d) for d in by_doc} == brute_components(by_doc)


def test_simhash_covering():
    """Two fingerprints share a cell if they differ in two bits at most, and hardly ever if in more."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64, 400, np.uint64)
    for bits in range(5):
        flips = np.array([sum(1 << int(i) for i in rng.choice(64, bits, replace=False)) for _ in a], np.uint64)
        shared = [len(set(x) & set(y)) for x, y in zip(simhash.covering_keys(a[:, None]), simhash.covering_keys((a ^ flips)[:, None]), strict=True)]
        assert all(shared) if bits <= 2 else not any(shared)


def brute_similar(texts, least):
    """Components of texts by five-word Jaccard similarity of at least `least`, by comparing all pairs."""
    sets = {}
    for d, t in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets[d] = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    up = {d: d for d in texts}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    pairs = set()
    for a, b in combinations(sorted(texts), 2):
        x, y = sets[a], sets[b]
        if min(len(x), len(y)) >= least * max(len(x), len(y)) and len(x & y) >= least * len(x | y):
            pairs.add((a, b))
            ra, rb = root(a), root(b)
            up[max(ra, rb)] = min(ra, rb)
    return {d: root(d) for d in texts}, pairs


def near_copies(words, rng, share):
    """words with about so large a share of their five-word shingles changed, by single substitutions."""
    out = list(words)
    for at in range(int(rng.integers(3)), len(out), max(6, round(5 / share))):
        out[at] = f"other{int(rng.integers(1e9))}"
    return " ".join(out)


@pytest.mark.parametrize("pairs", [simhash.PAIRS, 4])
def test_similar_documents(spark, monkeypatch, pairs):
    """Recall on copies planted at similarities of 0.8 to 0.95, and nothing linked that brute force doesn't link; with small
    cells leaders take over, and a group of copies lies over several ranges."""
    monkeypatch.setattr(simhash, "PAIRS", pairs)
    rng = np.random.default_rng(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = {}
    for k in range(120):
        words = [str(w) for w in rng.choice(vocabulary, int(rng.integers(60, 500)))]
        texts[10 * k] = " ".join(words)
        texts[10 * k + 1] = near_copies(words, rng, float(rng.uniform(0.03, 0.1)))  # a changed share of x is a similarity of (1-x)/(1+x)
    group = [str(w) for w in rng.choice(vocabulary, 300)]
    for i in range(300):
        texts[5000 + i] = near_copies(group, np.random.default_rng(i), 0.03)
    texts |= {9000: "", 9001: " ", 9002: "one two", 9003: "ONE  two", 9004: "one two three"}
    brute, wanted = brute_similar(texts, 0.8)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["component_id"] for r in simhash.similar_documents(df).collect()}
    assert set(found) == set(texts) and all(brute[d] == brute[c] for d, c in found.items())
    planted = [(a, b) for a, b in wanted if a < 5000]
    assert len(planted) > 90 and sum(found[a] == found[b] for a, b in planted) >= 0.9 * len(planted)
    assert sum(found[5000 + i] == 5000 for i in range(300)) >= 295
    assert found[9001] == 9000 and found[9003] == 9002 and found[9004] == 9004
    kept = {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()}
    assert kept == {d for d, c in found.items() if d == c}


def test_hot_fingerprint(spark, monkeypatch):
    """A fingerprint of many rows is dealt over tasks; every row keeps its component."""
    monkeypatch.setattr(simhash, "HOT", 10)
    df = spark.range(0, 200, 1, 4).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "").otherwise(F.concat(F.lit("t "), F.col("id").cast("string"))).alias("text"))
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(df).collect()}
    assert len(found) == 200 and {found[i] for i in range(0, 200, 3)} == {0}


def test_simhash_odd(spark, odd):
    found = simhash.near_duplicates(odd).collect()
    assert len(found) == odd.count() and simhash.near_duplicates(none_of(spark)).count() == 0
    assert {r["component_id"] for r in found if r["fingerprint"] == "0" * 16} == {0}
    out = simhash.drop_near_duplicates(odd)
    assert out.columns == odd.columns and out.where("doc_id = 1").isEmpty() and not out.where("doc_id = 0").isEmpty()


def test_components_chain(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = simhash.connected_components(chain).collect()
    assert len(found) == 300 and {r["component"] for r in found} == {0}


# 6 ---------------------------------------------------------------------------------------------------------------
def test_bpe(spark, docs, local, odd):
    import tiktoken

    path, pattern = byte_bpe.default_vocabulary()
    with open(path, "rb") as f:
        ranks = byte_bpe.parse_ranks(f.read())
    lib = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    texts = {**local, **{10_000 + i: t for i, t in enumerate(ODD)}}
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string"))
    for r in byte_bpe.coding_digest(df).collect():
        ids, raw = lib.encode_ordinary(texts[r["doc_id"]] or ""), (texts[r["doc_id"]] or "").encode()
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest())
    both = byte_bpe.decode(byte_bpe.encode(odd)).collect()
    assert all(bytes(r["decoded"]) == (r["text"] or "").encode() for r in both)
    assert byte_bpe.coding_digest(none_of(spark)).count() == 0


def test_bpe_random():
    import tiktoken

    path, pattern = byte_bpe.default_vocabulary()
    with open(path, "rb") as f:
        blob = f.read()
    own, lib = byte_bpe.coder(blob, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.parse_ranks(blob), special_tokens={})
    rng = np.random.default_rng(3)
    letters = "abetion  \n\t.,'sé漢🙂0 1 "
    for n in rng.integers(1, 60, 1500):
        text = "".join(letters[i] for i in rng.integers(0, len(letters), n))
        assert own.encode(text) == lib.encode_ordinary(text), repr(text)


def test_bpe_white_space():
    """White space at all places, with a vocabulary that has tokens of several blanks."""
    import base64

    import tiktoken

    ranks = {bytes([i]): i for i in range(256)} | {b"  ": 256, b"    ": 257, b" a": 258, b"\n ": 259, b" \n": 260}
    blob = b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items())
    own, lib = byte_bpe.coder(blob, byte_bpe.WORD_PATTERN), tiktoken.Encoding("own", pat_str=byte_bpe.WORD_PATTERN, mergeable_ranks=ranks, special_tokens={})
    for n in range(7):
        for letters in product("a \n", repeat=n):
            assert own.encode("".join(letters)) == lib.encode_ordinary("".join(letters)), letters


# 7 ---------------------------------------------------------------------------------------------------------------
def test_language(spark, docs, odd):
    found = langid.predicted_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)
    few = {r["doc_id"]: r for r in langid.predicted_languages(odd).collect() if r["doc_id"] is not None}
    assert all(few[i]["lang_pred"] == "und" and few[i]["score"] == 0 and few[i]["rejected"] for i in (0, 1, 2, 13))
    assert langid.predicted_languages(none_of(spark)).count() == 0
    assert langid.drop_rejected(odd).columns == odd.columns
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string")).limit(5)
    assert {r["lang_pred"] for r in langid.predicted_languages(unlabelled).collect()} == {"und"}


def test_language_subwords():
    """A word's buckets don't depend on the words beside it, and are as many as its runs of 2 to 4 characters and one."""
    words = ["a", "ab", "naïve", "日本語", "🙂x", "abababab"]
    buckets, starts = langid.subwords(words)
    together = np.split(buckets, starts[1:])
    for w, own in zip(words, together, strict=True):
        assert own.tolist() == langid.subwords([w])[0].tolist()
        assert len(own) == 1 + sum(max(0, len(w) + 3 - n) for n in (2, 3, 4)) and own.min() >= 0 and own.max() < langid.BUCKETS


def test_language_letters():
    """Words are runs of letters as Unicode has them: no fractions, powers, Roman numerals or circled numbers."""
    for c in map(chr, [*range(0xD800), *range(0xE000, 0x30000)]):
        assert bool(langid._words(c)) == unicodedata.category(c).startswith("L"), hex(ord(c))
    assert not langid._words("½ ² Ⅷ ① 12 %") and langid._words("m² à½b") == ["m", "à", "b"]


def test_language_rejects_strangers(docs):
    rows = docs.where("doc_id % 3 <> 1").select("text", "lang").collect()
    model = langid.fit([r["text"] for r in rows], [r["lang"] for r in rows])
    judge = langid.Predictor(model)
    assert all(judge.score(t)[1] < model.threshold for t in ("日本語のテキスト", "привет мир как дела"))
    assert np.isfinite(model.logits).all()


# 1 ---------------------------------------------------------------------------------------------------------------
def test_seeds_miss_nothing():
    """All stretches of 13 to 24 tokens, and all items of 5 to 12, with any fifth of the tokens substituted, share a seed."""
    for n in range(5, 25):
        seeds = [sum(1 << at + o for o in mask) for mask in (decontamination.SEEDS if n >= 13 else decontamination.SHORT_SEEDS) for at in range(n - mask[-1])]
        for lost in combinations(range(n), n // 5):
            gone = sum(1 << i for i in lost)
            assert any(not s & gone for s in seeds), (n, lost)


def brute_overlap(doc, item):
    """Whether some diagonal has a stretch of at least 13 tokens, four fifths the same (of short items: the whole)."""
    n = len(item)
    if n < 5:
        return False
    places = {w: [k for k in range(n) if item[k] == w] for w in item}
    equal = Counter(i - k for i, w in enumerate(doc) for k in places.get(w, ()))
    for start in (d for d, many in equal.items() if many * 5 >= 4 * min(n, 13)):  # 13 tokens, four fifths of them the same, are 11
        same = [0 <= start + k < len(doc) and doc[start + k] == item[k] for k in range(n)]
        inside = [k for k in range(n) if 0 <= start + k < len(doc)]
        if n < 13:
            if len(inside) == n and sum(same) * 5 >= 4 * n:
                return True
            continue
        for a in range(len(inside)):
            for b in range(a + 13, len(inside) + 1):
                if sum(same[k] for k in inside[a:b]) * 5 >= 4 * (b - a):
                    return True
    return False


def test_decontamination(spark, sf, docs):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = {r["item_id"]: decontamination.tokens(r["text"]) for r in bench.collect()}
    some = {r["doc_id"]: r["text"] for r in docs.where("n_chars < 1500").limit(40).collect()}
    words = items[3]
    changed = [w if k % 5 else "zz" for k, w in enumerate(words)]
    planted = {90_001: "before " * 7 + " ".join(changed) + " after" * 5, 90_002: " ".join(words[4:20]).upper(), 90_003: " ".join(words[:12]), 90_004: ", ".join(w if k % 3 else "qq" for k, w in enumerate(words)), 90_005: " ".join(words) + ". " + " ".join(items[4])}
    texts = {**some, **planted, 90_006: "", 90_007: "the " * 20_000}
    df = spark.createDataFrame(list(texts.items()) + [(90_008, None)], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(df, bench).collect()}
    wanted = {(d, i) for d, t in texts.items() if d < 90_007 for i, w in items.items() if brute_overlap(decontamination.tokens(t), w)}
    assert found == wanted and {(90_001, 3), (90_002, 3), (90_005, 3), (90_005, 4)} <= found and not {d for d, _ in found} & {90_003, 90_004, 90_006, 90_007}
    left = {r["doc_id"] for r in decontamination.drop_contaminated(df, bench).collect()}
    assert left == set(texts) - {d for d, _ in found} | {90_008}
    assert decontamination.contaminated(none_of(spark), bench).count() == 0
    assert decontamination.contaminated(df, bench.limit(0)).count() == 0


def test_decontamination_short_items(spark):
    """Items of 5 to 12 tokens, a fifth of which may differ; repeated rows and items, null ids, items of fewer tokens."""
    items = [(1, "one two three four five"), (2, "a b c d e f g h i j k l"), (3, "too short"), (None, "six seven eight nine ten eleven"), (2, "a b c d e f g h i j k l")]
    docs = [(10, "say One two, other four five now"), (11, "one two other four other"), (12, "x a b c zz e f g yy i j k l x"), (13, "six seven eight nine ten twelve"), (13, "six seven eight nine ten twelve"), (14, "too short"), (15, None)]
    bench = spark.createDataFrame(items, "item_id int, text string")
    found = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()
    assert sorted((r["doc_id"], r["item_id"] or 0, r["n_tokens"], r["n_same"]) for r in found) == [(10, 1, 5, 4), (12, 2, 12, 10), (13, 0, 6, 5), (13, 0, 6, 5)]


def test_decontamination_joins(spark, sf, docs, monkeypatch):
    """The same rows with a filter that lets nearly everything pass and with joins that shuffle."""
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    whole = sorted(tuple(r) for r in decontamination.contaminated(docs, bench).collect())
    monkeypatch.setattr(decontamination, "FILTER_BITS", (8, 8))
    monkeypatch.setattr(decontamination, "bounded_broadcast", lambda df: df)
    assert whole and sorted(tuple(r) for r in decontamination.contaminated(docs, bench).collect()) == whole


# 2 ---------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("", ""),
        ("a  b\n c", "a b c"),
        ("<title>t</title><p>a<p>b", "a\n\nb"),
        ("<div>a</div><div>b<br>c</div>", "a\nb\nc"),
        ("<ul><li>one<li>two<ol start=3><li>x<li>y</ol></ul>", "- one\n- two\n  3. x\n  4. y"),
        ("<table><tr><th>Name<th>N<tr><td>abc<td>1<tr><td colspan=2>wide</table>", "Name  N\nabc   1\nwide"),
        ("<p>a<span hidden>b</span><span style='display : none'>c</span><script>var x='</p>'</script>d</p>", "ad"),
        ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b></div>c", "b\nc"),
        ("<pre>a\n  b</pre>", "a\n  b"),
        ("<details><summary>S</summary>x</details><details open><summary>T</summary>y</details>", "S\nT\ny"),
        ("a&lt;b&nbsp;c &copy;<!-- no --> d", "a<b c © d"),
        ("<p>a</b></i>b</p></div>c", "ab\n\nc"),
        ("<a href='x>y'>z</a> <a title=\"unclosed>w", "z w"),
        ("<dl><dt>t<dd>d</dl>", "t\n  d"),
        ("x<textarea> a\n b</textarea>", "x a\n b"),
        ("a < b > c", "a < b > c"),
    ],
)
def test_html(page, wanted):
    assert html_text.visible_text(page) == wanted


@pytest.mark.parametrize(
    "page, wanted",
    [
        ("<html><head><title>t</title><p>all the text", "all the text"),
        ("<html><head><meta charset=utf-8><title>t</title> all <b>the</b> text", "all the text"),
        ("<head><style>x</style><script>y</script><img src=z><h1>a</h1>b", "a\n\nb"),
        ("<head><title>t</title></br>a", "a"),
        ("<head><title>t</title><template><p>unseen</template></head><body>a", "a"),
        ("<table><td>a<td>b<tr><td>c<td>d</table>", "a  b\nc  d"),
        ("<table><tbody><td>a<td>b</tbody><tbody><td>c</table>", "a  b\nc"),
        ("<table><tr><td>a<tbody><tr><td>b</table>", "a\nb"),
        ("<table><tr><form><td>a</td><td>b</td></form></tr></table>", "a  b"),
        ("<table><form><tr><td>a</td></tr></form></table>", "a"),
        ("x<table><tr>loose <b>bold</b><td>a</table>y", "x loose bold\n\na\n\ny".replace("x loose", "xloose")),
        ("<table><tbody><div>d</div><tr><td>a</table>", "d\n\na"),
        ("<table><tr><td>a<caption>c</caption></table>", "c\na"),
        ("<table><tr><td>a<table><tr><td>b</table>c<td>d</table>", "a  d\n\nb\n\nc"),
        ("<table><tr><td>a<table><td>b</table></table>", "a\n\nb"),
        ("<table><tr><td>one<br>two<td>x<tr><td>three<td>y</table>", "one    x\ntwo\nthree  y"),
        ("<table><tr><td><ul><li>n<li>m</ul><td><p>" + "long " * 12 + "<p>b<pre>k\n  l</pre></table>", "- n\n- m\n" + ("long " * 12).strip() + "\n\nb\n\nk\n  l"),
        ("<div>" * 600 + "<table><tr><td>a<td>b", "ab"),
        ("<div>" * 508 + "<table><tbody><tr><td>a<td>b", "a  b"),
    ],
)
def test_html_implied(page, wanted):
    assert html_text.visible_text(page) == wanted


@pytest.mark.parametrize(
    ("page", "wanted"),
    [
        ("<div HIDDEN>secret</div>x", "x"),
        ("<p STYLE='Display : None'>no</p><DETAILS OPEN><summary>s</summary>in</DETAILS>", "s\nin"),
        ('<table><tr style="visibility:hidden"><td>a<tr><td>b</table>', "b"),
        ('<table><tbody style="visibility:collapse"><tr><td>a<td style="visibility:visible">b</table>c', "  b\n\nc"),
        ("<table><tr><td rowspan=2>A<td>b<tr><td>c<tr><td>d<td>e</table>", "A  b\n   c\nd  e"),
        ("<table><tr><td>a<td rowspan=2 colspan=2>B<td>c<tr><td>d<td>e</table>", "a  B   c\nd      e"),
        ("<svg><title>no</title><g>loose<path d=x/><text>drawn <tspan>text</tspan></text></g><defs><text>no</text></defs></svg>", "drawn text"),
        ("<math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>no</annotation></math>", "x=1"),
        ("a<!-- c --!>b<!-->c<!--->d<!--!>e-->f<!---->g<!-- open", "abcdfg"),
        ("<ol reversed><li>a<li>b<li>c</ol><ol reversed start=9><li>x<li value=4>y<li>z</ol>", "3. a\n2. b\n1. c\n\n9. x\n4. y\n3. z"),
        ("<div style='white-space: PRE-wrap'>a  b\n c<p style='white-space:normal'>d  e</div>", "a  b\n c\n\nd e"),
        ("<map name=m><p>in the map</p><area href=x></map>", "in the map"),
        ("<input type=email value=e@x> <input type=URL value=u> <input type=number value=5> <input type=hidden value=no> <input type=password value=no>", "e@x u 5"),
    ],
)
def test_html_visibility(page, wanted):
    assert html_text.visible_text(page).strip("\n") == wanted.strip("\n")


def brute_visible(page):
    """Words of visible text by the parser of the standard library, which knows no implied tags: for well-formed pages only."""
    from html.parser import HTMLParser

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__()
            self.hidden, self.words = [], []

        def handle_starttag(self, tag, attrs):
            if tag not in html_text.VOID:
                at = dict(attrs)
                self.hidden.append((tag, tag in ("head", "script", "style", "template", "title", "svg") or "hidden" in at or "display:none" in (at.get("style") or "").replace(" ", "")))

        def handle_endtag(self, tag):
            while self.hidden and any(t == tag for t, _ in self.hidden):
                if self.hidden.pop()[0] == tag:
                    break

        def handle_data(self, data):
            if not any(h for _, h in self.hidden):
                self.words += data.split()

    reader = Reader()
    reader.feed(page)
    return reader.words


def test_html_all_text():
    """Every visible word of random well-formed pages stands in the output, in order; bullets and numbers are left out by words of letters."""
    rng = np.random.default_rng(11)

    def content(depth):
        out = []
        for _ in range(int(rng.integers(1, 5))):
            word = "w" + "".join(chr(97 + int(c)) for c in rng.integers(0, 26, 6))
            kind = int(rng.integers(10)) if depth < 5 else 9
            inner = content(depth + 1) if kind < 8 else ""
            out.append([f"<div>{inner}</div>", f"<ul><li>{inner}</li><li>{word}</li></ul>", f"<span hidden>{inner}</span>", f"<section><h2>{word}</h2>{inner}</section>", f"<blockquote>{inner}</blockquote>", f"<b>{inner}</b>", f'<div style="display: none">{inner}</div>', f"<table><tr><td>{word}</td></tr><tr><td>{inner}</td></tr></table>", f"<!-- {word} --><script>{word}</script>", f"{word} "][kind])
        return "".join(out)

    for _ in range(150):
        page = f"<html><head><title>no</title></head><body>{content(0)}</body></html>"
        glued = lambda words: "".join(re.findall("[a-z]+", " ".join(words)))  # noqa: E731 - where words touch, both readings do
        assert glued(html_text.visible_text(page).split()) == glued(brute_visible(page))


def test_html_odd(spark, sf):
    pages = spark.createDataFrame([(1, None, "x", "y"), (2, "<p>" * 30_000 + "a", "x", "y"), (3, "<table>" * 300 + "b", "x", "y"), (None, "c", "x", "y")], "page_id long, html string, text string, url string")
    found = {r["page_id"]: r["text"] for r in html_text.page_texts(pages).collect()}
    assert found == {1: "", 2: "a", 3: "b", None: "c"}
    assert html_text.rendered(pages).columns == ["page_id", "html", "url", "text"]
    real = spark.read.parquet(f"{sf}/pages.parquet")
    assert html_text.page_texts(real).where("text LIKE '%track(%' OR text LIKE '%margin:0%' OR n_chars = 0").count() == 0


# 4 ---------------------------------------------------------------------------------------------------------------
def test_tool_calls(spark):
    schemas = {"add": {"a": (("BIGINT", "DOUBLE"), True), "b": (("BIGINT",), False)}}
    calls = [
        (1, "r", 0, "add", '{"b": 2, "a": 1}', None), (1, "s", 1, "add", '{"a": 1.5}', "r"), (1, "t", 2, "add", '{"a": 1}', "s"), (1, "r", 3, "add", "{}", None), (1, "u", 4, "add", "[1]", None), (1, "v", 5, "add", '{"a":"x"}', None),
        (1, "w", 6, "add", '{"a":1,"z":1}', None), (1, "x", 7, "no", '{"a":1}', None), (1, "y", 8, "add", '{"a":1}', "gone"), (1, "p", 9, "add", '{"a":1}', "q"), (1, "q", 10, "add", '{"a":1}', "p"), (1, None, 11, "add", "{}", None), (None, "r", 3, "add", '{"a":1}', None), (None, "s", 4, "add", '{"a":1}', "r"), (2, "r", 0, "add", '{"a":1}', None), (1, "n", 12, "add", None, None),
    ]
    results = [(1, c[1], i, f'say "{c[1]}"\n') for i, c in enumerate(calls) if c[0] == 1 and c[1]] + [(1, "orphan", 5, "x"), (1, "orphan", 7, "y"), (1, "t", 99, None), (None, "r", 4, "z"), (3, None, 1, "n")]
    df = tool_calls.linked(spark.createDataFrame(calls, "conv long, id string, seq long, tool string, arguments string, parent string"), spark.createDataFrame(results, "conv long, id string, seq long, content string"), schemas)
    found = {(r["conv"], r["call_id"]): r for r in df.collect()}
    assert {k[1]: r["status"] for k, r in found.items() if k[0] == 1} == {"r": "ok", "s": "ok", "t": "ok", "u": "bad_json", "v": "bad_arguments", "w": "bad_arguments", "x": "unknown_tool", "y": "lost_parent", "p": "cyclic", "q": "cyclic", "n": "bad_json", "orphan": "no_call", None: "no_id"}
    assert found[2, "r"]["status"] == "pending" and found[1, "t"]["depth"] == 2 and found[1, "p"]["depth"] is None and found[1, "t"]["n_results"] == 2
    assert found[1, "r"]["json"] == '{"arguments":{"a":1,"b":2},"call_id":"r","depth":0,"name":"add","result":"say \\"r\\"\\n"}'
    assert all(json.loads(r["json"]) for r in found.values())
    assert (found[1, "orphan"]["seq"], found[1, "orphan"]["n_results"], json.loads(found[1, "orphan"]["json"])["result"]) == (5, 2, "x")
    assert found[3, None]["status"] == "no_call" and found[None, "r"]["status"] == "ok" and found[None, "s"]["depth"] == 1 and found[None, "s"]["status"] == "pending"
    places = {i: found[1, i]["place"] for i in ("r", "u", "v", "w", "x", "y", "n", "s", "t", "p")}
    assert places == {"r": 1, "u": 2, "v": 3, "w": 4, "x": 5, "y": 6, "n": 7, "s": 8, "t": 9, "p": None}


def test_tool_calls_odd(spark):
    """Empty tables, columns of the operator's own names, and very long arguments and contents."""
    kinds = "conv long, id string, seq long, tool string, arguments string, parent string", "conv long, id string, seq long, content string"
    empty = [spark.createDataFrame([], k) for k in kinds]
    assert tool_calls.linked(*empty, {}).count() == 0
    long = "x" * 300_000
    calls = spark.createDataFrame([(1, "a", 0, "t", json.dumps({"v": long}), None)], kinds[0])
    results = spark.createDataFrame([(1, "a", 1, long)], kinds[1])
    clashing = ("own", "called", "status", "depth", "place", "json", "content", "lost")
    wide = calls.select("*", *(F.lit(7).alias(c) for c in clashing)), results.select("*", *(F.lit(8).alias(c) for c in clashing if c != "content"))
    (found,) = tool_calls.linked(*wide, {"t": {"v": (("STRING",), True)}}).collect()
    assert (found["status"], found["depth"], found["place"]) == ("ok", 0, 1) and json.loads(found["json"])["result"] == long == json.loads(found["json"])["arguments"]["v"]
    assert tool_calls.linked(calls, empty[1], {}).first()["status"] == "unknown_tool" and tool_calls.linked(empty[0], results, {}).first()["status"] == "no_call"


def test_tool_call_chain(spark):
    calls = spark.range(100).select(F.lit(1).alias("conv"), F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent"))
    assert {int(r["id"]): r["depth"] for r in tool_calls.depths(calls).collect()} == {i: i for i in range(100)}


# 8 ---------------------------------------------------------------------------------------------------------------
def test_licenses(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n"
    rows = [(1, None), (2, ""), (3, "Text.\nReleased under the MIT License.\nReleased under the MIT License."), (4, mit), (5, mit + 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'), (6, "released under the mit licence"), (7, mit.split("\n")[0] + "\n" + "Line.\n" * 9 + mit.split("\n")[2])]
    found = [(r["doc_id"], r["rule"]) for r in licenses.scanned(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()]
    assert found == [(3, "mit_notice"), (4, "mit_grant"), (5, "mit_text")]


MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""
MIT_AS_IS = """
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE.
"""
GPL_GRANT = """    This program is free software{} you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation{} either version {} of the License, or
    (at your option) any later version.
"""
GPL_REST = """
    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD_3 = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
APACHE = """   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
BSD_AS_IS = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE.
"""
LGPL_GRANT = """This {0} is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version {1} of the License, or (at your option) any later version.
"""
LGPL_REST = """
This {0} is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
Lesser General Public License for more details.
"""
EPL = """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at {}
"""
ZLIB = """This software is provided 'as-is', without any express or implied
warranty.  In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not
   claim that you wrote the original software. If you use this software
   in a product, an acknowledgment in the product documentation would be
   appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be
   misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.
"""
BSL = """Permission is hereby granted, free of charge, to any person or organization
obtaining a copy of the software and accompanying documentation covered by
this license (the "Software") to use, reproduce, display, distribute,
execute, and transmit the Software, and to prepare derivative works of the
Software, and to permit third-parties to whom the Software is furnished to
do so, all subject to the following:
"""
APACHE_TEXT = """   2. Grant of Copyright License. Subject to the terms and conditions of
      this License, each Contributor hereby grants to You a perpetual,
      worldwide, non-exclusive, no-charge, royalty-free, irrevocable
      copyright license to reproduce, prepare Derivative Works of,
      publicly display, publicly perform, sublicense, and distribute the
      Work and such Derivative Works in Source or Object form.
"""
ISC_AS_IS = """
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE.
"""
AGPL_GRANT, AGPL_REST = (x.replace("GNU\n    General", "GNU Affero\n    General").replace("GNU General", "GNU Affero General") for x in (GPL_GRANT, GPL_REST))
LICENCE_TEXTS = {
    "mit_text": MIT_GRANT + MIT_AS_IS,
    "mit_grant": MIT_GRANT,
    "mit_notice": "Released under the\nMIT License.",
    "mit_notice_2": "Licensed under the MIT\nlicense.",
    "apache_header": APACHE + "   You may obtain a copy of the License at\n\n       http://www.apache.org/licenses/LICENSE-2.0\n",
    "apache_header_short": APACHE.replace("2.0 (the", "2.0\n(the"),
    "apache_notice": "Licensed under the Apache License,\nVersion 2.0.",
    "gpl3_header": GPL_GRANT.format(":", ", ", "3") + GPL_REST,
    "gpl3_grant": GPL_GRANT.format(":", ", ", "3"),
    "gpl3_notice": "This work is licensed under the GNU General\nPublic License version 3.",
    "gpl2_header": GPL_GRANT.format(";", "; ", "2") + GPL_REST,
    "gpl2_grant": GPL_GRANT.format(";", "; ", "2"),
    "bsd3_text": BSD + BSD_3,
    "bsd2_text": BSD,
    "cc_by_nc_notice": "Licensed under\nCC BY-NC 4.0.",
    "cc_by_notice": "Licensed under\nCC BY 4.0.",
    "cc_by_sa_notice": "Licensed under\nCC BY-SA 4.0.",
    "cc_by_deed": "This work is licensed under a Creative Commons\nAttribution 4.0 International License.",
    "cc_by_sa_deed": "This work is licensed under a Creative Commons\nAttribution-ShareAlike 4.0 International License.",
    "cc_by_nc_deed": "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License.",
    "unlicense_text": "This is free and unencumbered software released\ninto the public domain.",
    "mpl2_header": "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one.",
    "isc_text": ISC + MIT_AS_IS,
    "isc_grant": ISC + '\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES.',
    "spdx_mit": "SPDX-License-Identifier: MIT",
    "spdx_apache": "// SPDX-License-Identifier: Apache-2.0\n",
    "spdx_gpl3": "/* SPDX-License-Identifier: GPL-3.0-only */",
    "spdx_gpl3_later": "# SPDX-License-Identifier: GPL-3.0-or-later\nimport os",
    "spdx_bsd3": "SPDX-License-Identifier: BSD-3-Clause",
    "agpl3_header": AGPL_GRANT.format(":", ", ", "3") + AGPL_REST,
    "agpl3_grant": AGPL_GRANT.format(":", ", ", "3"),
    "lgpl21_header": LGPL_GRANT.format("library", "2.1") + LGPL_REST.format("library"),
    "lgpl21_grant": LGPL_GRANT.format("library", "2.1"),
    "lgpl3_header": LGPL_GRANT.format("program", "3") + LGPL_REST.format("program"),
    "lgpl3_grant": LGPL_GRANT.format("program", "3"),
    "epl2_header": EPL.format("https://www.eclipse.org/legal/epl-2.0/"),
    "epl2_header_2": EPL.format("http://www.eclipse.org/legal/epl-2.0."),
    "bsl1_text": BSL,
    "zlib_text": ZLIB,
    "zlib_grant": ZLIB[ZLIB.index("Permission") : ZLIB.index("2.")],
    "bsd3_whole": BSD + BSD_3 + BSD_AS_IS,
    "bsd2_whole": BSD + BSD_AS_IS,
    "isc_whole": ISC + ISC_AS_IS,
    "apache_text": APACHE_TEXT,
    "spdx_bsd2": "SPDX-License-Identifier: BSD-2-Clause",
    "spdx_mpl2": "<!-- SPDX-License-Identifier: MPL-2.0 -->",
    "spdx_isc": "SPDX-License-Identifier: ISC",
    "spdx_agpl3_later": "SPDX-License-Identifier: AGPL-3.0-or-later",
    "spdx_lgpl21_later": "SPDX-License-Identifier: LGPL-2.1-or-later",
    "spdx_unlicense": "; SPDX-License-Identifier: Unlicense",
}


@pytest.mark.parametrize("form", ["{}", "Copyright 2020 A.\n\n{}\nMore text.", "commented", "windows"])
def test_licenses_as_published(spark, form):
    """Every rule on its licence's own punctuation and line ends: bare, inside a text, in a comment, with CRLF."""
    shown = {"commented": lambda t: "\n".join(" * " + x for x in t.split("\n")), "windows": lambda t: t.replace("\n", "\r\n")}.get(form, form.format)
    assert list(LICENCE_TEXTS) == [name for name, *_ in licenses.RULES]
    found = licenses.scanned(spark.createDataFrame([(k, shown(t)) for k, t in LICENCE_TEXTS.items()], "doc_id string, text string")).collect()
    assert sorted((r["doc_id"], r["rule"]) for r in found) == sorted((k, k) for k in LICENCE_TEXTS)


# 9 ---------------------------------------------------------------------------------------------------------------
def test_language_model(docs, local):
    found = {r["doc_id"]: r for r in language_model.scored(docs).collect()}
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) + ["\n"]
    counts = Counter(w for d, t in local.items() if zlib.crc32(str(d).encode()) % 5 != 1 for w in split(t))
    total, distinct = sum(counts.values()), len(counts)
    for d, t in local.items():
        words, r = split(t), found[d]
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in words)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert abs(r["base_score"] - base) <= 1e-9 * abs(base) + 1e-9
        assert r["score"] < 0 and r["score"] > base + len(words) * math.log10(1 - language_model.MIX) - 1e-6
    held = [r for r in found.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_rare_tokens(docs, monkeypatch):
    """Scores don't depend on how many counts are shipped and how many are joined."""
    whole = {r["doc_id"]: r["base_score"] for r in language_model.scored(docs).collect()}
    monkeypatch.setattr(language_model, "FREQUENT", 300)
    for r in language_model.scored(docs).collect():
        assert abs(r["base_score"] - whole[r["doc_id"]]) < 1e-6


def test_language_model_odd(spark, odd):
    found = language_model.scored(odd).collect()
    assert len(found) == odd.count() and all(np.isfinite(r["score"]) and np.isfinite(r["base_score"]) for r in found)
    assert {r["n_tokens"] for r in found if r["doc_id"] in (0, 1, 2)} == {1}
    assert language_model.scored(none_of(spark)).count() == 0
    nobody = odd.where("doc_id = 4").withColumn("doc_id", F.lit(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)))
    assert {r["n_known"] for r in language_model.scored(nobody).collect()} == {0}


def test_language_model_trains_on_all(spark, monkeypatch):
    """Every training document reaches the network, also beyond a million tokens, and is in one round."""
    many = spark.range(0, 3000, 1, 4).select(F.col("id").alias("doc_id"), F.concat(F.lit("word " * 600), F.col("id").cast("string")).alias("text"))
    seen = []
    monkeypatch.setattr(language_model, "train", lambda texts, lex: (seen.append(texts), gru.start(lex.unigrams))[1])
    language_model.scored(many)
    wanted = sum(zlib.crc32(str(i).encode()) % 5 != 1 for i in range(3000))
    assert seen[0].distinct().count() == wanted
    rounds = [{r["text"] for r in language_model.of_round(seen[0], k).collect()} for k in range(language_model.ROUNDS)]
    assert all(rounds) and sum(map(len, rounds)) == len(set().union(*rounds)) == wanted


def brute_log_probabilities(w, doc, first):
    """The network token by token, in plain Python."""
    h, before, out = [0.0] * gru.HIDDEN, first, []
    logistic = lambda x: 1 / (1 + math.exp(-x))
    n = gru.HIDDEN
    for token in doc:
        u = [sum(h[i] * float(w.over[i, j]) for i in range(n)) for j in range(3 * n)]
        a = [float(x) for x in w.into[before]]
        z = [logistic(2 * (a[j] + u[j])) for j in range(n)]
        r = [logistic(2 * (a[n + j] + u[n + j])) for j in range(n)]
        cand = [math.tanh(a[2 * n + j] + 2 * r[j] * u[2 * n + j]) for j in range(n)]
        h = [z[j] * h[j] + (1 - z[j]) * cand[j] for j in range(n)]
        c, k = divmod(int(token), gru.CLASS)
        of_class = [sum(h[i] * float(w.classes[i, j]) for i in range(n)) + float(w.class_bias[j]) for j in range(w.classes.shape[1])]
        of_word = [sum(h[i] * float(w.words[j, i]) for i in range(n)) + float(w.word_bias[j]) for j in range(c * gru.CLASS, (c + 1) * gru.CLASS)]
        out.append(of_class[c] - math.log(sum(map(math.exp, of_class))) + of_word[k] - math.log(sum(map(math.exp, of_word))))
        before = token
    return out


def test_gru_scores():
    """Against plain Python, however the documents are laid into lanes, and after training."""
    rng = np.random.default_rng(1)
    w = gru.start(rng.integers(1, 50, 2 * gru.CLASS).astype(float))
    docs = [rng.integers(0, 2 * gru.CLASS, n).astype(np.int32) for n in [*rng.integers(1, 40, 49), 300]]
    trainer = gru.Trainer(w)
    before = -gru.score(w, docs, 5).sum()
    assert trainer.learn(docs, 5)[1] == sum(map(len, docs))
    wanted = [x for d in docs for x in brute_log_probabilities(trainer.w, d, 5)]
    found = gru.score(trainer.w, docs, 5)
    assert np.allclose(found, wanted, atol=2e-4) and -found.sum() < before
    for name in ("words", "classes"):  # scores beyond the range of exponentials
        getattr(trainer.w, name)[:] *= 300
    assert np.isfinite(gru.score(trainer.w, docs, 5)).all()


def test_gru_memory():
    """Memory is in proportion to the tokens: a document of a million beside 511 short ones stays far below a gigabyte."""
    rng = np.random.default_rng(2)
    docs = [rng.integers(0, 999, n).astype(np.int32) for n in [1_000_000, *[5] * 511]]
    tracemalloc.start()
    lanes = gru.Lanes(docs, gru.LANES, 0)
    seen = sum(int(real.sum()) for _, real in lanes.windows(gru.LANES * gru.WINDOW, gru.WINDOW))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert seen == 1_000_000 + 5 * 511 and peak < 200e6


def test_gru_gradients():
    """Backpropagation against differences, and probabilities that sum to one."""
    rng = np.random.default_rng(0)
    w = gru.start(rng.integers(1, 50, 2 * gru.CLASS).astype(float))
    for name in ("into", "over", "classes", "words"):
        setattr(w, name, rng.normal(0, 0.3, getattr(w, name).shape))
    for name in ("class_bias", "word_bias"):
        setattr(w, name, getattr(w, name).astype(np.float64))
    docs = [rng.integers(0, 2 * gru.CLASS, n).astype(np.int32) for n in (7, 4, 3)]
    lanes = gru.Lanes(docs, 2, 0)
    index, real = next(lanes.windows(100, 1))
    trainer = gru.Trainer(w)
    h = np.zeros((2, gru.HIDDEN))
    loss = lambda: trainer.gradients(h, lanes.input[index], lanes.token[index], real, lanes.fresh[index] & real)
    value, grads, (words, _), (rows, d_into), _ = loss()
    n = int(real.sum())
    assert abs(value + gru.score(w, docs, 0).sum()) < 1e-3
    into = np.zeros_like(w.into)
    into[rows] = d_into
    for name, grad in (("over", grads["over"]), ("classes", grads["classes"]), ("class_bias", grads["class_bias"]), ("words", words), ("into", into)):
        array = getattr(w, name)
        for at in zip(*(rng.integers(0, k, 6) for k in array.shape), strict=True):
            keep, step = array[at], 1e-5
            array[at] = keep + step
            up = loss()[0]
            array[at] = keep - step
            down = loss()[0]
            array[at] = keep
            assert abs((up - down) / (2 * step) / n - grad[at]) < 1e-4, name
    state = rng.normal(size=(1, gru.HIDDEN))
    every = gru.log_probabilities(w, np.repeat(state, 2 * gru.CLASS, 0), np.arange(2 * gru.CLASS))
    assert abs(np.exp(every).sum() - 1) < 1e-6


# 10 --------------------------------------------------------------------------------------------------------------
def test_shards(spark, docs, odd):
    for df in (docs, odd, none_of(spark), spark.range(3000).select(F.lit(5).alias("doc_id"), F.lit("same").alias("text"))):
        rows = sharding.document_shards(df).collect()
        assert len(rows) == df.count()
        total, largest = sum(r["size"] for r in rows), max((r["size"] for r in rows), default=0)
        for k in range(8):
            own = [r for r in rows if r["shard"] == k]
            assert sorted(r["slot"] for r in own) == list(range(len(own)))
            assert abs(sum(r["size"] for r in own) - total / 8) <= largest
    for r in sharding.document_shards(odd).join(odd.select("doc_id", "text"), "doc_id").where("doc_id <> 4").collect():
        assert (r["size"], r["text_crc32"]) == (len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode()))


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == docs.count() and {r["shard"] for r in back.select("shard").distinct().collect()} == {0, 1, 2}
