"""The pipeline against a brute-force version of each stage."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from loomgate.llm import byte_bpe, decontamination, langid
from tests.llm.test_operators import brute_exact, brute_overlap, brute_similar


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):
    """The test tables, with copies, near copies, leaks and junk among the documents."""
    out = tmp_path_factory.mktemp("tables")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    extra = docs.where("doc_id < 20").withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("text", F.regexp_replace("text", " ", "  "))
    near = docs.where("n_chars > 5000").withColumn("doc_id", F.col("doc_id") + 20_000).withColumn("text", F.concat("text", F.lit(" extra")))
    leak = docs.where("doc_id < 5").withColumn("doc_id", F.col("doc_id") + 30_000).withColumn("text", F.concat(F.lit("Look: "), F.lit(bench.first()["text"]), F.lit(" and more "), F.col("doc_id").cast("string")))
    junk = spark.createDataFrame([(40_000, None), (40_001, ""), (40_002, "%%% 123")], "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("x"), "n_chars": F.lit(0).cast("long")})
    docs.unionByName(extra).unionByName(near).unionByName(leak).unionByName(junk.select(docs.columns)).write.parquet(f"{out}/documents.parquet")
    bench.write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_pipeline(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    items = [decontamination.tokens(r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    rejected = {r["doc_id"] for r in langid.predicted_languages(docs).where("rejected").collect()}
    left = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] not in rejected}
    wanted = [set(left)]
    left = {d: left[d] for d, keep, _, _ in brute_exact(list(left.items())) if d == keep}
    wanted.append(set(left))
    component, pairs = brute_similar(left, 0.8)
    left = {d: t for d, t in left.items() if component[d] == d}
    wanted.append(set(left))
    grams = {tuple(i[k : k + 5]) for i in items for k in range(len(i) - 4)}
    suspects = {d for d, t in left.items() if any(tuple(w[k : k + 5]) in grams for w in [decontamination.tokens(t)] for k in range(len(w) - 4))}
    left = {d: t for d, t in left.items() if d not in suspects or not any(brute_overlap(decontamination.tokens(t), i) for i in items)}
    wanted.append(set(left))
    for (name, stage), ids in zip(pipeline.STAGES[:-1], wanted, strict=True):
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        assert {r["doc_id"] for r in docs.select("doc_id").collect()} == ids, name
    assert {40_000, 40_001, 40_002} <= rejected and not rejected & set(range(10_000))
    assert all(10_000 + i not in wanted[1] for i in range(20)) and all(30_000 + i not in wanted[3] for i in range(5))
    path, pattern = byte_bpe.default_vocabulary()
    with open(path, "rb") as f:
        own = byte_bpe.coder(f.read(), pattern)
    rows = {r["doc_id"]: r for r in pipeline.run(spark, folder).collect()}
    assert set(rows) == set(left)
    for d, t in left.items():
        assert rows[d]["n_tokens"] == len(own.encode(t)) and rows[d]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
