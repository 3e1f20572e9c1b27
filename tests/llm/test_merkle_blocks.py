"""What a review of round 3 found in the manifest: a plan for each halving filled the driver."""

import random

import pytest
from pyspark.sql import functions as F

from loomgate.llm import merkle
from tests.llm.test_merkle_minhash_spelling import brute_manifest, found_manifest, rows_of


@pytest.mark.parametrize("fanout", [2, 3, 300])
def test_manifest_of_several_blocks(spark, fanout):
    """Trees of one block, of just one more, and of several rounds, each leaf with the path that the plain tree gives."""
    rng = random.Random(fanout)
    rows = [(i, "s", lang, rng.choice([None, i]), f"text {i}") for lang, n in (("a", 256), ("b", 257), ("c", 700), (None, 243), ("d", 1)) for i in range(1000 * n, 1000 * n + n)]
    rng.shuffle(rows)
    assert found_manifest(rows_of(spark, rows), fanout) == brute_manifest(rows, fanout)


def test_rounds_of_a_manifest(spark):
    """A round takes eight halvings, so joins don't grow with the tree's height."""
    nodes = spark.range(1000).select(F.lit(0).cast("long").alias("tree"), F.col("id").alias("idx"), F.lit(1000).cast("long").alias("m"), merkle.digest(F.col("id").cast("string")).alias("digest"), F.struct("id").alias("row"))
    rounds = merkle.grown(nodes, 1000, 1000)
    assert [r.count() for r in rounds] == [4, 1]
    assert rounds[-1].select("m").first()[0] == 1
