"""From documents to training tokens, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents.

1. language_id      drops documents whose language is rejected: no letters, or a score below the fitted threshold
2. exact_dedup      keeps one document of each group of equal texts, the one with the smallest doc_id
3. simhash          keeps one document of each component of texts whose sets of five-word shingles have a similarity of 0.8 or
                    more, the one with the smallest doc_id
4. decontamination  drops documents that hold a passage of the benchmark
5. byte_bpe         encodes and decodes each text: doc_id, n_tokens, ids_sha256, decoded_sha256

SQL expresses none of stages 1, 3, 4 and 5, so ORACLE_SQL is None; tests hold run() against a
brute-force version of every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomgate.llm import byte_bpe, decontamination, exact_dedup, langid, simhash
from loomgate.llm.common import materialise, read

ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return langid.drop_rejected(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.coding_digest(docs)


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("simhash", near), ("decontamination", decontaminate), ("byte_bpe", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; the rows of the last."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
