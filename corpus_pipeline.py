"""A training corpus from raw documents: bad texts go, one of each group of near copies stays, documents that hold
benchmark items go, secrets are masked, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the columns of
``documents`` (the last: the pieces). ``run`` writes each stage's rows in the shared folder before the next reads
them, so that a lost executor costs one stage at most.

Texts go to Python ``BATCH_ROWS`` at a time at most: the stages that only describe their rows, and are written later, set this on the session that
they are given.

Defined results: rows with a null doc_id stay rows of their own: they are scored, meet their near copies by text, are never
held to contain an item, are masked and packed. Null and empty texts are scored as one empty passage, link with nothing and are
packed as their end id. Of a group of near copies the smallest doc_id stays (null ids last), then the smallest hash of the text;
of rows equal in both, the first by the other columns. Rows that repeat are judged one by one but for that. Columns beside those
of ``documents`` pass through, whatever their names, until the last stage. Empty tables give empty tables; without labels every text
scores 0.5 and stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedimenta.llm import decontamination, jaccard_join, mil_quality, packing, secrets
from sedimenta.llm.common import BATCH_KEY, BATCH_ROWS, stored, table


def few_at_a_time(spark: SparkSession) -> None:
    held = int(spark.conf.get(BATCH_KEY))
    if not 0 < held <= BATCH_ROWS:
        spark.conf.set(BATCH_KEY, str(BATCH_ROWS))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    few_at_a_time(spark)
    return mil_quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs, k=5, num=80, den=100)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_items(docs, table(spark, sf_dir, "benchmark"))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    few_at_a_time(spark)
    return secrets.mask_secrets(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_with_public_tokenizer(docs)


STAGES = [
    ("quality_classifier", quality),
    ("jaccard_join", near_copies),
    ("decontamination", benchmark_items),
    ("secret_scans", mask),
    ("best_fit_packing", sequences),
]

#: The first stage is a trained model, which SQL cannot express; tests/llm/test_pipeline.py compares every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
