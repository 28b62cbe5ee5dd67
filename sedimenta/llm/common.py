"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but the space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (``spark.checkpoint.dir``); a temporary one only where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sedimenta-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


#: Rows that go to Python at a time while a table is written: whole texts among them make larger batches heavy.
BATCH_ROWS, BATCH_KEY = 2000, "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(BATCH_KEY)
    spark.conf.set(BATCH_KEY, str(min(BATCH_ROWS, int(before)) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as a table in the shared folder and reads it back, so that its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array (native)."""
    return F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once a row, even where lambdas in ``body`` use it for each element
    (the optimizer would otherwise write its expression into them)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def documents_of(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` (null: empty) alone, whatever else the table holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))


def text_bytes(docs: DataFrame, column: str = "text") -> int:
    """Bytes of all texts: one aggregate over all rows, to size chunks and buckets by."""
    return int(docs.agg(F.sum(F.octet_length(F.col(column)))).first()[0] or 0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
