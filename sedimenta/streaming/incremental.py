"""The same operators over streams: documents in, evidence out; reviews in, latest decisions out; activity in, sessions out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.derivation import mentions
from ..operators.evidence import extract
from ..operators.graph import latest_reviews
from ..operators.text import tokenised


def evidence_to(path: str):
    """For ``foreachBatch``: the evidence of a micro-batch of lines. Keys come from content, so a batch that is replayed
    writes the folder of its own number again and adds nothing."""

    def write(batch: DataFrame, number: int) -> None:
        found = mentions(extract(tokenised(batch, "document_id", "project_id", "line_index")))
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest_to(path: str):
    """For ``foreachBatch``: the latest review of each target in a micro-batch, as a folder of its number; a batch that is replayed writes
    the same folder again. Nothing older is rewritten: ``latest_from`` reads the state off the batches."""

    def write(batch: DataFrame, number: int) -> None:
        latest_reviews(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def latest_from(spark: SparkSession, path: str) -> DataFrame:
    """The latest review of each target, by time and id, whatever the order of arrival."""
    return latest_reviews(spark.read.parquet(path).drop("batch"))


def sessions(activity: DataFrame, idle: str = "2 hours", late: str = "1 hour") -> DataFrame:
    """Sessions of each user: activity without a gap of ``idle``."""
    rows = activity.withWatermark("ts", late) if activity.isStreaming else activity
    return rows.groupBy("user_id", F.session_window("ts", idle).alias("s")).agg(F.count("*").alias("n_events")).select("user_id", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n_events")


def action_counts(activity: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    rows = activity.withWatermark("ts", late) if activity.isStreaming else activity
    return rows.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
