"""Ranks within keys by sorted ranges: no key, however hot, is ever ordered by one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stages import staged


def ranked(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """``rows`` with ``rank``, the number of rows of the same key before each by ``order`` (which should tell rows of a key apart). Rows are dealt
    and sorted by ranges of key and order; how many rows each range holds of each key gives the first rank there."""
    seat = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    held = staged(dealt.select("*", F.shiftright(seat, 33).alias("_range"), seat.bitwiseAND((1 << 33) - 1).alias("_seat")), "ranges")
    each = held.groupBy(key, "_range").agg(F.count("*").alias("_n"), F.min("_seat").alias("_least"))
    # of a key as many rows as there are ranges at most
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_range")) - F.col("_n") - F.col("_least")
    first = staged(each.select(F.col(key).alias("_key"), F.col("_range").alias("_of"), before.alias("_shift")), "first-ranks")
    own = held.join(first, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_range") == F.col("_of")))
    return own.withColumn("rank", F.col("_seat") + F.col("_shift")).drop("_range", "_seat", "_key", "_of", "_shift")
