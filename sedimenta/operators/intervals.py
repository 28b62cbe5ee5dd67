"""Intervals from logs of openings and closings, and what timelines of conversations add up to.

A machine of two states judges each row: an opening while open and a closing while closed are refused, and change nothing. The accepted rows of a
key alternate, so that the (2 k)th and the one after it are an interval; the last one stays open, with null for its end. Both the judging and the
ranks work on blocks and ranges of rows, so a key with most of all rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import constraints as c
from .ledger import TURNS
from .machines import Machine, run
from .ordering import ranked

#: May be opened again after it was closed.
AGAIN = Machine("open", (("open", "closed"), ("closed", "open")))


def intervals(log: DataFrame, key: str, what: str, at: str, *order: str, machine: Machine = AGAIN) -> DataFrame:
    """key, number (from 0), opened_at, closed_at and seconds (null while open) of ``log``, whose column ``what`` holds the machine's states."""
    accepted = run(log.select(key, what, at, *order), machine, key, what, (at, *order)).where("accepted").select(key, at, *order)
    placed = ranked(accepted, key, at, *order)
    pairs = placed.groupBy(key, F.expr("rank div 2").alias("number")).agg(F.min(at).alias("opened_at"), F.when(F.count("*") == 2, F.max(at)).alias("closed_at"))
    return pairs.withColumn("seconds", F.unix_timestamp("closed_at") - F.unix_timestamp("opened_at"))


def refused(log: DataFrame, key: str, what: str, at: str, *order: str, machine: Machine = AGAIN) -> DataFrame:
    """The rows that opened what was open, or closed what was not."""
    return run(log, machine, key, what, (at, *order)).where("not accepted").drop("accepted", "after")


def turn_statistics(timeline: DataFrame) -> DataFrame:
    """conv_id, turn, messages, responses, opened_at, closed_at, seconds. ``timeline``: conv_id, turn, sequence, event_type, at."""
    turn_key = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    marks = timeline.where(F.col("event_type").isin("turn_started", "turn_completed")).select(turn_key.alias("turn_key"), F.when(F.col("event_type") == "turn_started", "started").otherwise("completed").alias("what"), "at", "sequence")
    spans = intervals(marks, "turn_key", "what", "at", "sequence", machine=TURNS).select("turn_key", "opened_at", "closed_at", "seconds")
    counts = timeline.where("turn is not null").groupBy("conv_id", "turn").agg(F.count_if(F.col("event_type") == "message_added").alias("messages"), F.count_if(F.col("event_type") == "response_attached").alias("responses"))
    return counts.withColumn("turn_key", turn_key).join(spans, "turn_key", "left").drop("turn_key")


def conversation_statistics(timeline: DataFrame) -> DataFrame:
    """conv_id, turns, messages, responses, events, seconds (from the first event to the last) and last_activity_at."""
    of = lambda kind: F.count_if(F.col("event_type") == kind)
    span = F.unix_timestamp(F.max("at")) - F.unix_timestamp(F.min("at"))
    return timeline.groupBy("conv_id").agg(F.count_distinct("turn").alias("turns"), of("message_added").alias("messages"), of("response_attached").alias("responses"), F.count("*").alias("events"), span.alias("seconds"), F.max("at").alias("last_activity_at"))


def timeline_violations(timeline: DataFrame) -> DataFrame:
    """conv_id, sequence, code: events that are not numbered on from zero, that go back in time, or that begin a turn with something else than its start."""
    conversation = Window.partitionBy("conv_id").orderBy("sequence")  # the events of one conversation
    turn = Window.partitionBy("conv_id", "turn").orderBy("sequence")
    rows = timeline.withColumns({"_place": F.row_number().over(conversation) - 1, "_before": F.lag("at").over(conversation), "_in_turn": F.row_number().over(turn)})
    return c.violations(
        rows, ["conv_id", "sequence"], c.Rule("not_contiguous", F.col("sequence") != F.col("_place")), c.Rule("back_in_time", F.col("at") < F.col("_before")),
        c.Rule("turn_not_started", F.col("turn").isNotNull() & (F.col("_in_turn") == 1) & (F.col("event_type") != "turn_started")),
    )


def recorded_violations(recorded: DataFrame, counted: DataFrame, own: list[str], counts: tuple[str, ...]) -> DataFrame:
    """``own`` and a code for each recorded count that is not the one counted, for what was recorded of nothing, and (where there are seconds) for
    a duration of what is still open."""
    theirs = {f"_{n}": F.min(n) for n in counts}
    differs = {f"{n}_differ": ~F.col(n).eqNullSafe(F.col(f"_{n}")) & F.col("_known").isNotNull() for n in counts}
    return c.violations(recorded, own, c.Refers({k: k for k in own}, counted, {**theirs, "_known": F.count("*")}, {"unknown": F.col("_known").isNull(), **differs}))
