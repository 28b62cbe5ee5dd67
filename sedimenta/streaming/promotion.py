"""Promotion over a stream: statements and reviews come in, in any order and more than once; changes of edges and of nodes go out.

Two keyed states. Each edge holds its latest review and whether its statement is there, each by time and number, and so ends in the same state
whatever the order of arrival; rows that are older than what is held, or replayed, change nothing and emit nothing. Each node holds the edges at it
(an entry each) and how many are active: the last one's retirement retires the node, a new one brings it back. The edges' changes are a
stream of their own, so the nodes follow from the table that the first query writes.

Defined results: an edge is known once it has had an approved review and a statement; it is active while its latest review approves and its statement
is there, else historical, because the statement went (``requires_revalidation``) or the review was reversed (``review_reversed``). Rows with a null
edge_id are dropped, those with a null time are older than all others.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: ``what`` is ``review`` (with a decision) or ``statement`` (``present`` or not); ``at`` and ``number`` order the rows of an edge.
EVENTS = "edge_id string, subject_id string, object_id string, what string, decision string, present boolean, at timestamp, number long"
EDGE_CHANGES = "edge_id string, subject_id string, object_id string, state string, retirement_reason string, change long"
NODE_CHANGES = "node_id string, state string, retirement_reason string, change long"
#: Into how many groups keys are dealt; a stream's checkpoint is bound to it.
GROUPS = 4096
#: Places in an edge's state.
DECISION, DECIDED, REVIEW, PRESENT, SEEN, VERSION, APPROVED, KNOWN, STATE, REASON, CHANGE = range(11)
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class EdgeProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getMapState("held", "edge_id string", "decision string, decided long, review long, present boolean, seen long, version long, approved boolean, known boolean, state string, reason string, change long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        touched: dict[str, list] = {}  # the edges of the group that this batch has rows of
        ends = {}
        for part in rows:
            times = part["at"].astype("int64").where(part["at"].notna(), -(2**62))
            for edge, what, said, there, at, number, subject, object_ in zip(part["edge_id"], part["what"], part["decision"], part["present"], times, part["number"], part["subject_id"], part["object_id"], strict=True):
                if edge not in touched:
                    touched[edge] = list(self.held.getValue((edge,)) or (None, None, None, False, None, None, False, False, None, None, 0))
                now = touched[edge]
                ends[edge], place = (subject, object_), (int(at), int(number))
                if what == "review":
                    now[APPROVED] = now[APPROVED] or said == "approved"
                    if now[DECIDED] is None or place > (now[DECIDED], now[REVIEW]):
                        now[DECISION], (now[DECIDED], now[REVIEW]) = said, place
                else:
                    now[KNOWN] = now[KNOWN] or bool(there)
                    if now[SEEN] is None or place > (now[SEEN], now[VERSION]):
                        now[PRESENT], (now[SEEN], now[VERSION]) = bool(there), place
        changes = []
        for edge, now in touched.items():
            before = now[STATE], now[REASON]
            if now[APPROVED] and now[KNOWN]:
                active = now[PRESENT] and now[DECISION] == "approved"
                now[STATE], now[REASON] = ("active", None) if active else ("historical", "review_reversed" if now[PRESENT] else "requires_revalidation")
            changed = (now[STATE], now[REASON]) != before
            now[CHANGE] += changed
            self.held.updateValue((edge,), tuple(now))
            if changed:
                changes.append((edge, *ends[edge], now[STATE], now[REASON], now[CHANGE]))
        if changes:
            yield pd.DataFrame(changes, columns=["edge_id", "subject_id", "object_id", "state", "retirement_reason", "change"])

    def close(self) -> None:
        pass


class NodeProcessor(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.edges = handle.getMapState("edges", "node_id string, edge_id string", "change long, active boolean")
        self.held = handle.getMapState("held", "node_id string", "active long, state string, change long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        touched: dict[str, list] = {}
        newest: dict[tuple, tuple] = {}  # the last change of each edge at a node
        for part in rows:
            for node, edge, now, number in zip(part["node_id"], part["edge_id"], part["state"], part["change"], strict=True):
                if int(number) > newest.get((node, edge), (0, False))[0]:
                    newest[node, edge] = int(number), now == "active"
        for (node, edge), (number, active) in newest.items():
            if node not in touched:
                touched[node] = list(self.held.getValue((node,)) or (0, None, 0))
            last, was = self.edges.getValue((node, edge)) or (0, False)
            if number > last:
                touched[node][0] += active - was
                self.edges.updateValue((node, edge), (number, active))
        changes = []
        for node, (count, state, change) in touched.items():
            now = "active" if count else "historical"
            changed = now != state
            self.held.updateValue((node,), (count, now, change + changed))
            if changed:
                changes.append((node, now, None if count else "no_remaining_relationships", change + changed))
        if changes:
            yield pd.DataFrame(changes, columns=["node_id", "state", "retirement_reason", "change"])

    def close(self) -> None:
        pass


def grouped(rows: DataFrame, key: str):
    """Rows by groups of keys: a call of Python serves all keys of its group, each of which has a state of its own there."""
    return rows.withColumn("_group", F.pmod(F.xxhash64(key), F.lit(GROUPS)).cast("int")).groupBy("_group")


def edge_changes(events: DataFrame) -> DataFrame:
    return grouped(events.where("edge_id is not null"), "edge_id").transformWithStateInPandas(EdgeProcessor(), EDGE_CHANGES, "Append", "None")


def node_changes(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("node_id"), "edge_id", "state", "change")
    return grouped(ends, "node_id").transformWithStateInPandas(NodeProcessor(), NODE_CHANGES, "Append", "None")


def follow(spark: SparkSession, events: str, out: str, files_at_once: int | None = None) -> None:
    """Takes in what is new in the folder ``events`` (parquet files) and writes changes below ``out``; a later call goes on where this one ended."""
    own = spark.newSession()
    own.conf.set(*PROVIDER)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    for source, schema, changes, name in ((events, EVENTS, edge_changes, "edges"), (f"{out}/edges", EDGE_CHANGES, node_changes, "nodes")):
        reader = own.readStream.schema(schema)
        if files_at_once and name == "edges":
            reader = reader.option("maxFilesPerTrigger", files_at_once)
        query = changes(reader.parquet(source)).writeStream.format("parquet").option("path", f"{out}/{name}").option("checkpointLocation", f"{out}/checkpoint-{name}").trigger(availableNow=True).start()
        query.awaitTermination()


def latest(spark: SparkSession, out: str, name: str) -> DataFrame:
    """The edges or nodes as the changes so far leave them."""
    key, schema = ("edge_id", EDGE_CHANGES) if name == "edges" else ("node_id", NODE_CHANGES)
    rows = spark.read.schema(schema).parquet(f"{out}/{name}")
    fields = [c for c in rows.columns if c not in (key, "change")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*fields), "change").alias("r")).select(key, "r.*")


def batch(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same from all rows at once: edges and nodes."""
    place = F.struct(F.coalesce("at", F.timestamp_seconds(F.lit(-(2**31)))), "number")
    review, statement = F.col("what") == "review", F.col("what") == "statement"
    edges = events.where("edge_id is not null").groupBy("edge_id").agg(
        F.first("subject_id").alias("subject_id"), F.first("object_id").alias("object_id"), F.max_by("decision", F.when(review, place)).alias("decision"), F.max_by("present", F.when(statement, place)).alias("present"),
        F.bool_or(review & (F.col("decision") == "approved")).alias("approved"), F.bool_or(statement & F.col("present")).alias("known"),
    ).where("approved and known")
    active = F.col("present") & F.col("decision").eqNullSafe("approved")
    edges = edges.select("edge_id", "subject_id", "object_id", F.when(active, "active").otherwise("historical").alias("state"), F.when(~F.col("present"), "requires_revalidation").when(~active, "review_reversed").alias("retirement_reason"))
    nodes = edges.select(F.explode(F.array("subject_id", "object_id")).alias("node_id"), "state").groupBy("node_id").agg(F.bool_or(F.col("state") == "active").alias("alive"))
    return edges, nodes.select("node_id", F.when(F.col("alive"), "active").otherwise("historical").alias("state"), F.when(~F.col("alive"), "no_remaining_relationships").alias("retirement_reason"))
