"""The graph as a stored table of generations: rebuilt from decisions, or reconciled with those of some documents.

Edges and nodes are copy-on-write tables; each version of the edges names the version of the nodes that belongs to it, so that readers see pairs. A
rebuild replays all decisions, drops what was retired and is recorded as a generation; reconciling records none. Nothing depends on the order
of rows or on the clock: equal decisions give equal rows.

Defined results: without any version the graph is empty and its generation 0; decisions without a promoted row give an empty generation; a document without
decisions that is named has its active edges retired; null document ids are never reconciled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..sources.stages import staged
from ..sources.versions import BucketTable
from . import graph

RETIRED = StructField("retirement_reason", StringType())
LOG = "generation long, version long, active_nodes long, active_edges long, left_out long, added long, unchanged boolean"


class StoredGraph:
    def __init__(self, spark: SparkSession, path: str, edges: StructType, nodes: StructType, buckets: int = 64) -> None:
        self.spark = spark
        self.edge_table = BucketTable(spark, f"{path}/edges", "edge_id", StructType([*edges.fields, RETIRED]), buckets)
        self.node_table = BucketTable(spark, f"{path}/nodes", "node_id", StructType([*nodes.fields, RETIRED]), buckets)

    @classmethod
    def of(cls, path: str, decisions: DataFrame, entities: DataFrame, buckets: int = 64) -> StoredGraph:
        edges = graph.edge_rows(decisions)
        return cls(decisions.sparkSession, path, edges.schema, graph.node_rows(edges, entities).schema, buckets)

    def edges(self, version: int | None = None) -> DataFrame:
        return self.edge_table.read(version)

    def nodes(self, version: int | None = None) -> DataFrame:
        note = self.edge_table.manifest(version)["note"]
        return self.node_table.read(note.get("nodes", 0))

    def log(self) -> DataFrame:
        """A row for each generation, from the notes of the versions (a few numbers each)."""
        names = [c.split()[0] for c in LOG.split(", ")]
        notes = [self.edge_table.manifests.read(n) for n in self.edge_table.manifests.numbers()]
        found = [tuple({**m["note"], "version": m["version"]}[n] for n in names) for m in notes if m["note"].get("rebuilt")]
        return self.spark.createDataFrame(found, LOG)

    def generation(self) -> int:
        return self.edge_table.manifest()["note"].get("generation", 0)

    def rebuild(self, decisions: DataFrame, entities: DataFrame) -> int:
        """Replays all decisions into a new generation, and says how it differs from what was held."""
        none = F.lit(None).cast("string").alias("retirement_reason")
        edges = staged(graph.edge_rows(decisions).select("*", none), "edges")
        nodes = staged(graph.node_rows(edges, entities).select("*", none), "nodes")
        before = self.edges()
        gone = before.join(edges.select("edge_id"), "edge_id", "left_anti").count()
        new = edges.join(before.select("edge_id"), "edge_id", "left_anti").count()
        same = not gone and not new and graph.same_content(before, edges).isEmpty()
        version = self.node_table.overwrite(nodes)
        note = {"rebuilt": True, "generation": self.generation() + 1, "nodes": version, "active_nodes": nodes.count(), "active_edges": edges.count(), "left_out": gone, "added": new, "unchanged": same}
        self.edge_table.overwrite(edges, note=note)
        return note["generation"]

    def reconcile(self, decisions: DataFrame, entities: DataFrame, documents: DataFrame) -> DataFrame:
        """Brings the edges of ``documents`` (document_id) in line with their decisions; returns what became of each edge. Only buckets of edges and
        nodes that change are written; a node all of whose edges have been retired is retired, one that gets an edge again comes back."""
        visited = documents.select("document_id").distinct()
        decided = decisions.join(visited, "document_id", "left_semi")
        held = self.edges()
        of_documents = held.join(visited, "document_id", "left_semi")
        events = staged(graph.incremental(decided, of_documents), "events")
        fresh = graph.edge_rows(decided).withColumn("retirement_reason", F.lit(None).cast("string"))
        differing = graph.same_content(of_documents, fresh).join(fresh.select("edge_id"), "edge_id", "left_semi")
        retired = held.drop("state", "retirement_reason").join(events.where("event = 'retired'").select("edge_id", "retirement_reason"), "edge_id").withColumn("state", F.lit("historical"))
        changed = staged(fresh.join(differing, "edge_id", "left_semi").unionByName(retired.select(*fresh.columns)), "changed")
        # of the nodes at changed edges: which have an active edge now, those of untouched edges among them
        ends = lambda rows: rows.select("edge_id", "state", F.explode(F.array("subject_id", "object_id")).alias("node_id"))
        at = ends(changed).select("node_id").distinct()
        now = ends(held.join(changed.select("edge_id"), "edge_id", "left_anti")).unionByName(ends(changed)).join(at, "node_id", "left_semi")
        alive = now.groupBy("node_id").agg(F.bool_or(F.col("state") == "active").alias("alive"))
        made = graph.node_rows(fresh.join(differing, "edge_id", "left_semi"), entities).withColumn("retirement_reason", F.lit(None).cast("string"))
        known = self.nodes().join(at, "node_id", "left_semi").join(made.select("node_id"), "node_id", "left_anti")
        state, reason = F.when(F.col("alive"), "active").otherwise("historical"), F.when(~F.col("alive"), "no_remaining_relationships")
        touched = made.unionByName(known.select(*made.columns)).drop("state", "retirement_reason").join(alive, "node_id").withColumns({"state": state, "retirement_reason": reason}).select(*made.columns)
        note = self.edge_table.manifest()["note"] | {"rebuilt": False}
        note["nodes"] = self.node_table.upsert(staged(touched, "touched"))
        self.edge_table.change([changed.select("edge_id")], lambda rows: rows.join(changed.select("edge_id"), "edge_id", "left_anti").unionByName(changed.select(rows.columns)), note=note)
        return events
