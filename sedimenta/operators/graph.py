"""Reviews, promotion of approved statements to a graph, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import UNIT_SEPARATOR, key
from ..functions.rules import EDGE_KINDS, NODE_KINDS, REASONS
from .ledger import newest

TARGET = ["document_id", "statement_key"]


def policy_violations(reviews: DataFrame) -> DataFrame:
    """All rules that a review breaks: a reason not permitted for its decision; a comment that is needed and missing."""
    spark = reviews.sparkSession
    allowed = spark.createDataFrame([(d, r) for d, reasons in REASONS for r in reasons], "decision string, reason string").withColumn("permitted", F.lit(True))
    rows = reviews.join(F.broadcast(allowed), ["decision", "reason"], "left")
    needs = F.col("decision").isin("rejected", "needs_investigation") | (F.col("reason") == "other")
    broken = F.array_compact(F.array(F.when(F.col("permitted").isNull(), "reason_not_permitted"), F.when(needs & (F.coalesce(F.trim("comment"), F.lit("")) == ""), "comment_required")))
    return rows.withColumn("violations", F.array_join(broken, ",")).where("violations <> ''").select("review_id", "decision", "reason", "violations")


def latest_reviews(reviews: DataFrame) -> DataFrame:
    return newest(reviews, TARGET, F.desc("recorded_at"), F.desc("review_id"))


def review_history(reviews: DataFrame) -> DataFrame:
    """Every review with its place from the newest on; all but the first are superseded."""
    k = F.row_number().over(Window.partitionBy(*TARGET).orderBy(F.desc("recorded_at"), F.desc("review_id")))
    return reviews.withColumn("place", k.cast("long")).withColumn("superseded", F.col("place") > 1)


def review_counts(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy(*TARGET).agg(F.count("*").alias("n_reviews"))


def applicability(latest: DataFrame, statements: DataFrame) -> DataFrame:
    """``orphaned`` where the document has no statements now, ``applies`` where the statement is there, else stale."""
    documents = statements.select("document_id").distinct().withColumn("has_set", F.lit(True))
    current = statements.select(*TARGET).withColumn("is_current", F.lit(True))
    rows = latest.join(documents, "document_id", "left").join(current, TARGET, "left")
    return rows.withColumn("applicability", F.when(F.col("has_set").isNull(), "orphaned").when(F.col("is_current"), "applies").otherwise("requires_revalidation")).drop("has_set", "is_current")


def review_events(reviews: DataFrame) -> DataFrame:
    """recorded for each review; superseded for the one it follows."""
    before = F.lag("review_id").over(Window.partitionBy(*TARGET).orderBy("recorded_at", "review_id"))
    rows = reviews.withColumn("before", before)
    events = F.array_compact(F.array(F.struct(F.lit("recorded").alias("event"), F.col("review_id").alias("about")), F.when(F.col("before").isNotNull(), F.struct(F.lit("superseded").alias("event"), F.col("before").alias("about")))))
    return rows.select("document_id", F.explode(events).alias("e")).select("document_id", "e.event", F.col("e.about").alias("review_id"))


def unknown_targets(reviews: DataFrame, statements: DataFrame) -> DataFrame:
    return reviews.join(statements, TARGET, "left_anti")


def promotion_decisions(statements: DataFrame, entities: DataFrame, latest: DataFrame) -> DataFrame:
    """Governance first, then vocabulary: the first refusal, or promotion with its kinds."""
    spark = statements.sparkSession
    kinds = F.broadcast(spark.createDataFrame(list(NODE_KINDS), "entity_type string, node_kind string"))
    edges = F.broadcast(spark.createDataFrame(list(EDGE_KINDS), "statement_type string, subject_expected string, object_expected string"))
    typed = entities.select("document_id", "entity_key", "entity_type").join(kinds, "entity_type", "left")
    rows = statements
    for side in ("subject", "object"):
        rows = rows.join(typed.select("document_id", F.col("entity_key").alias(f"{side}_key"), F.col("node_kind").alias(f"{side}_kind")), ["document_id", f"{side}_key"])
    rows = rows.join(applicability(latest, statements).select(*TARGET, "decision", "applicability", "review_id", "recorded_at"), TARGET, "left").join(edges, "statement_type", "left")
    refusal = (
        F.when(F.col("decision").isNull(), "not_reviewed").when(F.col("decision") == "rejected", "review_rejected").when(F.col("decision") != "approved", "review_inconclusive")
        .when(F.col("applicability") == "orphaned", "review_orphaned").when(F.col("applicability") != "applies", "review_stale").when(F.col("subject_expected").isNull(), "ungoverned_statement_type")
        .when(F.col("subject_kind").isNull() | F.col("object_kind").isNull(), "ungoverned_entity_type").when((F.col("subject_kind") != F.col("subject_expected")) | (F.col("object_kind") != F.col("object_expected")), "invalid_endpoints")
    )
    return rows.withColumn("refusal", refusal).withColumn("promoted", F.col("refusal").isNull())


def edge_rows(decisions: DataFrame) -> DataFrame:
    rows = decisions.where("promoted")
    node = lambda side: key(F.lit("node"), f"{side}_kind", f"{side}_key", sep=UNIT_SEPARATOR)
    return rows.select(
        key(F.lit("edge"), "statement_type", "statement_key", sep=UNIT_SEPARATOR).alias("edge_id"), F.col("statement_type").alias("edge_kind"), node("subject").alias("subject_id"), node("object").alias("object_id"), "subject_key", "object_key", "subject_kind", "object_kind", "document_id", "statement_key", "review_id", F.col("recorded_at").alias("created_at"), F.lit("active").alias("state")
    )


def node_rows(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """A node for each end; the last statement in key order gives provenance and time."""
    ends = edges.select(F.explode(F.array(*(F.struct(F.col(f"{s}_id").alias("node_id"), F.col(f"{s}_key").alias("entity_key"), F.col(f"{s}_kind").alias("node_kind")) for s in ("subject", "object")))).alias("e"), "document_id", "statement_key", "created_at")
    ends = ends.select("e.*", "document_id", "statement_key", "created_at")
    last = ends.groupBy("node_id", "entity_key", "node_kind", "document_id").agg(F.max(F.struct("statement_key", "created_at")).alias("last"))
    normalized = F.coalesce(F.upper("designation"), F.when(F.col("value").isNotNull(), F.col("number_text")), F.col("label"))
    shown = entities.select("document_id", "project_id", "entity_key", "label", normalized.alias("normalized_value"), "value", "unit")
    return last.join(shown, ["document_id", "entity_key"]).select("node_id", "node_kind", "document_id", "project_id", "entity_key", "label", "normalized_value", "value", "unit", F.col("last.statement_key").alias("statement_key"), F.col("last.created_at").alias("created_at"), F.lit("active").alias("state"))


def incremental(decisions: DataFrame, held: DataFrame) -> DataFrame:
    """What becomes of each edge: promoted, revalidated, unchanged, retired (with the reason) or untouched history."""
    now = decisions.select("document_id", "statement_key", "statement_type", "promoted", "refusal", key(F.lit("edge"), "statement_type", "statement_key", sep=UNIT_SEPARATOR).alias("edge_id"))
    both = now.join(held.select("edge_id", F.col("state").alias("held_state")), "edge_id", "full")
    event = (
        F.when(F.col("promoted") & F.col("held_state").isNull(), "promoted").when(F.col("promoted") & (F.col("held_state") == "historical"), "revalidated").when(F.col("promoted"), "unchanged")
        .when((F.col("held_state") == "active"), "retired").when(F.col("held_state").isNotNull(), "history").otherwise("refused")
    )
    reason = F.when(F.col("promoted").isNull() | (F.col("refusal") == "review_stale"), "requires_revalidation").when(F.col("refusal") == "review_orphaned", "orphaned").when(F.col("refusal").isin("not_reviewed", "review_rejected", "review_inconclusive"), "review_reversed").otherwise("rebuild_reconciliation")
    return both.withColumn("event", event).withColumn("retirement_reason", F.when(F.col("event") == "retired", reason)).select("edge_id", "event", "retirement_reason")


def orphan_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes at no active edge."""
    ends = edges.where("state = 'active'").select(F.explode(F.array("subject_id", "object_id")).alias("node_id")).distinct()
    return nodes.join(ends, "node_id", "left_anti")


def same_content(before: DataFrame, after: DataFrame) -> DataFrame:
    """Edges that differ between two builds."""
    columns = ("state", "subject_id", "object_id", "review_id")
    both = before.select("edge_id", *(F.col(c).alias(f"{c}_before") for c in columns)).join(after.select("edge_id", *columns), "edge_id", "full")
    same = F.lit(True)
    for c in columns:
        same = same & F.col(c).eqNullSafe(F.col(f"{c}_before"))
    return both.where(~same).select("edge_id")


def neighbourhood(edges: DataFrame) -> DataFrame:
    """Each node with the edges at it."""
    return edges.select("edge_id", "edge_kind", F.explode(F.array("subject_id", "object_id")).alias("node_id"), "subject_id", "object_id").withColumn("other_id", F.when(F.col("node_id") == F.col("subject_id"), F.col("object_id")).otherwise(F.col("subject_id")))
