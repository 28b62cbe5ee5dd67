"""Identities from source to statements: walking them back, and refusing what was made under other versions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import identity
from .text import settled

#: Kinds of artifact, each made from the one before.
KINDS = ("source", "representation", "segmentation", "evidence", "entities", "facts", "statements")


def artifact_sets(sources: DataFrame, missing: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """identity, upstream_identity and document_id of each kind's sets; ``missing``: kind to a condition on document_id for which there is none. Each identity
    is worked out once a row from the one before: written into each other, they would double with every kind."""
    made, rows = {}, sources.select("document_id", F.lit(None).cast("string").alias("upstream_identity"), F.col("checksum").alias("identity"))
    for kind in KINDS:
        upstream = F.lit(None).cast("string") if kind == "source" else F.col("upstream_identity")
        rows = settled(rows.select("document_id", F.col("identity").alias("upstream_identity")), identity=identity(kind, F.col("upstream_identity")))
        sets = rows.select("document_id", "identity", upstream.alias("upstream_identity"))
        made[kind] = sets.where(~F.expr(missing[kind])) if missing and kind in missing else sets
    return made


def traced(sets: dict[str, DataFrame]) -> DataFrame:
    """Of each set of the last kind: how many steps back its upstream identities lead, and the identity at the far end. Six equi-joins, each within the
    document that both sets are of: rows that lie by document stay there."""
    rows = sets[KINDS[-1]].select("document_id", F.col("identity").alias("statements"), F.col("upstream_identity").alias("next"), F.lit(0).alias("steps"), F.col("identity").alias("furthest"))
    for kind in reversed(KINDS[:-1]):
        up = sets[kind].select("document_id", F.col("identity").alias("next"), F.col("upstream_identity").alias("beyond"), F.lit(True).alias("found"))
        rows = rows.join(up.hint("merge"), ["document_id", "next"], "left")
        rows = rows.select("document_id", "statements", F.when(F.col("found"), F.col("beyond")).alias("next"), (F.col("steps") + F.coalesce(F.col("found"), F.lit(False)).cast("int")).alias("steps"), F.when(F.col("found"), F.col("next")).otherwise(F.col("furthest")).alias("furthest"))
    return rows.select("document_id", F.col("steps").cast("long").alias("steps"), "furthest", (F.col("steps") == len(KINDS) - 1).alias("complete"))


def refused(sets: DataFrame, supported: tuple[str, ...]) -> DataFrame:
    """Upstream sets that may not be built on: of an unsupported policy version, or without an identity."""
    reason = F.when(~F.col("policy_version").isin(*supported) | F.col("policy_version").isNull(), "unsupported_version").when(F.col("identity").isNull(), "missing_identity")
    return sets.withColumn("reason", reason).where("reason is not null").select("document_id", "reason")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def copied(rows: DataFrame, condition: str, copy: str | None = None) -> DataFrame:
    """``rows``, those of the condition twice. A union would lose where they are; these stay there. ``copy``: a column that is 1 in the second ones, else 0."""
    made = rows.withColumn(copy or "_copy", F.explode(F.when(F.expr(condition), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return made if copy else made.drop("_copy")
