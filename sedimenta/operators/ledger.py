"""Event logs and registers: transitions, latest rows, uniqueness, pages of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .machines import Machine

# The legal moves, and the state that each life begins in.
JOB_MOVES = (("uploaded", "queued"), ("queued", "processing"), ("processing", "processed"), ("processing", "failed"), ("failed", "queued"))
PROJECT_MOVES = (("draft", "active"), ("active", "archived"), ("archived", "active"), ("archived", "deleted"), ("deleted", "archived"))
CONVERSATION_MOVES = (("active", "completed"), ("completed", "archived"))
TURN_MOVES = (("started", "completed"),)
SESSION_MOVES = (("created", "active"), ("active", "paused"), ("paused", "active"), ("active", "completed"), ("paused", "completed"), ("paused", "archived"), ("completed", "archived"))
CANDIDATE_MOVES = (("pending", "needs_changes"), ("needs_changes", "pending"), ("pending", "approved"), ("pending", "rejected"), ("needs_changes", "approved"), ("needs_changes", "rejected"))
JOBS, PROJECTS, CONVERSATIONS, TURNS = Machine("uploaded", JOB_MOVES), Machine("draft", PROJECT_MOVES), Machine("active", CONVERSATION_MOVES), Machine("started", TURN_MOVES)
SESSIONS, CANDIDATES = Machine("created", SESSION_MOVES), Machine("pending", CANDIDATE_MOVES)


def newest(rows: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


def oldest_active(jobs: DataFrame) -> DataFrame:
    return newest(jobs.where(F.col("state").isin("uploaded", "queued", "processing")), ["document_id"], F.col("job_id"))


def refused_requests(requests: DataFrame, jobs: DataFrame) -> DataFrame:
    """Requests for a document with an active job."""
    return requests.join(oldest_active(jobs).select("document_id"), "document_id", "left_semi")


def repeated(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias("n")).where("n > 1")


def page_of(rows: DataFrame, wanted: Column, sort: list[Column], offset: int, size: int) -> DataFrame:
    """A page of the rows that match, and the total before the cut."""
    size = max(1, min(100, size))
    found = rows.where(wanted)
    return found.orderBy(*sort).offset(offset).limit(size).crossJoin(found.agg(F.count("*").alias("total")))  # one row of one number


def contains_text(column: str, text: str) -> Column:
    """Case-insensitive, literal: % and _ are ordinary characters."""
    return F.contains(F.lower(column), F.lower(F.lit(text)))


def registry_page(rows: DataFrame, key: str, search: tuple[str, ...], text: str, sort: str, descending: bool, page: int, size: int = 25, **equal: str) -> DataFrame:
    """A page (from 1) of a register: equality filters, a text that one of the ``search`` columns contains, one sort column either way
    with the key as tie-break; ``total`` and ``pages`` before the cut."""
    size, wanted = max(1, min(100, size)), F.lit(False)
    for c in search:
        wanted = wanted | F.coalesce(contains_text(c, text), F.lit(False))
    for c, v in equal.items():
        wanted = wanted & (F.col(c) == v)
    order = F.desc(sort) if descending else F.asc(sort)
    return page_of(rows, wanted, [order, F.asc(key)], (max(1, page) - 1) * size, size).withColumn("pages", F.ceil(F.col("total") / size))


def project_intelligence(projects: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents, completion, health, risk, readiness and next action of each project."""
    n = documents.groupBy("project_id").agg(F.count("*").alias("n"))
    rows = projects.join(n, "project_id", "left").withColumn("document_count", F.coalesce("n", F.lit(0)))
    rows = rows.withColumn("completion", F.when(F.col("document_count") == 0, 0).when(F.col("document_count") < 5, F.least(F.col("document_count") * 20, F.lit(80))).otherwise(100))
    rows = rows.withColumn("health", F.least(F.lit(40) + F.bround(F.col("completion") * 60 / 100).cast("int"), F.lit(100)))
    readiness = F.when(F.col("completion") >= 100, "ready").when(F.col("completion") > 0, "partially_ready").otherwise("not_ready")
    action = F.when(F.col("document_count") == 0, "load_first_documents").when(F.col("document_count") < 5, "complete_document_set").otherwise("verify_revisions")
    return rows.select("project_id", "document_count", "completion", "health", F.when(F.col("health") >= 80, "low").when(F.col("health") >= 55, "medium").otherwise("high").alias("risk"), readiness.alias("readiness"), action.alias("next_action"))


def visible(projects: DataFrame, include_deleted: bool = False) -> DataFrame:
    """Projects, deleted ones only if asked for, the newest first."""
    rows = projects if include_deleted else projects.where("state <> 'deleted'")
    return rows.orderBy(F.desc("created_at"), F.desc("project_id"))


def definition_attributes(definitions: DataFrame, attributes: DataFrame) -> DataFrame:
    """definition_id, attribute_id, refused, required, default_value: each reference of a definition (array of structs ``refs``:
    attribute_id, required, default_value) against the attributes; unknown ids are refused, ``required`` is true unless said otherwise."""
    refs = definitions.select("definition_id", F.explode("refs").alias("r")).select("definition_id", "r.*")
    known = attributes.select("attribute_id", F.lit(True).alias("known"))
    rows = refs.join(known, "attribute_id", "left")
    return rows.select("definition_id", "attribute_id", F.col("known").isNull().alias("refused"), F.coalesce("required", F.lit(True)).alias("required"), "default_value")


def catalogue_faults(entries: DataFrame) -> DataFrame:
    """entry_id, code, n: faults of catalogue entries (entry_id, name, parent, relations: array of structs kind, target)."""
    known = entries.select(F.col("entry_id").alias("target")).distinct()
    code = lambda rows, name: rows.groupBy("entry_id").agg(F.count("*").alias("n")).select("entry_id", F.lit(name).alias("code"), "n")
    relations = entries.select("entry_id", F.explode("relations").alias("r")).select("entry_id", "r.*")
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    return (
        code(entries, "duplicate_id").where("n > 1").unionByName(code(entries.where(blank("name")), "blank_name")).unionByName(code(entries.where("parent is not null").join(known, F.col("parent") == F.col("target"), "left_anti"), "unknown_parent"))
        .unionByName(code(relations.where(F.col("kind").isNull() | F.col("target").isNull()), "incomplete_relation")).unionByName(code(relations.where("target is not null").join(known, "target", "left_anti"), "unknown_target"))
    )


def missing_targets(rows: DataFrame, target: str, dimension: DataFrame, of: str) -> DataFrame:
    """Rows whose reference is not in the dimension."""
    return rows.join(dimension.select(F.col(of).alias(target)).distinct(), target, "left_anti")


def first_by_alias(names: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Each observed name with the first catalogue entry whose id, name or an alias it is, whatever the case."""
    known = catalogue.select("entry_id", "rank", F.explode(F.array_union(F.array("entry_id", "entry_name"), "aliases")).alias("alias")).select("entry_id", "rank", F.lower(F.trim("alias")).alias("folded")).distinct()
    found = names.withColumn("folded", F.lower(F.trim("name"))).join(known, "folded")
    return found.groupBy("name").agg(F.min_by("entry_id", "rank").alias("entry_id"))


def catalogue_lookups(asked: DataFrame, catalogue: DataFrame) -> DataFrame:
    """request_id, what, entry_id, place of what the catalogue answers to requests (request_id, what, text, more), in catalogue order from 0.

    ``catalogue``: entry_id, rank, parent, category, relations (array of kinds), attributes (map of values). ``what`` is ``child`` (entries whose parent is
    the text), ``category`` (entries in it), ``relation`` (the entry, if it supports the kind ``more``) or ``attribute`` (the entry, if it has ``more``). Ids
    and categories are compared in lower case without outer spaces; blank texts find nothing."""
    fold = lambda c: F.lower(F.trim(F.col(c).cast("string")))
    by = lambda what, column, more=None: catalogue.select(F.lit(what).alias("what"), fold(column).alias("text"), (F.lit(None).cast("string") if more is None else more).alias("more"), "entry_id", "rank")
    keys = by("child", "parent").unionByName(by("category", "category")).unionByName(by("relation", "entry_id", F.explode("relations"))).unionByName(by("attribute", "entry_id", F.explode(F.map_keys("attributes"))))
    rows = asked.select("request_id", "what", fold("text").alias("text"), "more").where("text <> ''")
    found = rows.join(keys.withColumnRenamed("more", "_more"), ["what", "text"]).where(F.col("_more").isNull() | (F.col("_more") == F.col("more")))
    first = found.groupBy("request_id", "what", "entry_id").agg(F.min("rank").alias("rank"))
    place = F.row_number().over(Window.partitionBy("request_id", "what").orderBy("rank", "entry_id")) - 1
    return first.select("request_id", "what", "entry_id", place.cast("long").alias("place"))


def attribute_lookups(asked: DataFrame, attributes: DataFrame) -> DataFrame:
    """asked text, by, attribute_id: attributes (attribute_id, units, domain) by id, by a unit, or by the domain of their metadata, whatever the case."""
    keys = [attributes.select(F.lit(by).alias("by"), c.alias("text"), "attribute_id") for by, c in (("id", F.col("attribute_id")), ("unit", F.explode("units")), ("domain", F.col("domain")))]
    known = keys[0].unionByName(keys[1]).unionByName(keys[2]).withColumn("text", F.lower("text")).distinct()
    return asked.withColumn("_text", F.lower(F.trim("text"))).join(known.withColumnRenamed("text", "_text"), ["by", "_text"]).select("text", "by", "attribute_id")


def scope_violations(documents: DataFrame) -> DataFrame:
    """document_id, code: a document of a project that names none, one of the library that names one, or one whose scope is neither; a scope is never
    inferred from a missing project."""
    scope, named = F.col("scope"), F.col("project_id").isNotNull()
    code = F.when(scope.isNull() | ~scope.isin("project", "library"), "unknown_scope").when((scope == "project") & ~named, "project_missing").when((scope == "library") & named, "project_not_allowed")
    return documents.withColumn("code", code).where("code is not null").select("document_id", "code")


def claims_of_documents(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """document_id, claim_id of the claims (claim_id) that have evidence (claim_id, document_id) in a document, each once."""
    return evidence.select("document_id", "claim_id").distinct().join(claims.select("claim_id"), "claim_id", "left_semi").select("document_id", "claim_id")
