"""Entities, facts and statements of each document. All keys begin with document_id, so one shuffle by it serves all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import checksum, key
from ..functions.rules import RULE_VERSIONS
from .text import settled

LINE = ("document_id", "line_index")
TYPES = {"designation": ("equipment_designation", "designation_grouping"), "location": ("structural_location", "location_grouping")}


def mentions(evidence: DataFrame) -> DataFrame:
    """Every observation with the key of its entity: designations and locations by text, status and rule version within
    the document, each quantity for itself."""
    kind = F.col("kind")
    entity_type = F.when(kind == "designation", "equipment_designation").when(kind == "location", "structural_location").otherwise("engineering_quantity")
    rule = F.when(kind == "designation", "designation_grouping").when(kind == "location", "location_grouping").otherwise("quantity_identity")
    which = F.when(kind.isin("designation", "location"), F.concat_ws("|", "designation", "status", "rule_version")).otherwise(F.col("evidence_key"))
    rows = evidence.withColumns({"entity_type": entity_type, "resolution_rule": rule})
    return rows.withColumn("entity_key", key("document_id", "checksum", F.lit("2.0"), "resolution_rule", F.lit("1.0"), F.lit("1.0"), "entity_type", which))


def entities(rows: DataFrame) -> DataFrame:
    """One row per entity, from its mentions."""
    by = rows.groupBy("document_id", "project_id", "entity_key", "entity_type").agg(
        F.count("*").alias("n_evidence"), F.min("designation").alias("designation"), F.min("number_text").alias("number_text"), F.min("value").alias("value"), F.min("unit").alias("unit"), F.min("base_value").alias("base_value"), F.min("base_unit").alias("base_unit"), F.min("kind").alias("kind"), F.min("status").alias("seen")
    )
    label = F.coalesce("designation", F.when(F.col("value").isNotNull(), F.concat_ws(" ", "number_text", "unit")), F.substring("entity_key", 1, 12))
    return by.withColumns({"label": label, "status": F.when(F.col("seen") == "observed", "resolved").otherwise("ambiguous")}).drop("seen")


def failing_documents(found: DataFrame) -> DataFrame:
    """Documents with an entity that has no value at all: their whole set fails."""
    return found.where((F.col("entity_type") == "engineering_quantity") & F.col("value").isNull()).select("document_id").distinct()


def valueless_documents(evidence: DataFrame) -> DataFrame:
    """``failing_documents`` from observations: each quantity is an entity by itself, so that its place stands for its key."""
    place = ["document_id", "line_index", "token_start", "token_end", "kind", "rule_id"]
    by = evidence.where(~F.col("kind").isin("designation", "location")).groupBy(*place).agg(F.max(F.col("value").isNotNull()).alias("valued"))
    return by.where("not valued").select("document_id").distinct()


def strict(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(failing_documents(found), "document_id", "left_anti")


def _sides(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Subjects, quantities and eligible locations of each line, one row per entity."""
    subjects = rows.where("kind = 'designation'").select("document_id", "line_index", F.col("entity_key").alias("subject_key"), F.col("status").alias("subject_status")).distinct()
    quantities = rows.where("entity_type = 'engineering_quantity'").select("document_id", "line_index", F.col("entity_key").alias("object_key"), F.col("status").alias("object_status")).distinct()
    places = rows.where("kind = 'location'")
    named = rows.where("kind = 'designation'").select("document_id", "line_index", "token_start", "token_end").distinct()
    shared = places.join(named, ["document_id", "line_index", "token_start", "token_end"], "left_semi").select("document_id", "line_index", "entity_key").distinct()
    eligible = places.join(shared, ["document_id", "line_index", "entity_key"], "left_anti")
    return subjects, quantities, eligible.select("document_id", "line_index", F.col("entity_key").alias("object_key"), F.col("status").alias("object_status")).distinct()


def _line_pairs(rows: DataFrame) -> list[DataFrame]:
    """``line_pairs`` for each rule by itself: each stays where its document is."""
    subjects, quantities, places = _sides(rows)
    line = Window.partitionBy(*LINE)
    subjects = subjects.withColumn("subjects", F.count("*").over(line))
    one = quantities.withColumn("objects", F.count("*").over(line)).withColumns({"rule": F.lit("same_line_association"), "predicate": F.lit("has_associated_quantity")})
    two = places.withColumn("objects", F.count("*").over(line)).withColumns({"rule": F.lit("same_line_location_association"), "predicate": F.lit("has_location_aspect")})
    return [subjects.join(objects, list(LINE)) for objects in (one, two)]


def line_pairs(rows: DataFrame) -> DataFrame:
    """Pairs that a line rule joins, with the line's counts on both sides."""
    one, two = _line_pairs(rows)
    return one.unionByName(two)


def token_pairs(rows: DataFrame) -> DataFrame:
    """A designation and a location observed on one token, each alone there."""
    at = ["document_id", "line_index", "token_start", "token_end"]
    one = rows.where("kind = 'designation'").groupBy(*at).agg(F.countDistinct("entity_key").alias("subjects"), F.min("entity_key").alias("subject_key"), F.min("status").alias("subject_status"))
    two = rows.where("kind = 'location'").groupBy(*at).agg(F.countDistinct("entity_key").alias("objects"), F.min("entity_key").alias("object_key"), F.min("status").alias("object_status"))
    both = one.join(two, at).where("subjects = 1 and objects = 1").withColumns({"rule": F.lit("compound_reference_designation"), "predicate": F.lit("has_location_aspect")})
    return both.select(*LINE, "subject_key", "subject_status", "subjects", "object_key", "object_status", "objects", "rule", "predicate")


def _joined_lines(rows: DataFrame) -> list[DataFrame]:
    compound = token_pairs(rows)
    alone = (p.where("subjects = 1 and (rule = 'same_line_association' or objects = 1)").select(compound.columns) for p in _line_pairs(rows))
    return [*alone, compound]


def joined_lines(rows: DataFrame) -> DataFrame:
    """All pairs that become facts, a row for each line that joins them."""
    return reduce(DataFrame.unionByName, _joined_lines(rows))


def _facts(lines: DataFrame) -> DataFrame:
    found = lines.groupBy("document_id", "subject_key", "predicate", "object_key", "rule").agg(F.countDistinct("line_index").alias("n_lines"), F.max(F.greatest(F.col("subject_status") != "observed", F.col("object_status") != "observed")).alias("unsure"))
    found = found.withColumns({"status": F.when(F.col("unsure"), "ambiguous").otherwise("constructed"), "checksum": checksum()})
    return found.withColumn("fact_key", key("document_id", "checksum", F.lit("1.0"), "subject_key", "predicate", "object_key", "rule", F.lit("1.0"), F.lit("1.1"))).drop("unsure")


def facts(rows: DataFrame) -> DataFrame:
    """One row per fact of each document, with how many lines support it. No fact is of two rules, so each rule's are grouped by themselves."""
    return reduce(DataFrame.unionByName, (_facts(lines) for lines in _joined_lines(rows)))


def fact_support(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Observations of both sides on every line that joins a fact's pair, with their role."""
    pair = ["document_id", "subject_key", "object_key", "rule", "predicate"]
    facts_of = found.select(*pair, "fact_key")
    seen = rows.select(*LINE, "entity_key", "evidence_key")

    def support(joined: DataFrame, role: str) -> DataFrame:
        lines = joined.select(*LINE, "subject_key", "object_key", "rule", "predicate").distinct().join(facts_of, pair)
        side = lines.select(*LINE, "fact_key", F.col(f"{role}_key").alias("entity_key"), F.lit(role).alias("role"))
        return side.join(seen, [*LINE, "entity_key"]).select("document_id", "fact_key", "role", "evidence_key", "line_index").distinct()

    # a fact is of one rule, so that no row comes from two of these
    return reduce(DataFrame.unionByName, (support(joined, role) for joined in _joined_lines(rows) for role in ("subject", "object")))


def fact_diagnostics(rows: DataFrame) -> DataFrame:
    """Lines on which a line rule asserts nothing, since it finds several subjects or (locations) objects."""
    reason = F.when(F.col("subjects") > 1, "multiple_subjects").when((F.col("rule") == "same_line_location_association") & (F.col("objects") > 1), "multiple_objects")
    found = (p.withColumn("reason", reason).where("reason is not null").groupBy(*LINE, "rule", "reason").agg(F.countDistinct("subject_key").alias("n_subjects"), F.countDistinct("object_key").alias("n_objects")) for p in _line_pairs(rows))
    return reduce(DataFrame.unionByName, found)


def statement_candidates(found: DataFrame, parts: DataFrame) -> DataFrame:
    """Facts that a statement rule reads, with how many there are for the subject."""
    objects = parts.select("document_id", F.col("entity_key").alias("object_key"), F.col("kind").alias("object_kind"))
    rows = found.join(objects, ["document_id", "object_key"])
    kind = F.when((F.col("predicate") == "has_associated_quantity") & (F.col("object_kind") == "power_value"), "has_rated_power").when((F.col("predicate") == "has_location_aspect") & (F.col("rule") == "compound_reference_designation") & (F.col("object_kind") == "location"), "is_located_in")
    rows = rows.withColumn("statement_type", kind).where("statement_type is not null")
    return rows.withColumn("candidates", F.count("*").over(Window.partitionBy("document_id", "subject_key", "statement_type")))


def statements(candidates: DataFrame, *beside: str) -> DataFrame:
    rows = candidates.where("candidates = 1").withColumn("statement_status", F.when(F.col("status") == "constructed", "interpreted").otherwise("ambiguous"))
    return rows.select("document_id", "subject_key", "statement_type", "object_key", "fact_key", "statement_status", "checksum", key("document_id", "checksum", F.lit("1.0"), F.lit("1.1"), "subject_key", "statement_type", "object_key", F.concat(F.lit("rule:"), F.col("statement_type")), F.lit("1.0"), F.lit("1.0")).alias("statement_key"), *beside)


def statement_diagnostics(candidates: DataFrame) -> DataFrame:
    rows = candidates.where("candidates > 1")
    return rows.groupBy("document_id", "subject_key", "statement_type").agg(F.count("*").alias("n_facts"), F.min("fact_key").alias("first_fact"), F.max("fact_key").alias("last_fact"))


# The same from lines with their observations (``evidence.shown_in``): all pairs of a line come from its own array, and an entity goes by a short name
# (``subject``, ``object``) until its rows are counted. Keys are functions of the names and worked out behind that.
NAMED = ("designation", "location")
SHORT = ("rule", "subject", "object", "seen_kind", "candidates", "status")
RULES = {"same_line_association": "has_associated_quantity", "same_line_location_association": "has_location_aspect", "compound_reference_designation": "has_location_aspect"}


def place_name(x: Column, line_index: Column | str = "line_index") -> Column:
    """What an observation's key is made of, but for its document."""
    version = F.create_map(*(F.lit(v) for pair in RULE_VERSIONS.items() for v in pair))[x["rule_id"]]
    return F.concat_ws("|", x["rule_id"], version, x["kind"], F.lit("1"), F.lit("0"), F.col(line_index) if isinstance(line_index, str) else line_index, x["token_start"], x["token_end"])


def entity_name(x: Column) -> Column:
    """What the key of an observation's entity is made of, but for its document and type."""
    version = F.create_map(*(F.lit(v) for pair in RULE_VERSIONS.items() for v in pair))[x["rule_id"]]
    return F.when(x["kind"].isin(*NAMED), F.concat_ws("|", x["designation"], x["status"], version)).otherwise(place_name(x))


def place_key(name: Column | str) -> Column:
    return key("document_id", checksum(), name)


def entity_key(kind: Column, name: Column | str) -> Column:
    """``mentions``' key of an entity, from the kind of its observations and its name."""
    of = lambda rule, kind, which: key("document_id", checksum(), F.lit("2.0"), F.lit(rule), F.lit("1.0"), F.lit("1.0"), F.lit(kind), which)
    return F.when(kind == "designation", of("designation_grouping", "equipment_designation", name)).when(kind == "location", of("location_grouping", "structural_location", name)).otherwise(of("quantity_identity", "engineering_quantity", place_key(name)))


def entities_of(shown: DataFrame) -> DataFrame:
    """``entities`` of lines with their observations."""
    rows = shown.select("document_id", "project_id", "line_index", F.explode("found").alias("e"))
    rows = rows.select("document_id", "project_id", entity_name(F.col("e")).alias("name"), "e.*").withColumn("group", F.when(F.col("kind").isin(*NAMED), F.col("kind")).otherwise("quantity"))
    by = rows.groupBy("document_id", "project_id", "group", "name").agg(
        F.count("*").alias("n_evidence"), F.min("designation").alias("designation"), F.min("number_text").alias("number_text"), F.min("value").alias("value"), F.min("unit").alias("unit"), F.min("base_value").alias("base_value"), F.min("base_unit").alias("base_unit"), F.min("kind").alias("kind"), F.min("status").alias("seen")
    )
    entity_type = F.when(F.col("group") == "designation", "equipment_designation").when(F.col("group") == "location", "structural_location").otherwise("engineering_quantity")
    by = settled(by, entity_key=entity_key(F.col("group"), "name"), entity_type=entity_type)
    label = F.coalesce("designation", F.when(F.col("value").isNotNull(), F.concat_ws(" ", "number_text", "unit")), F.substring("entity_key", 1, 12))
    columns = ("document_id", "project_id", "entity_key", "entity_type", "n_evidence", "designation", "number_text", "value", "unit", "base_value", "base_unit", "kind")
    return by.select(*columns, label.alias("label"), F.when(F.col("seen") == "observed", "resolved").otherwise("ambiguous").alias("status"))


def sides(shown: DataFrame) -> DataFrame:
    """Lines with the designations, quantities and eligible locations that they show (name, status, kind), and the pairs that stand on one token."""
    m = F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["status"].alias("status"), x["token_start"].alias("a"), x["token_end"].alias("b"), entity_name(x).alias("name")))
    rows = settled(shown, m=m)
    rows = settled(rows, ds=F.filter("m", lambda x: x["kind"] == "designation"), ls=F.filter("m", lambda x: x["kind"] == "location"), qs=F.filter("m", lambda x: ~x["kind"].isin(*NAMED)))
    short = lambda c: F.array_distinct(F.transform(c, lambda x: F.struct(x["name"].alias("name"), x["status"].alias("status"), x["kind"].alias("kind"))))
    at = lambda c, y: short(F.filter(c, lambda x: (x["a"] == y["a"]) & (x["b"] == y["b"])))
    on_token = F.transform(F.filter("ls", lambda y: (F.size(at("ds", y)) == 1) & (F.size(at("ls", y)) == 1)), lambda y: F.struct(F.get(at("ds", y), F.lit(0)).alias("subject"), F.get(at("ls", y), F.lit(0)).alias("object")))
    shared = F.transform(F.filter("ls", lambda x: F.exists("ds", lambda y: (x["a"] == y["a"]) & (x["b"] == y["b"]))), lambda x: x["name"])
    rows = settled(rows, shared=shared)
    return settled(rows, subjects=short("ds"), quantities=short("qs"), places=short(F.filter("ls", lambda x: ~F.array_contains("shared", x["name"]))), compound=F.array_distinct(on_token)).drop("m", "ds", "ls", "qs", "shared")


def pairs_of(shown: DataFrame) -> DataFrame:
    """``joined_lines`` of lines with their observations: a row (subject, object: name, status, kind) for each line that joins a pair, and the line."""
    pair = lambda rule: lambda o: F.struct(F.lit(rule).alias("rule"), F.get("subjects", F.lit(0)).alias("subject"), o.alias("object"))
    rows = sides(shown)
    lone, none = F.size("subjects") == 1, F.expr("filter(quantities, x -> false)")
    found = F.concat(
        F.transform(F.when(lone, F.col("quantities")).otherwise(none), pair("same_line_association")), F.transform(F.when(lone & (F.size("places") == 1), F.col("places")).otherwise(none), pair("same_line_location_association")),
        F.transform("compound", lambda c: F.struct(F.lit("compound_reference_designation").alias("rule"), c["subject"].alias("subject"), c["object"].alias("object"))),
    )
    return rows.withColumn("p", F.explode(found)).select("document_id", "line_index", "found", "p.rule", "p.subject", "p.object")


def short_facts(shown: DataFrame) -> DataFrame:
    """``facts`` of lines with their observations, without keys."""
    rows = pairs_of(shown).select("document_id", "rule", F.col("subject.name").alias("subject"), F.col("object.name").alias("object"), F.col("object.kind").alias("seen_kind"), ((F.col("subject.status") != "observed") | (F.col("object.status") != "observed")).alias("unsure"))
    found = rows.groupBy("document_id", "rule", "subject", "object").agg(F.min("seen_kind").alias("seen_kind"), F.count("*").alias("n_lines"), F.max("unsure").alias("unsure"))
    return found.withColumn("status", F.when(F.col("unsure"), "ambiguous").otherwise("constructed")).drop("unsure")


def keyed_facts(rows: DataFrame) -> DataFrame:
    """Facts with their keys, from document_id, rule, subject, object and seen_kind, which are kept."""
    predicate = F.create_map(*(F.lit(x) for pair in RULES.items() for x in pair))[F.col("rule")]
    rows = settled(rows, predicate=predicate, checksum=checksum(), subject_key=entity_key(F.lit("designation"), "subject"), object_key=entity_key(F.col("seen_kind"), "object"))
    return rows.withColumn("fact_key", key("document_id", "checksum", F.lit("1.0"), "subject_key", "predicate", "object_key", "rule", F.lit("1.0"), F.lit("1.1")))


def short_candidates(rows: DataFrame) -> DataFrame:
    """``statement_candidates`` of facts without keys."""
    kind = F.when((F.col("rule") == "same_line_association") & (F.col("seen_kind") == "power_value"), "has_rated_power").when((F.col("rule") == "compound_reference_designation") & (F.col("seen_kind") == "location"), "is_located_in")
    rows = rows.withColumn("statement_type", kind).where("statement_type is not null")
    return rows.withColumn("candidates", F.count("*").over(Window.partitionBy("document_id", "subject", "statement_type")))


def short_support(shown: DataFrame) -> DataFrame:
    """``fact_support`` of lines with their observations, without keys: a row for each observation of either side (``seen``) on each line that joins a fact's
    pair. A line alone tells all of it."""
    rows = pairs_of(shown)
    of = lambda role: F.transform(F.filter("found", lambda x: (x["kind"] == F.col(f"{role}.kind")) & (entity_name(x) == F.col(f"{role}.name"))), lambda x: F.struct(F.lit(role).alias("role"), place_name(x).alias("place"), x.alias("seen")))
    rows = rows.withColumn("s", F.explode(F.concat(of("subject"), of("object"))))
    return rows.select("document_id", "line_index", "rule", F.col("subject.name").alias("subject"), F.col("object.name").alias("object"), F.col("object.kind").alias("seen_kind"), "s.*")


def keyed_support(rows: DataFrame) -> DataFrame:
    return keyed_facts(rows).select("document_id", "fact_key", "role", place_key("place").alias("evidence_key"), "line_index")


def line_diagnostics(shown: DataFrame) -> DataFrame:
    """``fact_diagnostics`` of lines with their observations."""
    rows, n = sides(shown), {c: F.size(c).cast("long") for c in ("subjects", "quantities", "places")}
    said = lambda when, rule, reason, objects: F.when(when & (n["subjects"] > 0) & (n[objects] > 0), F.struct(F.lit(rule).alias("rule"), reason.alias("reason"), n["subjects"].alias("n_subjects"), n[objects].alias("n_objects")))
    several = n["subjects"] > 1
    found = F.array_compact(F.array(
        said(several, "same_line_association", F.lit("multiple_subjects"), "quantities"), said(several | (n["places"] > 1), "same_line_location_association", F.when(several, "multiple_subjects").otherwise("multiple_objects"), "places"),
    ))
    return rows.select("document_id", "line_index", F.explode(found).alias("r")).select("document_id", "line_index", "r.*")
