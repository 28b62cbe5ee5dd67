"""Constraints declared over a table and checked together.

A set of checks is compiled into one read of the table: conditions on a row's own fields cost nothing more, each table that rows refer to is brought down to
one row a key and joined once, whatever number of checks reads what it brings, and each uniqueness is one count over its key. Every broken check of
every row is reported, in the order in which they are declared.

Defined results: a condition that is null is not broken; a reference with a null key finds nothing; rows that are equal are reported each; an empty table
has no violations.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import RULE_VERSIONS, UNITS


@dataclass(frozen=True)
class Rule:
    """Broken where the condition holds."""

    code: str
    broken: Column


@dataclass(frozen=True)
class Unique:
    """Broken where several rows have the same values."""

    code: str
    by: tuple[str, ...]


@dataclass(frozen=True)
class Refers:
    """What ``other`` has for a row (own column: its column), as aggregates by name; ``codes`` are conditions over the row and these. They are null where
    nothing is found."""

    on: dict[str, str]
    other: DataFrame
    brings: dict[str, Column]
    codes: dict[str, Column] = field(default_factory=dict)


def violations(rows: DataFrame, own: list[str], *checks: Rule | Unique | Refers, first: bool = False) -> DataFrame:
    """The columns ``own`` of each row that breaks a check, and its code; only the first of each row if ``first``."""
    found, codes = rows, []
    for k, check in enumerate(checks):
        if isinstance(check, Rule):
            codes.append((check.code, check.broken))
        elif isinstance(check, Unique):
            name = f"_times{k}"
            found = found.withColumn(name, F.count("*").over(Window.partitionBy(*check.by)))  # nulls are alike; rows that lie by a part of the key stay
            codes.append((check.code, F.col(name) > 1))
        else:
            side = check.other.groupBy(*(F.col(theirs).alias(f"_{k}{mine}") for mine, theirs in check.on.items())).agg(*(c.alias(n) for n, c in check.brings.items()))
            found = found.join(side, [F.col(mine) == F.col(f"_{k}{mine}") for mine in check.on], "left")
            codes += check.codes.items()
    broken = F.array_compact(F.array(*(F.when(condition, F.lit(code)) for code, condition in codes)))
    said = F.slice(broken, 1, 1) if first else broken
    return found.select(*own, F.explode(said).alias("code"))


# Which type a rule declares, what a fact's rule says and between what, types of entities and statements.
RULE_TYPES = {"designation_generic": "designation", "location_aspect_iec_81346": "location"}
FACT_RULES = (
    ("same_line_association", "has_associated_quantity", "equipment_designation", "engineering_quantity"),
    ("compound_reference_designation", "has_location_aspect", "equipment_designation", "structural_location"),
    ("same_line_location_association", "has_location_aspect", "equipment_designation", "structural_location"),
)
ENTITY_TYPES = ("equipment_designation", "structural_location", "engineering_quantity")
STATEMENT_TYPES = ("has_rated_power", "is_located_in")
REQUIRED = ("statement_key", "content_checksum", "semantic_rule_id", "semantic_rule_version", "semantic_contract_version", "resolution_policy_version", "fact_policy_version", "semantic_policy_version", "support_fingerprint", "reviewer_display_name")


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def evidence_violations(evidence: DataFrame, tokens: DataFrame, register: DataFrame, first: bool = False) -> DataFrame:
    """document_id, evidence_key, code. ``register``: document_id and the checksum of the text that evidence should come from."""
    quantity, start, end = F.col("kind").endswith("_value"), F.col("token_start"), F.col("token_end")
    declared = _map(dict(RULE_VERSIONS))[F.col("rule_id")]
    typed = F.coalesce(_map(RULE_TYPES)[F.col("rule_id")], F.col("rule_id"))
    written = F.col("number_text").isNotNull()
    return violations(
        evidence, ["document_id", "evidence_key"],
        Refers({"document_id": "document_id"}, register, {"_held": F.min("checksum")}, {"checksum_differs": F.col("_held").isNull() | (F.col("_held") != F.col("checksum"))}),
        Rule("unknown_rule", declared.isNull()),
        Rule("rule_version", declared != F.col("rule_version")),
        Rule("rule_type", declared.isNotNull() & (typed != F.col("kind"))),
        Refers(
            {"document_id": "document_id", "line_index": "line_index"}, tokens, {"_tokens": F.count("*"), "_chars": F.max("char_end")},
            {"unknown_line": F.col("_tokens").isNull(), "token_range": (start < 0) | (start > end) | (end >= F.col("_tokens")), "empty_span": (F.col("char_start") < 0) | (F.col("char_end") <= F.col("char_start")) | (F.col("char_end") > F.col("_chars"))},
        ),
        Rule("value_shape", F.when(quantity, F.col("designation").isNotNull() | ~written).otherwise(F.col("designation").isNull() | written)),
        Rule("value_missing", quantity & (F.col("status") == "observed") & F.col("value").isNull()),
        Rule("unit_undeclared", quantity & ~F.col("unit").isin(*sorted({u[0] for u in UNITS}))),
        first=first,
    )


def entity_violations(entities: DataFrame, references: DataFrame, evidence: DataFrame) -> DataFrame:
    """document_id, entity_key, code. ``references``: document_id, entity_key, evidence_key, a row for each evidence that an entity names."""
    known = evidence.select("document_id", "evidence_key", F.lit(True).alias("known")).distinct()
    named = references.join(known, ["document_id", "evidence_key"], "left")
    value, designation = F.col("value").isNotNull(), F.col("designation").isNotNull()
    return violations(
        entities, ["document_id", "entity_key"],
        Unique("repeated_key", ("document_id", "entity_key")),
        Rule("undeclared_type", ~F.col("entity_type").isin(*ENTITY_TYPES)),
        Refers({"document_id": "document_id", "entity_key": "entity_key"}, named, {"_named": F.count("*"), "_unknown": F.count_if(F.col("known").isNull())}, {"no_evidence": F.col("_named").isNull(), "unknown_evidence": F.col("_unknown") > 0}),
        Rule("several_values", value & designation),
        Rule("no_value", ~value & ~designation),
    )


def fact_violations(facts: DataFrame, entities: DataFrame, support: DataFrame, references: DataFrame) -> DataFrame:
    """document_id, fact_key, code. ``support``: document_id, fact_key, role, evidence_key, line_index; ``references`` as for entities."""
    rules = {r: F.struct(F.lit(p).alias("predicate"), F.lit(s).alias("subject"), F.lit(o).alias("object")) for r, p, s, o in FACT_RULES}
    said = F.create_map(*(x for r, v in rules.items() for x in (F.lit(r), v)))[F.col("rule")]
    sides = []
    for side in ("subject", "object"):
        kind = F.col(f"_{side}")
        sides.append(Refers({"document_id": "document_id", f"{side}_key": "entity_key"}, entities, {f"_{side}": F.min("entity_type")}, {f"{side}_missing": kind.isNull(), f"{side}_type": kind.isNotNull() & said.isNotNull() & (kind != said[side])}))
    ends = facts.select("document_id", "fact_key", "subject_key", "object_key").distinct()
    inside = references.select("document_id", "entity_key", "evidence_key", F.lit(True).alias("inside")).distinct()
    cited = support.join(ends, ["document_id", "fact_key"]).withColumn("entity_key", F.when(F.col("role") == "subject", F.col("subject_key")).otherwise(F.col("object_key")))
    cited = cited.join(inside, ["document_id", "entity_key", "evidence_key"], "left")
    by_line = cited.groupBy("document_id", "fact_key", "line_index").agg(*(F.count_if(F.col("role") == s).alias(s) for s in ("subject", "object")), F.count_if(F.col("inside").isNull()).alias("outside"))
    return violations(
        facts, ["document_id", "fact_key"],
        Unique("repeated_key", ("document_id", "fact_key")),
        Rule("unknown_rule", said.isNull()),
        Rule("rule_predicate", said["predicate"] != F.col("predicate")),
        Rule("same_ends", F.col("subject_key") == F.col("object_key")),
        *sides,
        Refers(
            {"document_id": "document_id", "fact_key": "fact_key"}, by_line, {"_s": F.sum("subject"), "_o": F.sum("object"), "_out": F.sum("outside"), "_shared": F.bool_or((F.col("subject") > 0) & (F.col("object") > 0))},
            {"no_support": (F.coalesce("_s", F.lit(0)) == 0) | (F.coalesce("_o", F.lit(0)) == 0), "support_outside": F.col("_out") > 0, "no_shared_line": ~F.col("_shared")},
        ),
    )


def statement_violations(statements: DataFrame, facts: DataFrame) -> DataFrame:
    """document_id, statement_key, code."""
    return violations(
        statements, ["document_id", "statement_key"],
        Unique("repeated_key", ("document_id", "statement_key")),
        Unique("several_of_type", ("document_id", "subject_key", "statement_type")),
        Rule("undeclared_type", ~F.col("statement_type").isin(*STATEMENT_TYPES)),
        Refers(
            {"document_id": "document_id", "fact_key": "fact_key"}, facts, {"_s": F.min("subject_key"), "_o": F.min("object_key")},
            {"fact_missing": F.col("_s").isNull(), "other_ends": (F.col("_s") != F.col("subject_key")) | (F.col("_o") != F.col("object_key"))},
        ),
    )


def provenance_violations(rows: DataFrame, own: str = "edge_id") -> DataFrame:
    """``own`` and a code for each required field that is missing or blank, and for ids that are not positive."""
    blank = [Rule(f"missing:{c}", F.coalesce(F.trim(F.col(c)), F.lit("")) == "") for c in REQUIRED]
    ids = [Rule(c, F.col(c).isNull() | (F.col(c) <= 0)) for c in ("document_id", "review_id")]
    return violations(rows, [own], *blank, *ids)


def memory_violations(entries: DataFrame, recorded: DataFrame) -> DataFrame:
    """conv_id, code over the entries of working memories and over what was recorded of them (conv_id, entries and a column a type)."""
    from .dialogue import MEMORY, memory_statistics

    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("sequence")) - 1
    policy = F.create_map(*(x for k, p, life in MEMORY for x in (F.lit(k), F.struct(F.lit(p).alias("priority"), F.lit(life).alias("lifetime")))))[F.col("entry_type")]
    answers = F.col("entry_type") == "recent_engineering_response"
    own = violations(
        entries.withColumn("_place", place), ["conv_id"], Rule("sequence", F.col("sequence") != F.col("_place")), Rule("unknown_type", policy.isNull()), Rule("priority", policy["priority"] != F.col("priority")), Rule("lifetime", policy["lifetime"] != F.col("lifetime")),
        Rule("response_missing", answers & F.col("response_id").isNull()), Rule("response_not_allowed", ~answers & F.col("response_id").isNotNull()),
    )
    names = ("entries", *(k for k, _, _ in MEMORY))
    counted = memory_statistics(entries)
    sums = violations(recorded, ["conv_id"], Refers({"conv_id": "conv_id"}, counted, {f"_{n}": F.min(n) for n in names}, {f"{n}_differ": F.col(n) != F.coalesce(f"_{n}", F.lit(0)) for n in names}))
    return own.unionByName(sums)


def intent_violations(intents: DataFrame, matches: DataFrame) -> DataFrame:
    """request_id, code of the intents (request_id, intent, confidence) that their matches do not bear out."""
    from .requests import CONFLICTING, PRECEDENCE

    plain, strong = F.col("strength") != "domain", F.col("strength") == "strong"
    rank = F.create_map(*(F.lit(x) for k, p in enumerate(PRECEDENCE) for x in (p, k)))
    brings = {
        "_all": F.count("*"), "_domain": F.count_if(~plain), "_plain": F.count_if(plain), "_candidates": F.collect_set(F.when(plain, F.col("intent"))), "_best": F.min(F.when(plain, rank[F.col("intent")])),
        "_operations": F.count_distinct(F.when(strong & F.col("intent").isin(*CONFLICTING), F.col("intent"))),
    }
    intent, n = F.col("intent"), lambda c: F.coalesce(c, F.lit(0))
    terminal = intent.isin("unsupported", "general", "ambiguous")
    held = F.coalesce(F.array_contains("_candidates", intent), F.lit(False))
    return violations(
        intents, ["request_id"],
        Refers({"request_id": "request_id"}, matches, brings, {
            "unsupported_by_evidence": ~terminal & ~held, "higher_precedence_left": ~terminal & held & (F.col("_best") < rank[intent]), "unsupported_with_evidence": (intent == "unsupported") & (n("_all") > 0), "general_without_domain": (intent == "general") & (n("_domain") == 0),
            "general_with_workflow": (intent == "general") & (n("_plain") > 0), "ambiguous_without_conflict": (intent == "ambiguous") & (n("_operations") < 2), "conflict_not_ambiguous": ~intent.isin("ambiguous") & (n("_operations") > 1),
        }),
        Rule("resolved_without_intent", intent.isin("ambiguous", "unsupported") & (F.col("confidence") != "unresolved")),
    )


def response_violations(responses: DataFrame) -> DataFrame:
    """response_id, code of responses (origin, provider, model, outcome, stated, evidence, bounded): no model named on an answer that none gave, verdicts
    bounded by their evidence."""
    provider, model = F.coalesce(F.trim("provider"), F.lit("")) != "", F.coalesce(F.trim("model"), F.lit("")) != ""
    by_model, without = F.col("origin") == "llm_invocation", F.col("origin") == "deterministic_retrieval"
    return violations(
        responses, ["response_id"],
        Rule("unknown_origin", F.col("origin").isNull() | ~F.col("origin").isin("llm_invocation", "deterministic_retrieval")), Rule("model_missing", by_model & ~(provider & model)), Rule("model_not_allowed", without & (provider | model)), Rule("negative_evidence", F.col("evidence") < 0),
        Rule("bounded_with_evidence", F.col("bounded") & (F.col("evidence") != 0)), Rule("bounded_verdict", F.col("bounded") & ~F.col("outcome").eqNullSafe("insufficient_evidence")), Rule("unbounded_without_evidence", ~F.col("bounded") & (F.col("evidence") == 0)),
        Rule("stated_nothing", F.col("outcome").isNull() & F.col("stated")),
    )


def prompt_violations(sections: DataFrame, recorded: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """prompt_id, code of prompts: their sections (prompt_id, place, section, content, enabled) against the ``order`` that all have, and the recorded counts
    (prompt_id, sections, enabled, disabled). Every section is there, a disabled one without content."""
    placed = F.transform(F.array_sort(F.collect_list(F.struct("place", "section"))), lambda x: x["section"])  # a prompt has a few sections
    blank = F.coalesce(F.trim("content"), F.lit("")) == ""
    counted = {"_order": placed, "_all": F.count("*"), "_on": F.count_if("enabled"), "_empty": F.count_if(F.col("enabled") & blank), "_filled": F.count_if(~F.col("enabled") & ~blank)}
    canonical = F.array(*map(F.lit, order))
    return violations(
        recorded, ["prompt_id"],
        Refers({"prompt_id": "prompt_id"}, sections, counted, {
            "no_sections": F.col("_all").isNull(), "sections_out_of_order": F.col("_order") != canonical, "section_count": F.col("sections") != F.col("_all"), "enabled_count": (F.col("enabled") != F.col("_on")) | (F.col("disabled") != F.col("_all") - F.col("_on")),
            "enabled_without_content": F.col("_empty") > 0, "disabled_with_content": F.col("_filled") > 0,
        }),
    )


def session_violations(sessions: DataFrame, timeline: DataFrame, moves: DataFrame) -> DataFrame:
    """session_id, code of sessions (session_id, project_id, state, responses, events, seconds) against their timelines (session_id, ts, response) and the states
    that their moves (session_id, state: the one that holds) lead to."""
    span = F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts"))
    return violations(
        sessions, ["session_id"],
        Rule("blank_id", F.col("session_id").isNull()), Rule("project", F.coalesce(F.col("project_id") <= 0, F.lit(True))),
        Refers({"session_id": "session_id"}, timeline, {"_events": F.count("*"), "_responses": F.count_if("response"), "_seconds": span}, {
            "no_events": F.col("_events").isNull(), "event_count": F.col("events") != F.col("_events"), "response_count": F.col("responses") != F.col("_responses"), "duration": F.col("seconds") != F.col("_seconds"),
        }),
        Refers({"session_id": "session_id"}, moves, {"_state": F.min("state")}, {"state": F.col("state") != F.col("_state")}),
    )
