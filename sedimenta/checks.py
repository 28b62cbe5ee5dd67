"""Queries of the declared constraints, over rows in which every fault is planted in some documents; in the catalogue's scheme.

The SQL states each condition by itself, over the same bent rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import QUERIES, Tables, once, query
from .functions.rules import RULE_VERSIONS, UNITS
from .operators import constraints, intervals
from .operators.lineage import copied, union_all
from .operators.machines import recursive_sql
from .operators.ordering import ranked
from .packages import _SUPPORT, snapshots
from .plans.oracle import sql
from .sources.stages import staged

_BEFORE = set(QUERIES)


def bent(rows: DataFrame, of: int, **faults) -> DataFrame:
    """``rows`` with columns changed in the documents whose number leaves the given remainder by ``of``: column = {remainder: value}."""
    k = F.col("document_id") % of
    changed = {}
    for column, by in faults.items():
        value = None
        for remainder, other in by.items():
            value = F.when(k == remainder, other) if value is None else value.when(k == remainder, other)
        changed[column] = value.otherwise(F.col(column))
    return rows.withColumns(changed)


def _bent(table: str, of: int, **faults: dict[int, str]) -> str:
    cases = ", ".join(f"case document_id % {of} " + " ".join(f"when {k} then {v}" for k, v in by.items()) + f" else {column} end as {column}" for column, by in faults.items())
    return f"select * replace ({cases}) from {table}"


def _codes(own: str, rows: str, **codes: str) -> str:
    """SQL: a row for each condition that holds."""
    said = ", ".join(f"case when {condition} then '{code}' end" for code, condition in codes.items())
    return f"select {own}, code from (select {own}, unnest([{said}]) as code from {rows}) where code is not null"


def _after(upto: str, parts: str, select: str) -> str:
    return sql("@", upto).replace("\n@", f",\n{parts}\n{select}")


# Evidence
_units = ", ".join(f"'{u}'" for u in sorted({u[0] for u in UNITS}))
_version = "case rule_id " + " ".join(f"when '{r}' then '{v}'" for r, v in RULE_VERSIONS.items()) + " end"
_EVIDENCE = f"""be as ({_bent('ev', 16, rule_id={0: "'unknown'"}, rule_version={1: "'9.9'"}, kind={2: "'current_value'"}, line_index={3: 'line_index + 1000'}, token_end={4: 'token_end + 100', 5: 'token_start - 1'}, char_end={6: 'char_start', 7: 'char_end + 1000'},
  number_text={8: "'5'"}, designation={9: 'null', 10: "'T1'"}, value={11: 'null'}, unit={12: "'furlong'"}, checksum={13: "'other'"})}),
sz as (select document_id, line_index, count(*) as tokens, max(char_start + length(text)) as chars from tok group by all),
rg as (select distinct document_id, sha256('register:' || document_id) as held from lines where document_id % 16 <> 14)"""


@query("c13_evidence_checks", _after("ev", _EVIDENCE, _codes(
    "document_id, evidence_key", "(select *, ends_with(kind, '_value') as q, " + _version + " as declared from be left join sz using (document_id, line_index) left join rg using (document_id))",
    checksum_differs="held is null or held <> checksum", unknown_rule="declared is null", rule_version="declared <> rule_version", rule_type="declared is not null and kind <> case rule_id when 'designation_generic' then 'designation' when 'location_aspect_iec_81346' then 'location' else rule_id end",
    unknown_line="tokens is null", token_range="token_start < 0 or token_start > token_end or token_end >= tokens", empty_span="char_start < 0 or char_end <= char_start or char_end > chars",
    value_shape="(q and (designation is not null or number_text is null)) or (not q and (designation is null or number_text is not null))", value_missing="q and status = 'observed' and value is null", unit_undeclared=f"q and unit not in ({_units})",
)))
def _(t: Tables) -> DataFrame:
    rows = bent(
        t.evidence, 16, rule_id={0: F.lit("unknown")}, rule_version={1: F.lit("9.9")}, kind={2: F.lit("current_value")}, line_index={3: F.col("line_index") + 1000}, token_end={4: F.col("token_end") + 100, 5: F.col("token_start") - 1}, char_end={6: F.col("char_start"), 7: F.col("char_end") + 1000},
        number_text={8: F.lit("5")}, designation={9: F.lit(None), 10: F.lit("T1")}, value={11: F.lit(None)}, unit={12: F.lit("furlong")}, checksum={13: F.lit("other")},
    )
    register = t.evidence.where("document_id % 16 <> 14").select("document_id", "checksum").distinct()
    return constraints.evidence_violations(rows, t.tokens, register)


# Entities
_ENTITIES = f"""be as ({_bent('ent', 11, entity_type={0: "'invented'"}, value={1: 'null', 2: '5'}, designation={3: 'null', 4: "'T1'"})} union all select * from ent where document_id % 11 = 5),
nm as (select document_id, entity_key, case when document_id % 11 = 6 then 'lost' else evidence_key end as evidence_key from ms where document_id % 11 <> 7),
su as (select document_id, entity_key, count(*) as named, count(*) filter (evidence_key = 'lost') as unknown from nm group by all), tw as (select document_id, entity_key, count(*) as times from be group by all)"""


@query("d07c_entity_checks", _after("ent", _ENTITIES, _codes(
    "document_id, entity_key", "(select * from be left join su using (document_id, entity_key) left join tw using (document_id, entity_key))",
    repeated_key="times > 1", undeclared_type="entity_type = 'invented'", no_evidence="named is null", unknown_evidence="unknown > 0", several_values="value is not null and designation is not null", no_value="value is null and designation is null",
)))
def _(t: Tables) -> DataFrame:
    rows = bent(t.entities, 11, entity_type={0: F.lit("invented")}, value={1: F.lit(None), 2: F.lit(5)}, designation={3: F.lit(None), 4: F.lit("T1")})
    named = bent(t.strict.where("document_id % 11 <> 7").select("document_id", "entity_key", "evidence_key"), 11, evidence_key={6: F.lit("lost")})
    return constraints.entity_violations(copied(rows, "document_id % 11 = 5"), named, t.evidence)


# Facts: ends, types, support
_JOIN = """jf as (select distinct j.document_id, f.fact_key, j.line_index, r.role, case r.role when 'subject' then j.subject_key else j.object_key end as entity_key from jl j join facts f using (document_id, subject_key, object_key, rule, predicate), (values ('subject'), ('object')) r(role)),
sp as (select distinct x.document_id, x.fact_key, x.role, e.evidence_key, x.line_index from jf x join ms e on e.document_id = x.document_id and e.line_index = x.line_index and e.entity_key = x.entity_key)"""
_FACTS = f"""{_JOIN}, bf as ({_bent('facts', 13, predicate={1: "'invented'"}, object_key={2: 'subject_key', 4: "'gone'"}, subject_key={3: "'lost'", 5: 'object_key'}, rule={9: "'unheard_of'"})} union all select * from facts where document_id % 13 = 0),
bs as ({_bent('sp', 13, evidence_key={6: "'outside'"}, line_index={7: "case role when 'object' then line_index + 1000 else line_index end"})} where not (document_id % 13 = 8 and role = 'object')),
en as (select document_id, entity_key, entity_type from ent), en1 as (select distinct document_id, fact_key, subject_key, object_key from bf),
ct as (select b.*, exists (select 1 from ms m where m.document_id = b.document_id and m.evidence_key = b.evidence_key and m.entity_key = case b.role when 'subject' then e.subject_key else e.object_key end) as inside from bs b join en1 e using (document_id, fact_key)),
ln2 as (select document_id, fact_key, line_index, count(*) filter (role = 'subject') as s, count(*) filter (role = 'object') as o, count(*) filter (not inside) as outside from ct group by all),
sm as (select document_id, fact_key, sum(s) as s, sum(o) as o, sum(outside) as outside, bool_or(s > 0 and o > 0) as shared from ln2 group by all), tw as (select document_id, fact_key, count(*) as times from bf group by all),
dr(rule, said, st0, ot0) as (values {', '.join(map(repr, constraints.FACT_RULES))})"""


@query("d16_fact_checks", _after("facts", _FACTS, _codes(
    "document_id, fact_key", "(select bf.*, a.entity_type as sk, b.entity_type as ok, dr.*, sm.s, sm.o, sm.outside, sm.shared, times from bf left join en a on a.document_id = bf.document_id and a.entity_key = bf.subject_key left join en b on b.document_id = bf.document_id and b.entity_key = bf.object_key left join dr on dr.rule = bf.rule left join sm on sm.document_id = bf.document_id and sm.fact_key = bf.fact_key left join tw on tw.document_id = bf.document_id and tw.fact_key = bf.fact_key)",
    repeated_key="times > 1", unknown_rule="said is null", rule_predicate="said <> predicate", same_ends="subject_key = object_key", subject_missing="sk is null", subject_type="sk <> st0", object_missing="ok is null", object_type="ok <> ot0",
    no_support="coalesce(s, 0) = 0 or coalesce(o, 0) = 0", support_outside="outside > 0", no_shared_line="not shared",
)))
def _(t: Tables) -> DataFrame:
    facts = bent(t.facts, 13, predicate={1: F.lit("invented")}, object_key={2: F.col("subject_key"), 4: F.lit("gone")}, subject_key={3: F.lit("lost"), 5: F.col("object_key")}, rule={9: F.lit("unheard_of")})
    support = bent(t.support, 13, evidence_key={6: F.lit("outside")}, line_index={7: F.when(F.col("role") == "object", F.col("line_index") + 1000).otherwise(F.col("line_index"))}).where("not (document_id % 13 = 8 and role = 'object')")
    return constraints.fact_violations(copied(facts, "document_id % 13 = 0"), t.entities, support, t.strict)  # no fault is planted in what is copied


# Statements
_STATEMENTS = f"""bt as ({_bent('st', 9, statement_type={2: "'invented'"}, fact_key={3: "'lost'"}, object_key={4: 'subject_key'})} union all select * from st where document_id % 9 = 0 union all select * replace (reverse(statement_key) as statement_key) from st where document_id % 9 = 1),
tk2 as (select document_id, statement_key, count(*) as times from bt group by all), ty as (select document_id, subject_key, statement_type, count(*) as same from bt group by all)"""


@query("d21_statement_checks", _after("st", _STATEMENTS, _codes(
    "document_id, statement_key", "(select bt.*, times, same, f.subject_key as fs, f.object_key as fo from bt join tk2 using (document_id, statement_key) join ty using (document_id, subject_key, statement_type) left join facts f on f.document_id = bt.document_id and f.fact_key = bt.fact_key)",
    repeated_key="times > 1", several_of_type="same > 1", undeclared_type="statement_type = 'invented'", fact_missing="fs is null", other_ends="fs <> subject_key or fo <> object_key",
)))
def _(t: Tables) -> DataFrame:
    rows = bent(t.statements, 9, statement_type={2: F.lit("invented")}, fact_key={3: F.lit("lost")}, object_key={4: F.col("subject_key")})
    rows = copied(rows, "document_id % 9 < 2", "copy").withColumn("statement_key", F.when((F.col("copy") == 1) & (F.col("document_id") % 9 == 1), F.reverse("statement_key")).otherwise(F.col("statement_key")))
    return constraints.statement_violations(rows.drop("copy"), t.facts)


# Provenance: every field that knowledge has to name
def provenance(t: Tables) -> DataFrame:
    """Where each edge comes from: statement, document and its bytes, review and reviewer, rule, policies, support."""
    seen = snapshots(t).select("document_id", "statement_key", F.col("checksum").alias("content_checksum"), F.col("rule_id").alias("semantic_rule_id"), F.col("rule_version").alias("semantic_rule_version"), F.col("fingerprint").alias("support_fingerprint"))
    who = t.reviews.select("review_id", F.concat(F.lit("reviewer "), F.col("reviewer").cast("string")).alias("reviewer_display_name"))
    versions = {"semantic_contract_version": "1.0", "resolution_policy_version": "2.0", "fact_policy_version": "1.1", "semantic_policy_version": "1.0"}
    rows = t.edges.select("edge_id", "document_id", "statement_key", "review_id").join(seen, ["document_id", "statement_key"]).join(who, "review_id")
    return rows.withColumns({n: F.lit(v) for n, v in versions.items()})


_FIELDS = dict(enumerate(constraints.REQUIRED))
_PROVENANCE = f"""{_SUPPORT}, pv as (select edge_id, e.document_id, e.statement_key, e.review_id, checksum as content_checksum, 'rule:' || statement_type as semantic_rule_id, '1.0' as semantic_rule_version, '1.0' as semantic_contract_version, '2.0' as resolution_policy_version, '1.1' as fact_policy_version, '1.0' as semantic_policy_version,
  sha256(keys) as support_fingerprint, 'reviewer ' || reviewer as reviewer_display_name from edges e join st on st.document_id = e.document_id and st.statement_key = e.statement_key join sup on sup.document_id = st.document_id and sup.subject_key = st.subject_key join rv on rv.review_id = e.review_id),
bp as (select * replace ({', '.join(f"case when document_id % 17 = {k} then {'null' if k % 2 else repr(' ')} else {c} end as {c}" for k, c in _FIELDS.items())}, case document_id % 17 when 11 then -review_id when 12 then null else review_id end as review_id, case when document_id % 17 = 13 then 0 else document_id end as document_id) from pv)"""


@query("g06_provenance_checks", _after("edges", _PROVENANCE, _codes("edge_id", "bp", **{f"missing:{c}": f"trim(coalesce({c}, '')) = ''" for c in constraints.REQUIRED}, document_id="document_id is null or document_id <= 0", review_id="review_id is null or review_id <= 0")))
def _(t: Tables) -> DataFrame:
    faults = {c: {k: F.lit(None) if k % 2 else F.lit(" ")} for k, c in _FIELDS.items()}
    rows = bent(provenance(t), 17, **faults, review_id={11: -F.col("review_id"), 12: F.lit(None)}, document_id={13: F.lit(0)})
    return constraints.provenance_violations(rows)


@query("g21_provenance", _after("edges", _PROVENANCE, "select * from pv"))
def _(t: Tables) -> DataFrame:
    return provenance(t)


# Timelines: two messages make a turn; a message comes a minute after the one before, a turn is begun a second before its first message and completed
# five seconds after its last one, unless nothing answers in it
_TIMELINE = """mg as (select conv_id, turn // 2 as turn, role, timestamp '2024-01-01' + to_minutes(conv_id * 7 + turn) as t, turn as k, text from conversations),
t0 as (select conv_id, null::bigint as turn, 'conversation_created' as event_type, min(t) - interval 10 second as at0, 0 as o, 0 as k, '' as x from mg group by conv_id union all select conv_id, turn, 'turn_started', min(t) - interval 1 second, 1, 0, '' from mg group by conv_id, turn
  union all select conv_id, turn, 'message_added', t, 2, k, coalesce(text, '') from mg union all select conv_id, turn, 'response_attached', t + interval 1 second, 3, k, coalesce(text, '') from mg where role = 'assistant'
  union all select conv_id, turn, 'turn_completed', max(t) + interval 5 second, 4, 0, '' from mg group by conv_id, turn having bool_or(role = 'assistant')),
tm as (select conv_id, turn, event_type, at0, row_number() over (partition by conv_id order by at0, o, k, x) - 1 as sequence from t0)"""


@once
def timeline_of(t: Tables) -> DataFrame:
    seconds = lambda n: F.expr(f"interval {n} second")
    at = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-01-01 00:00:00")) + (F.col("conv_id") * 7 + F.col("turn")) * 60)
    rows = t.read("conversations").select("conv_id", F.expr("turn div 2").alias("exchange"), "role", at.alias("t"), F.col("turn").alias("k"), F.coalesce("text", F.lit("")).alias("x"))
    of_turn = rows.groupBy("conv_id", "exchange").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.bool_or(F.col("role") == "assistant").alias("answered"))
    nothing = (F.lit(0).cast("long").alias("k"), F.lit("").alias("x"))
    event = lambda df, turn, kind, at, o, *tie: df.select("conv_id", turn.alias("turn"), F.lit(kind).alias("event_type"), at.alias("at"), F.lit(o).alias("o"), *(tie or nothing))
    turn = F.col("exchange")
    parts = [
        event(of_turn.groupBy("conv_id").agg(F.min("first").alias("first")), F.lit(None).cast("long"), "conversation_created", F.col("first") - seconds(10), 0), event(of_turn, turn, "turn_started", F.col("first") - seconds(1), 1),
        event(rows, turn, "message_added", F.col("t"), 2, "k", "x"), event(rows.where("role = 'assistant'"), turn, "response_attached", F.col("t") + seconds(1), 3, "k", "x"), event(of_turn.where("answered"), turn, "turn_completed", F.col("last") + seconds(5), 4),
    ]
    placed = ranked(union_all(parts), "conv_id", "at", "o", "k", "x")
    return staged(placed.select("conv_id", "turn", "event_type", "at", F.col("rank").alias("sequence")), "timeline")


_TURNS = """ts as (select conv_id, turn, count(*) filter (event_type = 'message_added') as messages, count(*) filter (event_type = 'response_attached') as responses, min(at0) filter (event_type = 'turn_started') as opened_at, max(at0) filter (event_type = 'turn_completed') as closed_at from tm where turn is not null group by all),
cs as (select conv_id, count(distinct turn) as turns, count(*) filter (event_type = 'message_added') as messages, count(*) filter (event_type = 'response_attached') as responses, count(*) as events, epoch(max(at0))::bigint - epoch(min(at0))::bigint as seconds, max(at0) as last_activity_at from tm group by conv_id)"""


@query("o01b_conversation_timelines", f"with {_TIMELINE}, {_TURNS} select * from cs")
def _(t: Tables) -> DataFrame:
    return intervals.conversation_statistics(timeline_of(t))


@query("o02b_turn_durations", f"with {_TIMELINE}, {_TURNS} select *, epoch(closed_at)::bigint - epoch(opened_at)::bigint as seconds from ts")
def _(t: Tables) -> DataFrame:
    return intervals.turn_statistics(timeline_of(t))


# events of some conversations are lost, swapped or come before their turn; recorded statistics are off
_BENT_TM = "bm as (select conv_id, turn, event_type, case when conv_id % 6 = 1 and sequence = 3 then at0 - interval 1 day else at0 end as at0, sequence from tm where not (conv_id % 6 = 0 and sequence = 2) and not (conv_id % 6 = 2 and event_type = 'turn_started' and turn = 1))"


@query("o03c_timeline_checks", f"with {_TIMELINE}, {_BENT_TM} " + _codes(
    "conv_id, sequence", "(select *, row_number() over (partition by conv_id order by sequence) - 1 as place, lag(at0) over (partition by conv_id order by sequence) as before, row_number() over (partition by conv_id, turn order by sequence) as n from bm)",
    not_contiguous="sequence <> place", back_in_time="at0 < before", turn_not_started="turn is not null and n = 1 and event_type <> 'turn_started'",
))
def _(t: Tables) -> DataFrame:
    k = F.col("conv_id") % 6
    rows = timeline_of(t).where("not (conv_id % 6 = 0 and sequence = 2) and not (conv_id % 6 = 2 and event_type = 'turn_started' and turn <=> 1)")
    return intervals.timeline_violations(rows.withColumn("at", F.when((k == 1) & (F.col("sequence") == 3), F.col("at") - F.expr("interval 1 day")).otherwise(F.col("at"))))


@query("o03d_recorded_statistics", f"with {_TIMELINE}, {_TURNS}, rc as (select case when conv_id % 8 = 5 then -conv_id else conv_id end as conv_id, turns + (conv_id % 8 = 1)::int as turns, messages - (conv_id % 8 = 2)::int as messages, responses, case when conv_id % 8 = 3 then null else events end as events, seconds + (conv_id % 8 = 4)::int as seconds from cs) " + _codes(
    "conv_id", "(select rc.*, c.turns as t1, c.messages as m1, c.responses as r1, c.events as e1, c.seconds as s1, c.conv_id is not null as known from rc left join cs c on c.conv_id = rc.conv_id)", unknown="not known", turns_differ="known and turns is distinct from t1", messages_differ="known and messages is distinct from m1", responses_differ="known and responses is distinct from r1",
    events_differ="known and events is distinct from e1", seconds_differ="known and seconds is distinct from s1",
))
def _(t: Tables) -> DataFrame:
    counted, k = intervals.conversation_statistics(timeline_of(t)), F.col("conv_id") % 8
    one = lambda r: (k == r).cast("int")
    recorded = counted.select(F.when(k == 5, -F.col("conv_id")).otherwise(F.col("conv_id")).alias("conv_id"), (F.col("turns") + one(1)).alias("turns"), (F.col("messages") - one(2)).alias("messages"), "responses", F.when(k != 3, F.col("events")).alias("events"), (F.col("seconds") + one(4)).alias("seconds"))
    return intervals.recorded_violations(recorded, counted, ["conv_id"], ("turns", "messages", "responses", "events", "seconds"))


_OPEN_CLOSE = "oc as (select user_id, event_id, ts, case when event_type in ('signup', 'view') then 'open' else 'closed' end as what from events)"


@query("o19_activity_intervals", "with " + recursive_sql(f"with {_OPEN_CLOSE} select * from oc", intervals.AGAIN, "user_id", "what", "ts, event_id, what") + """,
ac as (select user_id, ts, row_number() over (partition by user_id order by k) - 1 as r from run where before <> after) select user_id, r // 2 as number, min(ts) as opened_at, case when count(*) = 2 then max(ts) end as closed_at, case when count(*) = 2 then epoch(date_trunc('second', max(ts)))::bigint - epoch(date_trunc('second', min(ts)))::bigint end as seconds from ac group by user_id, r // 2""")
def _(t: Tables) -> DataFrame:
    what = F.when(F.col("event_type").isin("signup", "view"), "open").otherwise("closed")
    return intervals.intervals(t.read("events").select("user_id", "event_id", "ts", what.alias("what")), "user_id", "what", "ts", "event_id")


#: The queries of this module.
NAMES = sorted(set(QUERIES) - _BEFORE)
