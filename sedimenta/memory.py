"""Queries over catalogues, contexts, working memories and their validators; in the catalogue's scheme."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .audits import _state, generations_of, session_moves
from .catalogue import _INTENTS, QUERIES, Tables, _caps, _of_requests, expected_of, once, query
from .catalogue import _after as _of_items
from .checks import _codes
from .functions.rules import UNITS
from .operators import constraints, dialogue, ledger, machines, quality, requests, retrieval
from .operators import evidence as ev
from .operators.lineage import union_all
from .operators.machines import recursive_sql
from .plans.oracle import sql
from .sources.stages import staged

_BEFORE = set(QUERIES)

# Catalogue: parts are entries, every tenth part is the parent of the nine that follow it
_ENTRIES = """ct as (select p_partkey as entry_id, p_partkey as rank, case when p_partkey % 10 <> 0 then p_partkey // 10 * 10 end as parent, p_type as category, list_filter([case when p_partkey % 2 = 0 then 'feeds' end, case when p_partkey % 3 = 0 then 'protects' end], lambda x: x is not null) as relations,
  list_filter(['size', case when p_partkey % 4 = 0 then 'brand' end], lambda x: x is not null) as attributes from part),
rq as (select p_partkey as request_id, w as what, case w when 'category' then ' ' || lower(p_type) else p_partkey::varchar end as text, case w when 'relation' then 'feeds' when 'attribute' then 'brand' end as more from part, (values ('child'), ('relation'), ('attribute')) v(w) union all select min(p_partkey), 'category', ' ' || lower(p_type), null from part group by lower(p_type)),
hit as (select request_id, what, entry_id, rank from rq join ct on what = 'child' and parent::varchar = trim(text) union all select request_id, what, entry_id, rank from rq join ct on what = 'category' and lower(category) = lower(trim(text))
  union all select request_id, what, entry_id, rank from rq join ct on what = 'relation' and entry_id::varchar = trim(text) and list_contains(relations, more) union all select request_id, what, entry_id, rank from rq join ct on what = 'attribute' and entry_id::varchar = trim(text) and list_contains(attributes, more))"""


@query("a22b_catalogue_lookups", f"with {_ENTRIES} select request_id, what, entry_id, row_number() over (partition by request_id, what order by rank, entry_id) - 1 as place from (select distinct * from hit)")
def _(t: Tables) -> DataFrame:
    p, part = F.col("p_partkey"), t.read("part")
    kinds = F.array_compact(F.array(F.when(p % 2 == 0, "feeds"), F.when(p % 3 == 0, "protects")))
    values = F.when(p % 4 == 0, F.create_map(F.lit("size"), F.col("p_size").cast("string"), F.lit("brand"), F.col("p_brand"))).otherwise(F.create_map(F.lit("size"), F.col("p_size").cast("string")))
    entries = part.select(p.alias("entry_id"), p.alias("rank"), F.when(p % 10 != 0, F.expr("p_partkey div 10 * 10")).alias("parent"), F.col("p_type").alias("category"), kinds.alias("relations"), values.alias("attributes"))
    ask = lambda what, more: part.select(p.alias("request_id"), F.lit(what).alias("what"), p.cast("string").alias("text"), F.lit(more).cast("string").alias("more"))
    types = part.groupBy(F.concat(F.lit(" "), F.lower("p_type")).alias("text")).agg(F.min("p_partkey").alias("request_id"))
    in_category = types.select("request_id", F.lit("category").alias("what"), "text", F.lit(None).cast("string").alias("more"))
    return ledger.catalogue_lookups(union_all([ask("child", None), ask("relation", "feeds"), ask("attribute", "brand"), in_category]), entries)


_DOMAIN = "case when q like 'cable%' then 'cabling' else 'electrical' end"


@query("a23b_attributes_by_id_unit_domain", sql(f"""select text, "by", attribute_id from (select distinct kind as text, 'id' as "by" from ev union select distinct unit, 'unit' from ev where unit is not null union select distinct {_DOMAIN.replace('q like', 'kind like')}, 'domain' from ev where ends_with(kind, '_value')) o join (select distinct 'id' as b, quantity_type as k, quantity_type as attribute_id from units union select 'unit', lower(unit), quantity_type from units union select 'domain', {_DOMAIN.replace('q like', 'quantity_type like')}, quantity_type from units) a on b = "by" and k = lower(text)""", "ev"))
def _(t: Tables) -> DataFrame:
    domain = lambda kind: "cabling" if kind.startswith("cable") else "electrical"
    kinds = sorted({u[1] for u in UNITS})
    known = t.spark.createDataFrame([(k, [u[0] for u in UNITS if u[1] == k], domain(k)) for k in kinds], "attribute_id string, units array<string>, domain string")
    kind = F.col("kind")
    seen = lambda rows, column, by: rows.select(column.alias("text"), F.lit(by).alias("by")).where("text is not null").distinct()
    asked = union_all([seen(t.kinds, kind, "id"), seen(t.kinds, F.col("unit"), "unit"), seen(t.kinds.where(kind.endswith("_value")), F.when(kind.startswith("cable"), "cabling").otherwise("electrical"), "domain")])
    return ledger.attribute_lookups(asked, known)


@query("a28_scope_violations", "select * from (select document_id, case when scope is null or scope not in ('project', 'library') then 'unknown_scope' when scope = 'project' and project_id is null then 'project_missing' when scope = 'library' and project_id is not null then 'project_not_allowed' end as code from (select o_orderkey as document_id, case o_orderstatus when 'F' then 'library' when 'O' then 'project' else case when o_orderkey % 2 = 0 then 'shelf' end end as scope, case when o_custkey % 3 <> 0 then o_custkey end as project_id from orders)) where code is not null")
def _(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    scope = F.when(status == "F", "library").when(status == "O", "project").when(F.col("o_orderkey") % 2 == 0, "shelf")
    return ledger.scope_violations(t.read("orders").select(F.col("o_orderkey").alias("document_id"), scope.alias("scope"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("project_id")))


@query("l03_claims_by_document", "select distinct l_suppkey as document_id, l_orderkey as claim_id from lineitem where l_orderkey in (select o_orderkey from orders where o_orderstatus <> 'F')")
def _(t: Tables) -> DataFrame:
    claims = t.read("orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("claim_id"))
    return ledger.claims_of_documents(claims, t.read("lineitem").select(F.col("l_suppkey").alias("document_id"), F.col("l_orderkey").alias("claim_id")))


# Context: versions that all results agree in, entries up to the limit; two sides apart
_RESULTS = "rs as (select q.project_id, am.query_id, node_id, case when q.project_id % 3 = 0 and q.designation = lower(q.designation) then '1.1' else '1.0' end as normalisation, '1.0' as matching, case when q.project_id % 2 = 0 then 3 else 2 + (precedence = 1)::int end as generation from am join qs q using (query_id))"


@query("i08b_package_metadata", sql("@", "am").replace("\n@", f",\n{_RESULTS} select project_id, case when count(distinct normalisation) = 1 then max(normalisation) end as normalisation, case when count(distinct matching) = 1 then max(matching) end as matching, case when count(distinct generation) = 1 then max(generation) end as generation, count(*) as requested, least(count(*), 20) as accepted, count(*) - least(count(*), 20) as discarded, least(count(*), 20) / 20 as utilisation from rs group by project_id"))
def _(t: Tables) -> DataFrame:
    asked = t.asked.select("query_id", F.col("designation").alias("asked"))
    rows = t.found.join(asked, "query_id")
    odd = (F.col("project_id") % 3 == 0) & (F.col("asked") == F.lower("asked"))
    generation = F.when(F.col("project_id") % 2 == 0, 3).otherwise(F.lit(2) + (F.col("precedence") == 1).cast("int"))
    rows = rows.select("project_id", F.when(odd, "1.1").otherwise("1.0").alias("normalisation"), F.lit("1.0").alias("matching"), generation.cast("long").alias("generation"))
    return retrieval.package_metadata(rows, "project_id", ("normalisation", "matching", "generation"))


_SIDES = f"""si as (select document_id // 100 as request_id, case when document_id % 2 = 0 then 'left' else 'right' end as side, entity_key as item_id, case entity_type when 'equipment_designation' then 'engineering_asset' else entity_type end as kind, label as order_key from ent where document_id % 100 <> 1 and (document_id // 100 % 4 <> 0 or document_id % 2 = 0)),
el as (select *, row_number() over (partition by request_id, side, kind order by order_key, item_id) <= {_caps} as eligible from si), tb as (select *, coalesce(sum(eligible::int) over (partition by request_id, side order by order_key, item_id rows between unbounded preceding and 1 preceding), 0) as before from el)"""


@query("i09b_two_packages", sql("@", "ent").replace("\n@", f",\n{_SIDES} select request_id, count(*) filter (side = 'left' and eligible and before < 100) as left_evidence, count(*) filter (side = 'right' and eligible and before < 100) as right_evidence, count(*) filter (side = 'left') as left_found, count(*) filter (side = 'right') as right_found, count(*) filter (side = 'left' and eligible and before < 100) > 0 and count(*) filter (side = 'right' and eligible and before < 100) > 0 as both_sides from tb group by request_id"))
def _(t: Tables) -> DataFrame:
    document, kind = F.col("document_id"), F.when(F.col("entity_type") == "equipment_designation", "engineering_asset").otherwise(F.col("entity_type"))
    rows = t.entities.where("document_id % 100 <> 1 and (document_id div 100 % 4 <> 0 or document_id % 2 = 0)")
    items = rows.select(F.expr("document_id div 100").alias("question"), F.when(document % 2 == 0, "left").otherwise("right").alias("side"), F.col("entity_key").alias("item_id"), kind.alias("kind"), F.col("label").alias("order_key"))
    return retrieval.two_packages(items).withColumnRenamed("question", "request_id")


@query("h11b_retrieval_diagnostics", sql("""select q.query_id, lower(trim(q.designation)) as normalised, 'exact_designation,normalized_designation,normalized_value,canonical_designation' as strategies, case min(am.precedence) when 1 then 'exact_designation' when 2 then 'normalized_designation' when 3 then 'normalized_value' when 4 then 'canonical_designation' end as decided_by,
  coalesce(max(c.n), 0) as examined, count(am.node_id) as matched, least(count(am.node_id), 20) as returned, 3 as generation from qs q left join (select project_id, count(*) as n from nodes where node_kind = 'engineering_asset' group by project_id) c on c.project_id = q.project_id left join am on am.query_id = q.query_id group by q.query_id, q.designation""", "am"))
def _(t: Tables) -> DataFrame:
    held = generations_of(t)
    return retrieval.diagnostics(t.asked, held.nodes(), t.found, held.generation())


# Evaluation run: extraction over the register, scored against what is expected, with the versions of the rules that ran
@query("n06_evaluation_run", sql("""select kind, tp, fp, fn, case when tp + fp > 0 then round_even(tp / (tp + fp), 6) end as precision, case when tp + fn > 0 then round_even(tp / (tp + fn), 6) end as recall, case when tp > 0 then round_even(2 * tp / (2 * tp + fp + fn), 6) end as f1, fp = 0 and fn = 0 as perfect, (select string_agg(distinct rule_id || '@' || rule_version, ',' order by rule_id || '@' || rule_version) from ev) as rule_versions from (
  select kind, count(*) filter (kind <> 'current_value' and not (kind = 'designation' and document_id % 10 = 0)) as tp, count(*) filter (kind = 'current_value' or (kind = 'designation' and document_id % 10 = 0)) as fp, count(*) filter (kind = 'designation' and document_id % 10 = 0) as fn from ev group by grouping sets ((kind), ()))""", "ev"))
def _(t: Tables) -> DataFrame:
    return quality.evaluation_run(t.register, expected_of, lambda lines: t.by_document(ev.shown_in(lines, t.lines), "run"))


# Working memory: every answer is a response; its status, references, doubts and warnings follow from its place and length
_RESPONSES = r"""rp as (select conv_id * 1000 + turn as response_id, conv_id, turn as t, case turn % 4 when 1 then 'complete' when 3 then 'partial' when 0 then 'empty' else 'unsupported' end as status, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '')[1:4] as refs,
  list_filter([case when turn % 4 = 3 then 'not_in_full' end, case when turn % 4 = 0 then 'no_content' end, case when conv_id % 3 = 0 then 'ambiguous_query' end], lambda x: x is not null) as reasons, list_filter([case when length(text) > 400 then 'response_truncated' end, case when conv_id % 2 = 0 then 'partial_coverage' end], lambda x: x is not null) as warnings
  from conversations where role = 'assistant'), c as (select * from conversations where not (role = 'assistant' and turn >= 4 and conv_id % 2 = 0)), q as (select conv_id, max({'turn': turn, 'role': role, 'text': text}) as m from c group by conv_id),
r as (select * from (select *, row_number() over (partition by conv_id order by t desc, response_id desc) as place from rp) where place <= 5), rr as (select conv_id, place * 1000000 + i - 1 as k, refs[i] as item from (select *, unnest(range(1, len(refs) + 1)) as i from r)),
e as (select conv_id, 0 as p, 'open_question' as entry_type, 0 as k, (m).text as content, null::bigint as response_id from q where (m).role = 'user' union all select conv_id, 1, 'recent_engineering_response', place, 'status=' || status, response_id from r union all select conv_id, 2, 'active_reference', min(k), item, null from rr group by conv_id, item
  union all select conv_id, 3, 'assumption', i - 1, reasons[i], null from (select *, unnest(range(1, len(reasons) + 1)) as i from r where place = 1) union all select conv_id, 4, 'constraint', i - 1, warnings[i], null from (select *, unnest(range(1, len(warnings) + 1)) as i from r where place = 1)),
wm as (select conv_id, row_number() over (partition by conv_id order by p, k, content) - 1 as sequence, entry_type, content, response_id, case entry_type when 'recent_engineering_response' then 'low' when 'active_reference' then 'medium' when 'assumption' then 'medium' else 'high' end as priority, case entry_type when 'open_question' then 'turn' else 'conversation' end as lifetime from e)"""
_TYPES = tuple(k for k, _, _ in dialogue.MEMORY)
_counts = ", ".join(f"count(*) filter (entry_type = '{k}') as {k}" for k in _TYPES)


@once
def memories(t: Tables) -> DataFrame:
    turn, conv, rows = F.col("turn"), F.col("conv_id"), t.read("conversations")
    kept = lambda *parts: F.array_compact(F.array(*parts))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "\\s+"), lambda w: w != "")
    status = F.when(turn % 4 == 1, "complete").when(turn % 4 == 3, "partial").when(turn % 4 == 0, "empty").otherwise("unsupported")
    responses = rows.where("role = 'assistant'").select(
        (conv * 1000 + turn).alias("response_id"), "conv_id", turn.alias("at"), status.alias("status"), F.slice(words, 1, 4).alias("references"), kept(F.when(turn % 4 == 3, "not_in_full"), F.when(turn % 4 == 0, "no_content"), F.when(conv % 3 == 0, "ambiguous_query")).alias("reasons"),
        kept(F.when(F.length("text") > 400, "response_truncated"), F.when(conv % 2 == 0, "partial_coverage")).alias("warnings"),
    )
    return staged(dialogue.working_memory(rows.where("not (role = 'assistant' and turn >= 4 and conv_id % 2 = 0)"), responses), "memories")


@query("o08b_working_memory", f"with {_RESPONSES} select * from wm")
def _(t: Tables) -> DataFrame:
    return memories(t)


@query("o09_memory_statistics", f"with {_RESPONSES} select conv_id, count(*) as entries, {_counts} from wm group by conv_id")
def _(t: Tables) -> DataFrame:
    return dialogue.memory_statistics(memories(t))


_k = "conv_id % 9"
_BENT = f"""bw as (select conv_id, case when {_k} = 0 and sequence > 2 then sequence + 1 else sequence end as sequence, case when {_k} = 1 and entry_type = 'assumption' then 'guess' else entry_type end as entry_type, case when {_k} = 2 then 'low' else priority end as priority, case when {_k} = 3 then 'turn' else lifetime end as lifetime,
  case when {_k} = 4 then null when {_k} = 5 then conv_id else response_id end as response_id from wm), cn as (select conv_id, count(*) as entries, {_counts} from bw group by conv_id), rd as (select conv_id, entries + ({_k} = 6)::int as entries, {', '.join(f'"{k}" + ({_k} = 7)::int as "{k}"' for k in _TYPES)} from cn)"""


@query("o18c_memory_checks", f"with {_RESPONSES}, {_BENT} " + _codes(
    "conv_id", "(select *, row_number() over (partition by conv_id order by sequence) - 1 as place, case entry_type when 'recent_engineering_response' then 'low' when 'active_reference' then 'medium' when 'assumption' then 'medium' when 'open_question' then 'high' when 'constraint' then 'high' end as pr, case entry_type when 'open_question' then 'turn' when 'guess' then null else 'conversation' end as li from bw)",
    sequence="sequence <> place", unknown_type="pr is null", priority="pr <> priority", lifetime="li <> lifetime", response_missing="entry_type = 'recent_engineering_response' and response_id is null", response_not_allowed="entry_type <> 'recent_engineering_response' and response_id is not null",
) + " union all " + _codes("conv_id", "(select rd.*, " + ", ".join(f'cn."{n}" as {n}0' for n in ("entries", *_TYPES)) + " from rd join cn using (conv_id))", **{f"{n}_differ": f'"{n}" <> {n}0' for n in ("entries", *_TYPES)}))
def _(t: Tables) -> DataFrame:
    k, kind = F.col("conv_id") % 9, F.col("entry_type")
    bent = memories(t).withColumns({
        "sequence": F.when((k == 0) & (F.col("sequence") > 2), F.col("sequence") + 1).otherwise(F.col("sequence")), "entry_type": F.when((k == 1) & (kind == "assumption"), "guess").otherwise(kind), "priority": F.when(k == 2, "low").otherwise(F.col("priority")), "lifetime": F.when(k == 3, "turn").otherwise(F.col("lifetime")),
        "response_id": F.when(k == 4, None).when(k == 5, F.col("conv_id")).otherwise(F.col("response_id")),
    })
    counted = dialogue.memory_statistics(bent)
    recorded = counted.select("conv_id", (F.col("entries") + (k == 6).cast("int")).alias("entries"), *((F.col(n) + (k == 7).cast("int")).alias(n) for n in _TYPES))
    return constraints.memory_violations(bent, recorded)


_BENT_INTENTS = "bi as (select request_id, case h when 0 then 'drawing' when 1 then 'unsupported' when 2 then 'general' when 3 then 'ambiguous' else intent end as intent, case when h = 4 then 'high' else confidence end as confidence from (select *, length(request_id) * 7 + ascii(right(request_id, 1)) as g, (length(request_id) * 7 + ascii(right(request_id, 1))) % 6 as h from it))"
_clash = ", ".join(map(repr, requests.CONFLICTING))
_rank = lambda c: f"case {c} " + " ".join(f"when '{p}' then {k}" for k, p in enumerate(requests.PRECEDENCE)) + " end"


@query("o18d_intent_checks", _of_requests(_codes(
    "request_id", f"(select bi.*, x.n, x.dom, x.pl, x.cand, x.best, x.ops, {_rank('bi.intent')} as rk, bi.intent in ('unsupported', 'general', 'ambiguous') as terminal from bi left join (select request_id, count(*) as n, count(*) filter (strength = 'domain') as dom, count(*) filter (strength <> 'domain') as pl, list(distinct intent) filter (strength <> 'domain') as cand, min({_rank('intent')}) filter (strength <> 'domain') as best, count(distinct case when strength = 'strong' and intent in ({_clash}) then intent end) as ops from mt group by request_id) x using (request_id))",
    unsupported_by_evidence="not terminal and not coalesce(list_contains(cand, intent), false)", higher_precedence_left="not terminal and coalesce(list_contains(cand, intent), false) and best < rk", unsupported_with_evidence="intent = 'unsupported' and coalesce(n, 0) > 0", general_without_domain="intent = 'general' and coalesce(dom, 0) = 0",
    general_with_workflow="intent = 'general' and coalesce(pl, 0) > 0", ambiguous_without_conflict="intent = 'ambiguous' and coalesce(ops, 0) < 2", conflict_not_ambiguous="intent <> 'ambiguous' and coalesce(ops, 0) > 1", resolved_without_intent="intent in ('ambiguous', 'unsupported') and confidence <> 'unresolved'",
), _INTENTS, _BENT_INTENTS))
def _(t: Tables) -> DataFrame:
    h = (F.length("request_id") * 7 + F.ascii(F.right("request_id", F.lit(1)))) % 6
    intents = requests.classified(t.texts, t.rule_matches)
    bent = intents.select("request_id", F.when(h == 0, "drawing").when(h == 1, "unsupported").when(h == 2, "general").when(h == 3, "ambiguous").otherwise(F.col("intent")).alias("intent"), F.when(h == 4, "high").otherwise(F.col("confidence")).alias("confidence"))
    return constraints.intent_violations(bent, t.rule_matches)


_ANSWERS = """an as (select conv_id * 1000 + turn as response_id, case conv_id % 5 when 0 then 'deterministic_retrieval' when 1 then 'guess' else 'llm_invocation' end as origin, case when conv_id % 7 <> 2 then 'p' end as provider, case when conv_id % 10 <> 0 then 'm' else ' ' end as model,
  case turn % 4 when 1 then 'supported' when 2 then 'insufficient_evidence' when 3 then null else 'not_supported' end as outcome, conv_id % 3 = 0 as stated, (conv_id + turn) % 5 - 1 as evidence, (conv_id + turn) % 3 = 0 as bounded from conversations where role = 'assistant')"""


@query("o18e_response_checks", f"with {_ANSWERS} " + _codes(
    "response_id", "(select *, trim(coalesce(provider, '')) <> '' as pr, trim(coalesce(model, '')) <> '' as mo from an)", unknown_origin="origin not in ('llm_invocation', 'deterministic_retrieval')", model_missing="origin = 'llm_invocation' and not (pr and mo)", model_not_allowed="origin = 'deterministic_retrieval' and (pr or mo)",
    negative_evidence="evidence < 0", bounded_with_evidence="bounded and evidence <> 0", bounded_verdict="bounded and outcome is distinct from 'insufficient_evidence'", unbounded_without_evidence="not bounded and evidence = 0", stated_nothing="outcome is null and stated",
))
def _(t: Tables) -> DataFrame:
    c, turn = F.col("conv_id"), F.col("turn")
    rows = t.read("conversations").where("role = 'assistant'").select(
        (c * 1000 + turn).alias("response_id"), F.when(c % 5 == 0, "deterministic_retrieval").when(c % 5 == 1, "guess").otherwise("llm_invocation").alias("origin"), F.when(c % 7 != 2, "p").alias("provider"), F.when(c % 10 != 0, "m").otherwise(" ").alias("model"),
        F.when(turn % 4 == 1, "supported").when(turn % 4 == 2, "insufficient_evidence").when(turn % 4 == 0, "not_supported").alias("outcome"), (c % 3 == 0).alias("stated"), ((c + turn) % 5 - 1).alias("evidence"), ((c + turn) % 3 == 0).alias("bounded"),
    )
    return constraints.response_violations(rows)


@query("o17_session_statistics", "select user_id as session_id, count(*) as timeline_events, count(*) filter (event_type = 'purchase') as responses, min(ts) as created_at, max(ts) as last_activity_at, epoch(date_trunc('second', max(ts)))::bigint - epoch(date_trunc('second', min(ts)))::bigint as seconds from events group by user_id")
def _(t: Tables) -> DataFrame:
    return dialogue.session_statistics(t.read("events").select(F.col("user_id").alias("session_id"), (F.col("event_type") == "purchase").alias("response"), "ts"))


# Prompts: one for each conversation, of three sections; those without a line are disabled
_SECTIONS = ("system", "user", "assistant")
_PROMPTS = """ps as (select c.conv_id as prompt_id, case when c.conv_id % 8 = 1 then 2 - place else place end as place, section, case when c.conv_id % 8 = 2 and section = 'system' then 'x' when c.conv_id % 8 = 3 then ' ' else body end as content, body is not null as enabled from (select distinct conv_id from conversations) c, (values (0, 'system'), (1, 'user'), (2, 'assistant')) s(place, section)
  left join (select conv_id, role, string_agg(coalesce(text, ''), chr(10) order by turn, text) as body from conversations group by all) b on b.conv_id = c.conv_id and role = section where not (c.conv_id % 8 = 4 and section = 'user') and c.conv_id % 8 <> 5),
pc as (select prompt_id, list(section order by place) as o, count(*) as n, count(*) filter (enabled) as e, count(*) filter (enabled and trim(coalesce(content, '')) = '') as empty, count(*) filter (not enabled and trim(coalesce(content, '')) <> '') as filled from ps group by prompt_id),
pr as (select conv_id as prompt_id, 3 + (conv_id % 8 = 6)::int as sections, count(distinct role) + (conv_id % 8 = 7)::int as enabled, 3 - count(distinct role) as disabled from conversations group by conv_id)"""


@query("o18f_prompt_checks", f"with {_PROMPTS} " + _codes(
    "prompt_id", "(select * from pr left join pc using (prompt_id))", no_sections="n is null", sections_out_of_order="o <> ['system', 'user', 'assistant']", section_count="sections <> n", enabled_count="enabled <> e or disabled <> n - e", enabled_without_content="empty > 0", disabled_with_content="filled > 0",
))
def _(t: Tables) -> DataFrame:
    rows, k = t.read("conversations"), F.col("prompt_id") % 8
    lines = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("text"))))
    bodies = rows.groupBy(F.col("conv_id").alias("prompt_id"), F.col("role").alias("section")).agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\n").alias("body"))
    every = rows.select(F.col("conv_id").alias("prompt_id")).distinct().select("prompt_id", F.posexplode(F.array(*map(F.lit, _SECTIONS))).alias("place", "section"))
    whole = every.join(bodies, ["prompt_id", "section"], "left")
    content = F.when((k == 2) & (F.col("section") == "system"), "x").when(k == 3, " ").otherwise(F.col("body"))
    sections = whole.where("not (prompt_id % 8 = 4 and section = 'user') and prompt_id % 8 <> 5").select("prompt_id", F.when(k == 1, 2 - F.col("place")).otherwise(F.col("place")).alias("place"), "section", content.alias("content"), F.col("body").isNotNull().alias("enabled"))
    held = whole.groupBy("prompt_id").agg(F.count("body").alias("on"))
    recorded = held.select("prompt_id", (F.lit(3) + (k == 6).cast("int")).alias("sections"), (F.col("on") + (k == 7).cast("int")).alias("enabled"), (F.lit(3) - F.col("on")).alias("disabled"))
    return constraints.prompt_violations(sections, recorded, _SECTIONS)


# Sessions: a user's events; what was recorded is off in some
_SESSIONS = "with " + recursive_sql(f"select user_id, event_id, ts, {_state} as state from events", ledger.SESSIONS, "user_id", "state", "ts, event_id, state") + """,
ss as (select user_id as session_id, count(*) as events, count(*) filter (event_type = 'purchase') as responses, epoch(date_trunc('second', max(ts)))::bigint - epoch(date_trunc('second', min(ts)))::bigint as seconds from events group by user_id), sn as (select user_id as session_id, max_by(after, k) as held from run group by user_id),
sr as (select session_id, case when session_id % 9 = 1 then 0 when session_id % 9 = 2 then null else 1 end as project_id, case when session_id % 9 = 3 then 'created' else held end as state, responses - (session_id % 9 = 4)::int as responses, events + (session_id % 9 = 5)::int as events, seconds + (session_id % 9 = 6)::int as seconds from ss join sn using (session_id)),
tl as (select * from ss where session_id % 9 <> 7) """


@query("o18g_session_checks", _SESSIONS + _codes(
    "session_id", "(select sr.*, tl.events as e, tl.responses as r, tl.seconds as s, held from sr left join tl using (session_id) join sn using (session_id))", blank_id="session_id is null", project="project_id is null or project_id <= 0", no_events="e is null", event_count="events <> e", response_count="responses <> r", duration="seconds <> s", state="state <> held",
))
def _(t: Tables) -> DataFrame:
    timeline = t.read("events").select(F.col("user_id").alias("session_id"), (F.col("event_type") == "purchase").alias("response"), "ts")
    held = machines.now(session_moves(t), "user_id", "ts", "event_id").select(F.col("user_id").alias("session_id"), "state")
    k = F.col("session_id") % 9
    off = lambda c, n, by: (F.col(c) + by * (k == n).cast("int")).alias(c)
    counted = dialogue.session_statistics(timeline).withColumnRenamed("timeline_events", "events").join(held, "session_id")
    recorded = counted.select("session_id", F.when(k == 1, 0).when(k != 2, 1).alias("project_id"), F.when(k == 3, "created").otherwise(F.col("state")).alias("state"), off("responses", 4, -1), off("events", 5, 1), off("seconds", 6, 1))
    return constraints.session_violations(recorded, timeline.where("session_id % 9 <> 7"), held)


#: The queries of this module.
NAMES = sorted(set(QUERIES) - _BEFORE)
