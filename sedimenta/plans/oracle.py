"""The derivation as SQL, part by part; a query names the parts that it needs."""

from __future__ import annotations

from ..functions.rules import COMPOUND, DESIGNATION_SHAPES, NUMBER, NUMBER_WITH_UNIT, RULE_VERSIONS, STANDALONE_LOCATION, UNITS

TRIM = "'()[]{}\"''.,;:!?'"
_shape = " or ".join(f"regexp_matches(tr, '{s}')" for s in DESIGNATION_SHAPES)
_units = ", ".join(f"('{v}', '{u}', '{k}', {'null' if b is None else repr(b)}, {'null' if s is None else s})" for u, k, vs, b, s in UNITS for v in vs)
_versions = "case rule_id " + " ".join(f"when '{r}' then '{v}'" for r, v in RULE_VERSIONS.items()) + " end"

PARTS = {
    "lines": """
  select l_orderkey + 1 as document_id, l_orderkey % 7 + 1 as project_id,
    row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 as line_index,
    case l_partkey % 8
      when 0 then 'Unit T' || (l_partkey % 5 + 1) || ' rated ' || cast(l_quantity as int) || ' kVA'
      when 1 then 'Block -Q' || (l_suppkey % 20) || ' +E0' || (l_suppkey % 5)
      when 2 then 'Cable C' || (l_partkey % 9) || ' section ' || cast(l_quantity as int) || ' mm2, at 400 V'
      when 3 then 'Terminal +E0' || (l_suppkey % 5) || '-QA' || (l_partkey % 6)
      when 4 then 'Units T1 and T2 at ' || cast(l_quantity as int) || ',5 kV'
      when 5 then 'Rating 1.' || lpad(cast(cast(l_quantity as int) as varchar), 3, '0') || ' kVA'
      when 6 then 'General note, nothing to record.'
      else 'Relay (T' || (l_partkey % 5 + 1) || '), ' || cast(l_quantity as int) || 'kA;' end as line_text
  from lineitem""",
    "tok": """
  select document_id, project_id, line_index, p as position, w[p + 1] as text,
    coalesce(list_sum(list_transform(w[1:p], lambda x: length(x) + 1)), 0)::bigint as char_start from (
      select *, unnest(range(len(w))) as p from (select *, string_split(line_text, ' ') as w from lines))""",
    "bare": f"""
  select *, trim(text, {TRIM}) as tr, case when trim(text, {TRIM}) = '' then 0 else length(text) - length(ltrim(text, {TRIM})) end as tl,
    case when trim(text, {TRIM}) = '' then 0 else length(text) - length(rtrim(text, {TRIM})) end as rt from tok""",
    "units": f"select * from (values {_units}) u(variant, unit, quantity_type, base_unit, scale)",
    "ahead": """
  select *, char_start + tl as cs, char_start + length(text) - rt as ce,
    lead(tr) over w as next_tr, lead(position) over w as next_position, lead(char_start + length(text) - rt) over w as next_end
  from bare window w as (partition by document_id, line_index order by position)""",
    "marked": f"""
  select *, lag(two) over (partition by document_id, line_index order by position) as taken from (
    select a.*, u.*, regexp_matches(tr, '{NUMBER}') and u.unit is not null as two,
      case when regexp_matches(tr, '{NUMBER}') then tr else regexp_extract(tr, '{NUMBER_WITH_UNIT}', 1) end as num
    from ahead a left join units u on u.variant = case when regexp_matches(tr, '{NUMBER}') then next_tr else regexp_extract(tr, '{NUMBER_WITH_UNIT}', 2) end)""",
    "seen": f"""
  select document_id, project_id, line_index, position as token_start, position as token_end, 'designation' as kind, 'designation_generic' as rule_id, tr as observed_text, 'observed' as status,
    cs as char_start, ce as char_end, null as number_text, null::decimal(28, 6) as value, null as unit, null::decimal(38, 6) as base_value, null as base_unit, tr as designation
  from marked where not coalesce(taken, false) and ({_shape}) and not regexp_matches(tr, '{STANDALONE_LOCATION}')
  union all
  select document_id, project_id, line_index, position, position, 'location', 'location_aspect_iec_81346', loc, 'observed', cs, cs + length(loc), null, null, null, null, null, loc
  from (select *, case when regexp_matches(tr, '{COMPOUND}') then regexp_extract(tr, '{COMPOUND}', 1) when regexp_matches(tr, '{STANDALONE_LOCATION}') then tr end as loc from marked)
  where not coalesce(taken, false) and loc is not null
  union all
  select document_id, project_id, line_index, position, case when two then next_position else position end, quantity_type, quantity_type, case when two then tr || ' ' || next_tr else tr end, st,
    cs, case when two then next_end else ce end, replace(num, ',', '.'), v, unit, v * scale, case when v is not null then base_unit end, null
  from (select *, case when st = 'observed' then cast(replace(num, ',', '.') as decimal(28, 6)) end as v from (
    select *, case when len(regexp_extract_all(num, '[.,]')) > 1 or length(regexp_extract(num, '[.,]([0-9]+)$', 1)) >= 3 then 'ambiguous' else 'observed' end as st from marked where unit is not null))""",
    "ev": f"""
  select *, sha256(concat_ws('|', document_id, checksum, rule_id, rule_version, kind, 1, 0, line_index, token_start, token_end)) as evidence_key from (
    select *, {_versions} as rule_version, sha256('register:' || document_id) as checksum from seen)""",
    "m": """
  select *, sha256(concat_ws('|', document_id, checksum, '2.0', resolution_rule, '1.0', '1.0', entity_type,
    case when kind in ('designation', 'location') then concat_ws('|', designation, status, rule_version) else evidence_key end)) as entity_key from (
    select *, case kind when 'designation' then 'equipment_designation' when 'location' then 'structural_location' else 'engineering_quantity' end as entity_type,
      case kind when 'designation' then 'designation_grouping' when 'location' then 'location_grouping' else 'quantity_identity' end as resolution_rule from ev)""",
    "bad": "select distinct document_id from m where entity_type = 'engineering_quantity' and value is null",
    "ms": "select * from m where document_id not in (select document_id from bad)",
    "ent": """
  select document_id, project_id, entity_key, entity_type, n_evidence, designation, number_text, value, unit, base_value, kind,
    coalesce(designation, case when value is not null then number_text || ' ' || unit end, substr(entity_key, 1, 12)) as label, case when seen = 'observed' then 'resolved' else 'ambiguous' end as status from (
    select document_id, project_id, entity_key, entity_type, count(*) as n_evidence, min(designation) as designation, min(number_text) as number_text, min(value) as value, min(unit) as unit, min(base_value) as base_value, min(kind) as kind, min(status) as seen
    from ms group by all)""",
    "sub": "select *, count(*) over (partition by document_id, line_index) as subjects from (select distinct document_id, line_index, entity_key as subject_key, status as subject_status from ms where kind = 'designation')",
    "hit": """
  select distinct p.document_id, p.line_index, p.entity_key from ms p join ms d on p.document_id = d.document_id and p.line_index = d.line_index and p.token_start = d.token_start and p.token_end = d.token_end
  where p.kind = 'location' and d.kind = 'designation'""",
    "obj": """
  select *, count(*) over (partition by document_id, line_index, rule) as objects from (
    select distinct document_id, line_index, entity_key as object_key, status as object_status, 'same_line_association' as rule, 'has_associated_quantity' as predicate from ms where entity_type = 'engineering_quantity'
    union all
    select distinct document_id, line_index, entity_key, status, 'same_line_location_association', 'has_location_aspect' from ms p where kind = 'location'
      and not exists (select 1 from hit h where h.document_id = p.document_id and h.line_index = p.line_index and h.entity_key = p.entity_key))""",
    "lp": "select s.*, o.object_key, o.object_status, o.objects, o.rule, o.predicate from sub s join obj o on s.document_id = o.document_id and s.line_index = o.line_index",
    "tp": """
  select d.document_id, d.line_index, d.subject_key, d.subject_status, o.object_key, o.object_status, 'compound_reference_designation' as rule, 'has_location_aspect' as predicate from
    (select document_id, line_index, token_start, token_end, min(entity_key) as subject_key, min(status) as subject_status from ms where kind = 'designation' group by all having count(distinct entity_key) = 1) d
    join (select document_id, line_index, token_start, token_end, min(entity_key) as object_key, min(status) as object_status from ms where kind = 'location' group by all having count(distinct entity_key) = 1) o
    on d.document_id = o.document_id and d.line_index = o.line_index and d.token_start = o.token_start and d.token_end = o.token_end""",
    "jl": """
  select document_id, line_index, subject_key, subject_status, object_key, object_status, rule, predicate from lp where subjects = 1 and (rule = 'same_line_association' or objects = 1)
  union all select document_id, line_index, subject_key, subject_status, object_key, object_status, rule, predicate from tp""",
    "facts": """
  select *, sha256(concat_ws('|', document_id, checksum, '1.0', subject_key, predicate, object_key, rule, '1.0', '1.1')) as fact_key from (
    select document_id, subject_key, predicate, object_key, rule, count(distinct line_index) as n_lines,
      case when bool_or(subject_status <> 'observed' or object_status <> 'observed') then 'ambiguous' else 'constructed' end as status, sha256('register:' || document_id) as checksum from jl group by document_id, subject_key, predicate, object_key, rule)""",
    "cand": """
  select *, count(*) over (partition by document_id, subject_key, statement_type) as candidates from (
    select f.*, case when predicate = 'has_associated_quantity' and e.kind = 'power_value' then 'has_rated_power' when predicate = 'has_location_aspect' and rule = 'compound_reference_designation' and e.kind = 'location' then 'is_located_in' end as statement_type
    from facts f join ent e on f.document_id = e.document_id and f.object_key = e.entity_key) where statement_type is not null""",
    "st": """
  select document_id, subject_key, statement_type, object_key, fact_key, case when status = 'constructed' then 'interpreted' else 'ambiguous' end as statement_status, checksum,
    sha256(concat_ws('|', document_id, checksum, '1.0', '1.1', subject_key, statement_type, object_key, 'rule:' || statement_type, '1.0', '1.0')) as statement_key from cand where candidates = 1""",
    "rv": """
  select event_id * 1000 + row_number() over (partition by event_id order by statement_key) as review_id, document_id, statement_key, decision, reason, comment, user_id as reviewer, ts as recorded_at from (
    select e.*, (e.event_id * 7) % (select max(l_orderkey) + 1 from lineitem) + 1 as doc, case event_type when 'purchase' then 'approved' when 'signup' then 'approved' when 'error' then 'rejected' else 'needs_investigation' end as decision,
      case event_id % 3 when 0 then 'insufficient_evidence' when 1 then 'confirmed_by_source' else 'other' end as reason, case when event_id % 4 > 0 then 'seen' end as comment from events e) r
  join st on st.document_id = r.doc""",
    "lr": "select * from (select *, row_number() over (partition by document_id, statement_key order by recorded_at desc, review_id desc) as k from rv) where k = 1",
    "dec": """
  select *, case when decision is null then 'not_reviewed' when decision = 'rejected' then 'review_rejected' when decision <> 'approved' then 'review_inconclusive' end as refusal, decision is not null and decision = 'approved' as promoted from (
    select st.*, lr.decision, lr.review_id, lr.recorded_at from st left join lr on st.document_id = lr.document_id and st.statement_key = lr.statement_key)""",
    "edges": """
  select sha256(concat_ws(chr(31), 'edge', statement_type, statement_key)) as edge_id, statement_type as edge_kind, sha256(concat_ws(chr(31), 'node', 'engineering_asset', subject_key)) as subject_id,
    sha256(concat_ws(chr(31), 'node', case statement_type when 'has_rated_power' then 'engineering_quantity' else 'structural_location' end, object_key)) as object_id, subject_key, object_key, document_id, statement_key, review_id, recorded_at as created_at from dec where promoted""",
    "nodes": """
  select node_id, node_kind, e.document_id, project_id, e.entity_key, label, coalesce(upper(designation), case when value is not null then number_text end, label) as normalized_value, value, unit, x.statement_key, 'active' as state from (
    select node_id, entity_key, node_kind, document_id, max(statement_key) as statement_key from (
      select subject_id as node_id, subject_key as entity_key, 'engineering_asset' as node_kind, document_id, statement_key from edges
      union all select object_id, object_key, case edge_kind when 'has_rated_power' then 'engineering_quantity' else 'structural_location' end, document_id, statement_key from edges) group by node_id, entity_key, node_kind, document_id) x
  join ent e on e.document_id = x.document_id and e.entity_key = x.entity_key""",
    "qs": "select project_id || ':' || designation as query_id, project_id, designation from (select distinct project_id, designation from ent where kind = 'designation' union select distinct project_id, lower(designation) from ent where kind = 'designation')",
    "am": """
  select query_id, project_id, node_id, label, min(precedence) as precedence from (
    select q.query_id, q.project_id, n.node_id, n.label, k as precedence from qs q join nodes n on q.project_id = n.project_id and n.node_kind = 'engineering_asset', range(1, 5) r(k)
    where case k when 1 then q.designation = n.label when 2 then lower(q.designation) = lower(n.label) when 3 then lower(q.designation) = lower(n.normalized_value) else lower(regexp_replace(q.designation, '[^\\p{L}\\p{N}]', '', 'g')) = lower(regexp_replace(n.label, '[^\\p{L}\\p{N}]', '', 'g')) end) group by all""",
}


def sql(select: str, upto: str) -> str:
    """``select`` after all parts up to the named one."""
    names = list(PARTS)
    return "with " + ",\n".join(f"{n} as ({PARTS[n]})" for n in names[: names.index(upto) + 1]) + f"\n{select}"
