"""Checks, summaries and listings over the reference tables; they join the catalogue's queries under the same names' scheme.

Null keys: a row whose key is null is checked like any other; where a listing joins on a key, it has no partner.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .catalogue import QUERIES, Tables, _after, once, query
from .functions.keys import UNIT_SEPARATOR, key
from .functions.rules import RULE_VERSIONS, UNITS
from .operators import derivation, graph, ledger, machines, retrieval
from .operators.evidence import keyed
from .operators.generations import StoredGraph
from .operators.postings import PostingIndex
from .plans.oracle import sql
from .sources import stages
from .streaming import promotion

_BEFORE = set(QUERIES)


def codes(**checks: Column) -> Column:
    """The names of all checks that hold, in order, as one string."""
    return F.concat_ws(",", *(F.when(c, name) for name, c in checks.items()))


# Registers and representation
@query("a23_attribute_resolution", sql("select e.unit, a.unit as attribute_unit, a.quantity_type as attribute, count(*) as n from ev e join (select distinct unit, quantity_type from units) a on lower(a.unit) = lower(e.unit) group by all", "ev"))
def _(t: Tables) -> DataFrame:
    rows = t.spark.createDataFrame([(u[0], u[1]) for u in UNITS], "attribute_unit string, attribute string").distinct()
    observed = t.kinds.groupBy("unit").agg(F.sum("n").alias("n"))
    return observed.join(F.broadcast(rows), F.lower("attribute_unit") == F.lower("unit")).select("unit", "attribute_unit", "attribute", "n")


# Reviews
@query("f07_snapshot_integrity", sql("select review_id, review_id % 4 = 0 or review_id % 3 <> 0 as has_integrity from rv", "rv"))
def _(t: Tables) -> DataFrame:
    # a snapshot is missing in every fourth review and was taken from another statement in every third
    taken = F.when(F.col("review_id") % 3 == 0, F.reverse("statement_key")).otherwise(F.col("statement_key"))
    rows = t.reviews.withColumn("fingerprint", F.when(F.col("review_id") % 4 != 0, F.sha2(taken, 256)))
    return rows.select("review_id", (F.col("fingerprint").isNull() | (F.col("fingerprint") == F.sha2("statement_key", 256))).alias("has_integrity"))


@query("f08_review_summary", sql("""select document_id, count(*) as targets, sum(n) as n_reviews, count(*) filter (decision = 'approved') as approved, count(*) filter (decision = 'rejected') as rejected, count(*) filter (substr(statement_key, 1, 1) < '8') as applying
  from lr join (select document_id, statement_key, count(*) as n from rv group by all) using (document_id, statement_key) group by document_id""", "lr"))
def _(t: Tables) -> DataFrame:
    now = t.statements.where("substr(statement_key, 1, 1) < '8'")
    rows = graph.applicability(t.latest, now).join(graph.review_counts(t.reviews), ["document_id", "statement_key"])
    return rows.groupBy("document_id").agg(F.count("*").alias("targets"), F.sum("n_reviews").alias("n_reviews"), F.count_if(F.col("decision") == "approved").alias("approved"), F.count_if(F.col("decision") == "rejected").alias("rejected"), F.count_if(F.col("applicability") == "applies").alias("applying"))


# Graph
# the first generation is built from two thirds of the documents, the second and third from all
_GEN1 = "gen1 as (select * from edges where document_id % 3 <> 0), n as (select count(*) as a, count(*) filter (document_id % 3 <> 0) as e from edges), v as (select count(*) as a, (select count(*) from nodes where node_id in (select unnest([subject_id, object_id]) from gen1)) as e from nodes)"


@once
def generations_of(t: Tables) -> StoredGraph:
    stored = StoredGraph.of(f"{stages.shared_dir(t.spark)}/graph-{uuid.uuid4().hex}", t.decisions, t.entities, buckets=16)
    stored.rebuild(t.decisions.where("document_id % 3 <> 0"), t.entities)
    stored.rebuild(t.decisions, t.entities)
    stored.rebuild(t.decisions, t.entities)
    return stored


@query("g07_rebuild", sql("@", "nodes").replace("\n@", f""",\n{_GEN1} select 1 as generation, v.e as active_nodes, n.e as active_edges, 0 as left_out, n.e as added, n.e = 0 as unchanged from n, v
  union all select 2, v.a, n.a, 0, n.a - n.e, n.a = n.e from n, v union all select 3, v.a, n.a, 0, 0, true from n, v"""))
def _(t: Tables) -> DataFrame:
    return generations_of(t).log().drop("version")


@query("g18_latest_generation", sql("select 3 as generation, 'edge' as what, edge_kind as kind, count(*) as n from edges group by edge_kind union all select 3, 'node', node_kind, count(*) from nodes group by node_kind", "nodes"))
def _(t: Tables) -> DataFrame:
    held, number = generations_of(t), F.lit(generations_of(t).generation()).cast("long").alias("generation")
    count = lambda rows, what: rows.where("state = 'active'").groupBy(F.col(f"{what}_kind").alias("kind")).agg(F.count("*").alias("n")).select(number, F.lit(what).alias("what"), "kind", "n")
    return count(held.edges(), "edge").unionByName(count(held.nodes(), "node"))


@query("g07b_earlier_generation", sql("@", "nodes").replace("\n@", f",\n{_GEN1} select edge_id as id, 'active' as state from gen1 union all select node_id, 'active' from nodes where node_id in (select unnest([subject_id, object_id]) from gen1)"))
def _(t: Tables) -> DataFrame:
    held, first = generations_of(t), generations_of(t).log().where("generation = 1").first().version
    return held.edges(first).select(F.col("edge_id").alias("id"), "state").unionByName(held.nodes(first).select(F.col("node_id").alias("id"), "state"))


# reviews of every fifth document are reversed, statements of every seventh vanish (they come before the fifths), every second was not there at first
_RECONCILED = """was as (select * from edges where document_id % 2 = 0), now as (select edge_id, subject_id, object_id, case when document_id % 7 = 0 then 'requires_revalidation' when document_id % 5 = 0 then 'review_reversed' end as reason, document_id % 2 = 0 as held from edges),
fin as (select edge_id, subject_id, object_id, case when reason is null then 'active' else 'historical' end as state, reason from now where held or reason is null),
alive as (select node_id, bool_or(state = 'active') as alive from (select unnest([subject_id, object_id]) as node_id, state from fin) group by node_id)"""


@once
def reconciled_of(t: Tables) -> StoredGraph:
    stored = StoredGraph.of(f"{stages.shared_dir(t.spark)}/graph-{uuid.uuid4().hex}", t.decisions, t.entities, buckets=16)
    stored.rebuild(t.decisions.where("document_id % 2 = 0"), t.entities)
    back = F.col("promoted") & (F.col("document_id") % 5 == 0)
    now = t.decisions.where("document_id % 7 <> 0").withColumns({"refusal": F.when(back, "review_rejected").otherwise(F.col("refusal")), "promoted": F.col("promoted") & ~back})
    stored.reconcile(now, t.entities, t.statements.select("document_id"))
    return stored


@query("g09b_reconciled_edges", sql("@", "edges").replace("\n@", f",\n{_RECONCILED} select edge_id, state, reason as retirement_reason from fin"))
def _(t: Tables) -> DataFrame:
    return reconciled_of(t).edges().select("edge_id", "state", "retirement_reason")


@query("g12b_reconciled_nodes", sql("@", "edges").replace("\n@", f",\n{_RECONCILED} select node_id, case when alive then 'active' else 'historical' end as state, case when not alive then 'no_remaining_relationships' end as retirement_reason from alive"))
def _(t: Tables) -> DataFrame:
    return reconciled_of(t).nodes().select("node_id", "state", "retirement_reason")


# promotion as a stream: statements and reviews arrive by decision, late and in part twice; statements of every seventh document go in the end
_STREAMED = """sm as (select statement_key, bool_or(decision = 'approved') as approved, max_by(decision, (recorded_at, review_id)) as last from rv group by statement_key),
es as (select sha256(concat_ws(chr(31), 'edge', statement_type, statement_key)) as edge_id, sha256(concat_ws(chr(31), 'node', 'engineering_asset', subject_key)) as subject_id, sha256(concat_ws(chr(31), 'node', case statement_type when 'has_rated_power' then 'engineering_quantity' else 'structural_location' end, object_key)) as object_id,
  case when document_id % 7 = 0 then 'requires_revalidation' when last <> 'approved' then 'review_reversed' end as retirement_reason from st join sm using (statement_key) where approved),
ns as (select node_id, bool_or(retirement_reason is null) as alive from (select unnest([subject_id, object_id]) as node_id, retirement_reason from es) group by node_id)"""


@once
def streamed(t: Tables) -> str:
    """Where the stream's changes are."""
    node = lambda side: key(F.lit("node"), f"{side}_kind", f"{side}_key", sep=UNIT_SEPARATOR).alias(f"{side}_id")
    ends = t.decisions.select("document_id", "statement_key", key(F.lit("edge"), "statement_type", "statement_key", sep=UNIT_SEPARATOR).alias("edge_id"), node("subject"), node("object"))
    columns = [c.split()[0] for c in promotion.EVENTS.split(", ")]
    no_text, no_flag = F.lit(None).cast("string").alias("decision"), F.lit(None).cast("boolean").alias("present")
    there = lambda when, present: ends.select("*", F.lit("statement").alias("what"), no_text, F.lit(present).alias("present"), F.lit(when).cast("timestamp").alias("at"), F.lit(0).cast("long").alias("number"))
    reviews = t.reviews.join(ends, ["document_id", "statement_key"]).select(*ends.columns, F.lit("review").alias("what"), "decision", no_flag, F.col("recorded_at").cast("timestamp").alias("at"), F.col("review_id").alias("number"))
    rows = there("2000-01-01", True).unionByName(there("2100-01-01", False).where("document_id % 7 = 0")).unionByName(reviews)
    folder = f"{stages.shared_dir(t.spark)}/promotion-{uuid.uuid4().hex}"
    for part in (rows.where("decision is null or decision <> 'approved'"), rows.where("decision = 'approved' or document_id % 3 = 0")):
        part.select(*columns).write.mode("append").parquet(f"{folder}/events")
        promotion.follow(t.spark, f"{folder}/events", f"{folder}/out")
    return f"{folder}/out"


@query("g20_streamed_edges", sql("@", "rv").replace("\n@", f",\n{_STREAMED} select edge_id, case when retirement_reason is null then 'active' else 'historical' end as state, retirement_reason from es"))
def _(t: Tables) -> DataFrame:
    return promotion.latest(t.spark, streamed(t), "edges").select("edge_id", "state", "retirement_reason")


@query("g20b_streamed_nodes", sql("@", "rv").replace("\n@", f",\n{_STREAMED} select node_id, case when alive then 'active' else 'historical' end as state, case when not alive then 'no_remaining_relationships' end as retirement_reason from ns"))
def _(t: Tables) -> DataFrame:
    return promotion.latest(t.spark, streamed(t), "nodes").select("node_id", "state", "retirement_reason")


@query("g10_retired_statements", sql("select edge_id, 'historical' as state, 'requires_revalidation' as reason from edges where substr(statement_key, 1, 1) >= '8'", "edges"))
def _(t: Tables) -> DataFrame:
    now = t.statements.where("substr(statement_key, 1, 1) < '8'").select("statement_key")
    return t.edges.where("state = 'active'").join(now, "statement_key", "left_anti").select("edge_id", F.lit("historical").alias("state"), F.lit("requires_revalidation").alias("reason"))


@query("g11_retirement_reasons", sql("""select review_id, case when document_id % 5 = 0 or (substr(statement_key, 1, 1) >= '8' and document_id not in (select document_id from st where substr(statement_key, 1, 1) < '8')) then 'orphaned' when substr(statement_key, 1, 1) >= '8' then 'requires_revalidation'
  when decision <> 'approved' then 'review_reversed' else 'rebuild_reconciliation' end as reason from lr""", "lr"))
def _(t: Tables) -> DataFrame:
    rows = graph.applicability(t.latest, t.statements.where("document_id % 5 <> 0 and substr(statement_key, 1, 1) < '8'"))
    state = F.col("applicability")
    reason = F.when(state == "requires_revalidation", "requires_revalidation").when(state == "orphaned", "orphaned").when(F.col("decision") != "approved", "review_reversed").otherwise("rebuild_reconciliation")
    return rows.select("review_id", reason.alias("reason"))


@query("g19_promotion_preview", sql("select document_id, statement_key, promoted as would_promote, coalesce(refusal, 'none') as why_not from dec", "dec"))
def _(t: Tables) -> DataFrame:
    return t.decisions.select("document_id", "statement_key", F.col("promoted").alias("would_promote"), F.coalesce("refusal", F.lit("none")).alias("why_not"))


# Retrieval
@query("h05_document_knowledge", sql("select document_id, 'node' as what, node_id as id, node_kind as kind from nodes union all select document_id, 'edge', edge_id, edge_kind from edges", "nodes"))
def _(t: Tables) -> DataFrame:
    nodes = t.nodes.select("document_id", F.lit("node").alias("what"), F.col("node_id").alias("id"), F.col("node_kind").alias("kind"))
    return nodes.unionByName(t.edges.select("document_id", F.lit("edge").alias("what"), F.col("edge_id").alias("id"), F.col("edge_kind").alias("kind")))


@query("h06_by_identity", sql("select s.statement_key, e.edge_id is not null as found, edge_kind from st s left join edges e on e.edge_id = sha256(concat_ws(chr(31), 'edge', s.statement_type, s.statement_key))", "edges"))
def _(t: Tables) -> DataFrame:
    asked = t.statements.select("statement_key", key(F.lit("edge"), "statement_type", "statement_key", sep=UNIT_SEPARATOR).alias("edge_id"))
    rows = asked.join(t.edges.select("edge_id", "edge_kind", F.lit(True).alias("held")), "edge_id", "left")
    return rows.select("statement_key", F.col("held").isNotNull().alias("found"), "edge_kind")


@query("h11_retrieval_diagnostics", sql("""select q.query_id, lower(trim(q.designation)) as normalised, coalesce(c.n, 0) as examined, coalesce(m.n, 0) as matched, least(coalesce(m.n, 0), 20) as returned from qs q
  left join (select project_id, count(*) as n from nodes where node_kind = 'engineering_asset' group by project_id) c on c.project_id = q.project_id left join (select query_id, count(*) as n from am group by query_id) m on m.query_id = q.query_id""", "am"))
def _(t: Tables) -> DataFrame:
    of_project = t.nodes.where("node_kind = 'engineering_asset'").groupBy("project_id").agg(F.count("*").alias("examined"))
    matched = t.found.groupBy("query_id").agg(F.count("*").alias("matched"))
    rows = t.asked.join(of_project, "project_id", "left").join(matched, "query_id", "left").fillna(0, ["examined", "matched"])
    return rows.select("query_id", F.lower(F.trim("designation")).alias("normalised"), "examined", "matched", F.least("matched", F.lit(20)).alias("returned"))


@query("h12_query_checks", """select * from (select query_id, concat_ws(',', case when wanted < 1 or wanted > 200 then 'limit' end, case when trim(coalesce(designation, '')) = '' or length(designation) > 120 then 'designation' end, case when project < 1 then 'scope' end, case when subjects <> 1 then 'subject' end) as codes
  from (select p_partkey as query_id, p_size * 5 - 10 as wanted, case p_partkey % 50 when 0 then ' ' when 1 then repeat(p_name, 30) else p_name end as designation, p_partkey % 60 - 1 as project, 1 + (p_partkey % 40 = 3)::int - (p_partkey % 40 = 4)::int as subjects from part)) where codes <> ''""")
def _(t: Tables) -> DataFrame:
    p, name = F.col("p_partkey"), F.col("p_name")
    rows = t.read("part").select(
        p.alias("query_id"), (F.col("p_size") * 5 - 10).alias("wanted"), F.when(p % 50 == 0, " ").when(p % 50 == 1, F.repeat(name, 30)).otherwise(name).alias("designation"), (p % 60 - 1).alias("project"), F.when(p % 40 == 3, 2).when(p % 40 == 4, 0).otherwise(1).alias("subjects")
    )
    return retrieval.query_faults(rows)


# Context
@query("i01_first_of_each_item", sql("select project_id, node_id, min(query_id) as query_id, count(*) as times from am group by all", "am"))
def _(t: Tables) -> DataFrame:
    return t.found.groupBy("project_id", "node_id").agg(F.min("query_id").alias("query_id"), F.count("*").alias("times"))


KINDS = ["engineering_asset", "engineering_quantity", "structural_location", "relationship"]


@query("i04_sections", _after("select r.request_id, k.place, k.kind, count(s.item_id) as n_items from (select distinct request_id from sel) r, (values " + ", ".join(f"({i}, '{k}')" for i, k in enumerate(KINDS)) + ") k(place, kind) left join sel s on s.request_id = r.request_id and s.kind = k.kind and s.selected group by all"))
def _(t: Tables) -> DataFrame:
    chosen = t.chosen.where("selected").groupBy("request_id", "kind").agg(F.count("*").alias("n"))
    sections = t.items.select("request_id").distinct().select("request_id", F.posexplode(F.array(*map(F.lit, KINDS))).alias("place", "kind"))
    return sections.join(chosen, ["request_id", "kind"], "left").select("request_id", "place", "kind", F.coalesce("n", F.lit(0)).alias("n_items"))


_OUTCOME = "o as (select qs.query_id, qs.project_id, count(node_id) as total from qs left join am on am.query_id = qs.query_id group by all)"


def project_outcomes(t: Tables) -> DataFrame:
    return retrieval.outcomes(t.asked, t.found).join(t.asked.select("query_id", "project_id"), "query_id")


def _outcomes(select: str) -> str:
    return sql("@", "am").replace("\n@", ",\n" + _OUTCOME + "\n" + select)


@query("i05_retrieval_summary", _outcomes("select project_id, count(*) as n_queries, sum(total) as n_items, count(*) filter (total = 0) as empty, count(*) filter (total = 1) as single, count(*) filter (total > 1) as ambiguous from o group by project_id"))
def _(t: Tables) -> DataFrame:
    total = F.col("total")
    return project_outcomes(t).groupBy("project_id").agg(F.count("*").alias("n_queries"), F.sum("total").alias("n_items"), F.count_if(total == 0).alias("empty"), F.count_if(total == 1).alias("single"), F.count_if(total > 1).alias("ambiguous"))


@query("j06_subject_outcome", _outcomes("select project_id, case when bool_or(total = 0) then 'not_found' when bool_or(total > 1) then 'ambiguous' else 'resolved' end as outcome from o group by project_id"))
def _(t: Tables) -> DataFrame:
    worst = F.when(F.bool_or(F.col("total") == 0), "not_found").when(F.bool_or(F.col("total") > 1), "ambiguous").otherwise("resolved")
    return project_outcomes(t).groupBy("project_id").agg(worst.alias("outcome"))


@query("i07_warnings", _after("""select * from (select request_id, place, item_id, code, row_number() over (partition by request_id order by place, code, item_id) as k from (
  select request_id, 0 as place, '' as item_id, 'budget_exceeded' as code from sel group by request_id having bool_or(not selected) union all
  select request_id, 1, '', 'ambiguous_retrieval' from sel where kind = 'engineering_asset' group by request_id having count(*) > count(distinct order_key) union all
  select request_id, 2, '', 'none_selected:' || kind from sel group by request_id, kind having not bool_or(selected) union all
  select request_id, 3, '', 'partial_coverage' from sel group by request_id having bool_or(not selected and kind <> 'structural_location') union all
  select request_id, 4, item_id, 'discarded:' || discard_reason from sel where not selected)) where k <= 50"""))
def _(t: Tables) -> DataFrame:
    chosen, said = t.chosen, lambda df, place, code: df.select("request_id", F.lit(place).alias("place"), F.lit("").alias("item_id"), code.alias("code"))
    out = ~F.col("selected")
    sums = chosen.groupBy("request_id").agg(F.bool_or(out).alias("over"), F.bool_or(out & (F.col("kind") != "structural_location")).alias("partial"))
    names = chosen.where("kind = 'engineering_asset'").groupBy("request_id", "order_key").agg(F.count("*").alias("n")).where("n > 1").select("request_id").distinct()
    kinds = chosen.groupBy("request_id", "kind").agg(F.bool_or("selected").alias("any")).where("not any")
    rows = [said(sums.where("over"), 0, F.lit("budget_exceeded")), said(names, 1, F.lit("ambiguous_retrieval")), said(kinds, 2, F.concat(F.lit("none_selected:"), "kind")), said(sums.where("partial"), 3, F.lit("partial_coverage"))]
    # of the items, no more than the fifty that a request could still show
    each = chosen.where(out).select("request_id", F.lit(4).alias("place"), "item_id", F.concat(F.lit("discarded:"), "discard_reason").alias("code"))
    found = rows[0]
    for r in (*rows[1:], each):
        found = found.unionByName(r)
    k = F.row_number().over(Window.partitionBy("request_id").orderBy("place", "code", "item_id"))
    return found.withColumn("k", k).where("k <= 50").select("request_id", "place", "item_id", "code", "k")


@query("i08_agreed_versions", sql("select document_id, case when count(distinct rule_version) = 1 then max(rule_version) end as rule_version, case when count(distinct kind) = 1 then max(kind) end as kind from ev group by document_id", "ev"))
def _(t: Tables) -> DataFrame:
    # by place in a sorted list: least and most of numbers are kept before rows move, those of strings would sort them
    words = {"rule_version": sorted(set(RULE_VERSIONS.values())), "kind": sorted({"designation", "location", *(u[1] for u in UNITS)})}
    listed = {c: F.array(*(F.lit(w) for w in own)) for c, own in words.items()}
    rows = keyed(t.loose).select("document_id", *(F.array_position(listed[c], F.col(c)).alias(c) for c in words))
    rows = rows.groupBy("document_id").agg(*(f(c).alias(f"{c}_{n}") for c in words for n, f in (("least", F.min), ("most", F.max))))
    return rows.select("document_id", *(F.when(F.col(f"{c}_least") == F.col(f"{c}_most"), F.element_at(listed[c], F.col(f"{c}_most").cast("int"))).alias(c) for c in words))


@query("i09_two_sided_context", sql("select document_id, count(*) filter (kind = 'designation') as left_evidence, count(*) filter (kind = 'location') as right_evidence, count(*) filter (kind = 'designation') > 0 and count(*) filter (kind = 'location') > 0 as both_sides from ev group by document_id", "ev"))
def _(t: Tables) -> DataFrame:
    side = lambda kind: F.count_if(F.col("kind") == kind)
    rows = t.loose.groupBy("document_id").agg(side("designation").alias("left_evidence"), side("location").alias("right_evidence"))
    return rows.withColumn("both_sides", (F.col("left_evidence") > 0) & (F.col("right_evidence") > 0))


# Mentions, claims and candidates
@query("k01_mention_checks", """select * from (select mention_id, concat_ws(',', case when trim(coalesce(identifier, '')) = '' then 'blank_identifier' end, case when kind is null or kind not in ('ECONOMY', 'LARGE', 'PROMO', 'SMALL', 'STANDARD') then 'unknown_kind' end, case when page is null or page < 1 then 'page' end, case when locator is not null and not regexp_full_match(locator, '[0-9]+') then 'locator' end) as codes
  from (select p_partkey as mention_id, case p_partkey % 17 when 0 then ' ' when 1 then null else p_brand end as identifier, case when p_partkey % 19 = 0 then 'ODD' else split_part(p_type, ' ', 1) end as kind, p_size - 2 as page, case p_partkey % 13 when 0 then 'p' || p_size when 1 then p_size::varchar end as locator from part)) where codes <> ''""")
def _(t: Tables) -> DataFrame:
    p, size = F.col("p_partkey"), F.col("p_size")
    rows = t.read("part").select(
        p.alias("mention_id"), F.when(p % 17 == 0, " ").when(p % 17 != 1, F.col("p_brand")).alias("identifier"), F.when(p % 19 == 0, "ODD").otherwise(F.split_part("p_type", F.lit(" "), F.lit(1))).alias("kind"), (size - 2).alias("page"),
        F.when(p % 13 == 0, F.concat(F.lit("p"), size.cast("string"))).when(p % 13 == 1, size.cast("string")).alias("locator"),
    )
    return retrieval.mention_faults(rows, ("ECONOMY", "LARGE", "PROMO", "SMALL", "STANDARD"))


@query("k02_indexable_documents", "select o_orderkey as document_id, o_custkey as project_id from orders join customer on c_custkey = o_custkey where o_orderstatus <> 'F' and c_custkey % 4 < 2")
def _(t: Tables) -> DataFrame:
    # documents of status F stand outside projects; states of projects as in a18
    live = t.read("customer").where(F.col("c_custkey") % 4 < 2).select(F.col("c_custkey").alias("project_id"))
    docs = t.read("orders").where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("document_id"), F.col("o_custkey").alias("project_id"))
    return docs.join(live, "project_id", "left_semi").select("document_id", "project_id")


# words asked for: the beginnings of what the parts are
_ASKED = "wq as (select distinct substr(split_part(p_name, ' ', 2), 1, 3) as word from part)"


def mention_index(t: Tables) -> PostingIndex:
    index = PostingIndex(t.spark, f"{stages.shared_dir(t.spark)}/mentions-{uuid.uuid4().hex}", buckets=16)
    index.build(t.read("part").select(F.col("p_partkey").alias("entry"), (F.col("p_partkey") % 100).alias("document"), F.col("p_name").alias("identifier")))
    return index


def sought(t: Tables, index: PostingIndex) -> DataFrame:
    asked = t.read("part").select(F.substring(F.split_part("p_name", F.lit(" "), F.lit(2)), 1, 3).alias("word")).distinct()
    place = F.row_number().over(Window.partitionBy("word", "document").orderBy("mention_id"))
    return index.containing(asked).withColumn("mention_id", F.col("entry").cast("long")).select("word", "mention_id", "identifier", place.alias("place"))


@query("k04_mention_search", f"with {_ASKED} select word, p_partkey as mention_id, p_name as identifier, row_number() over (partition by word, p_partkey % 100 order by p_partkey) as place from part join wq on contains(lower(p_name), lower(word)) where word <> ''")
def _(t: Tables) -> DataFrame:
    return sought(t, mention_index(t))


@query("k04b_search_after_an_update", f"with {_ASKED}, np as (select p_partkey, case when p_partkey % 100 % 10 = 0 then 'new ' || p_brand || ' ' || p_name else p_name end as p_name from part where p_partkey % 100 <> 7) select word, p_partkey as mention_id, p_name as identifier, row_number() over (partition by word, p_partkey % 100 order by p_partkey) as place from np join wq on contains(lower(p_name), lower(word)) where word <> ''")
def _(t: Tables) -> DataFrame:
    # mentions of every tenth document are written anew, those of the seventh go
    index, page = mention_index(t), F.col("p_partkey") % 100
    changed = t.read("part").where((page % 10 == 0) | (page == 7))
    entries = changed.where(page != 7).select(F.col("p_partkey").alias("entry"), page.alias("document"), F.concat(F.lit("new "), "p_brand", F.lit(" "), "p_name").alias("identifier"))
    index.update(changed.select(page.alias("document")), entries)
    return sought(t, index)


@once
def designation_index(t: Tables) -> PostingIndex:
    index = PostingIndex(t.spark, f"{stages.shared_dir(t.spark)}/designations-{uuid.uuid4().hex}", buckets=16, runs=False)
    # an entry is the project and the place, from which the key follows
    rows = t.shown.select("document_id", "project_id", "line_index", F.explode("found").alias("e")).where("e.kind = 'designation'")
    index.build(rows.select(F.concat_ws("@", "project_id", derivation.place_name(F.col("e"))).alias("entry"), F.col("document_id").alias("document"), F.col("e.designation").alias("identifier")))
    return index


@query("c14_designation_lookup", sql("select evidence_key, document_id, designation from ev where designation = 'T1'", "ev"))
def _(t: Tables) -> DataFrame:
    rows = designation_index(t).exact("T1").where("identifier = 'T1'").select(F.col("document").alias("document_id"), F.substring_index("entry", "@", -1).alias("place"), F.col("identifier").alias("designation"))
    return rows.select(derivation.place_key("place").alias("evidence_key"), "document_id", "designation")


@query("c14b_designations_asked_for", sql("select q.query_id, count(*) as n, count(distinct document_id) as documents from qs q join ev on lower(ev.designation) = lower(q.designation) and ev.kind = 'designation' and ev.project_id = q.project_id group by q.query_id", "qs"))
def _(t: Tables) -> DataFrame:
    # asked for in either case of letters, a designation is looked up once
    asked = t.asked.withColumn("text", F.lower("designation"))
    met = designation_index(t).equal_to(asked.select("project_id", "text").distinct(), "text").where(F.substring_index("entry", "@", 1) == F.col("project_id").cast("string"))
    counted = met.groupBy("project_id", "text").agg(F.count("*").alias("n"), F.count_distinct("document").alias("documents"))
    return asked.join(counted, ["project_id", "text"]).select("query_id", "n", "documents")


@query("l01_claim_checks", """with c as (select o_orderkey as claim_id, case o_orderkey % 3 when 0 then 'relationship' when 1 then 'attribute' else 'entity' end as kind, case when o_orderkey % 23 <> 0 then o_orderpriority end as subject, case when o_orderkey % 5 <> 0 then o_orderstatus else ' ' end as predicate, case when o_orderkey % 7 <> 0 then o_orderpriority end as object from orders),
e as (select l_orderkey as claim_id, max(n) as times, min(d0) as d0, max(d1) as d1, min(p0) as p0, max(p1) as p1 from (select l_orderkey, l_partkey % 40 as x, count(*) as n, min(l_suppkey % 4) as d0, max(l_suppkey % 4) as d1, min(l_suppkey % 2) as p0, max(l_suppkey % 2) as p1 from lineitem group by all) group by l_orderkey)
select * from (select claim_id, concat_ws(',', case when subject is null then 'subject' end, case when kind <> 'entity' and trim(predicate) = '' then 'predicate' end, case when kind <> 'entity' and object is null then 'object' end, case when times is null then 'no_evidence' end, case when times > 1 then 'repeated_evidence' end, case when p0 < p1 then 'several_projects' end, case when d0 < d1 then 'several_documents' end) as codes
  from c left join e using (claim_id)) where codes <> ''""")
def _(t: Tables) -> DataFrame:
    k, supplier = F.col("o_orderkey"), F.col("l_suppkey")
    claims = t.read("orders").select(
        k.alias("claim_id"), F.when(k % 3 == 0, "relationship").when(k % 3 == 1, "attribute").otherwise("entity").alias("kind"), F.when(k % 23 != 0, F.col("o_orderpriority")).alias("subject"), F.when(k % 5 != 0, F.col("o_orderstatus")).otherwise(" ").alias("predicate"), F.when(k % 7 != 0, F.col("o_orderpriority")).alias("object"),
    )
    evidence = t.read("lineitem").select(F.col("l_orderkey").alias("claim_id"), (F.col("l_partkey") % 40).alias("evidence_id"), (supplier % 4).alias("document_id"), (supplier % 2).alias("project_id"))
    return retrieval.claim_faults(claims, evidence)


@query("l04_evidence_replacement", "select l_orderkey as claim_id, l_partkey as evidence_id from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderpriority = '1-URGENT') union all select o_orderkey, o_custkey from orders where o_orderpriority = '1-URGENT'")
def _(t: Tables) -> DataFrame:
    new = t.read("orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("claim_id"), F.col("o_custkey").alias("evidence_id"))
    held = t.read("lineitem").select(F.col("l_orderkey").alias("claim_id"), F.col("l_partkey").alias("evidence_id"))
    return held.join(new.select("claim_id"), "claim_id", "left_anti").unionByName(new)


@query("l06_open_candidates", "select o_custkey as project_id, o_orderkey as candidate_id, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as place from orders where o_orderstatus in ('O', 'P')")
def _(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return t.read("orders").where("o_orderstatus in ('O', 'P')").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("candidate_id"), place.alias("place"))


@query("l07_candidate_history", "select user_id as candidate_id, event_id, event_type, row_number() over (partition by user_id order by ts, event_id) as place from events")
def _(t: Tables) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.read("events").select(F.col("user_id").alias("candidate_id"), "event_id", "event_type", place.alias("place"))


@query("l10_canonical_facts", sql("select s.document_id, s.statement_key, case statement_type when 'has_rated_power' then 'attribute' else 'relationship' end as shape, lr.review_id from st s join lr on lr.document_id = s.document_id and lr.statement_key = s.statement_key where lr.decision = 'approved' and s.document_id % 4 <> 0", "lr"))
def _(t: Tables) -> DataFrame:
    held = t.statements.where("document_id % 4 = 0").select("document_id", "statement_key")
    approved = t.latest.where("decision = 'approved'").select("document_id", "statement_key", "review_id")
    rows = t.statements.join(approved, ["document_id", "statement_key"]).join(held, ["document_id", "statement_key"], "left_anti")
    return rows.select("document_id", "statement_key", F.when(F.col("statement_type") == "has_rated_power", "attribute").otherwise("relationship").alias("shape"), "review_id")


# Conversations and sessions
_STATE = {"view": "created", "click": "active", "signup": "paused", "purchase": "completed"}
_state = "case event_type " + " ".join(f"when '{e}' then '{s}'" for e, s in _STATE.items()) + " else 'archived' end"
_SESSION_RUN = "with " + machines.recursive_sql(f"select user_id, event_id, ts, {_state} as state from events", ledger.SESSIONS, "user_id", "state", "ts, event_id, state")


def session_moves(t: Tables) -> DataFrame:
    state = F.coalesce(*(F.when(F.col("event_type") == e, s) for e, s in _STATE.items()), F.lit("archived"))
    rows = t.read("events").select("user_id", "event_id", "ts", state.alias("state"))
    return machines.run(rows, ledger.SESSIONS, "user_id", "state", ("ts", "event_id"))


@query("o04_session_moves", _SESSION_RUN + " select user_id, event_id, before || '>' || state as move from run where before = after")
def _(t: Tables) -> DataFrame:
    return session_moves(t).where("not accepted").select("user_id", "event_id", F.concat_ws(">", "before", "state").alias("move"))


# a conversation is begun by its turns, completed by every third answer, archived by every fifth turn
_asked = "case when role = 'assistant' and turn % 3 = 2 then 'completed' when turn % 5 = 4 then 'archived' else 'active' end"
_CONVERSATION_RUN = "with " + machines.recursive_sql(f"select conv_id, turn, role, coalesce(text, '') as text, {_asked} as state from conversations", ledger.CONVERSATIONS, "conv_id", "state", "turn, role, text, state")


@query("o04b_conversation_states", _CONVERSATION_RUN + " select conv_id, max_by(after, k) as state, count(*) filter (before <> after) as accepted, count(*) filter (before = after) as refused from run group by conv_id")
def _(t: Tables) -> DataFrame:
    asked = F.when((F.col("role") == "assistant") & (F.col("turn") % 3 == 2), "completed").when(F.col("turn") % 5 == 4, "archived").otherwise("active")
    rows = t.read("conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"), asked.alias("state"))
    return machines.now(machines.run(rows, ledger.CONVERSATIONS, "conv_id", "state", ("turn", "role", "text")), "conv_id", "turn", "role", "text")


@query("o14_response_warnings", _after("select request_id, case when share = 0 then 'insufficient' when share < 0.5 then 'high' when share < 1 then 'moderate' else 'none' end as uncertainty, share < 1 as truncated from (select request_id, count(*) filter (selected) / count(*) as share from sel group by request_id)"))
def _(t: Tables) -> DataFrame:
    rows = t.chosen.groupBy("request_id").agg((F.count_if("selected") / F.count("*")).alias("share"))
    level = F.when(F.col("share") == 0, "insufficient").when(F.col("share") < 0.5, "high").when(F.col("share") < 1, "moderate").otherwise("none")
    return rows.select("request_id", level.alias("uncertainty"), (F.col("share") < 1).alias("truncated"))


@query("o15_declared_verdicts", r"select conv_id, turn, role, upper(regexp_extract(text, '^\s*([A-Za-z_]+)', 1)) as token, case upper(regexp_extract(text, '^\s*([A-Za-z_]+)', 1)) when 'YES' then 'supported' when 'NO' then 'contradicted' else 'not_declared' end as verdict from conversations where text is not null")
def _(t: Tables) -> DataFrame:
    rows = t.read("conversations").where("text is not null").select("conv_id", "turn", "role", F.upper(F.regexp_extract("text", r"^\s*([A-Za-z_]+)", 1)).alias("token"))
    return rows.withColumn("verdict", F.when(F.col("token") == "YES", "supported").when(F.col("token") == "NO", "contradicted").otherwise("not_declared"))


@query("o18_conversation_integrity", "select * from (select conv_id, concat_ws(',', case when max(turn) - min(turn) + 1 <> count(distinct turn) then 'turns_not_contiguous' end, case when count(*) filter (role = 'assistant') = 0 then 'no_response' end, case when count(*) > count(distinct turn) then 'repeated_turn' end, case when count(*) filter (text is null or trim(text) = '') > 0 then 'blank_message' end) as errors from conversations group by conv_id) where errors <> ''")
def _(t: Tables) -> DataFrame:
    blank = F.col("text").isNull() | (F.trim("text") == "")
    rows = t.read("conversations").select("conv_id", "turn", "role", blank.alias("blank")).groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1).alias("span"), F.count_distinct("turn").alias("turns"), F.count("*").alias("messages"), F.count_if(F.col("role") == "assistant").alias("responses"), F.count_if("blank").alias("blanks")
    )
    errors = codes(turns_not_contiguous=F.col("span") != F.col("turns"), no_response=F.col("responses") == 0, repeated_turn=F.col("messages") > F.col("turns"), blank_message=F.col("blanks") > 0)
    return rows.select("conv_id", errors.alias("errors")).where("errors <> ''")


#: The queries of this module.
NAMES = sorted(set(QUERIES) - _BEFORE)
