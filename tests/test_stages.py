"""The stages of documents: what they hold, and that their rows stay where their document is."""

import pytest
from pyspark.sql import functions as F

from sedimenta import audits, catalogue, checks, memory, packages  # noqa: F401 (they add their queries)
from sedimenta.catalogue import QUERIES, Tables, expected, expected_of
from sedimenta.functions.keys import identity
from sedimenta.operators import derivation, evidence, lineage, quality, text
from sedimenta.sources import stages

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, DATA)


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line.strip() for line in plan.splitlines() if "Exchange " in line and "BroadcastExchange" not in line]


def test_keys_are_not_stored(tables):
    assert not {"evidence_key", "checksum", "rule_version"} & set(tables.observations.columns)
    assert tables.evidence.where("evidence_key is null").isEmpty()


@pytest.mark.parametrize("made", [
    lambda t: derivation.valueless_documents(t.observations), lambda t: t.strict, lambda t: t.entities, lambda t: derivation.facts(t.strict), lambda t: derivation.statements(t.candidates), lambda t: derivation.fact_support(t.strict, t.facts), lambda t: t.latest,
])
def test_rows_of_a_document_are_moved_once(spark, tables, made):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(made(tables)) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_repeated_texts_show_what_each_line_shows(spark, monkeypatch):
    said = ["Unit T1 rated 25 kVA", "Terminal +E01-QA1 +CELLA", "", None, "note", "Unit T1 rated 25 kVA", "1.250 kV 3 A"]
    lines = spark.createDataFrame([(d, d % 7, k, t) for d in range(5) for k, t in enumerate(said)], "document_id long, project_id long, line_index long, line_text string")
    own = sorted(map(str, evidence.observed(text.tokenised(lines, *evidence.LINE)).collect()))
    assert len(own) > 20 and sorted(map(str, evidence.observed_in(lines, lines).collect())) == own
    monkeypatch.setattr(evidence, "REPEATED", 2)  # too many texts: line by line
    assert sorted(map(str, evidence.observed_in(lines, lines).collect())) == own


def test_documents_without_a_value_are_those_of_their_entities(spark, tables):
    wanted = {r[0] for r in derivation.failing_documents(derivation.entities(tables.mentions)).collect()}
    assert wanted and {r[0] for r in derivation.valueless_documents(tables.observations).collect()} == wanted


def test_support_and_diagnostics_of_both_rules(spark):
    lines = spark.createDataFrame([(1, 1, k, t) for k, t in enumerate(["Unit T1 rated 25 kVA", "T1 T2 20 kV", "+E01-QA1", "T1 +CELLA +CELLB"])], "document_id long, project_id long, line_index long, line_text string")
    rows = derivation.mentions(evidence.extract(text.tokenised(lines, *evidence.LINE)))
    assert {(r.line_index, r.reason) for r in derivation.fact_diagnostics(rows).collect()} == {(1, "multiple_subjects"), (3, "multiple_objects")}
    support = derivation.fact_support(rows, derivation.facts(rows)).groupBy("role").agg(F.count("*").alias("n"), F.sum("line_index").alias("at")).collect()
    assert {(r.role, r.n, r["at"]) for r in support} == {("subject", 2, 2), ("object", 2, 2)}


def test_normalisation_queues_no_arrays(spark):
    """A line of many words: what goes by Python holds its token, not the tokens of the whole line."""
    lines = spark.createDataFrame([(1, "wörd " * 50)], "document_id long, line_text string")
    made = text.normalised(text.tokenised(lines, "document_id"))
    plan = made._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "ArrowEvalPython":
        plan = plan.children().head()
    types = [plan.children().head().output().apply(k).dataType().typeName() for k in range(plan.children().head().output().size())]
    assert "array" not in types and made.count() == 50


def test_one_answer_for_requests_that_ask_the_same(spark, monkeypatch):
    """Customers ask 60 identifiers of 7 projects: what is joined, ranked and counted is a question, not a request."""
    from sedimenta import packages
    from sedimenta.catalogue import QUERIES

    seen, own = [], packages.retrieval.with_metadata
    monkeypatch.setattr(packages.retrieval, "with_metadata", lambda ranked, metadata, total: seen.append(total) or own(ranked, metadata, total))
    assert QUERIES["k08_index_warnings"](spark, "/root/testdata/sf0.01").count() == 1500
    assert seen[0].count() == 420


@pytest.mark.parametrize("name", ["d12_fact_diagnostics", "d13_fact_support", "d15_fact_lookups", "d16_fact_checks", "d16b_planted_fact_faults", "d21_statement_checks", "d22_provenance"])
def test_facts_and_their_checks_move_no_rows(spark, name):
    from sedimenta import audits, checks, packages  # noqa: F401
    from sedimenta.catalogue import QUERIES

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(QUERIES[name](spark, "/root/testdata/sf0.001")) == []
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_facts_and_decisions_are_stored_without_keys(tables):
    assert not {c for c in (*tables.short_facts.columns, *tables.short_statements.columns) if c.endswith("_key") or c == "checksum"}


def test_lines_tell_what_joins_tell(spark):
    """Facts, support, diagnostics and entities from the arrays of lines, against the joins over all observations."""
    said = ["Unit T1 rated 25 kVA", "T1 T2 20 kV", "+E01-QA1", "T1 +CELLA +CELLB", "+E01-QA1 +E01-QA1 +E02-QA1 5 A", "T1 +CELLA 7 kVA 8 V", "T1 T1 1.250 kV", "note", "+E01-QA1 +E01 T1"]
    lines = spark.createDataFrame([(doc, doc % 7, k, t) for doc in range(3) for k, t in enumerate(said[doc:])], "document_id long, project_id long, line_index long, line_text string")
    shown = evidence.shown_in(lines, lines)
    rows = derivation.mentions(evidence.extract(text.tokenised(lines, *evidence.LINE)))
    facts = derivation.facts(rows)
    pairs = [
        (derivation.keyed_facts(derivation.short_facts(shown)), facts), (derivation.keyed_support(derivation.short_support(shown)), derivation.fact_support(rows, facts)),
        (derivation.line_diagnostics(shown), derivation.fact_diagnostics(rows)), (derivation.entities_of(shown), derivation.entities(rows)),
    ]
    for one, two in pairs:
        own = sorted(map(str, one.select(*two.columns).collect()))
        assert own and own == sorted(map(str, two.collect()))


SEEN = "kind string, rule_id string, observed_text string, status string, token_start long, token_end long, char_start long, char_end long, value decimal(28,6), unit string, designation string"


def seen(kind, text, at=0, status="observed"):
    return (kind, "voltage_value", text, status, at, at, 0, 1, None, None, text)


@pytest.mark.parametrize("few", [32, 0])  # 0: all lines are dealt row by row
def test_a_line_tells_its_pairs(spark, monkeypatch, few):
    sides = [
        ([seen("a", "x")], [seen("b", "x")]), ([seen("a", "x")], [seen("a", "y"), seen("b", "z")]), ([seen("a", "x"), seen("b", "x")], [seen("c", "x")]), ([seen("a", "x")] * 3, [seen("a", "y"), seen("b", "y")]), ([], [seen("a", "x")]),
        ([seen("a", "x", 1)], []), ([seen("a", "x", k) for k in range(40)], [seen("a" if k % 3 else "b", "x", k) for k in range(40)]), ([seen("a", "x"), seen("b", "y", 2)], [seen("c", "x"), seen("b", "y", 2), seen("d", "y", 2)]), ([seen(None, "x")], [seen(None, None)]), ([], []),
    ]
    monkeypatch.setattr(quality, "FEW", few)
    lines = spark.createDataFrame([(1, k, *both) for k, both in enumerate(sides)], f"document_id long, line_index long, expected array<struct<{SEEN.replace(' ', ':').replace(',:', ',')}>>, found array<struct<{SEEN.replace(' ', ':').replace(',:', ',')}>>")
    versions = quality._versions(F.col("rule_id"))
    side = lambda c: lines.select("document_id", "line_index", F.explode(c).alias("x")).select("document_id", "line_index", "x.*").withColumn("rule_version", versions)
    shown = lambda rows: sorted(map(str, rows.collect()))
    wanted = shown(quality.pairings(side("expected"), side("found")))
    assert len(wanted) > 45 and shown(quality.line_pairings(lines)) == wanted


def test_pairs_and_faults_stay_with_their_document(spark, tables):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert exchanges(tables.judged) == [] and exchanges(tables.judged_again) == []
        # lines are dealt once, as numbers; evidence and keys stay
        for name in ("c15_planted_evidence_faults", "n09_corpus_faults"):
            moved = exchanges(QUERIES[name](spark, DATA))
            assert len(moved) == 1 and "REPARTITION_BY_NUM" in moved[0]
        moved = exchanges(QUERIES["c10_span_provenance"](spark, DATA))
        assert len(moved) == 1 and "REPARTITION_BY_NUM" in moved[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_errors_of_two_runs(spark):
    schema = "outcome string, kind string, observed_text string, document_id long, line_index long, token_start long, token_end long"
    row = lambda text, outcome="false_positive": (outcome, "a", text, 1, 0, 0, 0)
    before = spark.createDataFrame([row("kept"), row("gone"), row("gone"), row(None), row("right", "true_positive")], schema)
    after = spark.createDataFrame([row("kept"), row("new"), row(None), row("right", "true_positive")], schema)
    assert sorted((r.change, r.n) for r in quality.regressions(before, after).collect()) == [("new", 2), ("resolved", 2)]  # a null equals nothing


def test_repeated_ids_of_a_document(spark):
    corpus = spark.createDataFrame([("i", 1, 0, "k", "t", "1"), ("i", 1, 0, "k", "t", "1"), ("j", 1, 0, "k", "t", "1"), (None, 2, 0, "k", "t", "x"), (None, 2, 0, "k", "t", "1"), ("m", 3, 9, "z", None, "1")], "id string, document_id long, line_index long, kind string, observed_text string, value_text string")
    lines = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "document_id long, line_index long")
    found = [sorted(map(str, quality.corpus_faults(corpus, lines, ("k",), own=own).collect())) for own in (False, True)]
    assert found[0] == found[1] and len(found[0]) == 5


def test_sizes_of_lines_are_those_of_their_tokens(spark):
    lines = spark.createDataFrame([(1, 1, k, t) for k, t in enumerate(["a  b", " ", "", None, " x y z ", "w"])], "document_id long, project_id long, line_index long, line_text string")
    own = text.tokenised(lines, *evidence.LINE).groupBy("document_id", "line_index").agg(F.count("*").alias("tokens"))
    assert sorted(map(str, text.line_sizes(lines).collect())) == sorted(map(str, own.collect()))


def test_evidence_is_appended_without_keys(spark, monkeypatch):
    from sedimenta import catalogue

    made, plain = [], catalogue.bucket_table
    monkeypatch.setattr(catalogue, "bucket_table", lambda *a, **k: made.append(plain(*a, **k)) or made[-1])
    t = Tables(spark, DATA)
    t.__dict__["buckets"] = 400
    monkeypatch.setattr(catalogue, "tables", lambda *a: t)
    rows = QUERIES["a11_idempotent_append"](spark, DATA)
    wanted = t.evidence.where("document_id % 2 = 0 and status <> 'rejected'").select("evidence_key", "document_id")
    assert rows.exceptAll(wanted).isEmpty() and wanted.exceptAll(rows).isEmpty() and not rows.isEmpty()
    assert "evidence_key" not in made[0].schema.names and made[0].buckets == 50  # they grow with the lines
    assert exchanges(rows) == []


def test_units_and_kinds_are_counted_by_text(spark, monkeypatch):
    from sedimenta import catalogue

    t = Tables(spark, DATA)
    monkeypatch.setattr(catalogue, "tables", lambda *a: t)
    rows = QUERIES["a23_attribute_resolution"](spark, DATA)
    QUERIES["a23b_attributes_by_id_unit_domain"](spark, DATA).collect()
    assert "shown" not in t.__dict__ and not any("document_id" in x or "orderkey" in x for x in exchanges(evidence.counted_in(t.lines)))
    wanted = t.evidence.groupBy("kind", "unit").agg(F.count("*").alias("n"))
    assert t.kinds.exceptAll(wanted).isEmpty() and wanted.exceptAll(t.kinds).isEmpty() and not rows.isEmpty()


@pytest.mark.parametrize("name", ["i08_agreed_versions", "i09_two_sided_context"])
def test_counts_by_document_make_no_stage(spark, monkeypatch, name):
    from sedimenta import catalogue

    t = Tables(spark, DATA)
    monkeypatch.setattr(catalogue, "tables", lambda *a: t)
    rows = QUERIES[name](spark, DATA)
    assert "shown" not in t.__dict__ and not any("partkey" in x for x in exchanges(rows))
    own = rows.collect()
    assert own and t.shown and sorted(map(str, QUERIES[name](spark, DATA).collect())) == sorted(map(str, own))  # the same from the stage


def test_joins_of_stages_are_planned_by_their_rows_not_by_their_files(spark):
    Tables(spark, DATA)  # the session's settings
    # a million observations in well packed files: small on disk, a hundred bytes a row once they have keys
    packed = spark.range(2_000_000).select((F.col("id") % 1000).alias("document_id"), F.lit("designation_generic|1.0|T1").alias("place"))
    one, two = (stages.staged_by(packed, name, "document_id", 8).select("document_id", F.sha2("place", 256).alias("k")) for name in ("one", "two"))
    plan = one.join(two, ["document_id", "k"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan and "SortMergeJoin" in plan


def test_an_evaluation_run_extracts_once_and_moves_no_observation(tables):
    asked = []

    def extract(lines):
        asked.append(lines)
        return tables.by_document(evidence.shown_in(lines, tables.lines), "run")

    got = quality.evaluation_run(tables.register, expected_of, extract)
    assert len(asked) == 1 and not [x for x in exchanges(got) if "token_start" in x]
    wanted = quality.metrics(quality.classified(quality.pairings(expected(tables), tables.evidence)))
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(got.drop("rule_versions")) == rows(wanted) and got.where("kind is null").count() == 1
    versions = ",".join(sorted(r[0] for r in tables.evidence.select(F.concat_ws("@", "rule_id", "rule_version")).distinct().collect()))
    assert {r.rule_versions for r in got.collect()} == {versions}


def test_each_identity_is_worked_out_once_and_documents_stay_where_they_are(spark):
    docs = spark.range(20).select(F.col("id").alias("document_id"), F.sha2(F.col("id").cast("string"), 256).alias("checksum")).repartition(4, "document_id")
    sets = lineage.artifact_sets(docs, {"facts": "document_id = 3"})
    plan = sets["statements"]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("sha2(") <= 2 * len(lineage.KINDS)  # written into each other there would be over a hundred
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    got = lineage.traced(sets)
    assert not [x for x in exchanges(got) if "REPARTITION_BY_NUM" not in x]
    up, by_hand = "checksum", docs.select("document_id", "checksum")
    for kind in lineage.KINDS:
        by_hand = by_hand.withColumn(kind, identity(kind, F.col(up)))
        up = kind
    ends = {r.document_id: r for r in by_hand.collect()}
    for r in got.collect():
        assert (r.steps, r.furthest, r.complete) == ((0, ends[3].statements, False) if r.document_id == 3 else (6, ends[r.document_id].source, True))


def test_an_incremental_extraction_holds_a_row_a_document_without_keys(spark, monkeypatch):
    held = []
    monkeypatch.setattr(catalogue, "artifact_store", lambda rows, make=catalogue.artifact_store: held.append(make(rows)) or held[-1])
    rows = QUERIES["e05_incremental_extraction"](spark, DATA)
    (store,) = held
    kept = store.rows.read()
    assert "evidence_key" not in kept.columns and kept.groupBy("document_id").count().where("count > 1").isEmpty()
    assert 0 < rows.count() <= kept.select(F.explode("seen")).count() and not rows.where("made_in = 2").isEmpty()
