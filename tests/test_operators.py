"""Hand-written rows for the rules, and the catalogue against DuckDB on the smallest tables."""

import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import sedimenta.audits
import sedimenta.checks
import sedimenta.memory
import sedimenta.packages
from sedimenta.catalogue import ORACLE_SQL, QUERIES
from sedimenta.operators import evidence, graph, quality, requests, retrieval, spans, text
from sedimenta.sources import stages
from sedimenta.streaming import incremental

DATA = "/root/testdata/sf0.001"


def lines(spark, *texts):
    return spark.createDataFrame([(1, 1, k, t) for k, t in enumerate(texts)], "document_id long, project_id long, line_index long, line_text string")


def found(spark, *texts):
    return evidence.extract(text.tokenised(lines(spark, *texts), *evidence.LINE)).orderBy("line_index", "token_start", "kind").collect()


def test_offsets_count_code_points(spark):
    rows = text.tokenised(lines(spark, "  é\u00a0T1 "), *evidence.LINE).orderBy("position").collect()
    assert [(r.text, r.char_start, r.char_end) for r in rows] == [("é", 2, 3), ("T1", 4, 6)]


def test_a_unit_token_after_a_number_is_not_a_designation(spark):
    assert [r.kind for r in found(spark, "240 MM2")] == ["cable_section_value"]
    assert [r.kind for r in found(spark, "MM2")] == ["designation"]
    assert found(spark, "240mm2") == []


@pytest.mark.parametrize(("written", "status", "value"), [("1,250 kV", "ambiguous", None), ("1.2.3 kV", "ambiguous", None), ("20.0 kV", "observed", 20.0), ("(20kV);", "observed", 20.0)])
def test_numbers(spark, written, status, value):
    (r,) = found(spark, written)
    assert (r.status, None if r.value is None else float(r.value)) == (status, value)


def test_compound_shows_both(spark):
    rows = found(spark, "+E01-QA1 +CELLA")
    assert [(r.kind, r.designation) for r in rows] == [("designation", "+E01-QA1"), ("location", "+E01"), ("location", "+CELLA")]


def test_punctuation_alone_is_nothing(spark):
    r = evidence.trimmed(text.tokenised(lines(spark, "(.;)"), *evidence.LINE)).first()
    assert (r.trimmed, r.trim_left, r.trim_right) == ("", 0, 0)


def test_normalisation_drops_what_becomes_empty(spark):
    rows = text.normalised(text.tokenised(lines(spark, "ﬁx \u2003 kV"), *evidence.LINE)).orderBy("position").collect()
    assert [r.normalized_text for r in rows] == ["fix", "kV"]


def test_equal_times_are_settled_by_id(spark):
    rows = spark.createDataFrame([(1, 1, "s", "approved", 5), (2, 1, "s", "rejected", 5)], "review_id long, document_id long, statement_key string, decision string, recorded_at long")
    assert graph.latest_reviews(rows).first().review_id == 2


def test_budget_of_zero_and_caps(spark):
    items = spark.createDataFrame([(1, f"i{k}", "engineering_asset" if k < 3 else "other", f"{k}") for k in range(5)], "request_id long, item_id string, kind string, order_key string")
    assert retrieval.select_items(items, total=0).where("selected").count() == 0
    chosen = {r.item_id: r.discard_reason for r in retrieval.select_items(items, total=3, caps={"engineering_asset": 2}).collect()}
    assert chosen == {"i0": None, "i1": None, "i2": "engineering_asset", "i3": None, "i4": "items"}


def test_a_lone_leftover_pair_is_paired(spark):
    schema = "document_id long, line_index long, token_start long, token_end long, kind string, observed_text string, status string"
    e = spark.createDataFrame([(1, 0, 0, 0, "a", "x", "observed")], schema)
    f = spark.createDataFrame([(1, 0, 0, 0, "b", "x", "observed")], schema)
    rows = quality.classified(quality.pairings(e, f)).collect()
    assert sorted((r.outcome, r.reason) for r in rows) == [("false_negative", "kind"), ("false_positive", "kind")]
    assert quality.metrics(quality.classified(quality.pairings(e, e))).where("kind is null").first().f1 == 1.0


def test_intents(spark):
    asked = spark.createDataFrame([("1", "Compare T1 and draw TR2"), ("2", "which substation"), ("3", "hello"), ("4", "the transformer"), ("5", "Take me to page 3")], "request_id string, text string")
    got = {r.request_id: (r.intent, r.confidence) for r in requests.classified(asked, requests.rule_matches(asked)).collect()}
    assert got == {"1": ("ambiguous", "unresolved"), "2": ("knowledge", "medium"), "3": ("unsupported", "unresolved"), "4": ("general", "low"), "5": ("navigation", "high")}


def test_requests_are_folded(spark):
    asked = spark.createDataFrame([("1", "\uff34\uff32 Straße_\u00a0KABEL"), ("2", None)], "request_id string, text string")
    assert [r.t for r in asked.select(requests.request_tokens(F.col("text")).alias("t")).collect()] == [["tr", "strasse", "kabel"], None]


def test_match_evidence_is_numbered(spark):
    asked = spark.createDataFrame([("1", "Compare the rating versus the cable rating")], "request_id string, text string")
    rows = requests.match_evidence(requests.rule_matches(asked)).orderBy("sequence").collect()
    assert [(r.sequence, r.phrase) for r in rows] == [(1, "compare"), (2, "rating"), (3, "versus"), (4, "cable")]
    assert (rows[0].n_strong, rows[0].n_weak, rows[0].n_domain, rows[0].n_intents) == (1, 2, 1, 3)


def test_terms_meet_every_identifier_that_contains_them(spark):
    import itertools

    texts = sorted({"".join(x) for n in (1, 2, 3, 4) for x in itertools.product("AB%", repeat=n)})
    terms = spark.createDataFrame([(1, x) for x in texts[::3]] + [(2, "A"), (1, "")], "project_id long, term string")
    held = spark.createDataFrame([(1, x) for x in texts[::2]], "project_id long, identifier string")
    got = {(r.term, r.identifier) for r in retrieval.containing(terms, held).collect()}
    assert got == {(a, b) for a in texts[::3] for b in texts[::2] if a in b}


def test_repeated_leftovers_all_count(spark):
    schema = "document_id long, line_index long, token_start long, token_end long, kind string, observed_text string, status string"
    e = spark.createDataFrame([(1, 0, 0, 0, "a", "x", "observed")] * 3, schema)
    f = spark.createDataFrame([(1, 0, 0, 0, "b", "y", "observed")] * 2, schema)
    total = quality.metrics(quality.classified(quality.pairings(e, f))).where("kind is null").first()
    assert (total.tp, total.fp, total.fn) == (0, 2, 3)


def test_spans_share_a_line(spark):
    rows = [(1, 1, 0, 7, 1, "(20"), (1, 1, 0, 7, 2, "kV) T1"), (1, 1, 0, 3, 3, " 5  A;"), (1, 2, 0, 7, 4, "T2")]
    tokens = spans.span_tokens(spark.createDataFrame(rows, "document_id long, page long, block long, line long, span long, text string"))
    assert sorted((r.page, r.line_index, r.position, r.text, r.span) for r in tokens.collect()) == [(1, 0, 0, "(20", 1), (1, 0, 1, "kV)", 2), (1, 0, 2, "T1", 2), (1, 1, 0, "5", 3), (1, 1, 1, "A;", 3), (2, 0, 0, "T2", 4)]
    assert sorted((r.source_text, r.ranges) for r in spans.provenance(tokens).collect()) == [("20 kV", "1:1-3,2:0-2"), ("5 A", "3:1-5")]


def test_content_identities_of_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    empty = spark.createDataFrame([(f"file:{tmp_path}/b.bin", 0, bytearray())], "path string, length long, content binary")  # the reader itself passes over empty files
    files = stages.files_of(spark, str(tmp_path)).unionByName(empty)
    names = spark.createDataFrame([(k, f"file:{tmp_path}/{n}") for k, n in enumerate(("a.bin", "b.bin", "c.bin"))], "document_id long, path string")
    got = {r.document_id: (r.checksum, r["size"], r.failure) for r in stages.content_identities(names, files).collect()}
    assert got[0][:2] == ("ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad", 3) and got[1][2] == "empty_content" and got[2][2] == "content_not_found"


def test_references(spark):
    rows = spark.createDataFrame([("cable 7",), ("TR-295",), ("pump 1",)], "r string")
    assert {x.r: x.reference_id for x in requests.normalised_reference(rows, "r").collect()} == {"cable 7": "C-07", "TR-295": "TR-295", "pump 1": None}


def test_stream_equals_batch(spark, tmp_path):
    register = text.register_lines(spark.read.parquet(f"{DATA}/lineitem.parquet"))
    register.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(register.schema).option("maxFilesPerTrigger", 3).parquet(str(tmp_path / "in"))
    q = stream.writeStream.foreachBatch(incremental.evidence_to(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = evidence.extract(text.tokenised(register, *evidence.LINE)).select("evidence_key")
    assert spark.read.parquet(str(tmp_path / "out")).select("evidence_key").exceptAll(batch).isEmpty()
    assert spark.read.parquet(str(tmp_path / "out")).count() == batch.count()


def test_latest_reviews_over_a_stream(spark, tmp_path):
    rows = [(k, k % 7, "s", "approved" if k % 2 else "rejected", (k * 37) % 50) for k in range(60)]
    schema = "review_id long, document_id long, statement_key string, decision string, recorded_at long"
    spark.createDataFrame(rows, schema).repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(incremental.latest_to(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    got = {r.document_id: r.review_id for r in incremental.latest_from(spark, str(tmp_path / "out")).collect()}
    assert got == {d: max((x for x in rows if x[1] == d), key=lambda x: (x[4], x[0]))[0] for d in range(7)}


def test_every_query_outside_the_streams_has_its_sql():
    named = {n for n in QUERIES if n in ORACLE_SQL}
    assert set(ORACLE_SQL) == named
    # the files of the tables are not among what SQL reads: tests/test_files.py compares with hashlib
    assert set(QUERIES) - named == {"a01b_file_checksums"}


def test_codes_list_all_broken_rules_in_order(spark):
    rows = spark.createDataFrame([(0, None), (5, "x"), (None, None)], "a int, b string")
    got = rows.select(sedimenta.audits.codes(small=F.col("a") < 1, missing=F.col("b").isNull()).alias("c")).collect()
    assert [r.c for r in got] == ["small,missing", "", "missing"]


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "-"
    if hasattr(v, "isoformat"):
        return v.isoformat()[:19]
    return f"{float(v):.6g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", ["a07b_judged_job_moves", "a13_replace_by_document", "a20_project_intelligence", "c05_quantities", "d08_same_line_quantity_facts", "d12_fact_diagnostics", "d18_located_in_statements", "e05_incremental_extraction", "f08_review_summary", "g04_nodes", "g07_rebuild", "g09b_reconciled_edges", "g12b_reconciled_nodes", "g20b_streamed_nodes", "h09_ranked_results", "i02_budgeted_selection", "i07_warnings", "k04b_search_after_an_update", "l01_claim_checks", "m02_rule_matches", "n04_metrics", "o04_session_moves", "o10_activity_sessions", "k06_ranked_documents", *sorted({*sedimenta.packages.NAMES, *sedimenta.checks.NAMES, *sedimenta.memory.NAMES} - {"a01b_file_checksums"})])
def test_query_equals_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        db.sql(f"create view {p.stem} as select * from '{p}'")
    df, expected = QUERIES[name](spark, DATA), db.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    want = sorted(tuple(plain(r[expected.columns.index(c)]) for c in columns) for r in expected.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.select(*(F.col(c) for c in columns)).collect()) == want
