"""Copy-on-write tables, their versions, and reuse by identity."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sedimenta.sources.versions import ArtifactStore, BucketTable, Conflict

SCHEMA = StructType([StructField("k", LongType()), StructField("v", StringType())])


def rows(spark, *pairs):
    return spark.createDataFrame(list(pairs), SCHEMA)


def held(table, version=None):
    return sorted((r.k, r.v) for r in table.read(version).collect())


def files(path):
    return {os.path.join(d, n): os.stat(os.path.join(d, n)).st_mtime_ns for d, _, names in os.walk(path) for n in names if n.startswith("part-")}


@pytest.fixture
def table(spark, tmp_path):
    return BucketTable(spark, f"file://{tmp_path}/t", "k", SCHEMA, buckets=8)


def test_only_touched_buckets_are_written(spark, table, tmp_path):
    table.overwrite(rows(spark, *((k, "a") for k in range(100))))
    before, folders = files(tmp_path), table.manifest()["folders"]
    table.upsert(rows(spark, (7, "b"), (7, "c")))
    after, now = files(tmp_path), table.manifest()["folders"]
    assert {f: t for f, t in after.items() if f in before} == before  # nothing that was there is rewritten
    assert [b for b in now if now[b] != folders.get(b)] == [str(table._touched(rows(spark, (7, "x")))[0])]
    assert held(table) == sorted([(k, "a") for k in range(100) if k != 7] + [(7, "b")])
    assert held(table, 1) == [(k, "a") for k in range(100)]  # the version before is still there


def test_replays_add_nothing(spark, table):
    table.append_new(rows(spark, (1, "a"), (2, "b"), (2, "b")), batch=("job", 0))
    assert table.append_new(rows(spark, (3, "c")), batch=("job", 0)) == 1
    assert table.append_new(rows(spark, (2, "z"), (3, "c")), batch=("job", 1)) == 2
    assert table.replace(rows(spark, (9, "x")), batch=("other", 5)) == 3
    assert table.upsert(rows(spark, (9, "y")), batch=("other", 4)) == 3
    assert held(table) == [(1, "a"), (2, "b"), (3, "c"), (9, "x")]


def test_replace_and_clear(spark, table):
    table.overwrite(rows(spark, (1, "a"), (1, "b"), (2, "c"), (3, "d"), (None, "n")))
    table.replace(rows(spark, (1, "z")), cleared=rows(spark, (3, ""), (77, "")))
    assert {(r.k, r.v) for r in table.read().collect()} == {(1, "z"), (2, "c"), (None, "n")}
    table.replace(rows(spark), cleared=rows(spark, (2, "")))
    assert {(r.k, r.v) for r in table.read().collect()} == {(1, "z"), (None, "n")}


def test_a_lookup_reads_the_buckets_of_its_keys(spark, table):
    table.overwrite(rows(spark, *((k, "a") for k in range(1000))))
    found = table.lookup(5, 5000)
    assert [(r.k, r.v) for r in found.collect()] == [(5, "a")]
    assert len(found.inputFiles()) <= 2 * 8 and len(found.inputFiles()) < len(table.read().inputFiles())
    assert table.lookup(5000).collect() == []


def test_two_writers_from_one_version(spark, table, monkeypatch):
    table.overwrite(rows(spark, (1, "a")))
    base = table.manifest()
    table.upsert(rows(spark, (1, "b")))
    monkeypatch.setattr(table, "manifest", lambda version=None: base)
    with pytest.raises(Conflict):
        table.upsert(rows(spark, (1, "c")))
    monkeypatch.undo()
    assert held(table) == [(1, "b")] and table.version() == 2


def test_an_empty_table(spark, table):
    assert held(table) == [] and table.version() == 0
    table.overwrite(rows(spark))
    assert held(table) == [] and table.version() == 1


def test_documents_with_known_identities_are_not_made_again(spark, tmp_path):
    schema = StructType([StructField("document_id", LongType()), StructField("word", StringType())])
    store, seen = ArtifactStore(spark, f"file://{tmp_path}/s", schema, buckets=4), []

    def run(texts):
        docs = spark.createDataFrame(sorted(texts.items()), "document_id long, text string")
        asked = docs.select("document_id", F.sha2("text", 256).alias("identity"))

        def make(lacking):
            seen.append(sorted(r.document_id for r in lacking.collect()))
            return docs.join(lacking.select("document_id"), "document_id").select("document_id", F.explode(F.split("text", " ")).alias("word")).where("word <> ''")

        return sorted((r.document_id, r.word, r.made_in) for r in store.ensure(asked, make).collect())

    assert run({1: "a b", 2: "c", 3: ""}) == [(1, "a", 1), (1, "b", 1), (2, "c", 1)]
    assert run({1: "a b", 2: "c", 3: ""}) == [(1, "a", 1), (1, "b", 1), (2, "c", 1)]
    assert run({1: "a b", 2: "d", 3: "", 4: "e"}) == [(1, "a", 1), (1, "b", 1), (2, "d", 2), (4, "e", 2)]
    assert seen == [[1, 2, 3], [2, 4]]  # the document without words is known too


def test_reconciling_brings_an_edge_and_its_nodes_back(spark, tmp_path):
    from sedimenta.operators.generations import StoredGraph

    decision = "document_id long, statement_key string, statement_type string, subject_key string, object_key string, subject_kind string, object_kind string, review_id long, recorded_at timestamp, promoted boolean, refusal string"
    entity = "document_id long, project_id long, entity_key string, label string, designation string, number_text string, value decimal(28,6), unit string"

    def decided(*refusals):
        return spark.createDataFrame([(1, f"s{k}", "is_located_in", "a", f"p{k}", "engineering_asset", "structural_location", k, None, r is None, r) for k, r in enumerate(refusals) if r != "gone"], decision)

    entities = spark.createDataFrame([(1, 1, k, k.upper(), k.upper(), None, None, None) for k in ("a", "p0", "p1")], entity)
    held = StoredGraph.of(f"file://{tmp_path}/g", decided(None, None), entities, buckets=4)
    documents = spark.createDataFrame([(1,), (2,)], "document_id long")

    def states():
        name = {r.node_id: r.entity_key for r in held.nodes().collect()}
        return sorted((r.object_key, r.state, r.retirement_reason) for r in held.edges().collect()), sorted((name[r.node_id], r.state) for r in held.nodes().collect())

    assert held.generation() == 0 and held.edges().collect() == [] and held.nodes().collect() == []
    assert held.rebuild(decided(None, None), entities) == 1
    held.reconcile(decided(None, "review_rejected"), entities, documents)
    assert states() == ([("p0", "active", None), ("p1", "historical", "review_reversed")], [("a", "active"), ("p0", "active"), ("p1", "historical")])
    held.reconcile(decided("gone", "review_rejected"), entities, documents)
    assert states()[0] == [("p0", "historical", "requires_revalidation"), ("p1", "historical", "review_reversed")] and {s for _, s in states()[1]} == {"historical"}
    events = held.reconcile(decided("gone", None), entities, documents)
    assert {r.event for r in events.collect()} == {"revalidated", "history"}
    assert states() == ([("p0", "historical", "requires_revalidation"), ("p1", "active", None)], [("a", "active"), ("p0", "historical"), ("p1", "active")])
    assert held.generation() == 1 and [tuple(r)[0] for r in held.log().collect()] == [1]
    assert held.rebuild(decided(None, None), entities) == 2 and held.rebuild(decided(None, None), entities) == 3
    assert [(r.generation, r.unchanged) for r in held.log().orderBy("generation").collect()] == [(1, False), (2, False), (3, True)]


def test_a_stage_is_made_once(spark, tmp_path):
    """Rows are written once before the store reads them, and no identities are sent to all tasks by way of the driver."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for rows in batches:
            made.add(len(rows))
            yield rows

    asked = spark.range(40).select(F.col("id").alias("document_id"), F.col("id").cast("string").alias("identity"))
    store = ArtifactStore(spark, f"file://{tmp_path}/s", StructType([StructField("document_id", LongType())]), buckets=4)
    rows = store.ensure(asked, lambda lacking: lacking.select("document_id").mapInPandas(counted, "document_id long"))
    assert rows.count() == 40 and made.value == 40
    assert "BroadcastExchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_rows_are_dealt_by_what_keys_lie_within(spark, tmp_path):
    schema = StructType([StructField("d", LongType()), StructField("k", LongType())])
    table = BucketTable(spark, f"file://{tmp_path}/w", "k", schema, 8, within="d")
    made = lambda *pairs: spark.createDataFrame(list(pairs), schema)
    table.overwrite(made(*((1, k) for k in range(20))))
    assert len(table.manifest()["folders"]) == 1  # one document, one bucket
    version = table.append_new(made((1, 3), (1, 50), (2, 3), (2, 3)))  # the same key in another document is another row
    assert sorted(map(tuple, table.added(1, version).collect())) == [(1, 50), (2, 3)]
    assert sorted(map(tuple, table.lookup(2).collect())) == [(2, 3)]
    table.replace(made((2, 3)))
    assert table.read().count() == 22 and table.added(1).count() == 2  # files of version 1 are all there still
    with pytest.raises(ValueError):
        table.added(2)  # but not those of version 2
