"""Promotion over a stream equals promotion over all rows, after replays and late rows."""

import random
from datetime import datetime, timedelta

import pandas as pd

from sedimenta.streaming import promotion

DAY = datetime(2024, 1, 1)


def made(r):
    rows = []
    for e in range(12):
        ends = (f"n{e % 5}", f"n{5 + e % 3}")
        for k in range(r.randint(1, 5)):
            at = DAY + timedelta(hours=r.randrange(40))
            if r.random() < 0.5:
                rows.append((f"e{e}", *ends, "review", r.choice(["approved", "approved", "rejected", None]), None, at, e * 100 + k))
            else:
                rows.append((f"e{e}", *ends, "statement", None, r.random() < 0.7, at, e * 100 + k))
    return rows


def test_stream_equals_batch_in_any_order(spark, tmp_path):
    r = random.Random(3)
    rows = made(r)
    late, rest = rows[::4], [x for k, x in enumerate(rows) if k % 4]
    r.shuffle(rest)
    steps = [rest[: len(rest) // 2], rest[len(rest) // 2 :] + rest[:5], late + [("e1", "n1", "n6", "review", "approved", None, None, -1), (None, "n1", "n2", "review", "approved", None, DAY, 1)]]
    for step in steps:
        spark.createDataFrame(step, promotion.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        promotion.follow(spark, f"{tmp_path}/events", f"{tmp_path}/out")
    edges, nodes = promotion.batch(spark.read.parquet(f"{tmp_path}/events"))
    rows_of = lambda df: sorted((tuple(x) for x in df.collect()), key=repr)
    got = promotion.latest(spark, f"{tmp_path}/out", "edges").select(*edges.columns)
    assert rows_of(got) == rows_of(edges) and {x.state for x in got.collect()} == {"active", "historical"}
    assert rows_of(promotion.latest(spark, f"{tmp_path}/out", "nodes")) == rows_of(nodes)
    changes = spark.read.schema(promotion.EDGE_CHANGES).parquet(f"{tmp_path}/out/edges").count()
    spark.createDataFrame(rows, promotion.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")  # all once more
    promotion.follow(spark, f"{tmp_path}/events", f"{tmp_path}/out")
    assert spark.read.schema(promotion.EDGE_CHANGES).parquet(f"{tmp_path}/out/edges").count() == changes


def test_the_last_edge_takes_its_nodes_along_and_a_new_one_brings_them_back(spark, tmp_path):
    def step(*rows):
        spark.createDataFrame(list(rows), promotion.EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/events")
        promotion.follow(spark, f"{tmp_path}/events", f"{tmp_path}/out")
        return {r.node_id: r.state for r in promotion.latest(spark, f"{tmp_path}/out", "nodes").collect()}

    at = [DAY + timedelta(hours=h) for h in range(9)]
    here, yes = lambda e, o, h: (e, "a", o, "statement", None, True, at[h], h), lambda e, o, h: (e, "a", o, "review", "approved", None, at[h], h)
    assert step(here("e1", "b", 0), yes("e1", "b", 1), here("e2", "c", 0), yes("e2", "c", 1)) == {"a": "active", "b": "active", "c": "active"}
    assert step(("e1", "a", "b", "review", "rejected", None, at[2], 2)) == {"a": "active", "b": "historical", "c": "active"}
    assert step(("e2", "a", "c", "statement", None, False, at[3], 3)) == {"a": "historical", "b": "historical", "c": "historical"}
    assert step(yes("e1", "b", 4)) == {"a": "active", "b": "active", "c": "historical"}


def test_one_call_serves_all_edges_of_a_group():
    class Held(dict):
        getValue, updateValue = dict.get, dict.__setitem__

    class Handle:
        def getMapState(self, *_):
            return Held()

    processor = promotion.EdgeProcessor()
    processor.init(Handle())
    names = ["edge_id", "subject_id", "object_id", "what", "decision", "present", "at", "number"]
    rows = [(f"e{k}", "a", "b", *said, DAY, k) for said in (("statement", None, True), ("review", "approved", None)) for k in range(3)]
    parts = [pd.DataFrame(x, columns=names) for x in (rows[:4], rows[4:])]  # an edge's rows may come in several parts
    (changes,) = processor.handleInputRows((0,), iter(parts), None)
    assert list(changes["edge_id"]) == ["e0", "e1", "e2"] and set(changes["state"]) == {"active"}
    assert not list(processor.handleInputRows((0,), iter(parts), None))
