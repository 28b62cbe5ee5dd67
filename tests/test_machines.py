"""State machines that refuse, against a plain fold; ranks within hot keys."""

import random

import pytest
from pyspark.sql import functions as F

from sedimenta.operators import ledger, machines, ordering


def fold(rows, machine):
    """(key, n, target) in order: before, accepted, after of each."""
    legal, held, out = {*machine.moves, (machines.ABSENT, machine.initial)}, {}, []
    for key, n, target in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "")):
        before = held.get(key, machines.ABSENT)
        held[key] = target if (before, target) in legal else before
        out.append((key, n, target, before, before != held[key], held[key]))
    return sorted(out, key=repr)


def log(spark, rows):
    return spark.createDataFrame(rows, "key long, n int, target string").repartition(3)


def judged(spark, rows, machine, size=256):
    return machines.run(log(spark, rows), machine, "key", "target", ("n",), size)


def test_a_chain_of_illegal_moves_leaves_the_state(spark):
    asked = ["processing", "uploaded", "processed", "failed", "processing", "queued", "queued", "processing", "uploaded", "processed", "queued"]
    got = judged(spark, [(1, k, s) for k, s in enumerate(asked)], ledger.JOBS).orderBy("n").collect()
    assert [r.accepted for r in got] == [False, True, False, False, False, True, False, True, False, True, False]
    assert got[4].before == "uploaded" and got[4].after == "uploaded"  # neither 'processed' nor 'failed' ever held
    assert got[-1].after == "processed"


@pytest.mark.parametrize("machine", [ledger.JOBS, ledger.CANDIDATES, ledger.SESSIONS, ledger.CONVERSATIONS])
def test_folds_of_hot_keys_in_blocks(spark, machine):
    r = random.Random(7)
    names = [*machine.states[1:], "unheard of", None]
    rows = [(1 if k % 3 else r.choice([None, 2, 3, 4]), k, r.choice(names)) for k in range(900)]
    rows += [(9, 5, "x"), (9, 5, None), (9, 5, machine.initial)]
    got = judged(spark, rows, machine, size=4)
    assert sorted((tuple(x) for x in got.collect()), key=repr) == fold(rows, machine)


def test_states_of_keys_and_an_empty_log(spark):
    rows = [(1, 0, "pending"), (1, 1, "approved"), (1, 2, "rejected"), (2, 0, "pending"), (2, 1, "needs_changes"), (2, 2, "approved"), (3, 0, "rejected"), (4, 0, "pending"), (4, 1, "needs_changes"), (4, 2, "rejected")]
    got = {r.key: (r.state, r.accepted, r.refused) for r in machines.now(judged(spark, rows, ledger.CANDIDATES), "key", "n").collect()}
    assert got == {1: ("approved", 2, 1), 2: ("approved", 3, 0), 3: ("absent", 0, 1), 4: ("rejected", 3, 0)}
    assert judged(spark, [], ledger.CANDIDATES).collect() == []


def test_columns_of_the_log_come_back_whatever_their_names(spark):
    rows = log(spark, [(1, 0, "uploaded"), (1, 1, "queued")]).withColumns({"state": F.lit("s"), "own": F.lit("o"), "block": F.lit(1)})
    got = machines.run(rows, ledger.JOBS, "key", "target", ("n",))
    assert got.columns == ["key", "n", "target", "state", "own", "block", "before", "accepted", "after"]
    assert {(r.state, r.own, r.block) for r in got.collect()} == {("s", "o", 1)}


def test_ranks_within_keys(spark):
    r = random.Random(1)
    rows = [(None if k % 7 == 0 else 1 if k % 3 else k % 5, k, None) for k in range(500)]
    r.shuffle(rows)
    got = sorted(((x.key, x.n, x["rank"]) for x in ordering.ranked(log(spark, rows), "key", "n").collect()), key=repr)
    seen, want = {}, []
    for key, n, _ in sorted(rows, key=lambda x: x[1]):
        want.append((key, n, seen.get(key, 0)))
        seen[key] = seen.get(key, 0) + 1
    assert got == sorted(want, key=repr)


def test_moves_are_those_of_the_lifecycles():
    assert {("needs_changes", "approved"), ("needs_changes", "rejected")} <= set(ledger.CANDIDATE_MOVES)
    closed = {"approved", "rejected"}
    assert not any(a in closed for a, _ in ledger.CANDIDATE_MOVES) and not any(a == "processed" for a, _ in ledger.JOB_MOVES)
