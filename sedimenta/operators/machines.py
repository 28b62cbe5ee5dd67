"""State machines that refuse: an illegal request leaves the state as it was, so that what follows is judged against what held.

A request is a function from states to states (its target where that is a legal move, else the state itself), and functions compose associatively.
The requests of each key are cut into blocks of ``size`` by rank; blocks are composed to one function each, block functions to functions of
``size`` blocks, and so on; from the top, each gets the state that it is entered in; the requests of a block are then run from there. So a
key with most of all rows is folded by many tasks, and no task holds more than ``size`` requests of one group at a time.

Defined results: before its first accepted request a key is ``absent``, from which only ``initial`` is legal; asking for the state that holds is refused,
as any move that is not among the legal ones; a null or unknown target is refused; rows with a null key are those of one key; of rows with the
same order, the one with the lower target comes first; an empty log gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.stages import staged
from .ordering import ranked

ABSENT = "absent"


@dataclass(frozen=True)
class Machine:
    initial: str
    moves: tuple[tuple[str, str], ...]

    @property
    def states(self) -> tuple[str, ...]:
        return (ABSENT, self.initial, *sorted({s for m in self.moves for s in m} - {self.initial}))

    def table(self) -> list[list[int]]:
        """By request (the number of its target; the last: unknown) and state held, the state then held."""
        states, legal = self.states, {*self.moves, (ABSENT, self.initial)}
        rows = [[k if (s, t) in legal else i for i, s in enumerate(states)] for k, t in enumerate(states)]
        return [*rows, list(range(len(states)))]

    def number(self, target: Column) -> Column:
        names = self.states[1:]  # nothing may be asked to be absent
        return F.coalesce(*(F.when(target == s, k + 1) for k, s in enumerate(names)), F.lit(len(self.states))).cast("int")

    def name(self, number: Column) -> Column:
        return F.get(F.array(*map(F.lit, self.states)), number)


def _table(machine: Machine) -> Column:
    return F.array(*(F.array(*(F.lit(x).cast("int") for x in row)) for row in machine.table()))


def _composed(functions: Column, states: int) -> Column:
    """The functions of an array (each an array of states), in order, as one."""
    same = F.array(*(F.lit(k).cast("int") for k in range(states)))
    return F.aggregate(functions, same, lambda acc, f: F.transform(acc, lambda s: F.get(f, s)))


def entered(functions: DataFrame, states: int, size: int) -> DataFrame:
    """key, block, state: the state in which each block's function (key, block, f) is entered."""
    last = functions.agg(F.max("block")).first()[0] or 0  # one number: how many levels there are
    if not last:
        return functions.select("key", "block", F.lit(0).cast("int").alias("state"))
    held = functions.groupBy("key", F.expr(f"block div {size}").alias("run")).agg(F.array_sort(F.collect_list(F.struct("block", "f"))).alias("own"))
    held = staged(held, "blocks")
    above = entered(held.select("key", F.col("run").alias("block"), _composed(F.col("own.f"), states).alias("f")), states, size)
    rows = held.join(above.select(F.col("key").alias("k"), F.col("block").alias("b"), "state"), F.col("key").eqNullSafe(F.col("k")) & (F.col("run") == F.col("b")))
    start = F.struct(F.col("state").alias("now"), F.array().cast("array<struct<block:bigint,state:int>>").alias("out"))
    step = lambda acc, x: F.struct(F.get(x["f"], acc["now"]).alias("now"), F.concat(acc["out"], F.array(F.struct(x["block"].alias("block"), acc["now"].alias("state")))).alias("out"))
    return rows.select("key", F.explode(F.aggregate("own", start, step, lambda acc: acc["out"])).alias("x")).select("key", "x.block", "x.state")


def run(log: DataFrame, machine: Machine, key: str, target: str, order: tuple[str, ...], size: int = 256) -> DataFrame:
    """Each request of ``log`` with ``before`` (the state that held), ``accepted`` and ``after``; ``log`` keeps its columns."""
    states = len(machine.states)
    asked = ranked(log.withColumn("_asked", machine.number(F.col(target))), key, *order, target)
    rows = staged(asked.withColumn("_block", F.expr(f"rank div {size}")), "requests")
    table = _table(machine)
    request = F.struct(F.col("rank"), F.col("_asked").alias("asked"))
    blocks = staged(rows.groupBy(F.col(key).alias("key"), F.col("_block").alias("block")).agg(F.array_sort(F.collect_list(request)).alias("own")), "requests-by-block")
    functions = blocks.select("key", "block", _composed(F.transform("own", lambda r: F.get(table, r["asked"])), states).alias("f"))
    entries = staged(entered(functions, states, size), "entered")
    own = blocks.join(entries.select(F.col("key").alias("k"), F.col("block").alias("b"), "state"), F.col("key").eqNullSafe(F.col("k")) & (F.col("block") == F.col("b")))
    start = F.struct(F.col("state").alias("now"), F.array().cast("array<struct<rank:bigint,before:int,after:int>>").alias("out"))

    def step(acc: Column, r: Column) -> Column:
        after = F.get(F.get(table, r["asked"]), acc["now"])
        return F.struct(after.alias("now"), F.concat(acc["out"], F.array(F.struct(r["rank"].alias("rank"), acc["now"].alias("before"), after.alias("after")))).alias("out"))

    judged = own.select("key", F.explode(F.aggregate("own", start, step, lambda acc: acc["out"])).alias("x")).select(F.col("key").alias("_key"), F.col("x.rank").alias("_rank"), "x.before", "x.after")
    found = rows.join(judged, F.col(key).eqNullSafe(F.col("_key")) & (F.col("rank") == F.col("_rank")))
    named = {"before": machine.name(F.col("before")), "accepted": F.col("before") != F.col("after"), "after": machine.name(F.col("after"))}
    return found.select(*(F.col(c) for c in log.columns), *(c.alias(n) for n, c in named.items()))


def now(judged: DataFrame, key: str, *order: str) -> DataFrame:
    """The state that holds of each key, how many requests were accepted and refused, and the first refused one's place in time."""
    newest = F.max_by("after", F.struct(*order, F.col("accepted")))
    return judged.groupBy(key).agg(newest.alias("state"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("refused"))


def recursive_sql(log: str, machine: Machine, key: str, target: str, order: str) -> str:
    """The same fold in SQL, one row of each key after the other: the CTEs ``lg`` and ``run`` (all of lg's columns, before, after)."""
    pairs = ", ".join(f"('{a}', '{b}')" for a, b in ((ABSENT, machine.initial), *machine.moves))
    held = f"case when (r.after, l.{target}) in ({pairs}) then l.{target} else r.after end"
    return f"""recursive lg as (select *, row_number() over (partition by {key} order by {order}) as k from ({log})),
run as (select *, '{ABSENT}' as before, case when {target} = '{machine.initial}' then {target} else '{ABSENT}' end as after from lg where k = 1
  union all select l.*, r.after as before, {held} as after from run r join lg l on l.{key} = r.{key} and l.k = r.k + 1)"""
