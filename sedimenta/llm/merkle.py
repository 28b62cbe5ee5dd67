"""Merkle manifest of documents: a tree of 16 branches for each source, one tree over the sources' roots, and versions of it that share nodes.

Leaves are hashed where their rows are read. They are ranked within their source by sorted ranges (counts of ranges and sources give each range its
first rank), never by one task for a source. ``16 ** height`` consecutive leaves, at aligned ranks, are a block: its task makes the levels inside it
and hands on its top; the tops are the nodes of the next round, in blocks again, until each source has one; the roots of the sources are ranked
and raised likewise. Back down, each block gets the nodes beside its own way to the root once for all that it holds.

Each leaf that was tampered with makes a version of the tree: a persistent one, whose block shares all nodes that are not above the leaf and copies
only the ancestors (``Block.version``), and which continues above the block along the shared way to the root, in the block's own
task, so that the versions of all leaves are never together anywhere.

Defined results: each row is a leaf, repeated rows are several; of equal doc_id, the lower leaf digest comes first; null doc_id first (it is never
tampered with: it has no checksum); null source is a source of its own, before the empty one; null fields are ``-``; a lone leaf is its source's root,
a lone source's root the root; a leaf without siblings has the digest of nothing as proof; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

FAN = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(text: Column) -> Column:
    fields = [F.col("doc_id").cast("string"), F.col("source"), F.col("lang"), F.col("n_chars").cast("string"), text]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(f).cast("string"), F.lit(":"), f), F.lit("-")) for f in fields)), 256)


def leaves_of(docs: DataFrame) -> DataFrame:
    """tree, doc_id, node and altered (the digest after tampering; null if untouched), as bytes."""
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit(""))  # null before all others, which are in order of their bytes
    altered = F.when(touched, leaf_of(F.translate("text", UPPER, LOWER)))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), F.unhex(leaf_of(F.col("text"))).alias("node"), F.unhex(altered).alias("altered"))


def ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with each one's rank in its tree by ``order``, and the tree's number of rows."""
    seat = F.monotonically_increasing_id()
    dealt = rows.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order)
    sorted_rows = stored(dealt.select("*", F.shiftright(seat, 33).alias("range"), seat.bitwiseAND((1 << 33) - 1).alias("seat")), "ranges")
    each = stored(sorted_rows.groupBy("tree", "range").agg(F.count("*").alias("held"), F.min("seat").alias("least")), "counts")
    # of a tree as many rows as there are ranges at most
    own = Window.partitionBy("tree")
    first = each.select("tree", "range", F.sum("held").over(own).alias("nodes"), (F.sum("held").over(own.orderBy("range")) - F.col("held") - F.col("least")).alias("shift"))
    return sorted_rows.join(stored(first, "first-ranks"), ["tree", "range"]).withColumn("rank", F.col("seat") + F.col("shift")).drop("range", "seat", "shift")


class Block:
    """A persistent tree over nodes at aligned ranks: nodes are kept with their children and never changed, versions add copies of ancestors only."""

    def __init__(self, nodes: list[str], levels: int) -> None:
        """``levels``: how often runs of 16 become one node."""
        self.digests: list[str] = list(nodes)
        self.children: list[tuple[int, ...]] = [()] * len(nodes)
        level = list(range(len(nodes)))
        for _ in range(levels):
            level = [self.add(tuple(level[k : k + FAN])) for k in range(0, len(level), FAN)]
        self.top, self.levels = level[0], levels

    def add(self, children: tuple[int, ...]) -> int:
        self.digests.append(digest("".join(self.digests[c] for c in children)))
        self.children.append(children)
        return len(self.digests) - 1

    def way(self, place: int) -> list[tuple[int, int]]:
        """From the leaf at ``place`` up: each ancestor and which of its children the way comes from."""
        node, found = self.top, []
        for level in reversed(range(self.levels)):
            k = (place >> 4 * level) % FAN
            found.append((node, k))
            node = self.children[node][k]
        return found[::-1]

    def beside(self, place: int) -> list[tuple[str, str]]:
        """Level by level the digests left and right of the way from a leaf to the top."""
        sides = []
        for node, k in self.way(place):
            of = [self.digests[c] for c in self.children[node]]
            sides.append(("".join(of[:k]), "".join(of[k + 1 :])))
        return sides

    def version(self, place: int, leaf: str) -> int:
        """The top of a version in which another leaf stands at ``place``: ancestors are copied, all else is shared."""
        self.digests.append(leaf)
        self.children.append(())
        node = len(self.digests) - 1
        for old, k in self.way(place):
            of = self.children[old]
            node = self.add(of[:k] + (node,) + of[k + 1 :])
        return node


def continued(node: str, lefts: list[str], rights: list[str]) -> str:
    """The root that a block's top leads to along the shared way above it."""
    for left, right in zip(lefts, rights, strict=True):
        node = digest(left + node + right)
    return node


def levels_for(nodes: int, height: int) -> int:
    """How many levels a block has: all of them unless its tree ends in it."""
    levels = 0
    while nodes > 1 and levels < height:
        nodes, levels = -(-nodes // FAN), levels + 1
    return levels


BLOCKS = "tree string, block long, nodes long, held binary, top binary, doc_ids array<long>, altered array<binary>"


def gathered(height: int):
    """Rows sorted by tree and rank, all of a block in one task, as one row a block with the top of its tree."""
    size = FAN**height

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.binary()))
        open_key, open_rows, done = None, [], []

        def close() -> None:
            (tree, block, nodes), own = open_key, [r[0] for r in open_rows]
            made = Block([n.hex() for n in own], levels_for(nodes, height))
            done.append((tree, block, nodes, b"".join(own), bytes.fromhex(made.digests[made.top]), [r[1] for r in open_rows], [r[2] for r in open_rows]))

        def sent() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=["tree", "block", "nodes", "held", "top", "doc_ids", "altered"])
            done.clear()
            return out

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("tree", "rank", "nodes", "node", "doc_id", "altered")]
            for tree, rank, nodes, node, doc_id, altered in zip(*columns, strict=True):
                key = tree, rank // size, nodes
                if key != open_key:
                    if open_key is not None:
                        close()
                    open_key, open_rows = key, []
                    if len(done) * size >= 65_536:
                        yield sent()
                open_rows.append((node, doc_id, altered))
        if open_key is not None:
            close()
            yield sent()

    return run


def blocks_of(nodes: DataFrame, height: int, label: str) -> DataFrame:
    """``nodes``: tree, rank, nodes (how many its tree has), node, doc_id, altered."""
    by = F.expr(f"rank div {FAN**height}")
    dealt = nodes.select("tree", "rank", "nodes", "node", "doc_id", "altered").repartition("tree", by).sortWithinPartitions("tree", "rank")
    return stored(dealt.mapInArrow(gathered(height), BLOCKS), label)


def raised(nodes: DataFrame, height: int) -> list[DataFrame]:
    """Blocks, round by round, until each tree has one."""
    rounds = [blocks_of(nodes, height, "blocks")]
    while (rounds[-1].agg(F.max("block")).first()[0] or 0) > 0:  # one number
        tops = rounds[-1].select("tree", F.col("block").alias("rank"), F.ceil(F.col("nodes") / FAN**height).alias("nodes"), F.col("top").alias("node"), *nothing())
        rounds.append(blocks_of(tops, height, "upper-blocks"))
    return rounds


def nothing() -> tuple[Column, Column]:
    return F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("binary").alias("altered")


WAYS = "tree string, block long, subroot string, root string, lefts array<string>, rights array<string>"


def ways_down(height: int):
    """For each block of an upper round the ways of what it holds: the blocks of the round below."""

    names = [c.split()[0] for c in WAYS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, block, subroot, root, lefts, rights, nodes, held in zip(*(batch.column(c).to_pylist() for c in (*names, "nodes", "held")), strict=True):
                own = Block(split(held), levels_for(nodes, height))
                sides = [own.beside(k) for k in range(len(held) // 32)]
                n, ways = len(sides), (pa.array([[side[i] for side in s] + above for s in sides], pa.list_(pa.string())) for i, above in ((0, lefts), (1, rights)))
                yield pa.RecordBatch.from_arrays([pa.array([tree] * n, pa.string()), pa.array([block * FAN**height + k for k in range(n)], pa.int64()), pa.array([subroot] * n, pa.string()), pa.array([root] * n, pa.string()), *ways], names=names)

    return run


def split(held: bytes) -> list[str]:
    text = held.hex()
    return [text[k : k + 64] for k in range(0, len(text), 64)]


def lowered(rounds: list[DataFrame], ways: DataFrame, height: int) -> DataFrame:
    """The ways of the first round's blocks, from those of the last round's."""
    for upper in reversed(rounds[1:]):
        ways = stored(upper.select("tree", "block", "nodes", "held").join(ways, ["tree", "block"]).mapInArrow(ways_down(height), WAYS), "ways")
    return ways


PROOFS = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, nodes_copied long"


def proofs(height: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in PROOFS.split(", ")]
        kinds = (pa.int64(), *[pa.string()] * 5, pa.bool_(), pa.int64())
        for batch in batches:
            for nodes, held, doc_ids, changed, lefts, rights, subroot, root in zip(*(batch.column(c).to_pylist() for c in ("nodes", "held", "doc_ids", "altered", "lefts", "rights", "subroot", "root")), strict=True):
                block, above, rows = Block(split(held), levels_for(nodes, height)), "".join(x + y for x, y in zip(lefts, rights, strict=True)), []
                for k, (doc_id, other) in enumerate(zip(doc_ids, changed, strict=True)):
                    leaf, before = block.digests[k], len(block.digests)
                    proof = digest("".join(x + y for x, y in block.beside(k)) + above)
                    top = block.version(k, leaf if other is None else other.hex())
                    folded = continued(block.digests[top], lefts, rights)
                    copied = len(block.digests) - before - 1
                    if other is None:  # of an untouched leaf only the way was recomputed
                        del block.digests[before:], block.children[before:]
                        copied = 0
                    rows.append((doc_id, leaf, subroot, root, proof, folded, folded == root, copied + (0 if other is None else len(lefts))))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


def manifest(docs: DataFrame, height: int = 2) -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified, nodes_copied."""
    leaves = ranked(stored(leaves_of(docs), "leaves"), "doc_id", "node")
    own = raised(leaves, height)
    subroots = own[-1].select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("top").alias("node"))
    seats = stored(ranked(subroots, "of"), "seats")
    over = raised(seats.select("tree", "rank", "nodes", "node", *nothing()), height)
    nowhere = (F.lit(None).cast("string").alias("subroot"), F.lower(F.hex("top")).alias("root"), F.array().cast("array<string>").alias("lefts"), F.array().cast("array<string>").alias("rights"))
    over_ways = lowered(over, over[-1].select("tree", "block", *nowhere), height)
    # the ways of the upper tree's blocks, one round further down: from the root to that of each source
    tops = over[0].select("tree", "block", "nodes", "held").join(over_ways, ["tree", "block"]).mapInArrow(ways_down(height), WAYS)
    sources = seats.join(tops.select("root", "lefts", "rights", F.col("block").alias("rank")), "rank").select(F.col("of").alias("tree"), F.lower(F.hex("node")).alias("subroot"), "root", "lefts", "rights")
    ways = lowered(own, stored(own[-1].select("tree", "block").join(sources, "tree"), "ways-of-sources"), height)
    return own[0].join(ways, ["tree", "block"]).mapInArrow(proofs(height), PROOFS)


def op11_merkle_manifest(spark, sf_dir):
    return manifest(table(spark, sf_dir, "documents")).drop("nodes_copied")


def manifest_sql(levels: int = 6, upper_levels: int = 4) -> str:
    """The same rows level by level, for up to 16 ** levels rows of a source and 16 ** upper_levels sources."""
    fields = lambda text: " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in ("cast(doc_id as varchar)", "source", "lang", "cast(n_chars as varchar)", text))
    parts = [
        "crc as (select list(c order by i) as t from (select i, list_reduce(range(8), lambda c, x: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end, i) as c from range(256) r(i)))",
        "docs as (select doc_id, coalesce('s' || source, '') as tree, xor(4294967295, list_reduce(list_transform(string_split(cast(doc_id as varchar), ''), lambda d: cast(ascii(d) as bigint)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) % 5 = 0 as touched, "
        f"sha256({fields('text')}) as leaf, sha256({fields(f'translate(text, {UPPER!r}, {LOWER!r})')}) as other from documents, crc)",
        "placed as (select *, coalesce(touched, false) as changed, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by tree) as n from docs)",
        "a0 as (select tree, pos, n, leaf as h from placed)",
    ]

    def level(name: str, k: int, key: str) -> None:
        run = f"partition by {key}pos // 16 order by pos rows between"
        parts.append(f"{name}{k}s as (select *, coalesce(string_agg(h, '') over ({run} unbounded preceding and 1 preceding), '') as lft, coalesce(string_agg(h, '') over ({run} 1 following and unbounded following), '') as rgt from {name}{k})")
        parts.append(f"{name}{k + 1} as (select {key}pos // 16 as pos, (n + 15) // 16 as n, case when n > 1 then sha256(string_agg(h, '' order by pos)) else min(h) end as h from {name}{k} group by {key}pos // 16, n)")

    for k in range(levels):
        level("a", k, "tree, ")
    parts.append(f"u0 as (select tree, row_number() over (order by tree) - 1 as pos, count(*) over () as n, h from a{levels})")
    for k in range(upper_levels):
        level("u", k, "")
    parts.append("f0 as (select doc_id, tree, pos, leaf, case when changed then other else leaf end as f, '' as proof from placed)")
    sides = "r.*{but} replace (case when n.n > 1 then sha256(lft || f || rgt) else f end as f, case when n.n > 1 then proof || lft || rgt else proof end as proof)"
    for k in range(levels):
        parts.append(f"f{k + 1} as (select {sides.format(but='')} from f{k} r join a{k}s n on n.tree = r.tree and n.pos = r.pos // {16**k})")
    parts.append(f"g0 as (select r.* exclude (pos), u0.pos, u0.h as subroot from f{levels} r join u0 using (tree))")
    for k in range(upper_levels):
        parts.append(f"g{k + 1} as (select {sides.format(but='')} from g{k} r join u{k}s n on n.pos = r.pos // {16**k})")
    return f"with {', '.join(parts)} select doc_id, leaf, subroot, h as root, sha256(proof) as proof_sha256, f as folded_root, f = h as verified from g{upper_levels} r, u{upper_levels}"
