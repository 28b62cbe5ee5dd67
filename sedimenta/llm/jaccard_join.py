"""N-gram Jaccard join: set-relation skipping.

Each text is the set of its distinct k-word shingles. Two texts link when the shared part of their union
reaches the threshold. Equal sets are one node. Nodes meet in the index lists of their prefix shingles: those
of a set's rarest-first order that two similar sets cannot both miss. Shingles in more than ``hot`` sets'
windows come last in that order (then by hash), so that lists of common phrases are hardly ever read. Sets whose
windows hold too many such shingles (large groups of near copies) meet each other in lists of their own, by an order
that counts all their shingles; in the lists of windows they meet only the other sets.

Index-level skipping: in a list, the set with the fewest shingles of its own before this place (the lowest
position) is the hub; sets whose size or position rules the threshold out are skipped without being compared.
Answer-level skipping: every set is compared with the hub it shares most lists with, then with those hubs of its
lists that are in other components, and takes over a hub's answers if they link - the links inside one component need no further comparison. Only pairs of sets that share a list, are not
ruled out by size and position, and are in different components after that are compared one by one.

Before two sets are compared, the counts of their shingles by leading bits of the hash (``shape``) are: the sum of the smaller
counts is the most they can share, so that pairs below the threshold never bring their texts together.
Comparison is exact on whole texts. No list, group or candidate is capped.

Defined results: null or empty text has an empty set, is linked with nothing and is its own component;
a text with fewer words than a shingle is one shingle of all its words; rows with equal sets share a
component; a component is called by the smallest doc_id in it (null ids are larger than any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import mix
from .common import documents_of, stored, table, text_bytes
from .doubling import STEP, WordNumbers

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SETS = "sid long, n long, sig1 long, sig2 long, tokens binary, shape binary, packed binary"
#: Pairs (16 bytes each) that are sent to all tasks to fetch their texts; more are joined by shuffle.
SHARED_PAIRS = 1_000_000
#: Members of an index list up to which its remaining pairs come from a join.
SHORT = 16
#: Sets up to which a shingle of the unsettled sets counts as rare; above, they are ordered by that number.
RARE = 8
#: Documents described at a time.
SLICE = 500


def shingle_sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each text, one text after another, and how many each has."""
    numbers, ids, counts = WordNumbers(), [], []
    for text in texts:
        own = text.translate(LOWER).split()
        counts.append(len(own))
        ids.append(np.fromiter(map(numbers.__getitem__, own), np.int32, len(own)))
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))[np.concatenate(ids)] if ids else np.zeros(0, np.uint64)
    count = np.array(counts, np.int64)
    size = np.minimum(k, count)  # a text of fewer words is one shingle
    out = words[: max(0, len(words) - k + 1)].copy()
    for j in range(1, k):
        out *= STEP
        out += words[j : j + len(out)]
    out = mix(out + np.uint64(k))
    ends = np.cumsum(count)
    parts = []
    for a, b, n in zip((ends - count).tolist(), ends.tolist(), size.tolist(), strict=True):
        if n == k:
            own = np.sort(out[a : b - k + 1])
            parts.append(own[np.r_[True, own[1:] != own[:-1]]])
        else:
            own = words[a:b]
            h = np.zeros(1 if n else 0, np.uint64)
            for x in own:
                h = h * STEP + x
            parts.append(mix(h + np.uint64(n)))
    return np.concatenate(parts) if parts else out, np.array([len(x) for x in parts], np.int64)


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles of a text."""
    return shingle_sets([text], k)[0]


def shapes(tokens: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """Of each set: how many of its hashes have the same leading bits, one byte for each value of so many bits that it has
    half as many values as the set has hashes (more where a byte would not hold a number)."""
    bits = np.ceil(np.log2(np.maximum(counts, 32) / 2)).astype(np.int64)
    while True:
        begin = np.r_[0, np.cumsum(1 << bits)]
        place = np.repeat(begin[:-1], counts) + (tokens >> np.repeat(64 - bits, counts).astype(np.uint64)).astype(np.int64)
        held = np.bincount(place, minlength=int(begin[-1]))
        full = np.maximum.reduceat(held, begin[:-1]) > 255 if len(counts) else np.zeros(0, bool)
        if not full.any():
            held = held.astype(np.uint8)
            return [held[a:b].tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True)]
        bits[full] += 1


def shared_at_most(x: bytes, y: bytes) -> int:
    """The most that two sets of these shapes can share."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) != len(b):
        n = min(len(a), len(b))
        a, b = a.reshape(n, -1).sum(1), b.reshape(n, -1).sum(1)
    return int(np.minimum(a, b).sum())


def overlap_needed(a, b, num: int, den: int):
    """Smallest shared size of sets of sizes a and b that reaches num / den of their union."""
    return -(-(num * (a + b)) // (num + den))


def prefix_length(n, num: int, den: int):
    return n - -(-(num * n) // den) + 1


def window_length(n, num: int, den: int):
    p = prefix_length(n, num, den)
    return np.minimum(n, p + p // 2 + 16)


def describe(k: int, num: int, den: int):
    """SETS of a batch, with the columns it came with but for the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sid, press = TaskContext.get().partitionId() << 33, zstandard.ZstdCompressor(level=1)
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, batch.num_rows, SLICE):
                own = [x or b"" for x in texts.slice(at, SLICE).to_pylist()]
                token, n = shingle_sets(own, k)
                begin = np.cumsum(n) - n
                sig = []
                for salt in (0, 0xA5A5A5A55A5A5A5A):
                    sums = np.r_[np.zeros(1, np.uint64), np.cumsum(mix(token ^ np.uint64(salt)))]
                    sig.append((sums[begin + n] - sums[begin]).view(np.int64))
                w = window_length(n, num, den)
                windows = [token[a:b].tobytes() for a, b in zip(begin.tolist(), (begin + w).tolist(), strict=True)]
                packed = [press.compress(t) if m else None for t, m in zip(own, n.tolist(), strict=True)]
                rest = [(c, batch.column(c).slice(at, SLICE)) for c in batch.schema.names if c != "text"]
                made = zip(("sid", "n", "sig1", "sig2", "tokens", "shape", "packed"), (pa.array(np.arange(sid, sid + len(own))), pa.array(n), *map(pa.array, sig), pa.array(windows, pa.binary()), pa.array(shapes(token, n), pa.binary()), pa.array(packed, pa.binary())), strict=True)
                sid += len(own)
                columns = [*made, *rest]
                yield pa.RecordBatch.from_arrays([c for _, c in columns], names=[c for c, _ in columns])

    return run


def send_windows(buckets: int):
    """Packs (token, set, size, position) of all windows of a batch by bucket."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.iloc[at : at + 2000]
                counts = np.array([len(t) // 8 for t in part["tokens"]])
                token = np.frombuffer(b"".join(part["tokens"]), "<u8")
                sid, size = np.repeat(part["sid"].to_numpy(), counts), np.repeat(part["n"].to_numpy(), counts)
                pos = np.arange(len(token)) - np.repeat(np.cumsum(counts) - counts, counts)
                to = (mix(token) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((token, to))
                token, sid, size, pos, to = token[order], sid[order], size[order], pos[order], to[order]
                present, begin = np.unique(to, return_index=True)
                ends = np.r_[begin[1:], len(to)]
                press = zstandard.ZstdCompressor(level=1)
                yield pd.DataFrame({
                    "bucket": present,
                    "tokens": [token[a:b].tobytes() for a, b in zip(begin, ends, strict=True)],
                    "rest": [press.compress(np.concatenate([sid[a:b].astype("<i8").view("u1").reshape(-1, 8).T.ravel(), size[a:b].astype("<i4").view("u1").reshape(-1, 4).T.ravel(), pos[a:b].astype("<i4").view("u1").reshape(-1, 4).T.ravel()]).tobytes()) for a, b in zip(begin, ends, strict=True)],
                })

    return run


def shared_tokens(hot: int):
    """Of a bucket: the rows of tokens that several sets' windows hold, and whether more than ``hot`` do."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        token = np.concatenate([np.frombuffer(t, "<u8") for t in rows["tokens"]])
        sid, size, pos = [], [], []
        for t, x in zip(rows["tokens"], rows["rest"], strict=True):
            n, raw = len(t) // 8, np.frombuffer(zstandard.ZstdDecompressor().decompress(x), "u1")
            sid.append(np.ascontiguousarray(raw[: 8 * n].reshape(8, n).T).view("<i8").ravel())
            size.append(np.ascontiguousarray(raw[8 * n : 12 * n].reshape(4, n).T).view("<i4").ravel())
            pos.append(np.ascontiguousarray(raw[12 * n :].reshape(4, n).T).view("<i4").ravel())
        _, place, times = np.unique(token, return_inverse=True, return_counts=True)
        times = times[place]
        keep = times > 1
        return pd.DataFrame({"token": token[keep].view(np.int64), "sid": np.concatenate(sid)[keep], "n": np.concatenate(size)[keep].astype(np.int64), "pos": np.concatenate(pos)[keep], "is_hot": times[keep] > hot})

    return run


def prefix_size(num: int, den: int) -> Column:
    return F.expr(f"n - ({num} * n + {den - 1}) div {den} + 1")


def final_prefix(shared: DataFrame, num: int, den: int) -> DataFrame:
    """Places of a set's shared window tokens in the final order (hot last), cut to its prefix; ``settled`` is false
    where the window does not settle the prefix, since too many of its tokens are hot."""
    own = Window.partitionBy("sid")
    hot = F.col("is_hot").cast("long")
    rows = shared.select(
        "token", "sid", "n", "pos", "is_hot", F.coalesce(F.sum(hot).over(own.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum(hot).over(own).alias("hots"), prefix_size(num, den).alias("p")
    )
    rows = rows.withColumn("w", F.least("n", F.expr("p + p div 2 + 16"))).withColumn("cold", F.col("w") - F.col("hots"))
    rows = rows.withColumn("place", F.when(F.col("is_hot"), F.col("cold") + F.col("before")).otherwise(F.col("pos") - F.col("before")))
    return rows.withColumn("settled", (F.col("cold") >= F.col("p")) | (F.col("w") == F.col("n"))).where(~F.col("settled") | (F.col("place") < F.col("p"))).select("token", "sid", "n", "place", "settled")


def all_tokens(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for sid, packed in zip(batch["sid"], batch["packed"], strict=True):
                own = shingles(zstandard.ZstdDecompressor().decompress(packed), k)
                yield pd.DataFrame({"token": own.view(np.int64), "sid": sid, "n": len(own), "pos": np.arange(len(own))})

    return run


def whole_prefix(tokens: DataFrame, num: int, den: int, *order: str) -> DataFrame:
    """As ``final_prefix``, from all tokens of a set in the given order."""
    rows = tokens.withColumn("place", F.row_number().over(Window.partitionBy("sid").orderBy(*order, "pos")) - 1)
    return rows.where(F.col("place") < prefix_size(num, den)).select("token", "sid", "n", F.col("place").cast("long").alias("place"))


def index_lists(kept: DataFrame, more: DataFrame, hot_tokens: DataFrame, num: int, den: int) -> DataFrame:
    """list, token, sid, n, place, guest: the index lists. List 0 has all sets in the order of windows; there the unsettled
    ones (``more``: all their tokens) are guests, whose pairs with each other come from list 1, which has them alone."""
    more = stored(more, "tokens")
    common = more.groupBy("token").agg(F.count("*").alias("sets")).where(F.col("sets") > RARE)
    counted = more.join(common, "token", "left").withColumn("sets", F.coalesce("sets", F.lit(0)))
    apart = whole_prefix(counted, num, den, "sets").select(F.lit(1).alias("list"), "*", F.lit(False).alias("guest"))
    settled = kept.where("settled").drop("settled")
    asked = settled.select("token").distinct()
    guests = whole_prefix(more.join(hot_tokens, "token", "left").withColumn("is_hot", F.coalesce("is_hot", F.lit(False))), num, den, "is_hot").join(asked, "token", "left_semi")
    return settled.select(F.lit(0).alias("list"), "*", F.lit(False).alias("guest")).unionByName(guests.select(F.lit(0).alias("list"), "*", F.lit(True).alias("guest"))).unionByName(apart)


def compare(k: int):
    """Shared sizes of pairs of packed texts; the last left-hand set is kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened = zstandard.ZstdDecompressor()
        last, held = None, None
        for batch in batches:
            shared = []
            for r in batch.itertuples(index=False):
                if r.a != last:
                    last, held = r.a, shingles(opened.decompress(r.packed_a), k)
                own = shingles(opened.decompress(r.packed_b), k)
                at = np.searchsorted(held, own)
                shared.append(int(np.count_nonzero(held[np.minimum(at, len(held) - 1)] == own)))
            yield batch[["a", "b", "n_a", "n_b"]].assign(shared=shared)

    return run


def possible(pairs: DataFrame, sets: DataFrame, num: int, den: int, label: str) -> DataFrame:
    """Of pairs (a, b, others): those whose shapes let them reach the threshold; written."""
    one = sets.select(F.col("sid").alias("a"), F.col("n").alias("n_a"), F.col("shape").alias("shape_a"))
    two = sets.select(F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("shape").alias("shape_b"))
    names = pairs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            most = np.fromiter(map(shared_at_most, batch["shape_a"], batch["shape_b"]), np.int64, len(batch))
            yield batch.loc[most >= overlap_needed(batch["n_a"].to_numpy(), batch["n_b"].to_numpy(), num, den), names]

    return stored(pairs.join(two, "b").join(one, "a").mapInPandas(run, pairs.schema), label)


def links(pairs: DataFrame, sets: DataFrame, k: int, num: int, den: int, label: str) -> DataFrame:
    """Of pairs (a, b): those whose sets reach the threshold. Texts meet by pair, so that a set with many partners is many keys."""
    pairs = stored(pairs.select("a", "b"), "asked")
    asked = F.broadcast(pairs) if pairs.count() <= SHARED_PAIRS else pairs
    one = sets.select(F.col("sid").alias("a"), F.col("n").alias("n_a"), F.col("packed").alias("packed_a")).join(asked, "a")
    two = sets.select(F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("packed").alias("packed_b")).join(asked, "b")
    found = one.join(two, ["a", "b"]).select("a", "b", "n_a", "n_b", "packed_a", "packed_b").mapInPandas(compare(k), "a long, b long, n_a long, n_b long, shared long")
    return stored(found.where(F.col("shared") * (num + den) >= num * (F.col("n_a") + F.col("n_b"))).select("a", "b"), label)


def connected(edges: DataFrame) -> DataFrame:
    """node, component (smallest node reachable), by alternating large and small stars until nothing changes; each round is written."""
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.unionByName(both.where("v < u").join(least, "u").select("u", F.col("m").alias("v"))).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small_least.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    return edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")


def unlike(pairs: DataFrame, components: DataFrame) -> DataFrame:
    """Pairs (a, b) that are not in one component."""
    for side in ("a", "b"):
        pairs = pairs.join(components.select(F.col("node").alias(side), F.col("component").alias(f"c_{side}")), side, "left")
    return pairs.where(F.coalesce("c_a", "a") != F.coalesce("c_b", "b")).select("a", "b")


def remaining_pairs(num: int, den: int, block: int = 1000):
    """Pairs of each index list in different components that size and position do not rule out; takes a bucket of lists."""

    def of_list(n, p, c, s, guest, out: list) -> None:
        end = np.searchsorted(n, n * den // num, side="right")  # sizes that can still reach the threshold
        for a in range(0, len(n), block):
            rows_a = slice(a, min(a + block, len(n)))
            for b in range(a, int(end[rows_a].max()), block):
                rows_b = slice(b, min(b + block, len(n)))
                if c[rows_a].min() == c[rows_a].max() == c[rows_b].min() == c[rows_b].max():
                    continue  # the block's answers are known
                need = overlap_needed(n[rows_a, None], n[None, rows_b], num, den)
                can = np.minimum((n - p)[rows_a, None], (n - p)[None, rows_b]) >= need
                can &= (c[rows_a, None] != c[None, rows_b]) & (np.arange(rows_a.start, rows_a.stop)[:, None] < np.arange(rows_b.start, rows_b.stop)[None, :])
                can &= ~(guest[rows_a, None] & guest[None, rows_b])
                i, j = np.nonzero(can)
                out.append(np.stack([np.minimum(s[a + i], s[b + j]), np.maximum(s[a + i], s[b + j])]))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["list", "token", "n", "sid"])
        which, token = rows["list"].to_numpy(), rows["token"].to_numpy()
        columns = [rows[x].to_numpy() for x in ("n", "place", "component", "sid", "guest")]
        begin = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (which[1:] != which[:-1])])
        pairs = np.zeros((2, 0), np.int64)
        out: list[np.ndarray] = []
        for x, y in zip(begin, np.r_[begin[1:], len(token)], strict=True):
            of_list(*(v[x:y] for v in columns), out)
            if len(out) >= 500:  # a pair of sets often shares many lists
                pairs, out = np.unique(np.concatenate([pairs, *out], axis=1), axis=1), []
        pairs = np.unique(np.concatenate([pairs, *out], axis=1), axis=1)
        return pd.DataFrame({"a": pairs[0], "b": pairs[1]})

    return run


def short_pairs(left: DataFrame, num: int, den: int) -> DataFrame:
    """``remaining_pairs`` of short lists, as a join."""
    a = left.select("list", "token", F.col("sid").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("p_a"), F.col("component").alias("c_a"), F.col("guest").alias("g_a"))
    b = left.select("list", "token", F.col("sid").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("p_b"), F.col("component").alias("c_b"), F.col("guest").alias("g_b"))
    able = (F.least(F.col("n_a") - F.col("p_a"), F.col("n_b") - F.col("p_b")) * (num + den) >= num * (F.col("n_a") + F.col("n_b"))) & (den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b"))
    return a.join(b, ["list", "token"]).where((F.col("a") < F.col("b")) & (F.col("c_a") != F.col("c_b")) & ~(F.col("g_a") & F.col("g_b")) & able).select("a", "b")


def content_key() -> Column:
    """128 bits of a hash of the text."""
    return F.substring(F.unhex(F.sha2(F.col("text").cast("binary"), 256)), 1, 16)


def members(docs: DataFrame, k: int, num: int, den: int, hot: int = 32, content: bool = False) -> DataFrame:
    """doc_id, n, component (a number) of every row, with its ``content_key`` if wanted."""
    size = text_bytes(docs)
    buckets = max(8, size // 8_000_000)
    own = {"content": content_key()} if content else {}
    rows = documents_of(docs).withColumns({**own, "text": F.col("text").cast("binary")})
    sets = stored(rows.mapInArrow(describe(k, num, den), SETS + ", doc_id long" + ", content binary" * content), "sets")
    full = sets.where("n > 0")
    heads = stored(full.groupBy("n", "sig1", "sig2").agg(F.min("sid").alias("node"), F.count("*").alias("copies")), "heads")
    windows = sets.select("sid", "n", "tokens").join(heads.select(F.col("node").alias("sid")), "sid", "left_semi")
    sent = windows.mapInPandas(send_windows(buckets), "bucket long, tokens binary, rest binary")
    shared = stored(sent.groupBy("bucket").applyInPandas(lambda r: shared_tokens(hot)(r), "token long, sid long, n long, pos int, is_hot boolean"), "shared")
    kept = stored(final_prefix(shared, num, den), "prefixes")
    unsettled = kept.where("not settled").select("sid").distinct()
    hot_tokens = shared.where("is_hot").select("token").distinct().withColumn("is_hot", F.lit(True))
    more = sets.select("sid", "packed").join(unsettled, "sid", "left_semi").mapInPandas(all_tokens(k), "token long, sid long, n long, pos int")
    prefixes = stored(index_lists(kept, more, hot_tokens, num, den), "lists")
    # every set against the hub of each of its lists; where a settled set is in a list, it is the hub
    hubs = prefixes.groupBy("list", "token").agg(F.min(F.struct("guest", "place", "sid", "n")).alias("hub"), F.count("*").alias("members")).where("members > 1")
    able = (den * F.least("n", "hub.n") >= num * F.greatest("n", "hub.n")) & (F.least(F.col("n") - F.col("place"), F.col("hub.n") - F.col("hub.place")) * (num + den) >= num * (F.col("n") + F.col("hub.n")))
    pairs = prefixes.join(hubs, ["list", "token"]).where((F.col("sid") != F.col("hub.sid")) & able).groupBy(F.col("hub.sid").alias("a"), F.col("sid").alias("b")).agg(F.count("*").alias("times"))
    pairs = possible(pairs, sets, num, den, "hubs")
    # first with the hub met in most lists; then only with hubs whose answers that has not brought
    best = pairs.groupBy("b").agg(F.max(F.struct("times", (-F.col("a")).alias("less"))).alias("best")).select((-F.col("best.less")).alias("a"), "b")
    found = links(best, sets, k, num, den, "links")
    first = stored(connected(found), "components")
    other = unlike(pairs.join(best, ["a", "b"], "left_anti"), first)
    found = stored(found.unionByName(links(other, sets, k, num, den, "links")), "links")
    first = stored(connected(found), "components")
    # what is left between components
    named = prefixes.join(first.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))
    mixed = named.groupBy("list", "token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("members")).where("lo <> hi").select("list", "token", "members")
    left = stored(named.join(mixed, ["list", "token"]), "mixed")
    long = left.where(F.col("members") > SHORT).groupBy(F.pmod(F.xxhash64("list", "token"), F.lit(max(32, size // 2_000_000)))).applyInPandas(lambda r: remaining_pairs(num, den)(r), "a long, b long")
    rest = possible(short_pairs(left.where(F.col("members") <= SHORT), num, den).unionByName(long).distinct(), sets, num, den, "rest")
    again = links(rest, sets, k, num, den, "links")
    everything = stored(connected(found.unionByName(again)), "components") if not again.isEmpty() else first
    nodes = full.join(heads, ["n", "sig1", "sig2"]).select("sid", "node")
    of = nodes.join(everything, "node", "left").select("sid", F.coalesce("component", "node").alias("component"))
    return sets.select("sid", "doc_id", "n", *own).join(of, "sid", "left").withColumn("component", F.coalesce("component", "sid")).drop("sid")


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, hot: int = 32) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: components of the links between texts whose k-word shingle
    sets share at least num / den of their union."""
    member = members(docs, k, num, den, hot)
    names = member.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return member.join(names, "component").select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row of ``docs``, unchanged, of each component: that with the smallest doc_id (null ids last), then content key.

    Rows are told apart by doc_id and text, not by doc_id alone; of rows equal in both, the first by the other
    columns stays. Rows without a word are components of their own and all stay.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "content")).alias("least")
    first = members(docs, k, num, den, content=True).where("n > 0").groupBy("component").agg(least)
    first = stored(first.select(F.col("least.doc_id").alias("first_id"), F.col("least.content").alias("first_content")), "firsts")
    worded = F.coalesce(F.col("text").rlike("[^ \\t-\\r]"), F.lit(False))
    met = docs.where(worded).select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), content_key().alias("content"))
    met = met.join(first, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("content") == F.col("first_content")), "left_semi")
    others = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    one = met.groupBy("id", "content").agg(F.min_by("row", F.to_json(F.struct(*others)) if others else F.lit("")).alias("row"))
    return one.select("row.*").unionByName(docs.where(~worded))


def op4_jaccard_join(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))

