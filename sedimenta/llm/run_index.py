"""Substring deduplication by bytes: run-length index.

A string of ``length`` bytes is repeated if it starts at two places. Every such string holds an anchor, the
place where the hash of ``gram`` bytes is smallest in it, and equal strings hold equal anchors; so neighbouring strings
with one anchor travel together, as one context, to the bucket of that anchor's hash. Only contexts whose
anchor occurs twice travel. A bucket merges contexts that are equal byte by byte and builds a run-compressed
Burrows-Wheeler transform of what is left - of a context that several places hold, two copies - with samples at
the ends of its runs. Matching statistics are streamed from the samples: inside a run the common prefix with the
neighbouring suffix grows by one with each step to the left, so it is read off the text at the samples alone.
Positions whose statistic reaches ``length`` are marked; nothing else decides.

An anchor with more than ``group`` different contexts (borders of a passage that very many documents hold) is too
much for one index. There its strings travel one by one, as hashes of 128 bits in which all copies of a chunk are
merged, and the number of copies decides. Matches never cross documents.

The anchors of a chunk are found once, when it is written, and kept beside its texts.

Defined results: null text is empty; shorter texts lose nothing; overlapping occurrences in one document
count; equal rows are repeats of each other; everything is judged on the input; NUL bytes are bytes like any others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame

from .chunks import SENT, Chunk, ChunkTable, bucketed, look_up, mix, pack, received, send, spread, unpack
from .common import documents_of, stored, table

#: Starts in one context at most; only periodic text has more with one anchor.
RUN = 512
#: Bytes handled at a time where whole chunks would not stay in the cache.
BLOCK = 1 << 17
K1, K2, K3, POWER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), 0x5851F42D4C957F2D
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_text string, kept_sha256 string"
INDEXED = "bucket long, chunk long, anchors binary, keys binary, lengths binary, times binary, blob binary"


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, zero-padded, big-endian so that they compare as strings do."""
    held = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), ">u8", held, strides=(1,)).astype(np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number modulo 2^64, and of its inverse."""
    out = []
    for base in (POWER, pow(POWER, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        out.append(p)
    return out[0], out[1]


_POWERS = [powers(1)]


def gram_of(length: int) -> int:
    """Bytes of an anchor: the more, the fewer chance repeats; the fewer, the longer the contexts."""
    if length < 16:
        raise ValueError("strings of fewer than 16 bytes have no anchor")
    return max(g for g in (8, 16, 32, 64) if 2 * g <= length)


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the ``gram`` bytes from each position on (shorter by gram - 1), never 0."""
    out = np.empty(max(0, len(data) - gram + 1), np.uint64)
    for a in range(0, len(out), BLOCK):
        b = min(a + BLOCK, len(out))
        h, size = eights(data[a : b + gram - 1])[: b - a + gram - 8], 8
        while size < gram:
            x = h[:-size] * K1
            x += h[size:]
            h, size = x, 2 * size
        h = h ^ (h >> np.uint64(32))
        h *= K2
        h ^= h >> np.uint64(29)
        h |= np.uint64(1)
        out[a:b] = h
    return out


def sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over a[i : i + width] for each i (shorter by width - 1)."""
    n = max(0, len(a) - width + 1)
    out = np.empty(n, a.dtype)
    for at in range(0, n, BLOCK):
        x, size = a[at : min(at + BLOCK, n) + width - 1], 1
        while 2 * size <= width:
            x, size = pick(x[:-size], x[size:]), 2 * size
        rest = width - size
        out[at : at + BLOCK] = pick(x[:-rest], x[rest:]) if rest else x
    return out


def note_contexts(length: int):
    """What a chunk keeps of its contexts: first start, starts, anchor and content hash of each, and anchors that occur in several places."""

    def run(_: np.ndarray, texts: list[bytes]) -> bytes:
        data = np.frombuffer(b"".join(texts), np.uint8)
        ends, gram = np.cumsum([len(t) for t in texts]), gram_of(length)
        width = length - gram + 1
        if len(data) < length:
            return pack(np.zeros(2, "<i8"))
        h = gram_hashes(data, gram)
        least = sliding(h, width, np.minimum)  # one for each of the n - length + 1 starts
        for end in ends.tolist():
            least[max(0, end - length + 1) : end] = 0  # these would cross the end of a document
        pad = np.zeros(width - 1, np.uint64)
        held = sliding(np.concatenate([pad, least, pad]), width, np.maximum)
        unique, times = np.unique(h[h == held[: len(h)]], return_counts=True)
        starts = np.flatnonzero(least)
        value = least[starts]
        new = np.r_[True, (value[1:] != value[:-1]) | (starts[1:] != starts[:-1] + 1)][: len(starts)]
        at = np.flatnonzero(new)
        long = np.diff(np.r_[at, len(starts)])
        over = np.flatnonzero(long > RUN)
        if len(over):
            at = np.sort(np.concatenate([at, *(np.arange(at[k] + RUN, at[k] + long[k], RUN) for k in over)]))
            long = np.diff(np.r_[at, len(starts)])
        first = starts[at]
        if len(_POWERS[0][0]) < len(data) + 1:
            _POWERS[0] = powers(len(data) + len(data) // 4 + 1)
        up, down = _POWERS[0]
        sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=sums[1:])
        key = mix((sums[first + long - 1 + width] - sums[first]) * down[first] + long.astype(np.uint64))
        many = unique[times > 1]
        parts = (np.array([len(first), len(many)], "<i8"), first.astype("<i4"), long.astype("<i4"), value[at].astype("<u8"), key.astype("<u8"), many.astype("<u8"))
        return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in parts))

    return run


class Contexts:
    """Runs of string starts with one anchor in a chunk, as noted."""

    def __init__(self, chunk: Chunk, length: int) -> None:
        raw = zstandard.ZstdDecompressor().decompress(chunk.notes)
        n, m = np.frombuffer(raw[:16], "<i8").tolist()
        self.length, at = length, 16
        read = []
        for kind, size in (("<i4", n), ("<i4", n), ("<u8", n), ("<u8", n), ("<u8", m)):
            read.append(np.frombuffer(raw, kind, size, at))
            at += read[-1].nbytes
        self.first, self.count, self.anchor, self.key, many = read[0].astype(np.int64), read[1].astype(np.int64), *read[2:]
        self.data = np.frombuffer(chunk.data, np.uint8)
        self.unique = np.unique(self.anchor)
        self.many = np.isin(self.unique, many)

    def strings(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts in these runs and 128 bits of hash (fields a, b) of the string at each."""
        sizes, gram = self.count[runs] + self.length - 1, gram_of(self.length)
        h = gram_hashes(self.data[spread(self.first[runs], sizes)], gram)
        inner = spread(np.r_[0, np.cumsum(sizes)[:-1]], self.count[runs])
        up, down = powers(len(h) + 1)
        both = np.zeros(len(inner), [("a", "u8"), ("b", "u8")])
        for name, x in (("a", h), ("b", mix(h * K3))):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * up[: len(x)])])
            both[name] = mix((sums[inner + self.length - gram + 1] - sums[inner]) * down[inner])
        return spread(self.first[runs], self.count[runs]), both

    def different(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of these runs: one of each content, ordered by anchor; how often each occurs; which of them each run is.

        Contents are told apart by 128 bits, those of anchor and content."""
        order = np.lexsort((self.key[runs], self.anchor[runs]))
        a, k = self.anchor[runs][order], self.key[runs][order]
        new = np.r_[True, (a[1:] != a[:-1]) | (k[1:] != k[:-1])][: len(runs)]
        same = np.empty(len(runs), np.int64)
        same[order] = np.cumsum(new) - 1
        return runs[order[new]], np.diff(np.r_[np.flatnonzero(new), len(runs)]), same


def ask_anchors(length: int, buckets: int):
    def run(chunk: int, docs: Chunk, _: dict) -> Iterator[pd.DataFrame]:
        c = Contexts(docs, length)
        one, _, _ = c.different(np.arange(len(c.first)))
        different = np.zeros(len(c.unique), np.int64)
        np.add.at(different, np.searchsorted(c.unique, c.anchor[one]), 1)
        yield send(chunk, c.unique, buckets, lambda p: pack(np.minimum(different[p] * 2 + c.many[p], 65_535).astype("<u2")))

    return run


def decide_anchors(group: int):
    """0: the anchor occurs once; 1: again; 2: again, with too many different contexts for one bucket."""

    def run(hashes: list[np.ndarray], extras: list[bytes]) -> list[np.ndarray]:
        unique, place = np.unique(np.concatenate(hashes), return_inverse=True)
        told = np.concatenate([unpack(x, "<u2") for x in extras]).astype(np.int64)
        chunks = np.bincount(place, minlength=len(unique))
        different = np.bincount(place, told // 2, len(unique))
        many = np.bincount(place, told % 2, len(unique)) > 0
        code = np.where((chunks > 1) | many, np.where(different > group, 2, 1), 0)
        return [code[np.searchsorted(unique, h)] for h in hashes]

    return run


def coded(docs: Chunk, length: int, buckets: int, told: dict) -> tuple[Contexts, np.ndarray]:
    c = Contexts(docs, length)
    codes = received(c.unique, buckets, told.get(0, []))
    return c, look_up(c.unique, codes, c.anchor) if len(c.anchor) else np.zeros(0, np.uint8)


def by_bucket(c: Contexts, one: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order, present, begin = bucketed(c.anchor[one], buckets)
    return order, present, np.r_[begin, len(one)]


def send_contexts(length: int, buckets: int):
    def run(chunk: int, docs: Chunk, told: dict) -> Iterator[pd.DataFrame]:
        c, code = coded(docs, length, buckets, told)
        one, times, _ = c.different(np.flatnonzero(code == 1))
        order, present, begin = by_bucket(c, one, buckets)
        press, rows = zstandard.ZstdCompressor(level=1), []
        for k, bucket in enumerate(present.tolist()):
            own = order[begin[k] : begin[k + 1]]
            sizes = c.count[one[own]] + length - 1
            blob = c.data[spread(c.first[one[own]], sizes)]
            rows.append((bucket, chunk, c.anchor[one[own]].tobytes(), c.key[one[own]].tobytes(), sizes.astype("<i4").tobytes(), pack(np.minimum(times[own], 2).astype(np.uint8)), press.compress(blob.tobytes())))
        yield pd.DataFrame(rows, columns=["bucket", "chunk", "anchors", "keys", "lengths", "times", "blob"])

    return run


def send_strings(length: int, buckets: int):
    def run(chunk: int, docs: Chunk, told: dict) -> Iterator[pd.DataFrame]:
        c, code = coded(docs, length, buckets, told)
        runs = np.flatnonzero(code == 2)
        if len(runs):
            _, h = c.strings(runs)
            unique, times = np.unique(h, return_counts=True)
            yield send(chunk, unique["a"], buckets, lambda p: pack(np.r_[unique["b"][p], (times[p] > 1).astype(np.uint64)].astype("<u8")))

    return run


def decide_strings(hashes: list[np.ndarray], extras: list[bytes]) -> list[np.ndarray]:
    """1 for strings (by both their hashes) that several chunks hold, or one holds several times."""
    told = [unpack(x, "<u8").reshape(2, -1) for x in extras]
    both = np.zeros(sum(map(len, hashes)), [("a", "u8"), ("b", "u8")])
    both["a"], both["b"] = np.concatenate(hashes), np.concatenate([t[0] for t in told])
    _, same, times = np.unique(both, return_inverse=True, return_counts=True)
    many = (times > 1) | (np.bincount(same, np.concatenate([t[1] for t in told])) > 0)
    return np.split(many[same], np.cumsum([len(h) for h in hashes])[:-1])


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of some strings, suffixes in the order of their first ``depth`` bytes.

    Kept are the runs (``heads``, where each begins; ``lengths``; ``symbols``, 0: nothing stands before) and the
    samples at both ends of each: the text position before the suffix there, and the common prefix of the suffix at
    that position with its neighbours (``reach``). Suffix array and ranks are gone once it is built; ``statistics`` streams the samples to all positions.
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray, depth: int) -> None:
        self.n, self.depth = len(data), depth
        ends = np.cumsum(sizes)
        self.end = np.repeat(ends, sizes)
        self.eights = eights(data)
        order = self._suffixes(bool(data.all()))
        before = np.r_[np.int64(0), data[:-1].astype(np.int64) + 1]
        before[ends - sizes] = 0  # nothing stands before a string's first byte
        bwt = before[order]
        self.heads = np.flatnonzero(np.r_[True, (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)])
        self.lengths = np.diff(np.r_[self.heads, self.n])
        self.symbols = bwt[self.heads]
        sampled = np.zeros(self.n, bool)
        for x in (order[self.heads], order[self.heads + self.lengths - 1]):
            sampled[x[x > 0] - 1] = True
        sampled[ends - 1] = True
        self.samples = np.flatnonzero(sampled)
        rank = np.empty(self.n, np.int64)
        rank[order] = np.arange(self.n)
        row = rank[self.samples]
        self.reach = np.zeros(len(self.samples), np.int64)
        for step in (-1, 1):
            there = (row + step >= 0) & (row + step < self.n)
            near = order[np.clip(row + step, 0, self.n - 1)]
            self.reach = np.maximum(self.reach, np.where(there, self._common(self.samples, near), 0))
        del self.eights, self.last

    def _suffixes(self, no_nul: bool) -> np.ndarray:
        """Sorts suffixes by their first ``depth`` bytes, tripling the length compared; three ranks fit one key."""
        assert self.n < 2**21 - 1
        at = np.arange(self.n)
        left = self.end - at
        beyond = np.uint64(8) * np.clip(8 - left, 0, 7).astype(np.uint64)  # bits of bytes after the string's end
        key = self.eights >> beyond << beyond
        rank, size = self._ranks(key, None if no_nul else np.minimum(left, 8)), 8  # an end is less than a NUL byte
        while size < self.depth:
            if 3 * size <= self.depth:
                steps = (size, 2 * size)
            else:
                steps = ((self.depth - size) // 2, self.depth - size) if self.depth - size > size else (self.depth - size, self.depth - size)
            key = rank.astype(np.uint64) << np.uint64(42)
            for shift, step in zip((21, 0), steps, strict=True):
                key |= np.where(left > step, rank[np.minimum(at + step, self.n - 1)], 0).astype(np.uint64) << np.uint64(shift)
            size += steps[1]
            rank = self._ranks(key)
        return self.last

    def _ranks(self, key: np.ndarray, then: np.ndarray | None = None) -> np.ndarray:
        self.last = np.argsort(key, kind="stable") if then is None else np.lexsort((then, key))
        ordered = key[self.last]
        new = np.r_[True, ordered[1:] != ordered[:-1]]
        if then is not None:
            new[1:] |= then[self.last][1:] != then[self.last][:-1]
        rank = np.empty(self.n, np.int64)
        rank[self.last] = np.cumsum(new)
        return rank

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix, ``depth`` at most."""
        most = np.minimum(np.minimum(self.end[a] - a, self.end[b] - b), self.depth)
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        step = 0
        while len(live) and step < self.depth:
            x = self.eights[np.minimum(a[live] + step, self.n - 1)] ^ self.eights[np.minimum(b[live] + step, self.n - 1)]
            same = np.where(x == 0, 8, 0)
            odd = np.flatnonzero(x)
            if len(odd):
                v, lead = x[odd], np.zeros(len(odd), np.int64)
                for k in range(1, 8):
                    lead += v < (np.uint64(1) << np.uint64(64 - 8 * k))
                same[odd] = lead
            out[live] += same
            live = live[(same == 8) & (out[live] < most[live])]
            step += 8
        return np.minimum(out, most)

    def statistics(self) -> np.ndarray:
        """Of each position: how far (up to ``depth`` at the samples) what starts there also starts elsewhere, at least."""
        ends = self.samples + self.reach
        return np.repeat(ends, np.diff(np.r_[-1, self.samples])) - np.arange(self.n)


def content_numbers(anchors: np.ndarray, keys: np.ndarray, first: np.ndarray, size: np.ndarray, blob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One context of each content, ordered by anchor, and which of them each context is. Equal hashes are compared byte by byte."""
    keys = keys.copy()
    while True:
        order = np.lexsort((np.arange(len(keys)), keys, anchors))
        a, k = anchors[order], keys[order]
        new = np.r_[True, (a[1:] != a[:-1]) | (k[1:] != k[:-1])]
        same = np.empty(len(order), np.int64)
        same[order] = np.cumsum(new) - 1
        at = order[new]
        more = order[~new]
        other = size[more] != size[at[same[more]]]
        like = more[~other]
        if len(like):
            apart = blob[spread(first[like], size[like])] != blob[spread(first[at[same[like]]], size[like])]
            other[~other] = np.add.reduceat(apart, np.r_[0, np.cumsum(size[like])[:-1]]) > 0
        if not other.any():
            return at, same
        keys[more[other]] = mix(keys[more[other]] + np.uint64(1))  # unlike what its hash says: a content of its own


def settle(length: int, most: int):
    """Marks, for each context sent to a bucket, the starts that repeat."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        sizes = [np.frombuffer(x, "<i4").astype(np.int64) for x in rows["lengths"]]
        anchors = np.concatenate([np.frombuffer(x, "<u8") for x in rows["anchors"]])
        keys = np.concatenate([np.frombuffer(x, "<u8") for x in rows["keys"]])
        times = np.concatenate([unpack(x, "u1") for x in rows["times"]]).astype(np.int64)
        blob = np.frombuffer(b"".join(zstandard.ZstdDecompressor().decompress(x) for x in rows["blob"]), np.uint8)
        size = np.concatenate(sizes)
        first = np.r_[0, np.cumsum(size)[:-1]]
        at, same = content_numbers(anchors, keys, first, size, blob)
        copies = np.minimum(np.bincount(same, times, len(at)), 2).astype(np.int64)
        starts = size[at] - length + 1
        begin = np.r_[0, np.cumsum(starts)]
        marks = np.zeros(int(begin[-1]), bool)
        for part in pieces(anchors[at], size[at] * copies, most):
            twice = np.repeat(part, copies[part])
            index = RunLengthIndex(blob[spread(first[at[twice]], size[at[twice]])], size[at[twice]], length)
            reach = index.statistics()
            one = np.flatnonzero(np.r_[True, twice[1:] != twice[:-1]])
            inner = spread(np.r_[0, np.cumsum(size[at[twice]])[:-1]][one], starts[part])
            marks[spread(begin[part], starts[part])] = reach[inner] >= length
        out, k = [], 0
        for own in sizes:
            which = same[k : k + len(own)]
            out.append(pack(marks[spread(begin[which], starts[which])].astype(np.uint8)))
            k += len(own)
        return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "level": 1, "codes": out})

    return run


def pieces(anchors: np.ndarray, size: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Cuts contexts (ordered by anchor) between anchors into pieces of about ``most`` bytes."""
    group = np.cumsum(np.r_[True, anchors[1:] != anchors[:-1]]) - 1
    weight = np.cumsum(np.bincount(group, size))
    piece = ((weight - 1) // most).astype(np.int64)[group]
    yield from np.split(np.arange(len(anchors)), np.flatnonzero(np.diff(piece)) + 1)


def finish(length: int, buckets: int, with_text: bool):
    def run(_: int, docs: Chunk, told: dict) -> Iterator[pd.DataFrame]:
        c, code = coded(docs, length, buckets, told)
        edge = np.zeros(len(c.data) + 1, np.int64)
        runs = np.flatnonzero(code == 1)
        if len(runs):
            one, _, same = c.different(runs)
            order, present, _ = by_bucket(c, one, buckets)
            by = dict(told.get(1, []))
            flags = np.concatenate([unpack(by[b], "u1") for b in present.tolist()])
            counts = c.count[one]
            begin = np.empty(len(one), np.int64)  # where the flags of each content begin
            begin[order] = np.r_[0, np.cumsum(counts[order])[:-1]]
            at = spread(c.first[runs], c.count[runs])
            at = at[flags[spread(begin[same], c.count[runs])] > 0]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
        runs = np.flatnonzero(code == 2)
        if len(runs):
            at, h = c.strings(runs)
            unique, same = np.unique(h, return_inverse=True)
            at = at[received(unique["a"], buckets, told.get(2, []))[same] > 0]
            np.add.at(edge, at, 1)
            np.add.at(edge, at + length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        head = gone & ~np.r_[False, gone[:-1]] if len(gone) else gone
        rows = []
        for a, b in zip(docs.starts.tolist(), docs.ends.tolist(), strict=True):
            own = gone[a:b]
            removed = int(np.count_nonzero(own))
            kept = docs.data[a:b] if not removed else c.data[a:b][~own].tobytes()
            spans = int(np.count_nonzero(head[a:b])) + int(removed > 0 and own[0] and not head[a])
            rows.append((b - a, removed, spans, kept.decode("utf-8", "replace") if with_text else None, hashlib.sha256(kept).hexdigest()))
        out = pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_text", "kept_sha256"])
        out.insert(0, "doc_id", docs.doc_ids())
        yield out

    return run


def remove_repeated_strings(docs: DataFrame, length: int = 200, group: int = 1000, index_bytes: int = 500_000, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_text, kept_sha256: texts less each byte covered by a string of
    ``length`` bytes that starts anywhere else too.

    ``group``: an anchor with more different contexts is settled string by string, by 128-bit hashes; ``index_bytes``: one
    index holds about so many bytes. Both bound memory. Cut characters show as U+FFFD in ``kept_text``.
    """
    if index_bytes + 2 * group * (RUN + length) >= 2**21:
        raise ValueError("group * (512 + length) and index_bytes are more than one index can hold")
    with ChunkTable(documents_of(docs), note=note_contexts(length)) as chunks:
        buckets = chunks.buckets
        answers = chunks.decide(chunks.each(ask_anchors(length, buckets), SENT, texts=False), 0, decide_anchors(group))
        sent = chunks.each(send_contexts(length, buckets), INDEXED, answers)
        indexed = stored(sent.groupBy("bucket").applyInPandas(lambda r: settle(length, index_bytes)(r), "chunk long, bucket long, level int, codes binary"), "answers1")
        single = chunks.decide(chunks.each(send_strings(length, buckets), SENT, answers), 2, decide_strings)
        return stored(chunks.each(finish(length, buckets, with_text), RESULT, answers.unionByName(indexed).unionByName(single)), "strings")


def op1_run_length_index(spark, sf_dir):
    found = remove_repeated_strings(table(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
