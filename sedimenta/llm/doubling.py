"""Substring deduplication by words: level-wise doubling.

A window of ``min_words`` words can repeat only if each part of it repeats. So the operator begins with
short word sequences (a quarter of the length), one chosen in every window by its hash (the smallest), and
asks which of them other documents hold too. Those repeated at one length alone are extended to twice that
length, and the survivors to the next, until ``min_words`` is reached; then windows are compared whole. With
``max_words`` beyond ``min_words`` the doubling goes on until no candidate survives, for the length of the
longest repeated passages.

Every answer comes from all documents (see ``chunks``); nothing is capped or sampled. Words are cut, hashed and their
anchors found once, when a chunk is written; later passes read those notes, and texts only where words go. Short
sequences are compared by 64 bits, since they only choose candidates; whole windows by 128 (two polynomials of 64-bit word hashes).

Defined results: null text has no words; a document with fewer words than a window loses nothing; rows with
the same doc_id don't remove words from each other; a null doc_id counts as larger than any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame

from .chunks import SENT, Chunk, ChunkTable, look_up, mix, pack, received, send, spread, unpack
from .common import documents_of, stored, table

STEP, OTHER_STEP = np.uint64(0x9FB21C651E98DF25), np.uint64(0xC2B2AE3D27D4EB4F)
BOTH = [("a", "u8"), ("b", "u8")]
RESULT = "doc_id long, n_words long, n_removed long, n_spans long, longest long, kept_text string, kept_sha256 string"


class WordNumbers(dict):
    """Numbers words by the order in which they come."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def gram_hashes(words: np.ndarray, k: int, step: np.uint64 = STEP) -> np.ndarray:
    """Hash of the k words from each position on (shorter by k - 1)."""
    m = max(0, len(words) - k + 1)
    out = words[:m].copy()
    for j in range(1, k):
        out *= step
        out += words[j : j + m]
    return mix(out + np.uint64(k))


def quarter_of(length: int) -> int:
    return max(1, -(-length // 4))


def note_words(length: int):
    """What a chunk keeps of its words: how many each document has, the hash of those kept if none goes, distinct words' hashes,
    the number of each word, and runs of windows with one anchor (windows between runs, windows, where the anchor is in the first)."""

    def run(_: np.ndarray, texts: list[bytes]) -> bytes:
        numbers, counts, digests, ids = WordNumbers(), [], [], []
        for text in texts:
            own = text.split()
            counts.append(len(own))
            digests.append(hashlib.sha256(b" ".join(own)).digest())
            ids.append(np.fromiter(map(numbers.__getitem__, own), np.int32, len(own)))
        ids = np.concatenate(ids)
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
        quarter = quarter_of(length)
        span, m = length - quarter + 1, max(0, len(ids) - length + 1)
        first = size = place = np.zeros(0, np.int64)
        if m:
            g = gram_hashes(hashes[ids], quarter)
            low, at = g[:m].copy(), np.zeros(m, np.int32)
            for j in range(1, span):
                less = g[j : j + m] < low
                np.copyto(low, g[j : j + m], where=less)
                np.copyto(at, j, where=less)
            at += np.arange(m, dtype=np.int32)
            inside = np.ones(m, bool)
            for end in np.cumsum(counts).tolist():
                inside[max(0, end - length + 1) : end] = False  # these would cross the end of a document
            starts = np.flatnonzero(inside)
            if len(starts):
                new = np.flatnonzero(np.r_[True, (at[starts[1:]] != at[starts[:-1]]) | (starts[1:] != starts[:-1] + 1)])
                first, size = starts[new], np.diff(np.r_[new, len(starts)])
                place = at[first] - first
        gap = first - np.r_[0, first[:-1] + size[:-1]][: len(first)]
        parts = (np.array([len(texts), len(ids), len(hashes), len(first)], "<i8"), np.array(counts, "<i4"), np.frombuffer(b"".join(digests), "u1"), hashes, ids.astype("<i4"), gap.astype("<i4"), size.astype("<i2"), place.astype("<i2"))
        return zstandard.ZstdCompressor(level=1).compress(b"".join(x.tobytes() for x in parts))

    return run


class ChunkWords:
    """Word hashes of a chunk's documents one after another, as noted."""

    def __init__(self, chunk: Chunk) -> None:
        raw, at, read = zstandard.ZstdDecompressor().decompress(chunk.notes), 32, []
        docs, self.n, vocabulary, runs = np.frombuffer(raw[:32], "<i8").tolist()
        for kind, size in (("<i4", docs), ("u1", 32 * docs), ("<u8", vocabulary), ("<i4", self.n), ("<i4", runs), ("<i2", runs), ("<i2", runs)):
            read.append(np.frombuffer(raw, kind, size, at))
            at += read[-1].nbytes
        counts, self.digests, hashes, ids, gap, size, place = read
        self.counts, self.size = counts.astype(np.int64), size.astype(np.int64)
        self.first = np.cumsum(gap + np.r_[0, self.size[:-1]][:runs])
        self.place = self.first + place
        self.hash = hashes[ids]
        self.ends = np.cumsum(self.counts)
        self.doc = np.repeat(np.arange(docs), self.counts)
        self.id = chunk.ids[self.doc]

    def grams(self, k: int) -> np.ndarray:
        """64 bits of the k words from each position on."""
        return gram_hashes(self.hash, k)

    def windows(self, k: int, at: np.ndarray) -> np.ndarray:
        """128 bits (fields a, b) of the k words from these positions on."""
        out = np.zeros(len(at), BOTH)
        if len(at):
            out["a"], out["b"] = (gram_hashes(self.hash, k, step)[at] for step in (STEP, OTHER_STEP))
        return out

    def starts(self, k: int) -> np.ndarray:
        """Positions where k words follow in the same document."""
        if self.n < k:
            return np.zeros(0, np.int64)
        at = np.arange(self.n - k + 1)
        return at[at + k <= self.ends[self.doc[: self.n - k + 1]]]


def repeated_in(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes, and whether documents with different ids hold them."""
    order = np.lexsort((ids, hashes))
    h, d = hashes[order], ids[order]
    first = np.r_[True, h[1:] != h[:-1]] if len(h) else np.zeros(0, bool)
    at = np.flatnonzero(first)
    return h[at], (np.minimum.reduceat(d, at) != np.maximum.reduceat(d, at)) if len(at) else np.zeros(0, bool)


class Levels:
    """Candidates of a chunk at each length, given the answers for the shorter ones."""

    def __init__(self, words: ChunkWords, length: int, buckets: int, told: dict) -> None:
        self.w, self.length, self.buckets, self.told = words, length, buckets, told
        self.quarter = quarter_of(length)
        self.anchor = words.grams(self.quarter)[words.place] if len(words.place) else np.zeros(0, np.uint64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct anchors, and whether documents with different ids hold them."""
        return repeated_in(self.w.id[self.w.first], self.anchor)

    def halves(self) -> tuple[np.ndarray, np.ndarray]:
        """Windows whose anchor repeats, and the hash of twice its length around it, to its right where that stays in the window, else to its left."""
        unique = np.unique(self.anchor)
        keep = np.flatnonzero(look_up(unique, received(unique, self.buckets, self.told.get(0, [])), self.anchor) > 0)
        at = spread(self.w.first[keep], self.w.size[keep])
        if not len(at):
            return at, np.zeros(0, np.uint64)
        place = np.repeat(self.w.place[keep], self.w.size[keep])
        right = place - at <= self.length - 2 * self.quarter
        return at, self.w.grams(2 * self.quarter)[place - np.where(right, 0, self.quarter)]

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """Windows whose doubled anchor repeats too, and their hashes."""
        at, half = self.halves()
        unique = np.unique(half)
        at = at[look_up(unique, received(unique, self.buckets, self.told.get(1, [])), half) > 0]
        return at, self.w.windows(self.length, at)


def first_holders(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes (of fields a, b), the smallest id of each, and which of them each hash is."""
    order = np.lexsort((ids, hashes["b"], hashes["a"]))
    a, b = hashes["a"][order], hashes["b"][order]
    new = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])][: len(order)]
    same = np.empty(len(order), np.int64)
    same[order] = np.cumsum(new) - 1
    return hashes[order][new], ids[order][new], same


def decide_repeated(hashes: list[np.ndarray], extras: list[bytes]) -> list[np.ndarray]:
    """1 for hashes that several chunks hold, or several documents of one."""
    alone, times = np.unique(np.concatenate(hashes), return_counts=True)
    many = times > 1
    for h, x in zip(hashes, extras, strict=True):
        flags = unpack(x, "u1") > 0
        many[np.searchsorted(alone, h[flags])] = True
    return [many[np.searchsorted(alone, h)] for h in hashes]


def decide_smaller(hashes: list[np.ndarray], extras: list[bytes]) -> list[np.ndarray]:
    """1 for hashes that a document with an id below the chunk's own smallest holds. Extras: the other 64 bits, then the ids."""
    told = [unpack(x, "<i8").reshape(2, -1) for x in extras]
    both = np.zeros(sum(map(len, hashes)), BOTH)
    both["a"], both["b"] = np.concatenate(hashes), np.concatenate([t[0] for t in told]).view(np.uint64)
    own = np.concatenate([t[1] for t in told])
    _, least, same = first_holders(own, both)
    return np.split(least[same] < own, np.cumsum([len(h) for h in hashes])[:-1])


def send_windows(chunk: int, ids: np.ndarray, hashes: np.ndarray, buckets: int) -> pd.DataFrame:
    unique, least, _ = first_holders(ids, hashes)
    return send(chunk, unique["a"], buckets, lambda p: pack(np.r_[unique["b"][p].view(np.int64), least[p]].astype("<i8")))


def ask(level: int, length: int, buckets: int):
    """A pass that sends a chunk's hashes of level 0 (anchors), 1 (their doubles) or 2 (whole windows)."""

    def run(chunk: int, docs: Chunk, told: dict) -> Iterator[pd.DataFrame]:
        words = ChunkWords(docs)
        levels = Levels(words, length, buckets, told)
        if level == 2:
            at, hashes = levels.windows()
            yield send_windows(chunk, words.id[at], hashes, buckets)
            return
        if level == 1:
            at, half = levels.halves()
        unique, many = repeated_in(words.id[at], half) if level else levels.anchors()
        yield send(chunk, unique, buckets, lambda p: pack(many[p].astype(np.uint8)))

    return run


def repeats(words: ChunkWords, at: np.ndarray, hashes: np.ndarray, buckets: int, told: list) -> np.ndarray:
    """Which of these windows also start in a document with a smaller id, by the answers and within the chunk."""
    if not len(at):
        return np.zeros(0, bool)
    unique, least, same = first_holders(words.id[at], hashes)
    return (received(unique["a"], buckets, told)[same] > 0) | (least[same] < words.id[at])


def removable(words: ChunkWords, length: int, buckets: int, told: dict) -> np.ndarray:
    """Starts of windows that also start in a document with a smaller id."""
    at, hashes = Levels(words, length, buckets, told).windows()
    return at[repeats(words, at, hashes, buckets, told.get(2, []))]


def beyond(words: ChunkWords, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the starts of repeated windows of ``size`` words: starts and hashes of windows of twice the size whose both halves repeat."""
    alive = np.zeros(words.n + size + 1, bool)
    alive[at] = True
    at = words.starts(2 * size)
    at = at[alive[at] & alive[at + size]]
    return at, words.windows(2 * size, at)


def deepest(words: ChunkWords, length: int, buckets: int, told: dict, doublings: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(size, starts, hashes) of the candidates after 0, 1, ... doublings, each from those of the one before that repeat."""
    at, size = removable(words, length, buckets, told), length
    hashes = np.zeros(0, BOTH)
    yield size, at, hashes
    for k in range(1, doublings + 1):
        if k > 1:
            at = at[repeats(words, at, hashes, buckets, told.get(1 + k, []))]
        at, hashes = beyond(words, at, size)
        size *= 2
        yield size, at, hashes


def finish(length: int, buckets: int, doublings: int, with_text: bool):
    def run(_: int, docs: Chunk, told: dict) -> Iterator[pd.DataFrame]:
        words = ChunkWords(docs)
        longest, gone = np.zeros(len(docs.ids), np.int64), np.zeros(words.n, bool)
        for k, (size, at, hashes) in enumerate(deepest(words, length, buckets, told, doublings)):
            if k:
                at = at[repeats(words, at, hashes, buckets, told.get(2 + k, []))]
            else:
                edge = np.zeros(words.n + 1, np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
            longest[words.doc[at]] = size
        head = gone & ~np.r_[False, gone[:-1]] if words.n else gone
        begins = words.ends - words.counts
        first = begins[words.counts > 0]
        head[first] = gone[first]  # a run also begins at a document's first word
        upto, heads = np.r_[0, np.cumsum(gone)], np.r_[0, np.cumsum(head)]
        removed, spans = upto[words.ends] - upto[begins], heads[words.ends] - heads[begins]
        rows, byte_of = [], [0, *docs.ends.tolist()]
        for k, (a, b) in enumerate(zip(begins.tolist(), words.ends.tolist(), strict=True)):
            kept, digest = None, words.digests[32 * k : 32 * k + 32].tobytes().hex()
            if removed[k] or with_text:
                own = docs.data[byte_of[k] : byte_of[k + 1]].split()
                kept = b" ".join([x for x, g in zip(own, gone[a:b].tolist(), strict=True) if not g])
                digest = hashlib.sha256(kept).hexdigest()
            rows.append((b - a, removed[k], spans[k], longest[k], kept.decode("utf-8", "replace") if with_text else None, digest))
        out = pd.DataFrame(rows, columns=["n_words", "n_removed", "n_spans", "longest", "kept_text", "kept_sha256"])
        out.insert(0, "doc_id", docs.doc_ids())
        yield out

    return run


def remove_repeated_windows(docs: DataFrame, min_words: int = 13, max_words: int | None = None, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, longest, kept_text, kept_sha256: words less those in windows of
    ``min_words`` words that also start in a document with a smaller doc_id.

    ``longest`` is the longest of the lengths min_words, 2 * min_words, ... at which some window still repeats;
    ``max_words`` ends the doubling early (None: it ends when no candidate survives).
    """
    length, answers = min_words, None
    with ChunkTable(documents_of(docs), note=note_words(min_words)) as chunks:
        buckets = chunks.buckets
        for level, decide in enumerate((decide_repeated, decide_repeated, decide_smaller)):
            sent = chunks.each(ask(level, length, buckets), SENT, answers, texts=False)
            got = chunks.decide(sent, level, decide)
            answers = got if answers is None else answers.unionByName(got)
        doublings, size = 0, length
        while max_words is None or 2 * size <= max_words:
            k = doublings + 1

            def deeper(chunk: int, docs: Chunk, told: dict, k: int = k) -> Iterator[pd.DataFrame]:
                words = ChunkWords(docs)
                *_, (_, at, hashes) = deepest(words, length, buckets, told, k)
                yield send_windows(chunk, words.id[at], hashes, buckets)

            got = chunks.decide(chunks.each(deeper, SENT, answers, texts=False), 2 + k, decide_smaller)
            if got.isEmpty():
                break
            answers, doublings, size = answers.unionByName(got), k, 2 * size
        return stored(chunks.each(finish(length, buckets, doublings, with_text), RESULT, answers), "substrings")


def op6_substring_dedup(spark, sf_dir):
    found = remove_repeated_windows(table(spark, sf_dir, "documents"), min_words=13, max_words=13, with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")
