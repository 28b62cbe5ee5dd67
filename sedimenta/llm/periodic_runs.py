"""Runs: stretches of words that repeat with a smallest period, four times over at least.

The dictionary of basic factors gives equal stretches of a power-of-two length L the same name: names of length 2 L are those of pairs
of names L apart. At each length, the next occurrence of a position's factor at a distance d of up to L proposes the period d
(distances from L to 2 L are proposed with one occurrence in between, or again at length 2 L, exactly). Neighbouring positions that
agree in d stand for one stretch of period d, as many words longer as L + d; where they number more than d, the occurrences of a factor
form an arithmetic progression of three terms or more. For a run of period q, the length L with q <= L < 2 q finds it whole: any nearer
occurrence of a factor of length L >= q would give the run a smaller period. So a stretch is as long as it can be, and its period the least.
Lengths are doubled while any factor recurs; positions whose factor is unique take no further part.

Defined results: null or empty texts and texts of white space have no words, no runs and the digest of nothing; a null doc_id stays null
and changes no words (it has no checksum); repeated rows are judged one by one; other columns of the input are ignored; an
empty table gives no rows. A text is worked on whole, in the task that reads it, in memory that grows with its words.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import documents_of, table

WORD = re.compile("[^\x20\x09-\x0d]+")
FIELDS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string, n_words long, n_dropped long"
KINDS = (*[pa.int64()] * 6, pa.string(), pa.string(), pa.int64(), pa.int64())
NAMES = [f.split()[0] for f in FIELDS.split(", ")]


def named(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys with equal ones together, first come first, and for each place in it whether its key is that of the place before."""
    order = np.argsort(keys, kind="stable")
    held = keys[order]
    return order, np.r_[False, held[1:] == held[:-1]]


def runs_of(words: np.ndarray, times: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of ``words`` (numbers) of at least ``least`` words and ``times`` periods, by start, then period."""
    n, size, found = len(words), 1, []
    at, keys = np.arange(n), words.astype(np.int64)
    while len(at) and size <= 2 * n // times:
        order, same = named(keys)
        place = at[order]
        again = np.flatnonzero(same)
        distance = place[again] - place[again - 1]
        near = (distance <= size) & (2 * distance > size)
        start, step = place[again - 1][near], distance[near]
        if len(start):
            by = np.argsort(start)
            start, step = start[by], step[by]
            first = np.flatnonzero(np.r_[True, (start[1:] != start[:-1] + 1) | (step[1:] != step[:-1])])
            count = np.diff(np.r_[first, len(start)])
            begin, period = start[first], step[first]
            length = count + size - 1 + period
            long = (count > period) & (length >= np.maximum(least, times * period))
            found += zip(begin[long].tolist(), length[long].tolist(), period[long].tolist(), strict=True)
        # names of twice the length, where both halves recur
        shared = same.copy()
        shared[:-1] |= same[1:]
        name = np.full(n, -1, np.int64)
        name[place[shared]] = (np.cumsum(~same) - 1)[shared]
        at = np.flatnonzero(name >= 0)
        at = at[at + size < n]
        at = at[name[at + size] >= 0]
        keys = name[at] * n + name[at + size]
        size *= 2
    return sorted(found, key=lambda r: (r[0], r[2]))


def altered(words: list[str], doc_id: int | None) -> list[str]:
    """The words as the task has them: of every tenth document by checksum, the tail repeats a stretch."""
    n = len(words)
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if not n or h is None or h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which words stay: those in no run after its first period."""
    edge = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return np.cumsum(edge[:n]) == 0


def described(doc_id: int | None, text: str, change=altered) -> tuple:
    words = change(WORD.findall(text), doc_id)
    numbers: dict[str, int] = {}
    runs = runs_of(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words)))
    listed = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    stay = kept(len(words), runs)
    left = words if stay.all() else [w for w, k in zip(words, stay.tolist(), strict=True) if k]
    start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    return doc_id, len(runs), start, length, period, 1000 * length // period if runs else None, listed, hashlib.sha256(" ".join(left).encode()).hexdigest(), len(words), len(words) - len(left)


def periodic_runs(docs: DataFrame, change=lambda words, doc_id: words) -> DataFrame:
    """One row per document: its runs (their number, the longest, a digest of all), its collapsed text's digest, words and dropped words.
    ``change`` may alter the words of a document first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [described(d, t.as_py(), change) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), KINDS, strict=True)], names=NAMES)

    return documents_of(docs).mapInArrow(run, FIELDS)


def op13_periodic_runs(spark, sf_dir):
    return periodic_runs(table(spark, sf_dir, "documents"), altered)
