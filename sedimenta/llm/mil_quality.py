"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE`` words. Every passage of the whole text is encoded (shares of
character kinds, word lengths, repetition, hashed words), passed through a learned layer, weighted by learned
gated attention - tanh(V h) times sigmoid(U h) - and the weighted passage representation gives the score. Only
the label of the document is used: which passages speak for it, the attention learns.

The model is fitted on at most ``train_limit`` labelled documents of together at most ``train_bytes`` of text, those with
the smallest hash of doc_id that fit; all other rows are scored where they lie. Labels, lang, source and doc_id are no inputs.

Defined results: null or empty text is one passage of zeros and gets a score too; equal texts get equal
scores; a document with several labels counts by their mean (1 from one half on); rows with a null doc_id
are scored and count as held out of training; without any label every score is 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents_of, table

PASSAGE, HASHED = 64, 32
#: Bytes of a word that are hashed for all words at once; what is left of longer ones is hashed one by one.
SHORT = 24
LOWER, UPPER, DIGIT, SPACE, LINE, STOP, COMMA, BANG, PIPE, MARK, OTHER, HIGH = range(12)
KINDS = np.full(256, OTHER, np.uint8)
for _k, _chars in ((LOWER, b"abcdefghijklmnopqrstuvwxyz"), (UPPER, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (DIGIT, b"0123456789"), (SPACE, b" \t\r\x0b\x0c"), (LINE, b"\n"), (STOP, b".?"), (COMMA, b",;:"), (BANG, b"!"), (PIPE, b"|"), (MARK, b"#*$%&<>@^~_={}[]\\/+")):
    KINDS[list(_chars)] = _k
KINDS[128:] = HIGH
FEATURES = 12 + 6 + HASHED


def encode(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages of some texts, and how many passages each text has (one at least)."""
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes)
    kind = KINDS[data]
    blank = (kind == SPACE) | (kind == LINE)
    first = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    last = np.flatnonzero(~blank & np.r_[blank[1:], True]) + 1
    doc = np.searchsorted(ends, first, side="right")
    words = np.bincount(doc, minlength=len(texts))
    passages = np.maximum(1, -(-words // PASSAGE))
    base = np.r_[0, np.cumsum(passages)[:-1]]
    total = int(passages.sum())
    rank = np.arange(len(first)) - np.r_[0, np.cumsum(words)[:-1]][doc]
    of = base[doc] + rank // PASSAGE
    x = np.zeros((total, FEATURES), np.float32)
    if not len(first):
        return x, passages
    head = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    # a passage goes up to the next one or to the end of its text: what stands beside a text in a batch is not counted
    begin, after = first[head], np.r_[first[head][1:], len(data)]
    gap = np.zeros(len(data) - first[0] + 1, np.int32)
    np.add.at(gap, np.minimum(after, ends[doc[head]]) - first[0], 1)
    np.add.at(gap, after - first[0], -1)
    own = np.cumsum(gap[:-1]) == 0
    byte_of = np.repeat(of[head], after - begin)[own]
    kinds = np.bincount(byte_of * 12 + kind[first[0] :][own], minlength=total * 12).reshape(total, 12)
    n = np.bincount(of, minlength=total)
    chars = np.maximum(1, kinds.sum(1))
    x[:, :12] = kinds / chars[:, None]
    length = last - first
    mean = np.bincount(of, length, total) / np.maximum(1, n)
    x[:, 12] = mean / 10
    x[:, 13] = np.sqrt(np.maximum(0, np.bincount(of, length.astype(float) ** 2, total) / np.maximum(1, n) - mean**2)) / 10
    x[:, 14] = np.bincount(of, length <= 3, total) / np.maximum(1, n)
    ending = kind[last - 1]
    x[:, 15] = np.bincount(of, ending >= STOP, total) / np.maximum(1, n)
    lowered = np.where(kind == UPPER, data | 32, data).astype(np.uint64) + np.uint64(1)
    h = np.zeros(len(first), np.uint64)
    for j in range(SHORT):
        live = length > j
        h[live] = (h[live] ^ lowered[first[live] + j]) * np.uint64(0x100000001B3)
    for k in np.flatnonzero(length > SHORT):  # the rest of the few long words, whole
        h[k] ^= np.uint64(zlib.crc32(lowered[first[k] + SHORT : last[k]].astype(np.uint8).tobytes()) << 32)
    h = (h ^ length.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    pairs = np.sort((of.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    distinct = np.bincount((pairs[np.r_[True, pairs[1:] != pairs[:-1]]] >> np.uint64(40)).astype(np.int64), minlength=total)
    x[:, 16] = distinct / np.maximum(1, n)
    x[:, 17] = np.minimum(n, PASSAGE) / PASSAGE
    x[:, 18:] = np.bincount(of * HASHED + (h % np.uint64(HASHED)).astype(np.int64), minlength=total * HASHED).reshape(total, HASHED) / np.maximum(1, n)[:, None]
    return x, passages


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class GatedAttention:
    """Weights of the encoder (w, b), the gate (v, u, a) and the classifier (c, d)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        p = self.weights
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ p["w"] + p["b"])
        t, s = np.tanh(h @ p["v"]), sigmoid(h @ p["u"])
        e = (t * s) @ p["a"]
        starts = np.r_[0, np.cumsum(counts)[:-1]]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), counts))
        att = e / np.repeat(np.add.reduceat(e, starts), counts)
        bag = np.add.reduceat(att[:, None] * h, starts, axis=0)
        return {"z": z, "h": h, "t": t, "s": s, "att": att, "bag": bag, "score": sigmoid(bag @ p["c"] + p["d"][0]), "starts": starts}

    def gradients(self, x: np.ndarray, counts: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p, f = self.weights, self.forward(x, counts)
        err = (f["score"] - y) / len(y)
        g = {"c": f["bag"].T @ err, "d": np.array([err.sum()])}
        to_bag = np.repeat(err, counts)[:, None] * p["c"]
        to_att = (to_bag * f["h"]).sum(1)
        mean = np.repeat(np.add.reduceat(f["att"] * to_att, f["starts"]), counts)
        to_e = f["att"] * (to_att - mean)
        g["a"] = (f["t"] * f["s"]).T @ to_e
        gate = to_e[:, None] * p["a"]
        to_v, to_u = gate * f["s"] * (1 - f["t"] ** 2), gate * f["t"] * f["s"] * (1 - f["s"])
        g["v"], g["u"] = f["h"].T @ to_v, f["h"].T @ to_u
        to_h = (f["att"][:, None] * to_bag + to_v @ p["v"].T + to_u @ p["u"].T) * (1 - f["h"] ** 2)
        g["w"], g["b"] = f["z"].T @ to_h, to_h.sum(0)
        return g


def fit(bags: list[np.ndarray], labels: np.ndarray, hidden: int = 24, gate: int = 12, epochs: int = 60, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 7) -> GatedAttention:
    rng = np.random.default_rng(seed)
    every = np.concatenate(bags)
    p = {"w": rng.normal(0, FEATURES**-0.5, (FEATURES, hidden)), "b": np.zeros(hidden), "v": rng.normal(0, hidden**-0.5, (hidden, gate)), "u": rng.normal(0, hidden**-0.5, (hidden, gate)), "a": rng.normal(0, gate**-0.5, gate), "c": rng.normal(0, hidden**-0.5, hidden), "d": np.zeros(1)}
    model = GatedAttention(every.mean(0), every.std(0) + 1e-3, p)
    m, v, step = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}, 0
    counts = np.array([len(b) for b in bags])
    for _ in range(epochs):
        order = rng.permutation(len(bags))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            g = model.gradients(np.concatenate([bags[k] for k in own]), counts[own], labels[own])
            step += 1
            for k, d in g.items():
                d = d + decay * p[k]
                m[k], v[k] = 0.9 * m[k] + 0.1 * d, 0.999 * v[k] + 0.001 * d * d
                p[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the doc_id as text leaves 1 when divided by 3; null ids are held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        passages = [encode([text])[0].astype("<f4").tobytes() for text in batch["text"]]
        yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "passages": passages})


def train(docs: DataFrame, labels: DataFrame, train_limit: int = 6000, train_bytes: int = 64_000_000) -> GatedAttention | None:
    """Fits the model on labelled documents that are not held out: ``train_limit`` and ``train_bytes`` of text at most."""
    marked = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("double").alias("label"))
    sample = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_limit)
    rows = documents_of(docs).withColumn("text", F.col("text").cast("binary")).join(F.broadcast(sample), "doc_id")  # train_limit rows of two numbers
    sizes = rows.groupBy("doc_id").agg(F.sum(F.octet_length("text")).alias("size"), F.xxhash64("doc_id").alias("rank")).collect()  # train_limit rows at most
    chosen, held = [], 0
    for r in sorted(sizes, key=lambda r: (r["rank"], r["doc_id"])):
        if held + r["size"] <= train_bytes:
            chosen.append((r["doc_id"],))
            held += r["size"]
    if not chosen:
        return None
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long")), "doc_id", "left_semi")
    got = sorted(rows.select("doc_id", "text", "label").mapInPandas(encoded, "doc_id long, label double, passages binary").collect(), key=lambda r: (r.doc_id, r.passages))
    return fit([np.frombuffer(r.passages, "<f4").reshape(-1, FEATURES).astype(float) for r in got], np.array([r.label for r in got]))


def small_parts(batch: pa.RecordBatch, rows: int = 500, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows and ``size`` bytes of text, or one row: encoding takes tens of bytes for each byte of text."""
    ends = np.cumsum([len(t) if t else 0 for t in batch.column("text").to_pylist()])
    at = 0
    while at < batch.num_rows:
        before = ends[at - 1] if at else 0
        to = max(at + 1, min(at + rows, int(np.searchsorted(ends, before + size, "right"))))
        yield batch.slice(at, to - at)
        at = to


SCORED = "doc_id long, held_out boolean, score double, predicted int, n_passages long, top_passage long, top_weight double"


def score_quality(docs: DataFrame, labels: DataFrame, train_limit: int = 6000) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, top_passage (from 0) and top_weight of the passage that counted most."""
    model = train(docs, labels, train_limit)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_parts(batch):
                x, counts = encode(part.column("text").to_pylist())
                starts = np.r_[0, np.cumsum(counts)[:-1]]
                if shared.value is None:
                    score, att = np.full(len(counts), 0.5), np.repeat(1 / counts, counts)
                else:
                    f = shared.value.forward(x, counts)
                    score, att = f["score"], f["att"]
                top = np.array([np.argmax(att[a : a + c]) for a, c in zip(starts, counts, strict=True)], np.int64)
                made = (score, (score >= 0.5).astype(np.int32), counts.astype(np.int64), top, np.maximum.reduceat(att, starts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), *map(pa.array, made)], names=[c.split()[0] for c in SCORED.split(", ")])

    rows = documents_of(docs).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, SCORED)


def keep_good(docs: DataFrame, labels: DataFrame, train_limit: int = 6000, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, unchanged, whose text scores ``threshold`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_limit))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in small_parts(batch):
                if shared.value is not None:
                    x, counts = encode([(t or "").encode() for t in part.column("text").to_pylist()])
                    part = part.filter(pa.array(shared.value.forward(x, counts)["score"] >= threshold))
                yield part

    return docs.mapInArrow(run, docs.schema)


def op2_attention_quality(spark, sf_dir):
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
