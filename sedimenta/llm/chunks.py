"""Documents dealt into compressed chunks, and packed exchanges of hashes between chunks and buckets.

Substring operators ask the same question at every level: which of my hashes do other documents hold too?
A chunk (a few MB of whole documents, one row) sends each distinct hash once, packed with its neighbours
into one binary value per bucket; the bucket answers with one small code per hash, in the order sent. Rows
that a hot string would otherwise pile up are thus merged before the shuffle, and answers are a few bits.

Chunks are written once as a table bucketed by chunk, so that no later join on ``chunk`` moves texts again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, text_bytes

CHUNK_BYTES = 4_000_000
NO_ID = np.iinfo(np.int64).max
CHUNK = "chunk long, ids binary, ends binary, payload binary, notes binary"
SENT = "bucket long, chunk long, hashes binary, extra binary"
ANSWER = "chunk long, bucket long, level int, codes binary"

M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalises 64-bit hashes (multiply and xor-shift)."""
    h = (h ^ (h >> np.uint64(33))) * M1
    h = (h ^ (h >> np.uint64(29))) * M2
    return h ^ (h >> np.uint64(32))


def pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def unpack(b: bytes, dtype: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... count times, for each."""
    total = int(count.sum())
    return np.repeat(first - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(total) if total else np.zeros(0, np.int64)


class Chunk:
    """Whole documents: ids (``NO_ID``: null), end offsets, the UTF-8 bytes of all texts (where they were read) and
    the notes made of them when the chunk was written."""

    def __init__(self, ids: bytes, ends: bytes, payload: bytes | None, notes: bytes | None = None) -> None:
        self.ids = np.frombuffer(ids, "<i8")
        self.ends = np.frombuffer(ends, "<i8")
        self.data = zstandard.ZstdDecompressor().decompress(payload) if payload is not None else b""
        self.notes = notes

    @property
    def starts(self) -> np.ndarray:
        return np.concatenate([[0], self.ends[:-1]]).astype(np.int64)

    def texts(self) -> Iterator[bytes]:
        at = 0
        for end in self.ends.tolist():
            yield self.data[at:end]
            at = end

    def doc_ids(self) -> pd.Series:
        out = pd.Series(self.ids, dtype="Int64")
        out[self.ids == NO_ID] = pd.NA
        return out


def _chunks(limit: int, note: Callable[[np.ndarray, list[bytes]], bytes] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        ids, texts, held = [], [], 0
        press = zstandard.ZstdCompressor(level=1)

        def row():
            nonlocal ids, texts, held, k
            ends, own = np.cumsum([len(t) for t in texts], dtype=np.int64), np.array(ids, "<i8")
            out = pa.RecordBatch.from_arrays(
                [pa.array([part << 32 | k], pa.int64()), *(pa.array([x], pa.binary()) for x in (own.tobytes(), ends.tobytes(), press.compress(b"".join(texts)), note(own, texts) if note else None))],
                names=["chunk", "ids", "ends", "payload", "notes"],
            )
            ids, texts, held, k = [], [], 0, k + 1
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(NO_ID if doc_id is None else doc_id)
                texts.append(text)
                held += len(text)
                if held >= limit:
                    yield row()
        if ids:
            yield row()

    return run


class ChunkTable:
    """The bucketed table of chunks, and passes over it.

    ``note(ids, texts)`` makes of a chunk, once, what later passes need again and again; passes that need no more leave
    the texts unread.
    """

    def __init__(self, docs: DataFrame, chunk_bytes: int = CHUNK_BYTES, note: Callable[[np.ndarray, list[bytes]], bytes] | None = None) -> None:
        self.spark: SparkSession = docs.sparkSession
        size = text_bytes(docs)
        self.chunks = max(1, -(-size // chunk_bytes))
        self.buckets = max(8, self.chunks // 2)
        # with fewer files than shuffle partitions Spark would deal the chunks out anew for every join
        self.files = max(self.chunks // 4, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.name = f"chunks_{uuid.uuid4().hex}"
        rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(_chunks(chunk_bytes, note), CHUNK)
        with small_batches(self.spark):
            rows.write.format("parquet").option("compression", "none").bucketBy(self.files, "chunk").saveAsTable(self.name)

    def __enter__(self) -> ChunkTable:
        return self

    def __exit__(self, *_: object) -> None:
        """Drops the table, after a failure too."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def each(self, fn: Callable[[int, Chunk, dict], Iterator[pd.DataFrame]], schema: str, answers: DataFrame | None = None, texts: bool = True) -> DataFrame:
        """Runs ``fn(chunk, Chunk, answers by level)`` over all chunks; answers are joined by chunk, which moves only them."""
        rows = self.spark.table(self.name)
        if answers is not None:
            told = answers.groupBy("chunk").agg(F.collect_list(F.struct("level", "bucket", "codes")).alias("told"))  # of one chunk: as many as its buckets
            rows = rows.join(told.hint("shuffle_hash"), "chunk", "left")
        else:
            rows = rows.withColumn("told", F.lit(None).cast("array<struct<level:int,bucket:bigint,codes:binary>>"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for r in batch.itertuples(index=False):
                    by_level: dict[int, list] = {}
                    for x in r.told if r.told is not None else ():
                        by_level.setdefault(x["level"], []).append((x["bucket"], x["codes"]))
                    yield from fn(r.chunk, Chunk(r.ids, r.ends, r.payload, r.notes), by_level)

        payload = F.col("payload") if texts else F.lit(None).cast("binary").alias("payload")
        return rows.select("chunk", "ids", "ends", payload, "notes", "told").mapInPandas(run, schema)

    def decide(self, sent: DataFrame, level: int, fn: Callable[[list[np.ndarray], list[bytes]], list[np.ndarray]]) -> DataFrame:
        """Lets ``fn(hashes of each chunk, extras of each chunk)`` answer a bucket with codes of each chunk's hashes; written, since small."""

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("chunk")
            codes = fn([np.frombuffer(h, "<u8") for h in rows["hashes"]], list(rows["extra"]))
            return pd.DataFrame({"chunk": rows["chunk"], "bucket": rows["bucket"], "level": level, "codes": [pack(c.astype(np.uint8)) for c in codes]})

        return stored(sent.groupBy("bucket").applyInPandas(lambda r: run(r), ANSWER), f"answers{level}")


def bucketed(unique: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of sorted distinct hashes by (bucket, hash), the buckets present and where each begins.

    The bucket comes from other bits than those compared in it, so a bucket's 64-bit comparison stays
    as sure at any number of buckets.
    """
    of = (mix(unique ^ np.uint64(0x9E3779B97F4A7C15)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    present, begin = np.unique(of[order], return_index=True)
    return order, present, begin


def send(chunk: int, unique: np.ndarray, buckets: int, extra: Callable[[np.ndarray], bytes]) -> pd.DataFrame:
    """Rows (SENT) of sorted distinct hashes; ``extra`` packs what goes with the hashes at these positions."""
    order, present, begin = bucketed(unique, buckets)
    parts = np.split(order, begin[1:]) if len(present) else []
    return pd.DataFrame({"bucket": present, "chunk": chunk, "hashes": [unique[p].tobytes() for p in parts], "extra": [extra(p) for p in parts]})


def received(unique: np.ndarray, buckets: int, told: list) -> np.ndarray:
    """Codes of the hashes that ``send`` sent, in the order of ``unique``."""
    order, present, begin = bucketed(unique, buckets)
    by = dict(told)
    out = np.zeros(len(unique), np.uint8)
    if len(present):
        out[order] = np.concatenate([unpack(by[b], "u1") for b in present.tolist()])
    return out


def look_up(unique: np.ndarray, codes: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    return codes[np.searchsorted(unique, wanted)]
