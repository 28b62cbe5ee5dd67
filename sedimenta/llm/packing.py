"""Best-fit packing of tokenised documents into fixed-length sequences.

Bounded-space online best-fit: each task keeps a fixed number of open bins in a bitset keyed by free
space, puts every piece into the fullest bin that still holds it, and closes the fullest bin when it
needs room for another. Pieces leave the task as they are placed; nothing but the open bins is held. The bins still
open at a task's end are packed once more, as items, in groups of ``merge_tasks`` tasks.

Defined results: null or empty text is one piece that holds the end id alone; equal documents are packed
one by one; documents longer than ``capacity`` are cut into pieces of ``capacity`` ids, the first of
which may be shorter; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, stored, table

#: A row with piece -1 is a bin left open at a task's end; its ``length`` is what it holds.
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, place long, part long"
KINDS = (("doc_id", pa.int64()), ("piece", pa.int32()), *((n, pa.int64()) for n in ("start", "length", "ids_crc32", "bin", "place", "part")))


class OpenBins:
    """At most ``limit`` open bins of ``capacity``; ``bits`` has bit f set if a bin with f free places is open."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.bits, self.count, self.bins = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, length: int) -> tuple[int, int]:
        """Number of the bin taken and the offset in it."""
        fits = self.bits >> length
        if fits:
            free = (fits & -fits).bit_length() - 1 + length
            number = self._take(free)
        else:
            if self.count == self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)  # the fullest closes
            number, free = self.bins, self.capacity
            self.bins += 1
        if free > length:
            self._keep(number, free - length)
        return number, self.capacity - free

    def _take(self, free: int) -> int:
        number = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.count -= 1
        return number

    def _keep(self, number: int, free: int) -> None:
        self.by_free[free].append(number)
        self.bits |= 1 << free
        self.count += 1

    def still_open(self) -> list[tuple[int, int]]:
        """Number and fill of each open bin."""
        return [(n, self.capacity - free) for free, stack in enumerate(self.by_free) for n in stack]


def encoder(ranks_path: str, pattern: str):
    """Byte-level BPE encoder over a public rank file; plain text only, no special tokens."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def packed_pieces(tokenizer: str, ranks: str, pattern: str, special: dict, capacity: int, open_bins: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        plain, full, bins, rows = encoder(ranks, pattern), None, OpenBins(capacity, open_bins), []

        def sent() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(columns, KINDS, strict=True)], names=[n for n, _ in KINDS])
            rows.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if any(s in text for s in special):  # special tokens written in a text: as the tokenizer file has them
                    if full is None:
                        from tokenizers import Tokenizer

                        full = Tokenizer.from_file(tokenizer)
                    ids = full.encode(text, add_special_tokens=False).ids
                else:
                    ids = plain(text)
                ids.append(end_id)
                ids = np.array(ids, "<u4")
                at, first = 0, len(ids) % capacity or capacity
                for piece in range(-(-len(ids) // capacity)):
                    length = first if piece == 0 else capacity
                    number, place = bins.put(length)
                    rows.append((doc_id, piece, at, length, zlib.crc32(ids[at : at + length].tobytes()), part << 40 | number, place, part))
                    at += length
                if len(rows) >= 20_000:
                    yield sent()
        rows += [(None, -1, 0, fill, 0, part << 40 | number, 0, part) for number, fill in bins.still_open()]
        if rows:
            yield sent()

    return run


def repack(capacity: int, open_bins: int):
    def run(bins: pd.DataFrame) -> pd.DataFrame:
        bins = bins.sort_values(["fill", "bin"], ascending=[False, True])
        packer, to, shift = OpenBins(capacity, open_bins), [], []
        own = bins["bin"].to_numpy()
        first: dict[int, int] = {}
        for b, fill in zip(own, bins["fill"], strict=True):
            number, place = packer.put(int(fill))
            first.setdefault(number, b)  # a merged bin is called by the first one in it
            to.append(first[number])
            shift.append(place)
        return pd.DataFrame({"bin": own, "merged": to, "shift": shift})

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, ranks: str, pattern: str, capacity: int = 2048, open_bins: int = 1024, merge_tasks: int = 64, end_id: int = 0, special: tuple[str, ...] = ("<|endoftext|>",)
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``tokenizer`` is a tokenizers file; ``ranks`` the same vocabulary as ranks, which encodes the same ids
    several times faster. Texts that spell a special token go through ``tokenizer`` itself.
    """
    run = packed_pieces(tokenizer, ranks, pattern, dict.fromkeys(special), capacity, open_bins, end_id)
    rows = stored(documents_of(docs).mapInArrow(run, PIECES), "packing")
    pieces = rows.where("piece >= 0")
    left = rows.where("piece < 0").select((F.col("part") / merge_tasks).cast("long").alias("grp"), "bin", F.col("length").alias("fill"))
    moved = left.groupBy("grp").applyInPandas(lambda b: repack(capacity, open_bins)(b), "bin long, merged long, shift long")
    return pieces.join(moved, "bin", "left").select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("merged", "bin").alias("sequence_id"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("offset")
    )


def pack_with_public_tokenizer(docs: DataFrame) -> DataFrame:
    import public_tokenizers as public

    return pack_documents(docs, public.path("byte_bpe_50k.json"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)


def op10_best_fit_packing(spark, sf_dir):
    return pack_with_public_tokenizer(table(spark, sf_dir, "documents"))
