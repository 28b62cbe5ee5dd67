"""Checksums of stored files of any size.

Paths (of a register, or listed by Spark without reading contents) are dealt over the tasks, and each task reads a file in ranges of a few MB, so that a
file is never held, by a cell or by a process. ``binaryFile`` puts a whole file in a cell, which ends at 2 GB.

Defined results: an empty file has the failure ``empty_content``, one that is registered and not there ``content_not_found``, one that can't be read
``content_inaccessible``, one of which another number of bytes is read than it should have ``checksum_failure``; none of these has a checksum. A path that
is registered twice is answered twice, a null path is not there; Spark's listing leaves empty files out, a register does not.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from urllib.parse import urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RANGE = 8 * 1024 * 1024


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """path and length of all files below a folder that hold anything."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")


def opened(path: str):
    """The length of a file, and a stream of it; local paths, and what the installed file systems of Arrow reach."""
    where = urlparse(path)
    if where.scheme in ("", "file"):
        local = where.path if where.scheme else path
        return os.stat(local).st_size, open(local, "rb", buffering=0)  # noqa: SIM115 (the caller closes it)
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    return info.size, system.open_input_stream(inner)


def checksum_of(path: str, size: int = RANGE) -> tuple[str, int, int]:
    """SHA-256 of a file, how many bytes were read, and how many it should have."""
    digest, total = hashlib.sha256(), 0
    length, stream = opened(path)
    with stream:
        while part := stream.read(size):
            digest.update(part)
            total += len(part)
    return digest.hexdigest(), total, length


def checksums(paths: DataFrame, size: int = RANGE) -> DataFrame:
    """path, length, checksum, bytes_read and error of each different path of ``paths`` (path)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                checksum, total, length, error = None, None, None, None
                try:
                    checksum, total, length = checksum_of(path, size)
                except OSError as e:
                    error = "not_found" if isinstance(e, FileNotFoundError) else type(e).__name__
                yield pd.DataFrame({"path": [path], "length": pd.array([length], "Int64"), "checksum": [checksum], "bytes_read": pd.array([total], "Int64"), "error": [error]})

    return paths.select("path").where("path is not null").distinct().repartition("path").mapInPandas(run, "path string, length long, checksum string, bytes_read long, error string")


def identities(registry: DataFrame, size: int = RANGE) -> DataFrame:
    """document_id, path, checksum, size and failure of each registered file (document_id, path; ``expected`` bytes, if there is such a column)."""
    expected = F.col("expected") if "expected" in registry.columns else F.lit(None)
    error, length = F.col("error"), F.coalesce(expected, F.col("length"))
    failure = (
        F.when(F.col("bytes_read").isNull() & (error.isNull() | (error == "not_found")), "content_not_found").when(error.isNotNull(), "content_inaccessible").when(F.col("bytes_read") == 0, "empty_content").when(F.col("bytes_read") != length, "checksum_failure")
    )
    rows = registry.join(checksums(registry, size), "path", "left").withColumn("failure", failure)
    return rows.select("document_id", "path", F.when(F.col("failure").isNull(), F.col("checksum")).alias("checksum"), F.when(F.col("failure").isNull(), F.col("bytes_read")).alias("size"), "failure")
