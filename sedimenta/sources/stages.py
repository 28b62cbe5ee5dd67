"""Stage tables, idempotent sinks and file sources."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all executors share; a temporary folder only where it is unset, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not held.isDefined():
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sedimenta-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """A stage's rows as a table, read back: what follows reads it several times and recomputes nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged_by(df: DataFrame, name: str, key: str, buckets: int, placed: bool = False) -> DataFrame:
    """``staged`` in buckets by ``key``: what groups, joins or orders rows of one key moves none of them again. Rows that come from tables with the
    same buckets (``placed``) are written where they are, elsewhere that would only make more files. Rows are counted, since the size of packed files says
    nothing of them: a join planned by it would send to the driver what is many times as large (see ``Tables``)."""
    table = f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    rows = df if placed else df.repartition(buckets, key)
    rows.write.format("parquet").option("compression", "zstd").option("path", f"{shared_dir(df.sparkSession)}/{table}").bucketBy(buckets, key).saveAsTable(table)
    df.sparkSession.sql(f"analyze table {table} compute statistics")
    return df.sparkSession.table(table)


def appended(batches: list[DataFrame], name: str) -> DataFrame:
    """An append-only ledger: each batch adds files, none is ever rewritten; all rows are read back."""
    spark = batches[0].sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for batch in batches:
        batch.write.mode("append").parquet(path)
    return spark.read.schema(batches[0].schema).parquet(path)


def latest_set(rows: DataFrame, key: str, order: str) -> DataFrame:
    k = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("_k", k).where("_k = 1").drop("_k")


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """path, length and content of the files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "content")


def content_identities(registry: DataFrame, files: DataFrame) -> DataFrame:
    """Checksum and size of each registered file (``binaryFile`` rows: path, length, content), or why there is none."""
    rows = registry.join(files.select("path", "length", "content"), "path", "left")
    failure = F.when(F.col("length").isNull(), "content_not_found").when(F.col("content").isNull(), "content_inaccessible").when(F.col("length") == 0, "empty_content").when(F.length("content") != F.col("length"), "checksum_failure")
    return rows.withColumn("failure", failure).select("document_id", "path", F.when(F.col("failure").isNull(), F.sha2("content", 256)).alias("checksum"), F.when(F.col("failure").isNull(), F.col("length")).alias("size"), "failure")


# Byte signatures (hex), MIME types and extensions of formats.
SIGNATURES = (
    ("255044462D", "pdf"), ("41433130", "dwg"), ("4175746F4341442042696E61727920445846", "dxf"), ("2020300D0A53454354494F4E", "dxf"), ("2020300A53454354494F4E", "dxf"), ("300D0A53454354494F4E", "dxf"), ("300A53454354494F4E", "dxf"),
    ("89504E470D0A1A0A", "image"), ("FFD8FF", "image"), ("474946383761", "image"), ("474946383961", "image"), ("424D", "image"), ("49492A00", "image"), ("4D4D002A", "image"),
)
MIME = (("application/pdf", "pdf"), ("image/vnd.dwg", "dwg"), ("application/acad", "dwg"), ("image/vnd.dxf", "dxf"), ("application/dxf", "dxf"), ("image/png", "image"), ("image/jpeg", "image"), ("image/gif", "image"), ("image/bmp", "image"), ("image/tiff", "image"), ("model/step", "model_3d"), ("model/iges", "model_3d"))
EXTENSIONS = ((".pdf", "pdf"), (".dwg", "dwg"), (".dxf", "dxf"), (".xlsx", "xlsx"), (".xlsm", "xlsx"), (".docx", "docx"), (".png", "image"), (".jpg", "image"), (".jpeg", "image"), (".gif", "image"), (".bmp", "image"), (".tif", "image"), (".tiff", "image"), (".step", "model_3d"), (".stp", "model_3d"), (".iges", "model_3d"), (".igs", "model_3d"))


def classified_formats(files: DataFrame) -> DataFrame:
    """Format of each file (content_head hex, mime, filename): the longest signature decides alone; else MIME type and
    extension must agree (``conflicting``), or one of them tells; else ``unknown``."""
    signature = F.lit(None).cast("string")
    for hexa, kind in sorted(SIGNATURES, key=lambda s: len(s[0])):
        signature = F.when(F.startswith(F.col("content_head"), F.lit(hexa)), kind).otherwise(signature)
    lookup = lambda pairs, c: F.create_map(*(F.lit(x) for p in pairs for x in p))[c]
    extension = F.lower(F.regexp_extract("filename", "([.][^.]*)$", 1))
    rows = files.withColumns({"by_signature": signature, "by_mime": lookup(MIME, F.lower("mime")), "by_extension": lookup(EXTENSIONS, extension)})
    clash = F.col("by_mime").isNotNull() & F.col("by_extension").isNotNull() & (F.col("by_mime") != F.col("by_extension"))
    decided = F.coalesce("by_signature", F.when(clash, "conflicting"), "by_mime", "by_extension", F.lit("unknown"))
    decider = F.when(F.col("by_signature").isNotNull(), "signature").when(clash, "none").when(F.col("by_mime").isNotNull(), "mime").when(F.col("by_extension").isNotNull(), "extension").otherwise("none")
    rows = rows.withColumns({"format": decided, "decider": decider})
    disagreeing = F.array_join(F.array_compact(F.array(*(F.when(F.col(f"by_{n}") != F.col("format"), F.lit(n)) for n in ("signature", "mime", "extension")))), ",")
    return rows.withColumn("disagreeing", disagreeing)


def backfill_plan(files: DataFrame) -> DataFrame:
    """What a re-reading does to documents stored as ``other``; all four outcomes are counted, zeros too."""
    action = F.when(F.col("content_head").isNull(), "content_unavailable").when(F.col("format") == "conflicting", "conflicting_evidence").when(F.col("format") == "unknown", "left_unclassified").otherwise("reclassified")
    counted = files.where("stored_format = 'other'").select(action.alias("action")).groupBy("action").count()
    every = files.sparkSession.createDataFrame([(a,) for a in ("reclassified", "left_unclassified", "content_unavailable", "conflicting_evidence")], "action string")
    return every.join(counted, "action", "left").select("action", F.coalesce("count", F.lit(0)).alias("n"))
