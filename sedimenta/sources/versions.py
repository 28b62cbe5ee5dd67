"""Tables of which every version is kept: buckets of files, and a manifest a version that says which of them it is made of.

A write adds files and then commits by giving a manifest the next number; readers take the highest. The manifest comes into its place by a rename that
never replaces (atomic on HDFS and local disks), so of two writers that start from one version one wins and the other is told to begin again; a job
that dies before leaves files that no manifest names. Only buckets that a write touches are written anew, the files of the others are taken
over. A batch that its writer has committed before adds nothing (``batch``: a writer's name and a growing number).

Manifests hold folder names, one or a few for each bucket; rows never pass through the driver. What is given to a write is read more than once (for the
buckets that it touches, then for its rows): stage it first if it is costly or may come out differently. Null keys are in a bucket of
their own, but equal nothing: they are added and never replaced.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .stages import staged


class Conflict(RuntimeError):
    """Another writer committed in between: read again and repeat."""


class Manifests:
    """Numbered JSON files in a folder of the shared store."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.path_of = jvm.org.apache.hadoop.fs.Path
        self.folder, self.gateway, self.jvm = folder, spark.sparkContext._gateway, jvm
        self.files = self.path_of(folder).getFileSystem(conf)
        self.context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.files.getUri(), conf)

    def numbers(self) -> list[int]:
        at = self.path_of(self.folder)
        names = [f.getPath().getName() for f in self.files.listStatus(at)] if self.files.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def read(self, number: int) -> dict:
        stream = self.files.open(self.path_of(f"{self.folder}/{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, number: int, manifest: dict) -> None:
        draft = self.path_of(f"{self.folder}/.{uuid.uuid4().hex}")
        stream = self.files.create(draft, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        never_over = self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            self.context.rename(self.context.makeQualified(draft), self.context.makeQualified(self.path_of(f"{self.folder}/{number:012d}.json")), never_over)
        except Exception as error:
            self.files.delete(draft, False)
            if number in self.numbers():
                raise Conflict(f"version {number} was committed by another writer") from error
            raise


class BucketTable:
    """Rows by key in ``buckets`` buckets; see the module. Where keys mean something only beside another column (``within``: a place in a document), rows are
    dealt by that column and told apart by both: what lies by document then meets the table without moving."""

    def __init__(self, spark: SparkSession, path: str, key: str, schema: StructType, buckets: int = 64, within: str | None = None) -> None:
        self.spark, self.path, self.key, self.schema, self.buckets = spark, path, key, schema, buckets
        self.by, self.on = within or key, [within, key] if within else [key]
        self.manifests = Manifests(spark, f"{path}/versions")

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def version(self) -> int:
        return max(self.manifests.numbers(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        return self.manifests.read(version) if version else {"version": 0, "folders": {}, "batches": {}, "note": {}}

    def rows_of(self, folders: list[str]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.path}/{f}" for f in folders))

    def read(self, version: int | None = None) -> DataFrame:
        return self.rows_of([f for own in self.manifest(version)["folders"].values() for f in own])

    def lookup(self, *keys) -> DataFrame:
        """The rows of some values of the column that deals them (the key, if no other does), from the buckets that may hold them alone."""
        asked = self.spark.createDataFrame([(k,) for k in keys], StructType([self.schema[self.by]]))
        wanted = {str(r[0]) for r in asked.select(self.bucket(F.col(self.by))).distinct().collect()}  # as many as keys or buckets
        folders = self.manifest()["folders"]
        return self.rows_of([f for b in sorted(wanted) for f in folders.get(b, [])]).where(F.col(self.by).isin(*keys))

    def added(self, since: int, version: int | None = None) -> DataFrame:
        """The rows of files that were added after version ``since``. Where one of its files has been rewritten, files do not tell: that is refused."""
        before, after = self.manifest(since)["folders"], self.manifest(version)["folders"]
        if any(not set(own) <= set(after.get(b, [])) for b, own in before.items()):
            raise ValueError(f"files of version {since} were rewritten")
        return self.rows_of([f for b, own in after.items() for f in own if f not in before.get(b, [])])

    def _write(self, rows: DataFrame) -> dict[str, list[str]]:
        """Writes rows by bucket (several files for a large one) and says in which folders they are."""
        folder, split = f"data/{uuid.uuid4().hex}", F.pmod(F.xxhash64(*rows.columns), F.lit(8))
        rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema)).withColumn("_bucket", self.bucket(F.col(self.by))).repartition("_bucket", split).write.option("compression", "zstd").partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        found = self.manifests.files.listStatus(self.manifests.path_of(f"{self.path}/{folder}"))
        names = [f.getPath().getName() for f in found]
        return {n.partition("=")[2]: [f"{folder}/{n}"] for n in names if n.startswith("_bucket=")}

    def _touched(self, *keys: DataFrame) -> list[str]:
        """Buckets of the keys: as many as there are buckets at most."""
        found = set()
        for rows in keys:
            found |= {str(r[0]) for r in rows.select(self.bucket(F.col(self.by)).alias("b")).distinct().collect()}
        return sorted(found)

    def _done(self, base: dict, batch: tuple[str, int] | None) -> bool:
        return batch is not None and base["batches"].get(batch[0], -1) >= batch[1]

    def _commit(self, base: dict, folders: dict, batch: tuple[str, int] | None, note: dict | None) -> int:
        number = base["version"] + 1
        batches = base["batches"] | ({batch[0]: batch[1]} if batch else {})
        self.manifests.commit(number, {"version": number, "folders": folders, "batches": batches, "note": note or {}})
        return number

    def change(self, touching: list[DataFrame], made: Callable[[DataFrame], DataFrame], batch: tuple[str, int] | None = None, note: dict | None = None) -> int:
        """Rewrites the buckets of the keys in ``touching`` as ``made`` makes them of the rows they hold; returns the version then held."""
        base = self.manifest()
        if self._done(base, batch):
            return base["version"]
        touched = self._touched(*touching)
        held = self.rows_of([f for b in touched for f in base["folders"].get(b, [])])
        kept = {b: f for b, f in base["folders"].items() if b not in touched}
        return self._commit(base, kept | self._write(made(held)), batch, note)

    def replace(self, rows: DataFrame, cleared: DataFrame | None = None, batch: tuple[str, int] | None = None) -> int:
        """All rows of the keys of ``rows`` (and of ``cleared``) give way to ``rows``."""
        gone = rows.select(*self.on) if cleared is None else rows.select(*self.on).unionByName(cleared.select(*self.on))
        return self.change([gone], lambda held: held.join(gone.distinct().hint("merge"), self.on, "left_anti").unionByName(rows.select(held.columns)), batch)

    def upsert(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Each key's row gives way to the new one; of several new rows of a key, the one with the least fields stays."""
        fields = F.struct(*(F.col(c) for c in self.schema.names if c not in self.on))
        one = rows.groupBy(*self.on).agg(F.min(fields).alias("r")).select(*self.on, "r.*").select(*self.schema.names)
        return self.change([rows.select(*self.on)], lambda held: held.join(one.select(*self.on), self.on, "left_anti").unionByName(one), batch)

    def append_new(self, rows: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Adds the rows whose keys are not held, one for each key. Files are added, none is rewritten."""
        base = self.manifest()
        if self._done(base, batch):
            return base["version"]
        touched = self._touched(rows.select(*self.on))
        held = self.rows_of([f for b in touched for f in base["folders"].get(b, [])])
        new = self._write(rows.dropDuplicates(self.on).join(held.select(*self.on), self.on, "left_anti"))
        folders = {b: base["folders"].get(b, []) + new.get(b, []) for b in {*base["folders"], *new}}
        return self._commit(base, folders, batch, None)

    def overwrite(self, rows: DataFrame, batch: tuple[str, int] | None = None, note: dict | None = None) -> int:
        """A version made of ``rows`` alone: nothing of earlier ones is in it, whatever they held."""
        base = self.manifest()
        return base["version"] if self._done(base, batch) else self._commit(base, self._write(rows), batch, note)


class ArtifactStore:
    """What a stage made, by the identity of what it was made from: only documents whose identity is not there are worked on.

    ``key`` names the document; rows carry the ``identity`` of the input that they come from and the version ``made_in``. A document without
    rows is remembered by its identity all the same."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: str = "document_id", buckets: int = 64) -> None:
        from pyspark.sql.types import LongType, StringType, StructField

        own = [StructField("identity", StringType()), StructField("made_in", LongType())]
        self.key = key
        self.known = BucketTable(spark, f"{path}/known", key, StructType([schema[key], *own]), buckets)
        self.rows = BucketTable(spark, f"{path}/rows", key, StructType([*schema.fields, *own]), buckets)

    def missing(self, asked: DataFrame) -> DataFrame:
        """Of ``asked`` (key, identity) what has to be made."""
        return asked.join(self.known.read().select(self.key, "identity").hint("merge"), [self.key, "identity"], "left_anti")

    def ensure(self, asked: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """The rows of what is asked for. ``make`` gets the missing (key, identity) rows and returns the stage's rows of these documents. What was
        made of a document's other identities stays in earlier versions only."""
        lacking = staged(self.missing(asked.select(self.key, "identity")), "lacking")
        if not lacking.isEmpty():
            number = F.lit(self.rows.version() + 1).cast("long")
            # made once, then read by both steps of the write; identities are as many as documents, so no join sends them to the driver
            made = staged(make(lacking).join(lacking.hint("merge"), self.key).withColumn("made_in", number), "made")
            self.rows.replace(made, cleared=lacking)
            self.known.replace(lacking.withColumn("made_in", number))
        return self.rows.read().join(asked.select(self.key, "identity").hint("merge"), [self.key, "identity"], "left_semi")
