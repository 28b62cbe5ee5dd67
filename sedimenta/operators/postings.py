"""A stored index of identifiers: posting lists by exact text and by runs of up to three characters, in bucketed tables.

Three copy-on-write tables hold it: postings by term (``=text`` for a whole identifier, otherwise a run of characters), the number of postings of
each term, and the entries by document, from which an update knows what it takes away. A lookup reads the bucket of its term; a search for words chooses the
rarest run of each word by the stored numbers, reads the buckets of the chosen runs, and compares only what these list. An update of some documents
rewrites the buckets of the terms that they had or have.

Defined results: texts are compared in lower case; null and empty identifiers are not filed, null and empty words find nothing; an entry that occurs twice is
filed once; words that no identifier contains find nothing; a document that is updated without entries goes from the index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..sources.stages import staged
from ..sources.versions import BucketTable
from .retrieval import grams

WHOLE = "="


def _runs(word: Column) -> Column:
    """Runs by which a word may be sought: of three characters, or the word itself if it is shorter."""
    return F.when(F.length(word) < 3, F.array(word)).otherwise(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(word) - 2, F.lit(1))), lambda i: F.substring(word, i, 3))))


class PostingIndex:
    """Entries are rows (entry, document, identifier): ``entry`` tells those of a document apart. Without ``runs`` whole identifiers alone are filed: all lookups
    of texts are served, searches within identifiers are not."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64, runs: bool = True) -> None:
        text, number = lambda n: StructField(n, StringType()), lambda n: StructField(n, LongType())
        self.postings = BucketTable(spark, f"{path}/postings", "term", StructType([text("term"), text("entry"), number("document"), text("identifier")]), buckets)
        self.sizes = BucketTable(spark, f"{path}/sizes", "term", StructType([text("term"), number("n")]), buckets)
        self.entries = BucketTable(spark, f"{path}/entries", "document", StructType([number("document"), text("entry"), text("identifier")]), buckets)
        self.spark, self.runs = spark, runs

    def _filed(self, entries: DataFrame) -> DataFrame:
        folded = F.lower("identifier")
        rows = entries.where("identifier <> ''").select(F.col("entry").cast("string").alias("entry"), "document", "identifier").distinct()
        whole = F.concat(F.lit(WHOLE), folded)
        return rows.select((F.explode(F.array_append(grams(folded), whole)) if self.runs else whole).alias("term"), "entry", "document", "identifier")

    def build(self, entries: DataFrame) -> None:
        filed = self._filed(entries)
        self.postings.overwrite(filed)
        self.sizes.overwrite(self.postings.read().groupBy("term").agg(F.count("*").alias("n")))
        self.entries.overwrite(entries.select("document", F.col("entry").cast("string").alias("entry"), "identifier"))

    def update(self, documents: DataFrame, entries: DataFrame) -> None:
        """``entries`` are now all those of ``documents`` (document)."""
        gone = documents.select("document").distinct()
        before = self.entries.read().join(gone, "document", "left_semi")
        new = staged(self._filed(entries.join(gone, "document", "left_semi")), "filed")
        terms = staged(self._filed(before).select("term").unionByName(new.select("term")).distinct(), "terms")
        self.postings.change([terms], lambda held: held.join(gone, "document", "left_anti").unionByName(new.select(*held.columns)))
        counted = self._of(self.postings, terms).join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
        self.sizes.replace(counted, cleared=terms)
        self.entries.replace(entries.join(gone, "document", "left_semi").select("document", F.col("entry").cast("string").alias("entry"), "identifier"), cleared=gone)

    def _of(self, table: BucketTable, terms: DataFrame) -> DataFrame:
        """The rows of the buckets that hold ``terms``: which these are, is as many numbers as there are buckets at most."""
        folders = table.manifest()["folders"]
        return table.rows_of([f for b in table._touched(terms.select("term")) for f in folders.get(b, [])])

    def exact(self, *texts: str) -> DataFrame:
        """entry, document, identifier of the identifiers that are one of the texts, whatever the case."""
        return self.postings.lookup(*(WHOLE + t.lower() for t in texts)).drop("term")

    def equal_to(self, asked: DataFrame, column: str) -> DataFrame:
        """``asked`` with entry, document and identifier of each identifier that is its text, whatever the case."""
        rows = asked.withColumn("term", F.concat(F.lit(WHOLE), F.lower(column)))
        return rows.join(self._of(self.postings, rows.where("term is not null")), "term").drop("term")

    def containing(self, asked: DataFrame, column: str = "word") -> DataFrame:
        """``asked`` with entry, document and identifier of each identifier that contains its word."""
        if not self.runs:
            raise ValueError("this index files whole identifiers alone")
        words = asked.select(F.lower(column).alias("_word")).where("_word <> ''").distinct()
        sought = words.select("_word", F.explode(_runs(F.col("_word"))).alias("term"))
        n = F.coalesce("n", F.lit(0))
        rarest = sought.join(self._of(self.sizes, sought), "term", "left").groupBy("_word").agg(F.min(F.struct(n.alias("n"), "term")).alias("r"))
        chosen = staged(rarest.where("r.n > 0").select("_word", F.col("r.term").alias("term")), "chosen-terms")
        found = chosen.join(self._of(self.postings, chosen), "term").where(F.contains(F.lower("identifier"), F.col("_word"))).drop("term")
        return asked.join(found, F.lower(column) == F.col("_word")).drop("_word")
