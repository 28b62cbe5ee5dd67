"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame operations alone.

Documents are partitioned by size. In the partition of documents with up to 2^c shingles, hashes fall in 2^(c+1)
bins, and a document's sketch is the least hash in each bin (MinHash by one permutation), so that the sketch of
a long document keeps as large a share of its shingles as that of a short one. A test item is sketched with the
bins of every partition. A document and an item with a common sketch value are candidates; each is verified by
the exact share of the item's distinct shingles (as strings) that the document holds.

An item in a document misses the candidates only if none of its shared shingles is the least of its bin, which
a fifth of them are not: unthinkable from a dozen shingles on. Items with fewer than ``short`` shingles are
looked up among all shingles instead, which is exact.

Defined results: words are cut at spaces and U+0009 to U+000D, A-Z lower-cased; a text with fewer words than a
shingle is one shingle of all its words; null or empty items and documents match nothing; rows with one doc_id
(or one item_id) are one, and the best row counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored, table, whole_text, words_of

#: Rows of an index of items (about 40 bytes each) that are sent to all tasks; larger ones are joined by shuffle.
SHARED_ROWS = 1_000_000


def lowered(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keyed_texts(rows: DataFrame, key: str) -> DataFrame:
    """key and text of the rows that have a key."""
    return rows.select(F.col(key).cast("long").alias(key), lowered(whole_text()).alias("text")).where(F.col(key).isNotNull())


def places(words: Column, k: int) -> Column:
    """Where the k-word shingles of some words begin: at 0 alone if there are fewer words, nowhere without words."""
    last = F.greatest(F.lit(0), F.size(words) - k)
    return F.when(F.size(words) > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def hashes(text: Column, k: int) -> Column:
    """Sorted hashes of the k-word shingles of a text, one for each place."""
    one = lambda w: F.sort_array(F.transform(places(w, k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k)))))
    return let(words_of(text), one)


def strings(text: Column, k: int) -> Column:
    """Distinct k-word shingles of a text."""
    return let(words_of(text), lambda w: F.array_distinct(F.transform(places(w, k), lambda i: F.concat_ws(" ", F.slice(w, i + 1, F.lit(k))))))


def size_class(places: Column) -> Column:
    """The least c with places <= 2^c."""
    return F.ceil(F.log2(places.cast("double"))).cast("int")


def least_of_bins(sorted_hashes: Column, size: Column) -> Column:
    """Of sorted hashes: the first in each of 2^(size + 1) bins, taken from the leading bits."""
    shift = F.lit(63) - size
    place = lambda x: F.call_function("shiftrightunsigned", x, shift)
    return F.filter(sorted_hashes, lambda x, i: (i == 0) | (place(x) != place(F.get(sorted_hashes, i - 1))))


def document_sketches(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, size, h: the sketch of each document, a row for each value."""
    sketch = let(hashes(F.col("text"), k), lambda h: let(size_class(F.size(h)), lambda c: F.struct(c.alias("size"), least_of_bins(h, c).alias("h"))))
    rows = keyed_texts(docs, "doc_id").where("text <> ''").select("doc_id", sketch.alias("s"))
    return rows.select("doc_id", "s.size", F.explode("s.h").alias("h"))


def item_sketches(items: DataFrame, k: int, classes: int = 40) -> DataFrame:
    """item_id, size, h for every partition; beyond 2^classes shingles a document has no partition of its own kind."""
    all_sizes = let(hashes(F.col("text"), k), lambda h: F.transform(F.sequence(F.lit(0), F.lit(classes)), lambda c: F.struct(c.alias("size"), least_of_bins(h, c).alias("h"))))
    rows = keyed_texts(items, "item_id").select("item_id", F.explode(all_sizes).alias("s"))
    return rows.select("item_id", "s.size", F.explode("s.h").alias("h"))


def small(index: DataFrame) -> DataFrame:
    """Marks an index of items for broadcast if it is counted to be small."""
    return F.broadcast(index) if index.count() <= SHARED_ROWS else index


def candidates(docs: DataFrame, items: DataFrame, k: int, short: int) -> DataFrame:
    """doc_id, item_id that may reach the threshold."""
    sketches = stored(item_sketches(items, k), "items")
    found = document_sketches(docs, k).join(small(sketches.distinct()), ["size", "h"]).select("doc_id", "item_id")
    own = keyed_texts(items, "item_id").select("item_id", F.array_distinct(hashes(F.col("text"), k)).alias("h"))
    few = stored(own.where(F.size("h") < short).select("item_id", F.explode("h").alias("h")), "short")
    if not few.isEmpty():
        every = keyed_texts(docs, "doc_id").select("doc_id", F.explode(hashes(F.col("text"), k)).alias("h"))
        found = found.unionByName(every.join(small(few), "h").select("doc_id", "item_id"))
    return found.distinct()


def contained_items(docs: DataFrame, items: DataFrame, k: int = 5, num: int = 80, den: int = 100, short: int = 12) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_contained, containment of each document that holds num / den of an item's shingles."""
    pairs = stored(candidates(docs, items, k, short), "candidates")
    own = keyed_texts(items, "item_id").select("item_id", strings(F.col("text"), k).alias("i"))
    held = keyed_texts(docs, "doc_id").join(pairs.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", strings(F.col("text"), k).alias("d"))
    both = pairs.join(held, "doc_id").join(own, "item_id").select("doc_id", "item_id", F.size("i").cast("long").alias("n_item_shingles"), F.size(F.array_intersect("i", "d")).cast("long").alias("n_contained"))
    both = both.where(den * F.col("n_contained") >= num * F.col("n_item_shingles"))
    best = both.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_contained") / F.col("n_item_shingles")).alias("containment"), "n_item_shingles", "n_contained")).alias("b"))
    return best.select("doc_id", "item_id", "b.n_item_shingles", "b.n_contained", "b.containment")


def without_items(docs: DataFrame, items: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs``, unchanged, that hold none of the items; rows without doc_id stay."""
    held = stored(contained_items(docs, items, k, num, den).select("doc_id").distinct(), "held")
    return docs.join(held, "doc_id", "left_anti")


def op7_minhash_containment(spark, sf_dir):
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _words_sql(key: str, source: str) -> str:
    return f"(select {key}, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> '') w from {source})"


def _shingles_sql(key: str, source: str) -> str:
    return f"""select distinct {key}, unnest(case when len(w) < 5 then [array_to_string(w, ' ')]
  else list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) end) s from {_words_sql(key, source)} where len(w) > 0"""


OP7_SQL = f"""
with d as ({_shingles_sql('doc_id', 'documents')}), i as ({_shingles_sql('item_id', 'benchmark')}),
n as (select item_id, count(*) n from i group by item_id),
c as (select doc_id, item_id, count(*) c from d join i using (s) group by doc_id, item_id)
select doc_id, item_id, n as n_item_shingles, c as n_contained, c / n as containment from c join n using (item_id) where 100 * c >= 80 * n
"""
