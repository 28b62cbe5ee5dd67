"""The stored index against looking at every identifier; what an update and a lookup read and write."""

import random

import pytest

from sedimenta.operators.postings import PostingIndex

ENTRY = "entry string, document long, identifier string"


def made(r, documents):
    return [(f"{d}:{k}", d, "".join(r.choices("abAB-1é", k=r.randint(0, 7))) or None) for d in documents for k in range(r.randint(0, 4))]


def by_hand(rows, words):
    return sorted({(w, e, i) for w in words if w for e, _, i in rows if i and w.lower() in i.lower()})


def found(index, spark, words):
    asked = spark.createDataFrame([(w,) for w in words], "word string")
    return sorted((r.word, r.entry, r.identifier) for r in index.containing(asked).collect())


def test_search_lookup_and_updates(spark, tmp_path):
    r = random.Random(8)
    rows = made(r, range(40)) + [("x", 3, "Ring main"), ("x", 3, "Ring main")]
    words = ["a", "b-", "ab", "aba", "A1b", "é", "ring", "zzz", "", None, "ing m", "abab"]
    index = PostingIndex(spark, f"file://{tmp_path}/i", buckets=16)
    index.build(spark.createDataFrame(rows, ENTRY))
    assert found(index, spark, words) == by_hand(rows, words)
    assert sorted(x.entry for x in index.exact("RING MAIN").collect()) == ["x"]
    new = [(f"n{d}", d, "brand new") for d in (3, 4)] + [("n90", 90, "ab")]
    gone = [3, 4, 5, 90]
    index.update(spark.createDataFrame([(d,) for d in gone], "document long"), spark.createDataFrame([*new, ("no", 77, "not asked for")], ENTRY))
    rows = [x for x in rows if x[1] not in gone] + new
    assert found(index, spark, [*words, "new"]) == by_hand(rows, [*words, "new"])
    assert index.exact("ring main").collect() == []
    asked = spark.createDataFrame([("q", "BRAND new"), ("p", None)], "k string, t string")
    assert sorted((x.k, x.document) for x in index.equal_to(asked, "t").collect()) == [("q", 3), ("q", 4)]


def test_a_lookup_reads_one_bucket_and_an_update_leaves_the_others(spark, tmp_path):
    index = PostingIndex(spark, f"file://{tmp_path}/i", buckets=16)
    index.build(spark.createDataFrame([(f"e{k}", k, f"T{k}") for k in range(300)], ENTRY))
    one = index.exact("T7")
    assert len({f.rpartition("/")[0] for f in one.inputFiles()}) == 1 and one.count() == 1
    before = index.postings.manifest()["folders"]
    index.update(spark.createDataFrame([(7,)], "document long"), spark.createDataFrame([("e7", 7, "T8")], ENTRY))
    after = index.postings.manifest()["folders"]
    assert 0 < sum(after[b] != before[b] for b in before) <= 7 < len(before)
    assert sorted(r.entry for r in index.exact("t8").collect()) == ["e7", "e8"]


@pytest.mark.parametrize("words", [[], ["a"]])
def test_an_empty_index(spark, tmp_path, words):
    index = PostingIndex(spark, f"file://{tmp_path}/i", buckets=4)
    index.build(spark.createDataFrame([], ENTRY))
    asked = spark.createDataFrame([(w,) for w in words], "word string")
    assert index.containing(asked).collect() == []


def test_an_index_of_whole_identifiers_files_each_once(spark, tmp_path):
    index = PostingIndex(spark, f"file://{tmp_path}/w", buckets=4, runs=False)
    index.build(spark.createDataFrame([("a", 1, "T1"), ("a", 2, "t1"), ("b", 2, "CB-12"), ("c", 3, "")], "entry string, document long, identifier string"))
    assert index.postings.read().count() == 3
    assert sorted((r.entry, r.document) for r in index.exact("T1").collect()) == [("a", 1), ("a", 2)]
    with pytest.raises(ValueError):
        index.containing(spark.createDataFrame([("b",)], "word string"))
