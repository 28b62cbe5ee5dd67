"""The phrase automaton against looking everywhere; phrases longer than four words."""

import random

from pyspark.sql import functions as F

from sedimenta.operators import requests
from sedimenta.operators.phrases import Automaton, first_of_each


def everywhere(phrases, tokens):
    return sorted((k, n) for n, p in enumerate(phrases) for k in range(len(tokens) - len(p) + 1) if p and tuple(tokens[k : k + len(p)]) == tuple(p))


def test_every_occurrence_is_found():
    r = random.Random(1)
    for _ in range(500):
        phrases = [tuple(r.choices("ab c", k=r.randint(0, 6))) for _ in range(r.randint(1, 12))]
        tokens = r.choices("ab cd", k=r.randint(0, 40))
        assert sorted(Automaton(phrases).found(tokens)) == everywhere(phrases, tokens)


def test_the_earliest_phrase_comes_before_the_earliest_word(spark):
    rows = spark.createDataFrame([(1, ["x", "go", "a", "b", "a", "b", "c"]), (2, ["a"]), (3, []), (4, None)], "n int, t array<string>")
    got = {r.n: [tuple(m) for m in r.m] for r in rows.select("n", first_of_each(F.col("t"), [(("go",), 0), (("b", "a"), 0), (("a", "b"), 0), (("a",), 1), (("z",), 1)], 2).alias("m")).collect()}
    assert got == {1: [(0, 2, "a b"), (1, 2, "a")], 2: [(1, 0, "a")], 3: [], 4: []}


def test_phrases_of_any_length_and_language(spark):
    asked = {"a": "Prepara una BOZZA grafica del quadro!", "b": "che differenza passa tra T1 e T2", "c": "È corretto che il cavo sia qui?", "d": "make, a: schematic", "e": None, "f": "ｄｒａｗ up"}
    rows = spark.createDataFrame(list(asked.items()), "request_id string, text string")
    own = requests.RULES + (("long.one", "general", "weak", ("one two three four five six seven",)),)
    rows = rows.unionByName(spark.createDataFrame([("g", "zero one two three four five six seven eight")], rows.schema))
    got = {(r.request_id, r.rule_id, r.at, r.phrase) for r in requests.rule_matches(rows, own).collect()}
    assert {("a", "draw.request.it", 0, "prepara una bozza grafica del quadro"), ("b", "compare.request.it", 0, "che differenza passa tra"), ("c", "verify.request.it", 0, "è corretto che"), ("d", "draw.request", 0, "make a schematic"), ("f", "draw.request", 0, "draw up"), ("g", "long.one", 1, "one two three four five six seven")} <= got
    assert not any(r[0] == "e" for r in got)
