"""The manifest, the token counts and the periodic runs against brute force, and on odd rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

from sedimenta.llm import merkle, periodic_runs, token_transducer

public = pytest.importorskip("public_tokenizers")
MODEL = public.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, rank int, row string, chunk int, node string, block string, nodes int"


def corpus():
    r = random.Random(5)
    word = lambda: "".join(r.choices("abcdeé", k=r.randint(1, 6)))
    texts = [None, "", " \t\n", "one", "a" * 3000, "ab " * 500, "x y z " * 9 + "x y", "日本語 テスト", "<s> </s> <unk> <0x41>", "\x00 nul", " ".join(word() for _ in range(6000))]
    texts += [" ".join(word() for _ in range(r.randint(1, 80))).capitalize() for _ in range(700)]
    rows = [(k * 3, t, "en" if k % 4 else None, ("web", "", None, "Ä", "web", "web")[k % 6], len(t) if t and k % 5 else None) for k, t in enumerate(texts)]
    return rows + [(None, "ABC def", "en", "web", 7), (None, None, None, None, None), (3, "Repeated Row", "en", "lone", 1), rows[9], rows[9]]


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 1, "y", 2, "z", "w", 3) for r in ROWS], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree_of(leaves):
    """All levels of a tree, and the siblings left and right of each leaf's way."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 16])) for k in range(0, len(levels[-1]), 16)])
    ways = []
    for k in range(len(leaves)):
        way = []
        for level in levels[:-1]:
            at = k - k % 16
            way.append(("".join(level[at:k]), "".join(level[k + 1 : at + 16])))
            k //= 16
        ways.append(way)
    return levels[-1][0], ways


def manifest_by_hand():
    sources = defaultdict(list)
    for r in ROWS:
        sources[r[3]].append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_of([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in names}
    root, upper = tree_of([trees[s][0] for s in names])
    out = []
    for s, above in zip(names, upper, strict=True):
        for (_, _, own, r), way in zip(sorted(sources[s], key=lambda x: x[:3]), trees[s][1], strict=True):
            way = way + above
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None
            node = leaf(r[0], re.sub("[A-Z]", lambda m: m[0].lower(), r[1]), *r[2:]) if changed else own
            for left, right in way:
                node = sha(left + node + right)
            out.append((r[0], own, trees[s][0], root, sha("".join(a + b for a, b in way)), node, node == root))
    return sorted(out, key=repr)


PROOF = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


@pytest.mark.parametrize("height", [1, 2])
def test_manifest(docs, height):
    got = rows_of(merkle.manifest(docs, height), *PROOF)
    assert got == manifest_by_hand()
    assert {r[-1] for r in got} == {True, False}


def test_versions_share_what_they_do_not_change():
    block = merkle.Block([sha(str(k)) for k in range(256)], 2)
    before, top = len(block.digests), block.top
    made = block.version(37, sha("x"))
    assert len(block.digests) - before == 3  # the leaf and its two ancestors
    assert block.top == top and sum(a != b for a, b in zip(block.children[made], block.children[top], strict=True)) == 1
    assert block.digests[made] == merkle.Block([sha("x" if k == 37 else str(k)) for k in range(256)], 2).digests[-1]


def test_empty_tables(empty):
    assert merkle.manifest(empty).collect() == []
    assert token_transducer.token_counts(empty, MODEL).collect() == []
    assert periodic_runs.periodic_runs(empty).collect() == []


def counts_by_hand():
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = [(r[0], r[1] or "") for r in ROWS]
    return sorted(((d, len(t.encode()), len(m.encode(t)), len(m.encode(t)) > 100) for d, t in texts), key=repr)


@pytest.mark.parametrize(("chunk_chars", "fan_in"), [(32_768, 256), (50, 3), (1, 2)])
def test_token_counts(docs, chunk_chars, fan_in):
    few = docs if chunk_chars > 1 else docs.where("length(text) < 60 or text is null")
    got = rows_of(token_transducer.token_counts(few, MODEL, limit=100, chunk_chars=chunk_chars, fan_in=fan_in), "doc_id", "n_bytes", "n_tokens", "over_limit")
    want = counts_by_hand()
    assert got == (want if chunk_chars > 1 else [w for w in want if w in got]) and len(got) == few.count()


def test_texts_whose_maps_do_not_meet_are_read_through(docs, monkeypatch, spark):
    few = docs.where("length(text) > 500")
    real = token_transducer.state_maps

    def none_enters(model):
        run = real(model)

        def blind(batches):
            for batch in run(batches):
                batch["enter"] = [["nowhere"] * len(e) if c else list(e) for e, c in zip(batch["enter"], batch["chunk"], strict=True)]
                yield batch

        return blind

    monkeypatch.setattr(token_transducer, "state_maps", none_enters)
    got = rows_of(token_transducer.token_counts(few, MODEL, limit=100, chunk_chars=70), "doc_id", "n_bytes", "n_tokens", "over_limit")
    assert len(got) == few.count() and set(got) <= set(counts_by_hand())


def test_transducer_equals_the_library_on_random_texts():
    import sentencepiece

    r, m, t = random.Random(9), sentencepiece.SentencePieceProcessor(model_file=MODEL), token_transducer.transducer(MODEL)
    pieces = list(t.scores)
    for k in range(3000):
        text = "".join(r.choices(pieces, k=r.randint(1, 10)) if k % 3 == 0 else r.choices("ab c\n▁dé日€x\x00\t0", k=r.randint(0, 50)) if k % 3 == 1 else r.choices("=- a", k=1) * r.randint(1, 90))
        assert t.read(token_transducer.prepared(text), t.start)[1] == len(m.encode(text)), text


def test_small_vocabularies_with_uneven_scores():
    """Pieces whose merges are not ever worse ones, ties, and states forgotten now and then."""
    r = random.Random(4)
    for _ in range(60):
        scores = dict.fromkeys("abc", 0.0)
        for _ in range(r.randint(1, 12)):
            a, b = r.choices(list(scores), k=2)
            if len(a + b) <= 6:
                scores.setdefault(a + b, float(r.randint(-6, -1)))
        t = token_transducer.Transducer(scores, limit=5)
        for _ in range(40):
            text = "".join(r.choices("abcd", k=r.randint(1, 25)))
            assert t.read(text, t.start)[1] == len(t.merged(text)[0]), (scores, text)


def runs_by_hand(words):
    n, found = len(words), []
    for q in range(1, n // 4 + 1):
        k = 0
        while k + q < n:
            end = k
            while end + q < n and words[end] == words[end + q]:
                end += 1
            length = end + q - k
            if end > k and length >= max(6, 4 * q) and not any(all(words[k + x] == words[k + x + d] for x in range(length - d)) for d in range(1, q)):
                found.append((k, length, q))
            k = end + 1
    return sorted(found, key=lambda f: (f[0], f[2]))


def test_runs_of_words():
    r = random.Random(2)
    for _ in range(1500):
        words, alphabet = [], r.choice([1, 2, 3, 6])
        while len(words) < 60:
            unit = [r.randrange(alphabet) for _ in range(r.randint(1, 12))]
            words += (unit * r.randint(1, 7))[: r.randint(1, 60)]
        words = words[: r.randint(0, 70)]
        assert periodic_runs.runs_of(np.array(words, np.int64)) == runs_by_hand(words), words


def periodic_by_hand(doc_id, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a, own = g % n, list(words)
        p = 1 + (n - a) // (3 + g % 8)
        words = [own[k] if k < a else own[a + (k - a) % p] for k in range(n)]
    runs = runs_by_hand(words)
    gone = {k for s, size, q in runs for k in range(s + q, s + size)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
    return (doc_id, len(runs), *best, best[1] * 1000 // best[2] if runs else None, sha("".join(f"{s},{size},{q}\n" for s, size, q in runs)), sha(" ".join(w for k, w in enumerate(words) if k not in gone)))


def test_periodic_runs(docs):
    few = docs.where("coalesce(length(text), 0) < 4000")
    got = rows_of(periodic_runs.periodic_runs(few, periodic_runs.altered), "doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    assert got == sorted((periodic_by_hand(r[0], r[1]) for r in ROWS if len(r[1] or "") < 4000), key=repr)
    assert sum(r[1] > 0 for r in got) > 30


def test_runs_in_a_very_long_text():
    words = np.random.default_rng(1).integers(0, 50, 300_000)
    words[1000:241_000] = np.tile(words[1000:61_000], 4)
    assert (1000, 240_000, 60_000) in [(s, n - n % 10, q) for s, n, q in periodic_runs.runs_of(words)]
