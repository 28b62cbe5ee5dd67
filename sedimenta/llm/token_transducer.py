"""Token counts by a compiled finite-state tokenizer.

A byte-pair vocabulary is compiled, as texts ask for it, into a deterministic transducer. After a prefix of a text, what the
rest can still depend on is, for each place where a piece may be under way, what has been read of it, the token that ends there,
and how many tokens fewer than now had been emitted there; this is a state. A transition reads one character and is annotated with
the tokens it emits (fewer than none where a longer piece takes earlier ones back). The token that ends a prefix is the one piece at
its end that stands beside the token before it, that is, whose two characters' strings together merge into just these two tokens.

Texts of up to ``chunk_chars`` characters are read from the start state. Longer ones are cut, their chunks are dealt over all
tasks, and each gives its state map: from every state that it may be entered in (those that the characters before it lead to, from
wherever reading starts) to the state it is left in and the tokens emitted. Maps compose associatively and are composed by runs
of ``fan_in``, level by level. Should a chunk be entered in a state that its map lacks, the text is read through in one pass: exact.

Defined results: null text counts as empty (0 bytes, 0 tokens, not over the limit); a null doc_id stays null; repeated rows are
counted one by one; other columns of the input are ignored; an empty table gives no rows. Characters outside the vocabulary count as
one token for each byte, special strings inside a text are ordinary text, a space is put before each text, as the library does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents_of, stored, table

SPACE = "▁"


class State(dict):
    """Transitions known so far (character: next state, tokens emitted); ``places``: (read of a piece under way, token before it or else the few
    pieces that it may still become, tokens emitted there less those emitted now)."""

    __slots__ = ("places",)

    def __init__(self, places: tuple) -> None:
        self.places = places

    @property
    def name(self) -> str:
        return json.dumps(self.places)


class Transducer:
    """``scores``: the pieces that merging may make, the higher the sooner. At most ``limit`` states are held; all are forgotten beyond it."""

    def __init__(self, scores: dict[str, float], limit: int = 60_000) -> None:
        self.scores, self.limit = scores, limit
        self.under_way = {p[:k] for p in scores for k in range(1, len(p))}
        self.beside = {p[k : k + 2] for p in scores for k in range(len(p) - 1)}
        self.joined = {pair[0] for pair in self.beside}
        self.longest = max(map(len, scores), default=1)
        self.few = self._few(16)
        self.made = lru_cache(None)(self._made)  # of pieces: as many as the vocabulary has
        self.stands, self.left = lru_cache(100_000)(self._stands), lru_cache(100_000)(self._left)
        self.states: dict[tuple, State] = {}
        self.start = self.state((("", "", 0),))

    def state(self, places: tuple) -> State:
        found = self.states.get(places)
        if found is None:
            found = self.states[places] = State(places)
        return found

    def merged(self, text: str) -> tuple[list[str], list[float], tuple[str, str]]:
        """What merging leaves of ``text`` (the best pair first, of equals the leftmost), the scores of its merges in turn, and the two parts of the last."""
        parts, scores, last = list(text), [], ("", "")
        while len(parts) > 1:
            pairs = [(self.scores[a + b], -k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in self.scores]
            if not pairs:
                break
            score, k = max(pairs)
            last = parts[-k], parts[1 - k]
            parts[-k : 2 - k] = ["".join(last)]
            scores.append(score)
        return parts, scores, last

    def _made(self, piece: str) -> tuple[str, str] | None:
        """The parts that ``piece`` is merged from; None unless its own merges are ever worse ones and end in it."""
        parts, scores, last = self.merged(piece)
        return last if len(parts) == 1 and scores == sorted(scores, reverse=True) else None

    def _stands(self, before: str, piece: str) -> bool:
        """Whether ``before`` and ``piece`` together merge into just these two. Where the merges of both are ever worse ones, they are undone
        from the last: two neighbours across the border would have been joined had they been better than what parted them."""
        left, right = self.made(before) if before else ("", ""), self.made(piece)
        if not before or left is None or right is None:
            return self.merged(before + piece)[0] == ([before, piece] if before else [piece])
        a, b, scores, limit, ties = before, piece, self.scores, float("-inf"), True
        while True:
            across = scores.get(a + b)
            if across is not None and (across > limit or (ties and across == limit)):
                return False
            if len(a) == len(b) == 1:
                return True
            if len(b) == 1 or (len(a) > 1 and scores[a] < scores[b]):
                limit, ties, a = scores[a], False, self.made(a)[1]
            else:
                limit, ties, b = scores[b], True, self.made(b)[0]

    def _few(self, most: int) -> dict[str, tuple[str, ...]]:
        """What may come of the reads that have at most ``most`` pieces before them."""
        found: dict[str, list[str]] = {}
        for p in sorted(self.scores):
            for k in range(1, len(p)):
                found.setdefault(p[:k], []).append(p)
        return {read: tuple(pieces) for read, pieces in found.items() if len(pieces) <= most}

    def _left(self, read: str, before: str) -> str | tuple[str, ...]:
        """``before``, or the pieces that may come of ``read`` beside it where they are few: states that lead to the same are the same then."""
        return tuple(p for p in self.few[read] if self.stands(before, p)) if read in self.few else before

    def tokens_in(self, character: str) -> int:
        return 1 if character in self.scores else len(character.encode("utf-8", "surrogatepass"))

    def step(self, state: State, character: str) -> tuple[State, int]:
        """Compiles one transition."""
        read, last = [], None
        for piece, before, emitted in state.places:
            piece += character
            if isinstance(before, tuple):
                whole, left = piece in before, tuple(p for p in before if len(p) > len(piece) and p.startswith(piece))
            else:
                if len(piece) == 1 and before and before[-1] + piece not in self.beside:
                    before = ""  # nothing can join them: what came before no longer matters
                whole = last is None and (piece in self.scores or len(piece) == 1) and self.stands(before, piece)
                left = self.left(piece, before) if piece in self.under_way else ()
            if whole and last is None:
                last = piece, emitted + (self.tokens_in(piece) if len(piece) == 1 else 1)
            if left != ():
                read.append((piece, left, emitted))
        token, now = last
        if len(self.states) >= self.limit:
            self.states.clear()
            self.start.clear()
            self.states[self.start.places] = self.start
        found = self.state((*((p, b, e - now) for p, b, e in read), ("", token if token[-1] in self.joined else "", 0)))
        state[character] = found, now
        return found, now

    def read(self, text: str, state: State) -> tuple[State, int]:
        total = 0
        for character in text:
            state, emitted = state.get(character) or self.step(state, character)
            total += emitted
        return state, total

    def entries(self, before: str) -> dict[tuple, State]:
        """The states that the characters before a chunk may lead to, from wherever reading starts among the first of them."""
        found = {}
        for k in range(max(1, len(before) - self.longest)):
            state = self.read(before[k:], self.start)[0]
            found[state.places] = state
        return found


@lru_cache(4)
def transducer(model: str) -> Transducer:
    """From a sentencepiece file with byte fallback; control, unknown and byte pieces are never merged."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model)
    own = (i for i in range(m.get_piece_size()) if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i)))
    return Transducer({m.id_to_piece(i): m.get_score(i) for i in own})


def prepared(text: str) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


CHUNKS = "doc_id long, n_bytes long, n_tokens long, row string, chunk long, before string, body string"


def read_or_cut(model: str, chunk_chars: int):
    """A row with the count of each short text; the chunks of longer ones, with the characters before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, part, seen, rows, held = transducer(model), TaskContext.get().partitionId(), 0, [], 0
        context = 4 * t.longest

        def sent() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string())
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[c.split()[0] for c in CHUNKS.split(", ")])
            rows.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                n_bytes, text = len(text.encode()), prepared(text)
                if len(text) <= chunk_chars:
                    rows.append((doc_id, n_bytes, t.read(text, t.start)[1], None, 0, None, None))
                else:
                    seen += 1
                    for chunk, at in enumerate(range(0, len(text), chunk_chars)):
                        rows.append((doc_id, n_bytes, None, f"{part}:{seen}", chunk, text[max(0, at - context) : at], text[at : at + chunk_chars]))
                        held += chunk_chars
                        if held > 4_000_000:
                            yield sent()
                            held = 0
                if len(rows) >= 10_000:
                    yield sent()
                    held = 0
        if rows:
            yield sent()

    return run


MAPS = "row string, chunk long, enter array<string>, leave array<string>, tokens array<long>"


def state_maps(model: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t = transducer(model)
        for batch in batches:
            found = []
            for row, chunk, before, body in zip(batch["row"], batch["chunk"], batch["before"], batch["body"], strict=True):
                entered = [t.start] if chunk == 0 else list(t.entries(before).values())
                left = [t.read(body, s) for s in entered]
                found.append((row, chunk, [s.name for s in entered], [s.name for s, _ in left], [n for _, n in left]))
            yield pd.DataFrame(found, columns=["row", "chunk", "enter", "leave", "tokens"])

    return run


def after(first: dict, second: dict) -> dict:
    """The map of two neighbours; entries that lead where ``second`` says nothing fall out."""
    return {a: (second[b][0], n + second[b][1]) for a, (b, n) in first.items() if b in second}


def compose(maps: DataFrame, fan_in: int) -> DataFrame:
    """Runs of ``fan_in`` neighbouring maps of a text as one map each."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        each = [dict(zip(e, zip(b, n, strict=True), strict=True)) for e, b, n in zip(rows["enter"], rows["leave"], rows["tokens"], strict=True)]
        whole = reduce(after, each)
        return pd.DataFrame([(key[0], key[1], list(whole), [b for b, _ in whole.values()], [n for _, n in whole.values()])], columns=["row", "chunk", "enter", "leave", "tokens"])

    return maps.withColumn("run", F.expr(f"chunk div {fan_in}")).groupBy("row", "run").applyInPandas(run, MAPS)


def read_through(model: str):
    """Counts of texts whose maps did not meet: their chunks, sorted, are read one after another."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, row, state, total = transducer(model), None, None, 0
        for batch in batches:
            done = []
            for own, body in zip(batch["row"], batch["body"], strict=True):
                if own != row:
                    if row is not None:
                        done.append((row, total))
                    row, state, total = own, t.start, 0
                state, n = t.read(body, state)
                total += n
            yield pd.DataFrame(done, columns=["row", "n_tokens"])
        if row is not None:
            yield pd.DataFrame([(row, total)], columns=["row", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model: str, limit: int = 4096, chunk_chars: int = 32_768, fan_in: int = 256) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. ``model`` is a sentencepiece byte-pair file."""
    rows = stored(documents_of(docs).mapInArrow(read_or_cut(model, chunk_chars), CHUNKS), "tokens")
    short, cut = rows.where("row is null").select("doc_id", "n_bytes", "n_tokens"), rows.where("row is not null")
    maps = stored(cut.select("row", "chunk", "before", "body").repartition("row", "chunk").mapInPandas(state_maps(model), MAPS), "state-maps")
    chunks = maps.agg(F.max("chunk")).first()[0] or 0  # one number: how many levels the scan has
    while chunks > 0:
        maps, chunks = compose(maps, fan_in), chunks // fan_in
    begin = F.array_position("enter", Transducer({}).start.name).cast("int")
    met = stored(maps.select("row", F.when(begin > 0, F.get("tokens", begin - 1)).alias("n_tokens")), "composed")
    lost = met.where("n_tokens is null").select("row")
    again = cut.join(lost, "row", "left_semi").select("row", "chunk", "body").repartition("row").sortWithinPartitions("row", "chunk").mapInPandas(read_through(model), "row string, n_tokens long")
    long = cut.where("chunk = 0").select("row", "doc_id", "n_bytes").join(met.where("n_tokens is not null").unionByName(again), "row").select("doc_id", "n_bytes", "n_tokens")
    return short.unionByName(long).withColumn("over_limit", F.col("n_tokens") > limit)


def op12_token_counts(spark, sf_dir):
    import public_tokenizers as public

    return token_counts(table(spark, sf_dir, "documents"), public.path("piece_bpe_32k.model"))
