"""Phrases found in tokenised texts by one automaton: a trie over tokens with failure links.

The table of phrases is compiled once on the driver (its size is that of the rule table, not of the data) and sent with the function. A text's tokens are
read once, whatever the number and the length of phrases; nothing is exploded and nothing is shuffled.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Automaton:
    """``phrases``: token sequences; those without a token are never found."""

    def __init__(self, phrases: Iterable[Sequence[str]]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[int]] = [[]]  # phrases that end in this state, the longest first
        self.fail: list[int] = [0]
        self.lengths: list[int] = []
        for number, phrase in enumerate(phrases):
            self.lengths.append(len(phrase))
            state = 0
            for token in phrase:
                if token not in self.next[state]:
                    self.next[state][token] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                    self.fail.append(0)
                state = self.next[state][token]
            if phrase:
                self.ends[state].append(number)
        waiting = deque(self.next[0].values())
        while waiting:  # by depth, so that a failure link's own ends are complete
            state = waiting.popleft()
            for token, to in self.next[state].items():
                self.fail[to] = self.step(self.fail[state], token)
                self.ends[to] += self.ends[self.fail[to]]
                waiting.append(to)

    def step(self, state: int, token: str) -> int:
        while token not in self.next[state]:
            if not state:
                return 0
            state = self.fail[state]
        return self.next[state][token]

    def found(self, tokens: Iterable[str]) -> Iterable[tuple[int, int]]:
        """(place of the first token, phrase) of every occurrence."""
        state = 0
        for k, token in enumerate(tokens):
            state = self.step(state, token)
            for phrase in self.ends[state]:
                yield k + 1 - self.lengths[phrase], phrase


def first_of_each(tokens: Column, phrases: Sequence[tuple[Sequence[str], int]], groups: int) -> Column:
    """Of each group of phrases (``phrases``: tokens and group, below ``groups``) the occurrence that counts, as (group, at, phrase): the earliest of several
    words, else the earliest word; of two at one place the one that is first as text. Null tokens: none."""
    texts = [" ".join(p) for p, _ in phrases]
    group_of, longer = [g for _, g in phrases], [len(p) > 1 for p, _ in phrases]
    automaton = Automaton([tuple(p) for p, _ in phrases])

    @F.pandas_udf("array<struct<grp:int,at:bigint,phrase:string>>")
    def search(column: pd.Series) -> pd.Series:
        def of(row) -> list[dict]:
            best: dict[int, tuple] = {}
            for at, phrase in automaton.found(row if row is not None else ()):
                rank = (not longer[phrase], at, texts[phrase])
                held = best.get(group_of[phrase])
                if held is None or rank < held:
                    best[group_of[phrase]] = rank
            return [{"grp": g, "at": at, "phrase": text} for g, (_, at, text) in sorted(best.items())]

        return column.map(of)

    return search(tokens)
