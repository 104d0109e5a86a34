"""Optimal-string-alignment distance (a swap of neighbours is one edit): of pairs that blocking has already made few, and of a word to all words of a trie."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def osa(a: str, b: str, most: int) -> int:
    """The distance, or most + 1 if it is greater."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most and min(row) >= most:  # a swap goes through the row before
            return most + 1
        before, row = row, new
    return min(row[-1], most + 1)


class _Node:
    __slots__ = ("children", "place", "least")

    def __init__(self) -> None:
        self.children: dict[str, _Node] = {}
        #: Place of the first word that ends here, and the least place of all words below.
        self.place: int | None = None
        self.least: int = 0


class WordTrie:
    """Words by their letters. A search carries one row of distances down the trie, so words with one start share its cost."""

    def __init__(self, words: Iterable[str]) -> None:
        self.root = _Node()
        for place, word in enumerate(words):
            node = self.root
            for letter in word:
                if letter not in node.children:
                    node.children[letter] = new = _Node()
                    new.least = place
                node = node.children[letter]
            if node.place is None:
                node.place = place

    def start_of(self, word: str, shortest: int) -> int | None:
        """The first place of a word of at least so many letters that ``word`` starts with."""
        node, found = self.root, []
        for depth, letter in enumerate(word, 1):
            node = node.children.get(letter)
            if node is None:
                break
            if depth >= shortest and node.place is not None:
                found.append(node.place)
        return min(found, default=None)

    def has_start(self, start: str) -> bool:
        """Whether some word starts with ``start``."""
        node = self.root
        for letter in start:
            node = node.children.get(letter)
            if node is None:
                return False
        return bool(node.children) or node.place is not None

    def near(self, word: str, most: int, shortest: int = 0) -> int | None:
        """The first place of a word of at least so many letters within ``most`` edits."""
        n, best = len(word), None
        if self.root.place is not None and not shortest and n <= most:
            best = self.root.place
        open_ = [(child, letter, "", list(range(n + 1)), None, 1) for letter, child in self.root.children.items()]
        while open_:
            node, letter, last, row, before, depth = open_.pop()
            if best is not None and node.least >= best:
                continue
            new = [depth]
            for j, own in enumerate(word, 1):
                d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (own != letter))
                if before is not None and j > 1 and own == last and word[j - 2] == letter:
                    d = min(d, before[j - 2] + 1)
                new.append(d)
            if node.place is not None and depth >= shortest and new[n] <= most and (best is None or node.place < best):
                best = node.place
            # words further down can only be near through this row, or by a swap through the row before it
            if min(new) <= most or min(row) < most:
                open_ += [(child, x, letter, new, row, depth + 1) for x, child in node.children.items()]
        return best


#: Tries that a task keeps for rows with the same words.
_TRIES_KEPT = 64


class TriesByPool:
    """The trie of a list of words, built once for neighbouring rows that share the list."""

    def __init__(self) -> None:
        self._kept: dict[tuple[str, ...], WordTrie] = {}

    def of(self, pool: Iterable[str]) -> WordTrie:
        key = tuple(pool)
        if key not in self._kept:
            if len(self._kept) >= _TRIES_KEPT:
                self._kept.clear()
            self._kept[key] = WordTrie(key)
        return self._kept[key]


@F.pandas_udf(IntegerType())
def _osa(a: pd.Series, b: pd.Series, most: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else osa(x, y, int(m)) for x, y, m in zip(a, b, most, strict=True)], dtype="Int32")


def osa_distance(a: Column, b: Column, most: Column | int) -> Column:
    """OSA distance of two columns, cut off at most + 1; null for a null."""
    return _osa(a, b, F.lit(most) if isinstance(most, int) else most.cast("int"))
