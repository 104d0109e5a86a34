"""Word shingles of whole texts as 64-bit hashes, made with array operations over the bytes of many texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from larder.llm.common import text_slices, utf8

K = 5
_RNG = np.random.default_rng(20240229)
_LETTER = _RNG.integers(0, 1 << 64, 256, np.uint64)
_LETTER[65:91] = _LETTER[97:123]
_MULT = _RNG.integers(0, 1 << 64, K + 1, np.uint64) | np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A finalising permutation of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(max(n, 64), _MULT[K], np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased) of texts that lie end to end, and the index of each text's first word."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    letter = ~_IS_SPACE[data]
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = letter[heads]
    at = np.flatnonzero(first)
    starts = np.searchsorted(at, offsets)
    if not len(at):
        return np.zeros(0, np.uint64), starts
    packed = data[letter]
    word_at = np.cumsum(letter, dtype=np.int64)[at] - 1
    sizes = np.diff(np.append(word_at, len(packed)))
    place = np.arange(len(packed)) - np.repeat(word_at, sizes)
    sums = np.add.reduceat(_LETTER[packed] * _powers(int(sizes.max()))[place], word_at)
    return mixed(sums + sizes.astype(np.uint64)), starts


def _sets_of(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    words, starts = word_hashes(data, offsets)
    if len(words) >= K:
        sums = words[: len(words) - K + 1] * _MULT[0]
        for k in range(1, K):
            sums += words[k : len(words) - K + 1 + k] * _MULT[k]
        runs = mixed(sums)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        if b - a >= K:
            yield np.unique(runs[a : b - K + 1])
        elif b > a:
            yield mixed(np.array([(words[a:b] * _MULT[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: K consecutive words, all words of a shorter text, none of an empty one."""
    for a, b in text_slices(texts):
        yield from _sets_of(*utf8(texts.slice(a, b - a)))
