"""Token counts by a linear longest-match automaton.

A vocabulary trie gets failure links and, for each node, the number of tokens that are popped when the link is
taken. Reading a word then takes one step a byte plus the links, and gives the number of greedy longest-match
pieces without building a piece. A vocabulary is a file of byte-level pieces, so that a word is a space and its bytes.
Each distinct word of a task is read once (a bounded memo).

Words are the runs without ASCII white space of the whole text. Defined cases: null and empty texts have no words and
no tokens; a word that the pieces can't make up is one unknown token (in a vocabulary with all bytes there is none); very
long texts and words are read whole by one task, in memory in proportion to the text; equal texts, also of one id, give
equal rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

#: Words a task remembers before it starts anew.
MEMO = 400_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next free code point from 256."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def load_vocabulary(path: str) -> list[bytes]:
    """Pieces as bytes; entries outside the byte alphabet (special tokens) are left out. An error if the file has no pieces."""
    letters = byte_alphabet()
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f).get("model", {}).get("vocab")
    if not vocab:
        raise ValueError(f"{path} is no tokenizer file: it has no model.vocab")
    return [bytes(letters[c] for c in piece) for piece in vocab if piece and all(c in letters for c in piece)]


class LongestMatch:
    """The automaton. Edges: node * 256 + byte -> node; node 0 is the root."""

    def __init__(self, pieces: list[bytes]):
        edges: dict[int, int] = {}
        parent, label, is_piece = [0], [0], [False]
        for piece in pieces:
            at = 0
            for b in piece:
                key = at << 8 | b
                if key not in edges:
                    edges[key] = len(parent)
                    parent.append(at)
                    label.append(b)
                    is_piece.append(False)
                at = edges[key]
            is_piece[at] = True
        order, depth = [], [0] * len(parent)
        for v in range(1, len(parent)):  # a parent has a smaller number than its children
            depth[v] = depth[parent[v]] + 1
        order = sorted(range(1, len(parent)), key=depth.__getitem__)
        link, popped = [-1] * len(parent), [0] * len(parent)
        for v in order:
            if is_piece[v]:
                link[v], popped[v] = 0, 1
                continue
            z, count = link[parent[v]], popped[parent[v]]
            while z >= 0 and (z << 8 | label[v]) not in edges:
                count += popped[z]
                z = link[z]
            if z >= 0:
                link[v], popped[v] = edges[z << 8 | label[v]], count
        self.edges, self.link, self.popped = edges, link, popped

    def count(self, word: bytes) -> int:
        """Pieces of a word; -1 if it can't be split."""
        edges, link, popped = self.edges, self.link, self.popped
        at = n = 0
        for b in word:
            while (to := edges.get(at << 8 | b)) is None:
                n += popped[at]
                at = link[at]
                if at < 0:
                    return -1
            at = to
        while at:
            n += popped[at]
            at = link[at]
            if at < 0:
                return -1
        return n


class _Memo(dict):
    def __init__(self, automaton: LongestMatch):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self[word] = max(self.automaton.count(b" " + word), 1)  # unknown: one token
        return n


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens and the tokens of the longest word, over whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(LongestMatch(load_vocabulary(vocabulary)))  # bounded by the vocabulary

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memo = _Memo(shared.value)
        for b in batches:
            words, tokens, most = [], [], []
            for text in b["text"]:
                own = text.encode().split() if text else []
                counts = list(map(memo.__getitem__, own))
                words.append(len(own))
                tokens.append(sum(counts))
                most.append(max(counts, default=0))
                if len(memo) > MEMO:
                    memo.clear()
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_words": words, "n_tokens": tokens, "max_word_tokens": most})

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInPandas(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_words bigint, n_tokens bigint, max_word_tokens bigint")
