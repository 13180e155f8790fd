"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over bytes and a mark for the end of a word. Where a node has no edge for the next byte, its
failure link leads to the node that stands for what remains unmatched once the longest pieces before it are cut off; how
many pieces that are is kept with the node. A word's number of greedy longest-match pieces is thus found in time linear in
its length, and no piece is ever built.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, as_bytes, documents, in_turn
from .packing import AT_ONCE, CACHED_BYTES, UNIT_END, VOCABULARY, vocabulary_path

#: Counts of words that a worker keeps.
CACHED_WORDS = 300_000
#: Stands for the end of a word among the bytes.
END = 256


def byte_of_character() -> dict[str, int]:
    """The bytes that byte-level vocabularies write as characters: printable ones as themselves, the others from 256 on, in order."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def read_pieces(vocabulary: str) -> list[tuple[int, ...]]:
    """The vocabulary's pieces as bytes, with END at their end if they end a word; special tokens are left out."""
    with open(vocabulary_path(vocabulary), encoding="utf-8") as file:
        content = json.load(file)
    special, byte = {t["content"] for t in content["added_tokens"]}, byte_of_character()
    pieces = []
    for token in content["model"]["vocab"]:
        if token not in special:
            letters, ends = token.removesuffix(UNIT_END), token.endswith(UNIT_END) and token != UNIT_END
            pieces.append((*(byte[c] for c in letters), *[END] * ends))
    return pieces


class LongestMatch:
    """The automaton. Node 0 is the root; edges are keyed by node and byte together."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        self.edges: dict[int, int] = {}
        parents, labels, is_piece = [-1], [-1], [False]
        for piece in pieces:
            node = 0
            for byte in piece:
                key = node << 9 | byte
                if key not in self.edges:
                    self.edges[key] = len(parents)
                    parents.append(node)
                    labels.append(byte)
                    is_piece.append(False)
                node = self.edges[key]
            is_piece[node] = node != 0
        # an end that no piece takes in is left over and counts nothing
        bare_end = self.edges.setdefault(END, len(parents))
        if bare_end == len(parents):
            parents.append(0)
            labels.append(END)
            is_piece.append(True)
        depth = [0] * len(parents)
        for node in range(1, len(parents)):
            depth[node] = depth[parents[node]] + 1
        self.failure, self.popped = [-1] * len(parents), [0] * len(parents)
        for node in sorted(range(1, len(parents)), key=depth.__getitem__):
            if is_piece[node]:
                self.failure[node], self.popped[node] = 0, int(node != bare_end)
                continue
            at, count = self.failure[parents[node]], self.popped[parents[node]]
            while at >= 0 and (at << 9 | labels[node]) not in self.edges:
                count += self.popped[at]
                at = self.failure[at]
            self.failure[node], self.popped[node] = (self.edges[at << 9 | labels[node]], count) if at >= 0 else (-1, 0)

    def count(self, word: bytes) -> int:
        """Pieces of ``word``; a word that the vocabulary can't spell is one unknown piece."""
        edges, failure, popped = self.edges, self.failure, self.popped
        node = pieces = 0
        for byte in (*word, END):
            while (step := edges.get(node << 9 | byte, -1)) < 0:
                pieces += popped[node]
                node = failure[node]
                if node < 0:
                    return 1
            node = step
        while node:
            pieces += popped[node]
            node = failure[node]
            if node < 0:
                return 1
        return pieces


@cache
def _automaton(vocabulary: str) -> tuple[LongestMatch, dict[bytes, int]]:
    """The automaton and the counts of words seen so far: one of each for each Python worker."""
    return LongestMatch(read_pieces(vocabulary)), {}


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_words, n_tokens) of each row of ``docs``: words of the text in lower case (A-Z), and their greedy pieces.

    A null or empty text has none. Repeated rows and null ids are counted like others. An empty table gives no row. Other
    columns are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, known = _automaton(vocabulary)
        for batch in batches:
            words_of, tokens_of = [], []
            for texts in in_turn([t or b"" for t in as_bytes(batch.column(1))], AT_ONCE):
                split = [t.lower().split() for t in texts]
                new = (words := set().union(*split)).difference(known)
                if len(known) + len(new) > CACHED_WORDS:
                    known.clear()
                    new = words
                known.update((w, automaton.count(w)) for w in new)
                words_of += map(len, split)
                tokens_of += [sum(map(known.__getitem__, ws)) for ws in split]
                for word in new:
                    if len(word) > CACHED_BYTES:
                        del known[word]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words_of, pa.int64()), pa.array(tokens_of, pa.int64())], names=["doc_id", "n_words", "n_tokens"])

    return arrow_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, "doc_id long, n_words long, n_tokens long")


def op7_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(documents(spark, sf_dir))
