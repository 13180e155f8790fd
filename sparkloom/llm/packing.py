"""Concatenate and cut: documents' token ids as one long stream, cut into fixed windows.

First pass: each partition encodes its documents and keeps running offsets of its own; the ids are written once to the
shared checkpoint folder. The totals of the partitions (one number each) give each partition's place in the stream.
Second pass: each document's ids are cut where windows end; a piece is a boundary record with its ids.
"""

from __future__ import annotations

import os
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, chain, islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, as_bytes, cut, documents, in_turn, runs

WINDOW = 2048
#: Ends each document.
END_ID = 1
VOCABULARY = "word_bpe_49k.json"
#: Words that a worker keeps encoded, their bytes, and bytes of text whose words are looked up together.
CACHED_WORDS, CACHED_BYTES, AT_ONCE = 600_000, 16_000_000, 4_000_000
#: Words, one a line, that aren't letters and then perhaps ASCII punctuation without apostrophes; of others nothing is captured.
#: The tokenizer encodes letters and punctuation apart, each as one unit.
IRREGULAR = re.compile(rb"^(?:(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+[!-&(-/:-@\[-`{-~]*|(.+))$", re.MULTILINE)
SIGNS = bytes(set(range(0x21, 0x7F)) - {0x27} - set(range(0x30, 0x3A)) - set(range(0x41, 0x5B)) - set(range(0x61, 0x7B)))
#: Ends the last token of a unit; units that are encoded in one call.
UNIT_END, AT_A_TIME = "</w>", 1000

PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def vocabulary_path(name: str) -> str:
    """``name`` if it is a file; else the file of the public tokenizers with that name."""
    if os.path.exists(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Encodes texts word by word.

    The tokenizer drops white space and never joins what stands on both sides of it, so the ids of a text are those of
    its words in turn. Words get numbers as they come, and a word's ids are found once until all are forgotten. Case goes first, as the tokenizer does it, but for texts that may
    hold a special token's string.
    """

    def __init__(self, vocabulary: str):
        # a task has one core
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary_path(vocabulary))
        tokens = self.tokenizer.get_vocab()
        self.ends_unit = np.zeros(max(tokens.values()) + 1, bool)
        self.ends_unit[[i for token, i in tokens.items() if token.endswith(UNIT_END)]] = True
        self._forget()

    def _forget(self) -> None:
        #: Numbers of words as they come, the empty one first; where the ids of each begin in ``ids``, and how many they are.
        self.numbers: defaultdict[bytes, int] = defaultdict(None, {b"": 0})
        self.numbers.default_factory = self.numbers.__len__
        self.starts, self.sizes, self.ids = np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(0, "<u4")
        self.bytes = 0

    def _units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and how many of them are each unit's."""
        groups = [units[i : i + AT_A_TIME] for i in range(0, len(units), AT_A_TIME)]
        every, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for group, found in zip(groups, self.tokenizer.encode_batch_fast([b" ".join(g).decode() for g in groups], add_special_tokens=False)):
            every.append(np.array(found.ids, "<u4"))
            sizes.append(np.diff(np.flatnonzero(self.ends_unit[every[-1]]) + 1, prepend=0))
            if len(sizes[-1]) != len(group):
                raise ValueError("the vocabulary's tokens don't end with the words")
        return np.concatenate(every), np.concatenate(sizes)

    def _learn(self, words: list[bytes]) -> None:
        """The ids of ``words``, the last that got numbers."""
        irregular = IRREGULAR.findall(b"\n".join(words)) if words else []
        other = np.fromiter(map(bool, irregular), bool, len(words))
        regular = [w for w, x in zip(words, irregular) if not x]
        letters = [w.rstrip(SIGNS) for w in regular]
        known, get = len(self.starts), self.numbers.get
        fresh: dict[bytes, int] = {}

        def place(unit: bytes) -> int:
            number = get(unit)
            return number if number is not None and number < known else fresh.setdefault(unit, known + len(fresh))

        places = np.array([[place(x), place(w[len(x) :])] for w, x in zip(regular, letters)], np.int64).reshape(-1, 2)
        ids, sizes = self._units(list(fresh))
        every = np.concatenate([self.ids, ids])
        sizes = np.r_[self.sizes, sizes]
        starts = np.r_[self.starts, len(self.ids) + np.cumsum(sizes[known:]) - sizes[known:]]
        rest = list(filter(None, irregular))
        found = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in rest], add_special_tokens=False)
        others = [np.array(x.ids, "<u4") for x in found]
        size = np.zeros(len(words), np.int64)
        size[~other], size[other] = sizes[places].sum(axis=1), [len(x) for x in others]
        order = np.r_[np.flatnonzero(~other), np.flatnonzero(other)]
        start = np.empty(len(words), np.int64)
        start[order] = len(self.ids) + np.cumsum(size[order]) - size[order]
        self.ids = np.concatenate([self.ids, runs(every, starts[places.ravel()], sizes[places.ravel()]), *others])
        self.starts, self.sizes = np.r_[self.starts, start], np.r_[self.sizes, size]
        self.bytes += sum(map(len, words))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        split = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if len(self.numbers) > CACHED_WORDS or self.bytes > CACHED_BYTES:
            self._forget()
        known, words = len(self.numbers), np.fromiter(map(len, split), np.int64, len(split))
        number = np.fromiter(map(self.numbers.__getitem__, chain.from_iterable(split)), np.int32, int(words.sum()))
        self._learn(list(islice(self.numbers, known, None)))
        size = self.sizes[number]
        ends = np.cumsum(size)
        ids = runs(self.ids, self.starts[number], size).tobytes()
        cuts = (4 * np.r_[0, ends][np.r_[0, np.cumsum(words)]]).tolist()
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]


@cache
def _encoder(vocabulary: str) -> WordEncoder:
    """One for each Python worker, kept from task to task."""
    return WordEncoder(vocabulary)


def window_ends(total: int, window: int) -> list[int]:
    """Where the stream's rest after the last full window is cut: into powers of two, largest first, so that no padding is needed."""
    at, ends = total - total % window, []
    for bit in reversed(range((total % window).bit_length())):
        if total % window >> bit & 1:
            at += 1 << bit
            ends.append(at)
    return ends


def pack_documents(docs: DataFrame, vocabulary: str = VOCABULARY, window: int = WINDOW, end_id: int = END_ID, keep_words: bool = True) -> DataFrame:
    """Pieces (PIECES) of all documents: each id lies in one piece; a sequence holds the pieces from offset 0 without gaps.

    ``ids`` are little-endian unsigned 32-bit numbers. All sequences but the last few are full; the rest of the stream
    makes sequences whose lengths are powers of two. A null or empty text has the end id alone. Repeated rows are packed
    as often as they occur; a null doc_id is carried along; other columns are ignored; an empty table gives no piece.
    Texts are encoded as the tokenizer does by default, special tokens' strings included.
    Python workers keep encoded words from task to task, which is faster, unless ``keep_words`` is false, which leaves
    memory to what runs next.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at, end = (_encoder if keep_words else WordEncoder)(vocabulary), TaskContext.get().partitionId(), 0, np.array([end_id], "<u4").tobytes()
        for batch in batches:
            texts = [text or b"" for text in as_bytes(batch.column(1))]
            ids = [x + end for x in chain.from_iterable(map(encoder.encode, in_turn(texts, AT_ONCE)))]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
            places = np.cumsum(sizes) - sizes + at
            at += int(sizes.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(ids), part, np.int32)), batch.column(0), pa.array(places), pa.array(sizes), pa.array(ids, pa.binary())],
                names=["part", "doc_id", "place", "doc_tokens", "ids"],
            )

    narrow = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    encoded = cut(arrow_rows(narrow, encode, "part int, doc_id long, place long, doc_tokens long, ids binary"))
    # one row for each partition of the input
    totals = sorted(tuple(r) for r in encoded.groupBy("part").agg(F.sum("doc_tokens")).collect())
    starts = dict(zip((p for p, _ in totals), accumulate((n for _, n in totals), initial=0)))
    total = sum(n for _, n in totals)
    full, tail = total - total % window, window_ends(total, window)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail_starts = [full, *tail]
        for batch in batches:
            parts, ids, doc_ids = (batch.column(i).to_pylist() for i in (0, 4, 1))
            out: list[list] = [[] for _ in range(7)]
            for part, place, size, doc, tokens in zip(parts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), doc_ids, ids):
                first = at = starts[part] + place
                while at < first + size:
                    if at < full:
                        sequence, begin = divmod(at, window)
                        end = at - begin + window
                    else:
                        k = next(k for k, e in enumerate(tail) if at < e)
                        sequence, begin, end = full // window + k, at - tail_starts[k], tail[k]
                    end = min(end, first + size)
                    row = (doc, at - first, end - at, size, sequence, begin, tokens[4 * (at - first) : 4 * (end - first)])
                    for column, value in zip(out, row):
                        column.append(value)
                    at = end
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:6]), pa.array(out[6], pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

    return arrow_rows(encoded, pieces, PIECES)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_documents(documents(spark, sf_dir))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
