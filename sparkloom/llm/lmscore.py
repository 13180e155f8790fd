"""Language-model scores: prediction by partial matching, next to a unigram base, for every document.

Documents are encoded in blocks: the distinct words of a block, and each token as the number of its word. Counts go
between blocks as packed buckets, by a hash of the word or of the context, so what is shuffled is distinct words and distinct
contexts of a block, never tokens. Contexts are counted over all training documents and all are kept: the model lies in
buckets by the last two bytes of context, and what a block has to look up goes to the buckets, whose scores come back. Only
counts of single bytes and of pairs of bytes, at most 65,792, are held everywhere.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ppm
from .common import arrow_rows, as_bytes, cut, documents, held_out, in_turn, runs

FOLDS = 5
#: Bytes of text in a block, about, unless a text is longer; bytes of text and entries that are scored together.
BLOCK_BYTES, AT_ONCE, SCORED_AT_ONCE = 24_000_000, 2_000_000, 1_000_000
#: Bits of a word's hash by which a block's words are in order.
HASH_BITS = 16
LEAST_BUCKETS = 16

BLOCKS = "block_id long, doc_ids array<long>, held array<boolean>, n_tokens binary, tokens binary, words binary, hashes binary, counts binary, train_docs long, train_words long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class Block:
    """Documents of a block while they are read: words get numbers as they come."""

    def __init__(self) -> None:
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.doc_ids: list[int | None] = []
        self.held: list[bool] = []
        self.tokens: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, held: bool, text: bytes) -> None:
        words = text.lower().split()
        self.doc_ids.append(doc_id)
        self.held.append(held)
        self.tokens.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.bytes += len(text)

    def row(self, block_id: int) -> pa.RecordBatch:
        words, n = list(self.numbers), len(self.numbers)
        hashes = np.fromiter(map(crc32, words), np.uint32, n) >> np.uint32(32 - HASH_BITS)
        order = np.argsort(hashes, kind="stable")
        place = np.empty(n, np.int32)
        place[order] = np.arange(n, dtype=np.int32)
        tokens = [place[t] for t in self.tokens]
        learned = [t for t, held in zip(tokens, self.held) if not held]
        counts = np.bincount(np.concatenate(learned), minlength=n) if learned else np.zeros(n, np.int64)
        words = [words[i] for i in order]
        values = [
            block_id, self.doc_ids, self.held, np.array([len(t) for t in tokens], np.int64).tobytes(), _squeezed(np.concatenate(tokens)), b"\n".join(words),
            hashes[order].astype(np.uint16).tobytes(), counts.tobytes(), len(learned), sum(map(len, learned)),
        ]
        types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), *[pa.binary()] * 5, pa.int64(), pa.int64()]
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=names)


def encode_blocks(docs: DataFrame) -> DataFrame:
    """BLOCKS of ``docs`` (doc_id, held, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, n, block = TaskContext.get().partitionId() << 32, 0, Block()
        for batch in batches:
            for doc_id, held, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))):
                block.add(doc_id, held, text or b"")
                if block.bytes >= BLOCK_BYTES:
                    yield block.row(first + n)
                    n, block = n + 1, Block()
        if block.doc_ids:
            yield block.row(first + n)

    return arrow_rows(docs, rows, BLOCKS)


def _bucket_slices(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket begins among hashes in order, and their end; ``buckets`` is a power of two."""
    return np.searchsorted(hashes, np.arange(buckets + 1, dtype=np.int64) * ((1 << HASH_BITS) // buckets))


def word_counts(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block_id, bucket, counts binary, distinct long): for each block's words of a bucket how often training documents have them.

    ``distinct``, on one row of each bucket, is the number of its words that training documents have, and 0 elsewhere.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words, hashes, counts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words, counts = words.split(b"\n"), np.frombuffer(counts, np.int64)
                starts = _bucket_slices(np.frombuffer(hashes, np.uint16), buckets)
                for b in np.flatnonzero(np.diff(starts)).tolist():
                    part = slice(starts[b], starts[b + 1])
                    values = [block, b, b"\n".join(words[part]), counts[part].tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["block_id", "bucket", "words", "counts"])

    def merge(parts: pd.DataFrame) -> pd.DataFrame:
        total: dict[bytes, int] = {}
        get, words = total.get, [w.split(b"\n") for w in parts["words"]]
        for ws, counts in zip(words, parts["counts"]):
            for w, c in zip(ws, np.frombuffer(counts, np.int64).tolist()):
                if c:
                    total[w] = get(w, 0) + c
        found = [np.fromiter((get(w, 0) for w in ws), np.int64, len(ws)).tobytes() for ws in words]
        return pd.DataFrame({"block_id": parts["block_id"], "bucket": parts["bucket"], "counts": found, "distinct": [len(total)] + [0] * (len(parts) - 1)})

    packed = blocks.select("block_id", "words", "hashes", "counts").where(F.length("hashes") > 0)
    packed = packed.mapInArrow(split, "block_id long, bucket int, words binary, counts binary")
    return packed.groupBy("bucket").applyInPandas(merge, "block_id long, bucket int, counts binary, distinct long")


def _squeezed(tokens: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(tokens.astype(np.int32).tobytes())


def _tokens(row: dict) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(row["tokens"]), np.int32)


def _texts(row: dict) -> Iterator[bytes]:
    """The normalised texts of a block."""
    words = np.frombuffer(row["words"] + b"\n", np.uint8)
    ends = np.flatnonzero(words == 0x0A) + 1
    # each word with a space after it
    words = np.where(words == 0x0A, np.uint8(ppm.SPACE), words)
    sizes = np.diff(ends, prepend=0)
    starts, tokens = ends - sizes, _tokens(row)
    last = np.cumsum(np.frombuffer(row["n_tokens"], np.int64))
    first = last - np.frombuffer(row["n_tokens"], np.int64)
    length = np.cumsum(np.r_[0, sizes[tokens]])
    at = 0
    while at < len(last):
        # documents of about AT_ONCE bytes, one at least
        to = max(at + 1, int(np.searchsorted(length[last], length[first[at]] + AT_ONCE)))
        part = tokens[first[at] : last[to - 1]]
        data, base = runs(words, starts[part], sizes[part]).tobytes(), int(length[first[at]])
        for a, b in zip((length[first[at:to]] - base).tolist(), (length[last[at:to]] - base).tolist()):
            yield data[a : max(a, b - 1)]
        at = to


def _distinct(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The entries of ``texts`` in order and how often each occurs."""
    keys, counts, parts = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
    folded = lambda: ppm.count_keys(np.concatenate([keys, *(k for k, _ in parts)]), np.concatenate([counts, *(c for _, c in parts)]))
    for group in in_turn(texts, AT_ONCE):
        parts.append(ppm.count_keys(ppm.entry_keys(ppm.windows(group)[0], order)))
        if sum(len(k) for k, _ in parts) > max(4_000_000, 2 * len(keys)):
            (keys, counts), parts = folded(), []
    return folded()


def _entries_row(block_id: int, bucket: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([block_id], pa.int64()), pa.array([bucket], pa.int32()), pa.array([_packed(keys, counts)])], names=["block_id", "bucket", "entries"])


def all_pairs(entries: DataFrame) -> np.ndarray:
    """How often each pair of bytes occurs in training documents, from the entries of bucket -1; combined in each task, 65,536 numbers."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for data in batch.column(0).to_pylist():
                keys, counts = _unpacked(data)
                table[keys.astype(np.int64)] += counts
        some = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(table[some])], names=["pair", "n"])

    pairs = np.zeros(1 << 16, np.int64)
    for row in arrow_rows(entries.where("bucket < 0").select("entries"), add, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 65,536 at most
        pairs[row["pair"]] = row["n"]
    return pairs


def block_entries(blocks: DataFrame, buckets: int, order: int) -> DataFrame:
    """(block_id, bucket, entries): the distinct entries of each block, packed, and how often its training documents have them; in bucket -1 their pairs of bytes.

    Buckets go by the last two bytes of context, which entries and contexts of all orders but the two lowest share.
    """

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, counts = _distinct(list(compress(_texts(row), [not x for x in row["held"]])), order)
                others, none = _distinct(list(compress(_texts(row), row["held"])), order)
                pairs = ppm.pair_counts(keys, counts, order)
                some = np.flatnonzero(pairs)
                yield _entries_row(row["block_id"], -1, some.astype(np.uint64), pairs[some])
                keys, counts = ppm.count_keys(np.concatenate([keys, others]), np.concatenate([counts, 0 * none]))
                for b, part in _by_bucket(keys, buckets, order):
                    yield _entries_row(row["block_id"], b, keys[part], counts[part])

    return arrow_rows(blocks.select("block_id", "held", "n_tokens", "tokens", "words"), split, "block_id long, bucket int, entries binary")


def entry_scores(entries: DataFrame, pairs: np.ndarray, order: int) -> DataFrame:
    """(block_id, bucket, entries, scores): log10 of the probability of each of a block's entries of a bucket, after all training documents.

    ``pairs`` are the counts of pairs of bytes in training documents.
    """
    low = ppm.low_orders(pairs)

    def score(parts: pd.DataFrame) -> pd.DataFrame:
        each = [_unpacked(x) for x in parts["entries"]]
        keys, counts = ppm.count_keys(*(np.concatenate(x) for x in zip(*each)))
        entries = keys[counts > 0], counts[counts > 0]
        found, totals = [], []
        for k in range(order, 1, -1):
            found.insert(0, entries)
            totals.insert(0, ppm.context_totals(*entries, k))
            entries = ppm.shorter(*entries)
        model = ppm.Model([e for e, _ in low] + found, [t for _, t in low] + totals)
        scores = [np.zeros(0, np.float32)]
        for i in range(0, len(keys), SCORED_AT_ONCE):
            scores.append(model.score(keys[i : i + SCORED_AT_ONCE] << np.uint64(8 * (7 - order))).astype(np.float32))
        scores = np.concatenate(scores)
        return pd.DataFrame({"block_id": parts["block_id"], "bucket": parts["bucket"], "entries": parts["entries"], "scores": [scores[np.searchsorted(keys, k)].tobytes() for k, _ in each]})

    return entries.where("bucket >= 0").groupBy("bucket").applyInPandas(score, "block_id long, bucket int, entries binary, scores binary")


def _by_bucket(keys: np.ndarray, buckets: int, order: int) -> Iterator[tuple[int, np.ndarray]]:
    """Buckets and the places of their entries, in order."""
    bucket = ((keys >> np.uint64(8 * (order - 2)) & np.uint64(0xFFFF)) * ppm.MIX >> np.uint64(40)).astype(np.int64) % buckets
    by = np.argsort(bucket, kind="stable")
    starts = np.searchsorted(bucket[by], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(starts)).tolist():
        yield b, by[starts[b] : starts[b + 1]]


def _packed(keys: np.ndarray, counts: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(np.diff(keys, prepend=np.uint64(0)).tobytes() + counts.astype(np.int64).tobytes())


def _unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(data)
    return np.cumsum(np.frombuffer(data, np.uint64, len(data) // 16)), np.frombuffer(data, np.int64, offset=len(data) // 2)


def score_documents(docs: DataFrame, order: int = ppm.ORDER) -> DataFrame:
    """SCORES of each row of ``docs``, learning from rows whose crc32 of doc_id doesn't leave 1 over 5.

    A null text is empty and has the end mark alone. A null doc_id counts as the empty text in the crc32. Repeated rows are
    learned from and scored as often as they occur. Without training rows all symbols are alike and the base is
    log10(0.5 / 0.5) = 0 for a token. An empty table gives no row. Other columns are ignored.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id").cast("long"), FOLDS).alias("held"), F.col("text").cast("string").alias("text"))
    blocks = cut(encode_blocks(read))
    sums = blocks.agg(F.count("*").alias("n"), F.coalesce(F.sum("train_docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("train_words"), F.lit(0)).alias("words")).first()
    # four for each block, so that what a bucket gathers is a fraction of what a block holds
    buckets = min(1 << HASH_BITS, max(LEAST_BUCKETS, 4 << (max(1, sums["n"]) - 1).bit_length()))
    counts = cut(word_counts(blocks, buckets))
    entries = cut(block_entries(blocks, buckets, order))
    looked_up = entry_scores(entries, all_pairs(entries), order)
    n_docs, distinct = sums["docs"], counts.agg(F.coalesce(F.sum("distinct"), F.lit(0))).first()[0]

    total, kinds = sums["words"] + n_docs, distinct + (n_docs > 0)
    log_of = lambda c: np.log10((c + 0.5) / (total + 0.5 * (kinds + 1)))

    def score(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame({c.split()[0]: [] for c in SCORES.split(", ")})
        row = block.iloc[0]
        tokens, sizes = _tokens(row), np.frombuffer(row["n_tokens"], np.int64)
        found = found.sort_values("bucket")
        c = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x, np.int64) for x in found["counts"] if x is not None)])
        ends = np.cumsum(sizes)
        by_doc = lambda each: np.diff(np.r_[0, np.r_[0, np.cumsum(each[tokens])][ends]])
        some = [(_unpacked(e)[0], np.frombuffer(x, np.float32)) for e, x in zip(found["entries"], found["scores"]) if x is not None]
        of_key = np.concatenate([np.zeros(0, np.float32), *(x for _, x in some)])
        table, scores = ppm.Table(np.concatenate([np.zeros(0, np.uint64), *(k for k, _ in some)])), [np.zeros(0)]
        del some, found
        for group in in_turn(_texts(row), AT_ONCE):
            windows, lengths = ppm.windows(group)
            each = of_key[table.find(ppm.entry_keys(windows, order))].astype(np.float64)
            scores.append(np.add.reduceat(each, np.r_[0, np.cumsum(lengths)[:-1]]))
        return pd.DataFrame({
            "doc_id": pd.array([None if x is None or x != x else int(x) for x in row["doc_ids"]], dtype="Int64"),
            "held_out": row["held"], "n_tokens": sizes + 1, "n_known": by_doc((c > 0).astype(np.int64)) + (n_docs > 0), "train_tokens": total,
            "base_score": by_doc(log_of(c)) + log_of(n_docs), "score": np.concatenate(scores),
        })

    left = blocks.select("block_id", "doc_ids", "held", "n_tokens", "tokens", "words")
    back = counts.select("block_id", "bucket", "counts", F.lit(None).cast("binary").alias("entries"), F.lit(None).cast("binary").alias("scores"))
    back = back.union(looked_up.select("block_id", "bucket", F.lit(None).cast("binary"), "entries", "scores"))
    return left.groupBy("block_id").cogroup(back.groupBy("block_id")).applyInPandas(score, SCORES)


def op6_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(documents(spark, sf_dir))
