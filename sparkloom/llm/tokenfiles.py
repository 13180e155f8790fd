"""Token ids of documents as ORC files: integers in run-length encoding, row indexes, and Bloom filters on the ids of documents.

Documents are dealt over files by ranges of doc_id and lie in that order in each. A file holds doc_id, n_tokens, the number of
ids before the document in its file, and the ids. ``parts`` beside them has a row for each file with what the files before it
hold, so that a document's place in the whole stream takes one addition. Readers get stripes as separate tasks, leave out
columns, and skip stripes and groups of rows by their ranges of doc_id and, for single documents, by Bloom filters.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunks import ByteEncoder, gathered, pieces_of
from .common import arrow_rows, documents, set_up_checkpoints

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
#: Rows between entries of the row index, bytes of a stripe, and the share of wrong answers of a Bloom filter.
INDEX_STRIDE, STRIPE_BYTES, FALSE_POSITIVES = 1000, 16 << 20, 0.01
#: Rows after which a stripe's size is looked at; documents may be long.
ROWS_BETWEEN_CHECKS = 200
#: Units whose ids are handed on together, about.
UNITS_OUT = 500_000
ROWS = "part int, doc_id long, place long, n_tokens long, ids array<int>"


@cache
def _encoder(vocabulary: str) -> ByteEncoder:
    """One for each Python worker, kept from task to task."""
    return ByteEncoder(vocabulary)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder that the session names."""
    set_up_checkpoints(spark)
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """ROWS: the ids of each row of ``docs`` and end_id; place is the number of ids before it in its partition.

    A null or empty text has end_id alone. Texts are encoded as the tokenizer does by default, special tokens' strings
    included, and whole, however long.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, at = _encoder(vocabulary), TaskContext.get().partitionId(), 0
        for table in gathered(batches, 1):
            encoder.trim()
            end = encoder.add_unit([end_id])
            n, pieces = pieces_of(table.column(1))
            docs_n, first = len(n), np.cumsum(n) - n
            coded = pieces.dictionary_encode()
            # a document's pieces, then its end
            units = np.zeros((len(pieces) + docs_n, 2), np.int32)
            places = np.arange(len(pieces)) + np.repeat(np.arange(docs_n), n)
            units[places] = encoder.units(coded.dictionary)[coded.indices.to_numpy()]
            begins = pieces.take(pa.array(first)).dictionary_encode()
            units[places[first], 0] = encoder.numbers(begins.dictionary.to_pylist(), False)[begins.indices.to_numpy()]
            units[places[first], 1] = 0
            ends = first + n + np.arange(docs_n)
            units[ends, 0] = end
            doc_ids = table.column(0).combine_chunks()
            del pieces, coded, begins, places
            # documents of about so many units are handed on together
            cuts = [0, *(np.flatnonzero(np.diff(ends // UNITS_OUT)) + 1).tolist(), docs_n]
            for a, b in zip(cuts, cuts[1:]):
                begin = int(ends[a - 1]) + 1 if a else 0
                ids, sizes = encoder.ids_of(units[begin : ends[b - 1] + 1].ravel())
                stops = np.cumsum(sizes)[2 * (ends[a:b] - begin) + 1]
                counts = np.diff(stops, prepend=0)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, stops].astype(np.int32)), pa.array(ids))
                columns = [pa.array(np.full(b - a, part, np.int32)), doc_ids.slice(a, b - a), pa.array(at + stops - counts), pa.array(counts), lists]
                yield pa.RecordBatch.from_arrays(columns, names=["part", "doc_id", "place", "n_tokens", "ids"])
                at += int(stops[-1])

    return arrow_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, ROWS)


def write_token_ids(docs: DataFrame, path: str, vocabulary: str = VOCABULARY, end_id: int = END_ID, stripe_bytes: int = STRIPE_BYTES, index_stride: int = INDEX_STRIDE) -> None:
    """The ids of all ``docs`` (doc_id, text) as files under ``path``, in ascending order of doc_id.

    Null ids come first. Rows that share a doc_id follow each other in order of their texts' hashes and texts; equal rows are
    kept as often as they occur. Ranges are of (doc_id, hash, place of the row in the input), so one frequent doc_id, even of
    equal rows, is dealt over several files. Other columns, whatever their names, are ignored. An empty table gives no rows.
    """
    row = F.monotonically_increasing_id()
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64(F.col("text").cast("string")).alias("hash"), row.alias("row"))
    dealt = keyed.repartitionByRange("doc_id", "hash", "row").sortWithinPartitions("doc_id", "hash", "text")
    writer = encode_documents(dealt, vocabulary, end_id).write.option("compression", "zstd")
    writer = writer.option("orc.stripe.size", stripe_bytes).option("orc.row.index.stride", index_stride).option("orc.rows.between.memory.checks", ROWS_BETWEEN_CHECKS)
    writer.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", FALSE_POSITIVES).orc(f"{path}/ids")
    spark = docs.sparkSession
    files = spark.read.schema(ROWS).orc(f"{path}/ids").groupBy("part").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("n_docs"), F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # a row for each file
    files.withColumn("first", before).coalesce(1).write.orc(f"{path}/parts")


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files: start is the number of ids of all documents before. Conditions on doc_id reach the files' indexes."""
    parts = spark.read.schema("part int, first long").orc(f"{path}/parts")
    rows = spark.read.schema(ROWS).orc(f"{path}/ids")
    return rows.join(parts, "part").select("doc_id", (F.col("first") + F.col("place")).alias("start"), "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of read_token_ids: crc32 of the ids as little-endian unsigned 32-bit integers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(3)
            data, at = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B"), ids.offsets.to_numpy().astype(np.int64) * 4
            crc = [zlib.crc32(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(at) // 4), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return arrow_rows(tokens, rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op12_tokenfiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-ids")
    write_token_ids(documents(spark, sf_dir), path)
    return checksums(read_token_ids(spark, path))
