"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
DOC_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def ascii_lower(column: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(column, UPPER, LOWER)


def set_up_checkpoints(spark: SparkSession) -> None:
    """The cluster names the shared folder in spark.checkpoint.dir; only on one machine (as in tests) one is made without it."""
    if not spark.conf.get("spark.checkpoint.dir", "") and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="loom-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared checkpoint folder, its lineage cut; it survives lost executors."""
    set_up_checkpoints(df.sparkSession)
    done = df.checkpoint(eager=True)
    del df
    # shuffle files of finished steps go when the driver's garbage is collected
    gc.collect()
    done.sparkSession.sparkContext._jvm.System.gc()
    return done


#: Bytes of an Arrow batch, about: a task's memory doesn't grow with the length of texts times a fixed number of rows.
BATCH_BYTES = 4_194_304


def arrow_rows(df: DataFrame, rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``rows`` of each partition, in batches of BATCH_BYTES, a setting that stays with the session; then the Python worker, which waits for other tasks, gives memory back."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from rows(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)

    return df.mapInArrow(run, schema)


def quoted(name: str) -> str:
    """A column's name as F.col takes it, whatever signs it holds."""
    return "`" + name.replace("`", "``") + "`"


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df`` as one struct, out of the way of names that an operator adds; getField takes them out again."""
    return F.struct(*(F.col(quoted(c)).alias(c) for c in df.columns))


def repeats_ids(df: DataFrame) -> bool:
    """Whether rows of ``df`` share a doc_id, or have none in common."""
    return (df.groupBy(F.col("doc_id").cast("long").alias("doc_id")).count().agg(F.max("count")).first()[0] or 0) > 1


def row_key(df: DataFrame) -> Column:
    """A digest of all columns, the same for equal rows: tells rows apart that share a doc_id or have none."""
    return F.md5(F.to_json(whole_row(df), {"ignoreNullFields": "false"}).cast("binary"))


#: Places of a table that are added up and sent together, and values that a task counts at a time.
PART_BITS, COUNTED_AT_ONCE = 16, 4_000_000


def packed_table(
    df: DataFrame, places: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]], bits: int, kind: np.dtype, finish: Callable[[np.ndarray], np.ndarray]
) -> Iterator[tuple[int, np.ndarray, int]]:
    """(first place, what ``finish`` makes of the counts, their sum) for each part of a table of 2^``bits`` places that has any of the ``places`` of ``df``.

    Places are counted in each task before they are sent, packed by part; executors add up the parts, row by row, held as
    ``kind`` (of one byte: whether there is any). What reaches the driver has a fixed size.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            found = np.sort(np.concatenate(waiting).astype(np.uint32))
            first = np.flatnonzero(np.r_[True, found[1:] != found[:-1]])
            n, found = np.diff(np.r_[first, len(found)]).astype(np.uint32), found[first]
            part, at = found >> np.uint32(PART_BITS), found.astype(np.uint16)
            parts = np.unique(part)
            edges = [*np.searchsorted(part, parts).tolist(), len(part)]
            slices = [slice(a, b) for a, b in zip(edges, edges[1:])]
            return pa.RecordBatch.from_arrays([pa.array(parts.astype(np.int32)), pa.array([at[s].tobytes() for s in slices]), pa.array([n[s].tobytes() for s in slices])], names=["part", "at", "n"])

        for found in places(batches):
            if len(found):
                waiting.append(found)
            if sum(map(len, waiting)) >= COUNTED_AT_ONCE:
                yield counted()
                waiting = []
        if waiting:
            yield counted()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        totals: dict[int, int] = {}
        for batch in batches:
            for p, at, n in zip(*(c.to_pylist() for c in batch.columns)):
                at, n = np.frombuffer(at, np.uint16), np.frombuffer(n, np.uint32)
                if p not in tables:
                    tables[p], totals[p] = np.zeros(1 << PART_BITS, kind), 0
                if kind.itemsize == 1:
                    tables[p][at] = 1
                else:
                    tables[p][at] += n
                totals[p] += int(n.sum())
        for p, table in tables.items():
            yield pa.RecordBatch.from_arrays([pa.array([p << PART_BITS]), pa.array([finish(table).tobytes()]), pa.array([totals[p]])], names=["first", "data", "n"])

    dealt = arrow_rows(df, count, "part int, at binary, n binary").repartition(F.col("part"))
    for row in arrow_rows(dealt, add, "first long, data binary, n long").collect():
        yield row["first"], np.frombuffer(row["data"], np.uint8), row["n"]


def in_turn(texts: Iterable[bytes], at_once: int) -> Iterator[list[bytes]]:
    """``texts`` in groups of about ``at_once`` bytes, or of one longer text."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > at_once:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group


def runs(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of ``values``, one after another."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The values of a string column as UTF-8, without decoding them."""
    return column.cast(pa.large_binary()).to_pylist()


def training_row(doc_id: Column, folds: int) -> Column:
    """True unless crc32 of doc_id's decimal text leaves 1 over ``folds``; a null id counts as the empty text."""
    return ~held_out(doc_id, folds)


def held_out(doc_id: Column, folds: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds == 1


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the undirected ``edges`` (a, b); root is the least node that can be reached.

    Alternates large-star and small-star steps until nothing changes. Each step is a grouped minimum, combined before
    the shuffle, and an equi-join whose hot keys can be split; only two numbers a round reach the driver.
    """
    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _signature(edges)
    while True:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut(small.union(least).distinct())
        now = _signature(edges)
        if now == seen:
            return edges.toDF("node", "root").union(edges.select("b", "b").distinct())
        seen = now


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
