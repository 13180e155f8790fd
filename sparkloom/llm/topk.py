"""Exact top-k inner-product search over an impact-ordered index, score at a time.

The integer vectors are packed into blocks of one shape of rows each. A block's index, made once for all its queries, holds its
postings (dimension, vector, impact) in segments of descending quantised impact: the bit length of |component|, so a segment
holds components of one power of two. Queries, the smaller side, go to every block in groups; the index never moves again. For
a block and a group segments are processed in descending impact; after each one, a vector's score so far and the norm of its
unprocessed postings bound its score from both sides. Accumulation stops only once few vectors can still be members of a
query's top k, or nothing is left; all possible members are then scored exactly in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_rows, cut

SCALE, K, QUERY_EVERY = 64.0, 20, 20
#: Vectors in a block, queries in a group.
BLOCK, QUERY_BLOCK = 4096, 512
#: Few vectors make smaller blocks, down to this many in each, so that each core gets some TASKS_A_CORE blocks.
SMALL_BLOCK, TASKS_A_CORE = 256, 2
#: Possible members for each query, as a multiple of k, at which exact scoring is cheaper than another segment.
FEW = 8
#: A segment is kept as lists if it has postings in fewer than one of so many places.
DENSE = 8
#: Whole numbers up to this are exact in double precision.
EXACT = 2.0**53


def quantised(vector: Column, scale: float = SCALE) -> Column:
    """floor(scale * x) of each component as double; null if the vector is null or has a null or non-finite component."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double")))


class Segment:
    """The postings of one impact: for each dimension that has any, the vectors and their components."""

    def __init__(self, part: np.ndarray):
        vectors, dimensions = np.nonzero(part)
        order = np.argsort(dimensions, kind="stable")
        self.vectors, dimensions = vectors[order], dimensions[order]
        self.values = part[self.vectors, dimensions]
        self.dimensions, first = np.unique(dimensions, return_index=True)
        self.slices = [slice(a, b) for a, b in zip(first.tolist(), [*first[1:].tolist(), len(dimensions)])]

    def add_to(self, scores: np.ndarray, queries: np.ndarray) -> None:
        """Adds to ``scores`` (vectors x queries) what the postings bring: a vector is at most once in a dimension's list."""
        for d, part in zip(self.dimensions.tolist(), self.slices):
            scores[self.vectors[part]] += self.values[part][:, None] * queries[:, d][None, :]


class Index:
    """Segments of a block (vectors x dimensions) by descending impact, each with the norms of what is left after it."""

    def __init__(self, block: np.ndarray):
        self.block, self.segments, self.rests = block, [], []
        _, impact = np.frexp(np.abs(block))
        rest = block
        for i in sorted(set(impact[block != 0].ravel().tolist()), reverse=True):
            part = np.where(impact == i, block, 0)
            rest = rest - part
            # lists for few postings, the plain matrix where most places have one
            self.segments.append(Segment(part) if np.count_nonzero(part) * DENSE < part.size else part)
            self.rests.append(np.linalg.norm(rest, axis=1))


def search_block(queries: np.ndarray, index: Index, own: np.ndarray, k: int, few: int = FEW) -> np.ndarray:
    """Which vectors of the block can be among a query's k best of the block: a mask (queries x vectors) that misses none.

    ``own`` marks pairs that take no part.
    """
    n = len(index.block)
    if n <= k:
        return ~own
    scores = np.zeros((n, len(queries)))
    norms = np.linalg.norm(queries, axis=1)[:, None]
    possible = ~own
    for part, rest in zip(index.segments, index.rests):
        if isinstance(part, Segment):
            part.add_to(scores, queries)
        else:
            scores += part @ queries.T
        bound = norms * rest[None, :]
        slack = bound + 1e-9 * (np.abs(scores.T) + bound)  # rounding of the norms
        lower = np.where(own, -np.inf, scores.T - slack)
        kth = np.partition(lower, n - k, axis=1)[:, n - k]
        possible = (scores.T + slack >= kth[:, None]) & ~own
        if possible.sum() <= few * k * len(queries):
            break
    return possible


def exact_scores(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of rows, in whole numbers; they saturate at the limits of 64 bits."""
    if not len(queries):
        return np.zeros(0, np.int64)
    if np.abs(queries).max() * np.abs(vectors).max() * queries.shape[1] < EXACT:
        return np.einsum("ij,ij->i", queries, vectors).astype(np.int64)
    limits = np.iinfo(np.int64)
    whole = lambda rows: [[int(x) for x in row] for row in rows]
    sums = [sum(x * y for x, y in zip(a, b)) for a, b in zip(whole(queries), whole(vectors))]
    return np.array([min(max(s, limits.min), limits.max) for s in sums], np.int64)


def _packed(rows: pd.DataFrame, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width))
    for i, v in enumerate(rows["v"]):
        out[i, : len(v)] = v
    return out


def top_k(vectors: DataFrame, queries: Column, k: int = K, scale: float = SCALE, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of each row of ``vectors`` (vec_id, embedding) with ``queries``.

    Fewer rows if there are fewer candidates; ties go to the smaller vec_id. Vectors that are null or hold null or
    non-finite components, and rows with a null vec_id, take no part. Repeated rows of one vec_id count once, as the least
    of their vectors. Shorter vectors are filled with zeros. Other columns are ignored. No rows give no rows.
    """
    one = vectors.select(F.col("vec_id").cast("long"), quantised(F.col("embedding"), scale).alias("v"), queries.alias("is_query"))
    one = one.where("vec_id is not null and v is not null").groupBy("vec_id").agg(F.min("v").alias("v"), F.max("is_query").alias("is_query"))
    kept = cut(one)
    counts = kept.agg(F.count("*").alias("n"), F.count(F.when(F.col("is_query"), 1)).alias("q"), F.max(F.size("v")).alias("width")).first()
    n, n_queries, width = counts["n"], counts["q"], counts["width"] or 0
    tasks = TASKS_A_CORE * vectors.sparkSession.sparkContext.defaultParallelism
    n_blocks, n_groups = max(1, -(-n // block), min(-(-n // min(block, SMALL_BLOCK)), tasks)), max(1, -(-n_queries // query_block))

    def pack(blocks: int):
        # numbers of rows in a block vary a little, as rows are dealt by a hash
        return F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")

    def to_rows(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("vec_id")
        return pd.DataFrame({"b": [rows["b"].iloc[0]], "ids": [rows["vec_id"].to_numpy(np.int64).tobytes()], "data": [_packed(rows, width).tobytes()]})

    layout = "b int, ids binary, data binary"
    # a block is a task: its number is the task's, so that no two of them meet by their hash
    indexed = kept.select("vec_id", "v", pack(n_blocks).alias("b")).repartitionById(n_blocks, "b").groupBy("b").applyInPandas(to_rows, layout).select(F.col("b").alias("block"), "ids", "data", F.lit(-1).alias("query_group"))
    asked = kept.where("is_query").select("vec_id", "v", pack(n_groups).alias("b")).groupBy("b").applyInPandas(to_rows, layout)
    # the queries go to every block, not the index to every group: the smaller side is repeated
    asked = asked.select(F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("block"), "ids", "data", F.col("b").alias("query_group"))
    # a block's index comes first, then the groups of queries one by one
    pairs = indexed.unionByName(asked).repartitionById(n_blocks, "block").sortWithinPartitions("block", "query_group").select("query_group", "ids", "data")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, ids = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                found, data = (np.frombuffer(batch.column(i)[row].as_buffer(), t) for i, t in ((1, np.int64), (2, np.float64)))
                data = data.reshape(len(found), -1)
                if batch.column(0)[row].as_py() < 0:
                    index, ids = Index(data.copy()), found.copy()
                    continue
                q, v = np.nonzero(search_block(data, index, found[:, None] == ids[None, :], k))
                scores = exact_scores(data[q], index.block[v])
                order = np.lexsort((ids[v], -scores, q))
                q, v, scores = q[order], v[order], scores[order]
                best = np.arange(len(q)) - np.searchsorted(q, q) < k
                yield pa.RecordBatch.from_arrays([pa.array(found[q[best]]), pa.array(ids[v[best]]), pa.array(scores[best])], names=["query_id", "vec_id", "score"])

    found = arrow_rows(pairs, search, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")).cast("int")
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(vectors, F.col("vec_id") % QUERY_EVERY == 0)


ORACLE_TOP_K = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
    FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id
    WHERE q.vec_id % 20 = 0
), ranked AS (
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
