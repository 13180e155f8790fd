"""SimHash near-duplicates by segment-popcount embedding.

A 64-bit fingerprint is mapped to the bit counts of its segments. The Manhattan distance of two such points is at most
the Hamming distance of the fingerprints, so fingerprints within RADIUS have points that share a lattice point at
Manhattan distance 1 or less from each. Each distinct fingerprint enters those grid cells (about 31 of 5^16); members of
one cell are verified exactly. A crowded cell's members are embedded anew with segments of one bit, where the Manhattan
distance is the Hamming distance and sharing a cell is proof, so that no cell is ever compared all against all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_rows, as_bytes, connected_components, cut, documents

BITS, SEGMENTS = 64, 16
#: Words of a shingle.
WORDS = 3
#: Bits in which linked fingerprints may differ; cells within distance 1 of both points meet up to 2.
RADIUS = 2
PER_SEGMENT = BITS // SEGMENTS
BASE = PER_SEGMENT + 1
#: Cells with more members are embedded anew, with finer segments.
CROWDED = 256
#: Shingles that are hashed and counted at once, so that a long text needs no more memory than a few times its own size.
AT_ONCE = 65_536


def fingerprint(text: bytes | None, words_per_shingle: int, weights: np.ndarray | None = None) -> int:
    """The 64-bit SimHash of a text's shingles, repeats included: a bit is 1 if it is set in over half of their hashes."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends + 1 - lengths
    k = min(words_per_shingle, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(starts), AT_ONCE):
        hashes = np.array([digest(joined[a:b], 42) for a, b in zip(starts[i : i + AT_ONCE], ends[i : i + AT_ONCE])], "<u8")
        ones += _bit_totals(hashes)
    return int((2 * ones > len(starts)).astype(np.uint64) @ (np.uint64(1) << np.arange(BITS, dtype=np.uint64)))


def _bit_totals(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    totals = np.zeros(BITS, np.int64)
    for i in range(0, len(bits), 255):  # sums of up to 255 bits fit in a byte
        totals += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return totals


def fingerprints(docs: DataFrame, words_per_shingle: int = WORDS) -> DataFrame:
    """(doc_id, fp) for each row of ``docs``; fp is the fingerprint's 64 bits as a signed long. A null text has no words, and 0."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(text, words_per_shingle) for text in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return arrow_rows(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), rows, "doc_id long, fp long")


def points(fps: np.ndarray) -> np.ndarray:
    """The segments' bit counts of each fingerprint, read as one number in base ``BASE``."""
    places, out = np.int64(1), np.zeros(len(fps), np.int64)
    mask = np.uint64(2**PER_SEGMENT - 1)
    for i in range(SEGMENTS):
        out += np.bitwise_count(fps >> np.uint64(PER_SEGMENT * i) & mask).astype(np.int64) * places
        places *= BASE
    return out


def lattice_cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The lattice points at Manhattan distance 1 or less from each fingerprint's point, and the fingerprint of each."""
    point, mask = points(fps), np.uint64(2**PER_SEGMENT - 1)
    cells, of = [point], [fps]
    for i in range(SEGMENTS):
        count = np.bitwise_count(fps >> np.uint64(PER_SEGMENT * i) & mask)
        for step, fits in ((-1, count > 0), (1, count < PER_SEGMENT)):
            cells.append(point[fits] + np.int64(step * BASE**i))
            of.append(fps[fits])
    return np.concatenate(cells), np.concatenate(of)


def _cells(fps: DataFrame) -> DataFrame:
    """(cell, fp) of ``lattice_cells``; as an expression of so many parts they took the driver hundreds of MB to plan."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, of = lattice_cells(batch.column(0).to_numpy().view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(of.view(np.int64))], names=["cell", "fp"])

    return arrow_rows(fps.select("fp"), rows, "cell long, fp long")


def verified_in_cells(cells: np.ndarray, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of a cell (cells are in order) that differ in RADIUS bits or less.

    A pair whose points coincide is looked at in the cell of its point alone, and one whose points are neighbours in the
    cell of the first member's point, so that few pairs are found in several cells.
    """
    centre = points(fps) == cells
    a_out, b_out = [], []
    first = np.flatnonzero(cells[:-1] == cells[1:])
    step = 1
    while len(first):
        a, b = fps[first], fps[first + step]
        near = np.bitwise_count(a ^ b) <= RADIUS
        both, one = centre[first] & centre[first + step], centre[first] | centre[first + step]
        pa_, pb = points(a[near]), points(b[near])
        apart = pa_ != pb
        neighbours = one[near] & apart
        keep = np.where(apart, ~neighbours | centre[first][near], both[near])
        a_out.append(a[near][keep])
        b_out.append(b[near][keep])
        step += 1
        first = first[first + step < len(cells)]
        first = first[cells[first] == cells[first + step]]
    return (np.concatenate(a_out), np.concatenate(b_out)) if a_out else (fps[:0], fps[:0])


class Forest:
    """Union-find over the fingerprints that a task has linked: tells whether a link joins two trees."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (parent := up.get(x, x)) != x:
            up[x] = x = up.get(parent, parent)
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def _cell_links(crowded: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest()
        cells, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in _then_none(batches):
            if batch is not None:
                cells = np.concatenate([cells, batch.column(0).to_numpy()])
                fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            if not len(cells):
                continue
            starts = np.flatnonzero(np.r_[True, cells[1:] != cells[:-1]])
            sizes = np.diff(np.r_[starts, len(cells)])
            large = np.repeat(sizes > crowded, sizes)
            hot = fps[large]
            # the last cell may go on in the next batch; what is known to be crowded needn't wait
            done = len(cells) if batch is None else starts[-1]
            ready = ~large & (np.arange(len(cells)) < done)
            a, b = verified_in_cells(cells[ready], fps[ready])
            links = [(x, y) for x, y in zip(a.view(np.int64).tolist(), b.view(np.int64).tolist()) if forest.join(x, y)]
            hot = hot.view(np.int64)
            columns = np.concatenate([np.array(links, np.int64).reshape(-1, 2), np.stack([hot, hot], 1)])
            yield pa.RecordBatch.from_arrays([pa.array(columns[:, 0]), pa.array(columns[:, 1])], names=["a", "b"])
            # of a crowded cell so many members stay that it is still known to be crowded
            from_ = max(done, len(cells) - crowded - 1) if large[-1] else done
            cells, fps = cells[from_:], fps[from_:]

    return rows


def _then_none(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def fingerprint_links(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fps`` (fp), which connect all that differ in RADIUS bits or less, and no others."""
    cells = _cells(fps).select("cell", "fp").repartition("cell").sortWithinPartitions("cell", "fp")
    found = cut(arrow_rows(cells, _cell_links(crowded), "a long, b long"))
    links, hot = found.where("a <> b"), found.where("a = b").select(F.col("a").alias("fp")).distinct()
    flips = [F.col("fp").bitwiseXOR(F.shiftleft(F.lit(1).cast("long"), i)) for i in range(BITS)]
    meet = hot.select("fp", F.explode(F.array("fp", *flips)).alias("cell"))
    least = meet.groupBy("cell").agg(F.min("fp").alias("a"), F.count("*").alias("n")).where("n > 1").select("cell", "a")
    return links.union(meet.join(least, "cell").where("a <> fp").select("a", F.col("fp").alias("b")))


def near_duplicate_components(docs: DataFrame, words_per_shingle: int = WORDS, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs``; the component is the least doc_id reachable over links.

    Texts whose fingerprints differ in RADIUS bits or less are linked. Texts without words (null and empty ones
    too) have fingerprint 0 and are linked like any other. Repeated rows and ties fall into one component; a null doc_id
    never becomes a component's id unless the component has no other (then null). An empty table gives no row. Other
    columns are ignored.
    """
    by_doc = cut(fingerprints(docs, words_per_shingle))
    by_fp = cut(by_doc.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(fingerprint_links(by_fp.select("fp"), crowded))
    classes = by_fp.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    ids = classes.join(least, "root").select("fp", "component_id")
    return by_doc.join(ids, "fp").select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_components(documents(spark, sf_dir))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
