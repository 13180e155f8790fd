"""Near copies by SimHash: by the whole texts' fingerprints, as operator 1 links them, and by those of samples, verified exactly.

``drop_near_copies`` links texts whose whole fingerprints differ in few bits, through the operator's own grid range-join, and
those that are alike by the samples; both kinds of links make one set of components.

Texts of a given Jaccard similarity of their word shingles have SimHash fingerprints that differ in about 64 * angle / pi
bits: at 0.8 some 5 to 14 of 64, where a grid range-join no longer tells pairs from strangers. So each of TABLES fingerprints
here is the SimHash (bit majority) of a sample of three shingles, each the least by a hash of its own; similar texts have the
same sample in most tables. Texts that share a fingerprint are candidates, and their whole shingle sets are compared.

Equal sets are one node. In a cell that many different texts share, each is compared with the first and with its
neighbours in an order of the cell's own; only where that leaves the cell's texts in several components are those of
different components compared with each other, so a large group of copies is not compared all against all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import arrow_rows, as_bytes, connected_components, cut, repeats_ids, row_key, whole_row

TABLES, SAMPLE = 10, 3
WORDS, NUMERATOR, DENOMINATOR = 5, 4, 5
#: Cells with more different texts are crowded; parts into which they are dealt, and neighbours that are compared there.
CROWDED, SALTS, NEIGHBOURS = 48, 16, 4
#: Bits of the filter through which shingles are fetched; it only saves work.
FILTER_BITS = 24
MIX = np.uint64(0x9E3779B97F4A7C15)
ODD = (np.arange(1, TABLES * SAMPLE + 1, dtype=np.uint64) * MIX) | np.uint64(1)


def shingle_set(text: bytes | None, words_per_shingle: int) -> np.ndarray:
    """Distinct hashes of a text's shingles, in order; fewer words are one shingle, none are no shingle."""
    import xxhash

    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    k = min(words_per_shingle, len(words))
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = (ends + 1 - lengths)[: len(words) - k + 1].tolist()
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts, ends[k - 1 :].tolist())], np.uint64))


def set_id(shingles: np.ndarray) -> int:
    mixed = (shingles ^ shingles >> np.uint64(29)) * MIX
    return int((mixed ^ mixed >> np.uint64(32)).sum().view(np.int64)) if len(shingles) else 0


def sample_fingerprints(shingles: np.ndarray) -> np.ndarray:
    """For each table the SimHash of the shingles that are least by its hashes."""
    least = np.full(TABLES * SAMPLE, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), 8192):  # long texts in parts
        mixed = shingles[None, i : i + 8192] * ODD[:, None]
        mixed = (mixed ^ mixed >> np.uint64(31)) * MIX
        least = np.minimum(least, (mixed ^ mixed >> np.uint64(33)).min(axis=1))
    a, b, c = least.reshape(TABLES, SAMPLE).T
    return (a & b) | (a & c) | (b & c)


def _entries(texts: DataFrame, words_per_shingle: int, whole: bool) -> DataFrame:
    """(doc_id, row, id, n, cells, fp) of each text (doc_id, text, row): its set, the set's size, its samples' fingerprints and, with ``whole``, operator 1's of the whole text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = as_bytes(batch.column(1))
            sets = [shingle_set(t, words_per_shingle) for t in contents]
            fps = pa.array(np.array([simhash.fingerprint(t, simhash.WORDS) if whole else 0 for t in contents], np.uint64).view(np.int64))
            ids = pa.array([set_id(s) for s in sets], pa.int64())
            cells = pa.array([((sample_fingerprints(s) + ODD[:TABLES]) * MIX).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64()))
            sizes = pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), ids, sizes, cells, fps], names=["doc_id", "row", "id", "n", "cells", "fp"])

    return arrow_rows(texts, rows, "doc_id long, row string, id long, n long, cells array<long>, fp long")


def _whole_links(found: DataFrame) -> DataFrame:
    """Links (a, b) between sets (id) that connect all whose fingerprints (fp) operator 1 links, and no others."""
    pairs = cut(found.select("id", "fp").distinct())
    fps = pairs.select("fp").distinct()
    roots = connected_components(simhash.fingerprint_links(fps)).withColumnRenamed("node", "fp")
    placed = cut(pairs.join(roots, "fp", "left").select("id", F.coalesce("root", "fp").alias("root")).distinct())
    heads = placed.groupBy("root").agg(F.min("id").alias("a"))
    return cut(placed.join(heads, "root").where("a <> id").select("a", F.col("id").alias("b")).distinct())


def _shingles(texts: DataFrame, wanted: DataFrame, words_per_shingle: int) -> DataFrame:
    """(id, shingles) of the sets ``wanted`` (id), perhaps of a few more."""
    bits = np.zeros(1 << FILTER_BITS - 6, np.uint64)
    word, bit = F.pmod(F.col("id"), F.lit(len(bits))), F.expr("shiftleft(1L, cast(shiftrightunsigned(id, 50) & 63 as int))")
    for row in wanted.select(word.alias("at"), bit.alias("bit")).groupBy("at").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        bits[row["at"]] = row["bits"] % (1 << 64)
    held = texts.sparkSession.sparkContext.broadcast(bits)  # of a fixed size

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets = [], []
            for text in as_bytes(batch.column(0)):
                shingles = shingle_set(text, words_per_shingle)
                this = set_id(shingles)
                if int(held.value[this % len(held.value)]) >> (this >> 50 & 63) & 1:
                    ids.append(this)
                    sets.append(shingles.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["id", "shingles"])

    return arrow_rows(texts.select("text"), rows, "id long, shingles array<long>").groupBy("id").agg(F.first("shingles").alias("shingles"))


def _links(texts: DataFrame, pairs: DataFrame, words_per_shingle: int) -> DataFrame:
    """The pairs (a, b) whose sets are similar."""
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    shingles = cut(_shingles(texts, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), words_per_shingle))
    left, right = shingles.toDF("a", "x"), shingles.toDF("b", "y")
    both = F.size(F.array_intersect("x", "y"))
    similar = DENOMINATOR * both >= NUMERATOR * (F.size("x") + F.size("y") - both)
    return cut(pairs.join(left, "a").join(right, "b").where(similar).select("a", "b"))


def near_copy_groups(docs: DataFrame, words_per_shingle: int = WORDS, crowded: int = CROWDED) -> DataFrame:
    """(doc_id, component_id) of each row of ``docs``: the least doc_id among texts that similar ones link.

    Similar: a Jaccard similarity of 0.8 or more of the sets of shingles of ``words_per_shingle`` words (lower case for
    A-Z). A pair at 0.8 is missed with a probability of 0.488^10, below 0.001, and less above. Texts without words (null and
    empty ones too) are alike; fewer words are one shingle. Texts are read whole, very long ones in parts. Repeated rows fall
    into one component. A null doc_id never becomes a component's id unless it has no other. An empty table gives no row.
    Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.lit("").alias("row"))
    return _components(texts, words_per_shingle, crowded, False).select("doc_id", "component_id")


def _components(texts: DataFrame, words_per_shingle: int, crowded: int, whole: bool) -> DataFrame:
    """(doc_id, row, root, component_id) of each of the ``texts`` (doc_id, text, row); root is the component's own, also where no member has an id. With ``whole`` operator 1's links count too."""
    found = cut(_entries(texts, words_per_shingle, whole))
    sets = found.groupBy("id").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("cells").alias("cells"))
    entries = sets.select("id", "n", F.explode("cells").alias("cell"))
    shared = entries.groupBy("cell").agg(F.count("*").alias("size"), F.min("id").alias("head")).where("size > 1")
    members = cut(entries.join(shared, "cell"))
    few, many = members.where(F.col("size").between(3, crowded)), members.where(F.col("size") > crowded)
    fits = lambda a, b: DENOMINATOR * F.least(a, b) >= NUMERATOR * F.greatest(a, b)
    pairs = members.select(F.col("head").alias("a"), F.col("id").alias("b"))
    x, y = few.alias("x"), few.alias("y")
    pairs = pairs.union(x.join(y, F.col("x.cell") == F.col("y.cell")).where((F.col("x.id") < F.col("y.id")) & fits("x.n", "y.n")).select("x.id", "y.id"))
    order = Window.partitionBy("cell", "salt").orderBy(F.xxhash64("cell", "id"), "id")
    before = F.array(*(F.lag("id", k).over(order) for k in range(1, NEIGHBOURS + 1)))
    near = many.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS))).withColumn("before", before).select("id", F.explode("before").alias("b"))
    links = _links(texts, pairs.union(near.where("b is not null")), words_per_shingle)
    if whole:
        links = links.union(_whole_links(found))
    roots = cut(connected_components(links))
    if not many.isEmpty():
        placed = cut(many.join(roots, many["id"] == roots["node"], "left").select("cell", "id", "n", F.coalesce("root", "id").alias("root")))
        split = placed.groupBy("cell").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("cell")
        open_ = placed.join(split, "cell")
        x, y = open_.alias("x"), open_.alias("y")
        apart = (F.col("x.root") < F.col("y.root")) & fits("x.n", "y.n")
        more = x.join(y, F.col("x.cell") == F.col("y.cell")).where(apart).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        roots = connected_components(links.union(_links(texts, more, words_per_shingle)))
    classes = cut(sets.select("id", "least").join(roots, F.col("id") == F.col("node"), "left").select("id", "least", F.coalesce("root", "id").alias("root")))
    components = classes.join(classes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("id", "root", "component_id")
    return found.select("doc_id", "row", "id").join(components, "id").select("doc_id", "row", "root", "component_id")


def drop_near_copies(docs: DataFrame, words_per_shingle: int = WORDS, crowded: int = CROWDED) -> DataFrame:
    """One row of ``docs``, with its columns, of each group of near copies: the first by doc_id, null last, then by a digest of the row.

    Near are texts that operator 1 links by their SimHash fingerprints, and those of a Jaccard similarity of 0.8 (``near_copy_groups``).

    Rows that share a doc_id, or have none, are told apart by all their columns; of equal rows one stays. A group whose
    members all lack an id keeps one of them. Texts without words form one group. An empty table gives no row.
    """
    repeated = repeats_ids(docs)
    key = row_key(docs) if repeated else F.lit("")
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    groups = _components(docs.select(doc_id, F.col("text").cast("string").alias("text"), key.alias("row")), words_per_shingle, crowded, True)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row")).alias("first"))
    keep = first.select(F.col("first.doc_id").alias("kept_id"), F.col("first.row").alias("kept_row"))
    rows = docs.select(whole_row(docs).alias("whole"), doc_id.alias("own_id"), key.alias("own_row"))
    same = F.col("own_id").eqNullSafe(F.col("kept_id"))
    if not repeated:
        return rows.join(keep, same, "left_semi").select("whole.*")
    kept = rows.join(keep, same & (F.col("own_row") == F.col("kept_row")), "left_semi")
    return kept.dropDuplicates(["own_id", "own_row"]).select("whole.*")
