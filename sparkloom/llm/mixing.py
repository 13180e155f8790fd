"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length. Each source's budget is filled with whole passes over it; what remains
is filled with an even share of each length and then, exactly where possible, by bounded-knapsack dynamic programming over
the length counts. Which documents of a length are taken is drawn by a seeded hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, documents, repeats_ids, row_key, whole_row

WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix for each word of the corpus, and how often a source may be repeated.
SHARE, MOST_PASSES = 1.5, 2.0
SEED = 20_231
#: Parts into which the documents of one source and length are dealt, so that no group of equals meets in one task.
SALTS = 64
#: Largest remaining budget that the dynamic programme fills, in words; the greedy step before it leaves less.
TABLE = 1 << 14


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_PASSES) -> DataFrame:
    """(source, source_size, target) of each source from ``sizes`` (source, source_size).

    Sources in code-point order, null last, have the weights in turn. A target stops at ``most`` times its source's size
    and the excess is shared anew by weight among the others, until none is above; if all are at their limits, the mix
    is smaller. Each round is one aggregate over the sources, and three numbers of it reach the driver.
    """
    # place in the order: a range-partitioned sort, with each partition's start taken from its predecessors' row counts
    ordered = cut(sizes.repartitionByRange(F.col("source").asc_nulls_last()).sortWithinPartitions(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()))
    counts = {r["part"]: r["count"] for r in ordered.groupBy("part").count().collect()}
    starts, at = [], 0
    for part in sorted(counts):
        starts.append(F.when(F.col("part") == part, F.lit(at)))
        at += counts[part]
    inside = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last()))
    place = inside - 1 + F.coalesce(*starts, F.lit(0))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    weighted = cut(ordered.select("source", "source_size", weight.alias("weight")))
    level = 0.0  # words for each unit of weight; sources that reach their limit below it stay at the limit
    while True:
        limit = F.col("source_size") * F.lit(float(most))
        full = limit <= F.col("weight") * level
        row = weighted.agg(
            F.sum("source_size").alias("total"), F.sum(F.when(full, limit)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("open")
        ).first()
        if not row["open"]:
            break
        now = max(0.0, share * (row["total"] or 0) - (row["held"] or 0.0)) / row["open"]
        if now <= level:
            break
        level = now
    target = F.least(F.col("source_size") * F.lit(float(most)), F.col("weight") * F.lit(level))
    return weighted.select("source", "source_size", target.alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int, table: int = TABLE) -> np.ndarray:
    """How many documents of each length to take, at most ``counts``, so that their words add up to ``budget`` or as near below it as is found.

    An even share of each length first, then the longest that still fit while the rest is larger than ``table``, then
    bounded-knapsack dynamic programming over what is left; counts are split into powers of two, and the reachable sums
    of each step are one bit string.
    """
    taken = np.zeros(len(lengths), np.int64)
    total = int(lengths @ counts)
    if budget >= total:
        return counts.copy()
    if budget <= 0 or not total:
        return taken
    # floor(count * budget / total) in whole numbers
    taken = np.array([int(c) * budget // total for c in counts], np.int64)
    rest = budget - int(lengths @ taken)
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        if rest <= table:
            break
        more = min(int(counts[i] - taken[i]), (rest - table) // int(lengths[i]) + 1, rest // int(lengths[i]))
        taken[i] += more
        rest -= more * int(lengths[i])
    rest = min(rest, table) if rest > table else rest
    reach, mask, steps = 1, (1 << rest + 1) - 1, []
    for i in order[::-1]:  # short ones first: they reach most sums
        left, unit = min(int(counts[i] - taken[i]), rest // int(lengths[i])), 1
        while left > 0 and not reach >> rest & 1:
            n = min(unit, left)
            steps.append((i, n, reach))
            reach = (reach | reach << n * int(lengths[i])) & mask
            left, unit = left - n, 2 * unit
        if reach >> rest & 1:
            break
    at = reach.bit_length() - 1
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            taken[i] += n
            at -= n * int(lengths[i])
    return taken


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST_PASSES, seed: int = SEED, row: Column | None = None) -> DataFrame:
    """(doc_id, row, source, size, source_size, target, copies) for each row of ``docs``: how often the mix takes the document.

    A null text has size 0, and documents of size 0 are taken 0 times. A null source is a source of its own, the last
    one. Repeated rows are documents of their own, drawn by their rank among equals. Null ids are drawn like others; ``row``,
    if given, tells them and other rows that share an id apart. Very long texts are only counted, by their words. An empty
    table gives no row. The draw depends on the seed, ids, lengths and sources alone, so reruns agree.
    """
    whole = int(most)
    row = F.lit("") if row is None else row
    drawn = lambda by: F.xxhash64(F.lit(by), "doc_id", F.nullif(row, F.lit("")))
    salt = F.pmod(drawn(seed), F.lit(SALTS)).cast("int")
    # the sizes are counted once: the texts aren't read again
    sized = cut(docs.select("doc_id", row.alias("row"), "source", size_of(F.col("text")).alias("size"), salt.alias("salt"), drawn(seed + 1).alias("draw")))
    by_salt = cut(sized.groupBy("source", "size", "salt").agg(F.count("*").alias("n")))
    targets = cut(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    by_size = by_salt.groupBy("source", "size").agg(F.sum("n").alias("n"))
    same = by_size["source"].eqNullSafe(targets["source"])
    budgets = by_size.join(targets, same).select(by_size["source"], "size", "n", "source_size", "target")

    def fill(lengths: pd.DataFrame) -> pd.DataFrame:
        lengths = lengths.sort_values("size")
        total, target = int(lengths["source_size"].iloc[0]), float(lengths["target"].iloc[0])
        passes = min(whole, int(target // total)) if total else 0
        rest = round(target) - passes * total if passes < whole else 0
        some = lengths["size"].to_numpy() > 0
        extra = np.zeros(len(lengths), np.int64)
        extra[some] = fit(lengths["size"].to_numpy()[some], lengths["n"].to_numpy()[some], rest)
        return lengths[["source", "size", "source_size", "target"]].assign(passes=np.where(some, passes, 0), extra=extra)

    # lengths of one source: fewer than the square root of twice its words
    plan = cut(budgets.groupBy("source").applyInPandas(fill, "source string, size long, source_size long, target double, passes int, extra long"))
    p, s = plan.alias("p"), by_salt.alias("s")
    planned = s.join(p, F.col("p.source").eqNullSafe(F.col("s.source")) & (F.col("p.size") == F.col("s.size")))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("s.source", "s.size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = F.greatest(F.lit(0), F.least("n", F.col("extra") - before)).alias("quota")
    quota = planned.select("s.source", "s.size", "salt", "passes", "source_size", "target", extra).alias("q")
    rank = F.row_number().over(Window.partitionBy("source", "size", "salt").orderBy("draw", "doc_id", "row"))
    d = sized.withColumn("rank", rank).alias("d")
    on = F.col("d.source").eqNullSafe(F.col("q.source")) & (F.col("d.size") == F.col("q.size")) & (F.col("d.salt") == F.col("q.salt"))
    copies = F.col("passes") + (F.col("rank") <= F.col("quota")).cast("int")
    return d.join(quota, on).select("d.doc_id", "d.row", "d.source", "d.size", "source_size", "target", copies.alias("copies"))


def take_mix(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, with their columns, each as often as mix takes it.

    Rows that share a doc_id, or have none, are told apart by all their columns; equal rows are taken as often as mix takes
    them together. Nulls, empty texts and empty tables: as in mix.
    """
    repeated = repeats_ids(docs)
    key = row_key(docs) if repeated else None
    copies = mix(docs, row=key, **settings).groupBy("doc_id", "row").agg(F.sum("copies").alias("mix_copies")).where("mix_copies > 0")
    copies = copies.toDF("mix_id", "mix_row", "mix_copies")
    rows = docs.select(whole_row(docs).alias("whole"), F.col("doc_id").alias("own_id"), *([key.alias("own_row")] if repeated else []))
    same = F.col("own_id").eqNullSafe(F.col("mix_id"))
    if repeated:
        rows = rows.dropDuplicates(["own_id", "own_row"])
        same = same & (F.col("own_row") == F.col("mix_row"))
    joined = rows.join(copies, same)
    return joined.select("whole", F.explode(F.sequence(F.lit(1), F.col("mix_copies").cast("int")))).select("whole.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
