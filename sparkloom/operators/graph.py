"""The property graph as two tables, nodes and edges: upserts, routing, deletion, and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import code
from ..schemas import RELATIONS


def upsert_nodes(nodes: DataFrame, changes: DataFrame) -> DataFrame:
    """``nodes`` (label, id, name, file) with ``changes`` (the same and ord): by (label, id) the change with the largest ord stands, else the old row."""
    last = changes.groupBy("label", "id").agg(F.max_by(F.struct("name", "file"), "ord").alias("last")).select("label", "id", "last.name", "last.file")
    return nodes.select("label", "id", "name", "file").join(last, ["label", "id"], "left_anti").unionByName(last)


def route_edges(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``edges`` (type, src, dst, confidence) with rel_table, src_label and dst_label by the labels of their ends (id, label); unroutable edges are dropped, repeated ones stay."""
    rows = [F.struct(*(F.lit(x).alias(c) for x, c in zip(r, ("rel_table", "type", "src_label", "dst_label")))) for r in RELATIONS]
    # the catalogue: six rows that never grow
    catalogue = edges.sparkSession.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    source, target = labels.toDF("src", "src_label"), labels.toDF("dst", "dst_label")
    return edges.join(source, "src").join(target, "dst").join(F.broadcast(catalogue), ["type", "src_label", "dst_label"])


def detach_delete(nodes: DataFrame, edges: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What is left of nodes and edges when the nodes of ``files`` (file) and all edges at them are deleted."""
    gone = nodes.join(files, "file", "left_semi").select("id").distinct()
    left = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    return nodes.join(files, "file", "left_anti"), left


def node_counts(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("label").agg(F.count("*").alias("n"))


def edge_counts(edges: DataFrame) -> DataFrame:
    """(type, n), and the total under ``(all)``."""
    return edges.rollup("type").agg(F.count("*").alias("n")).select(F.coalesce("type", F.lit("(all)")).alias("type"), "n")


def language_counts(paths: DataFrame) -> DataFrame:
    """(language, n) of ``paths`` (path)."""
    return paths.groupBy(code.language_name(F.col("path")).alias("language")).agg(F.count("*").alias("n"))


def module_rollup(paths: DataFrame, most: int = 40) -> DataFrame:
    """(module, n): files by their first two path segments, the ``most`` largest."""
    return paths.groupBy(code.path_group(F.col("path")).alias("module")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "module").limit(most)


def counted(edges: DataFrame) -> DataFrame:
    """(type, src, dst, n) of the different ``edges``.

    Few edges repeat, so counting them before they are dealt would only fill a task's memory: they are dealt as they are, into all of
    the session's shuffle partitions, which adaptive execution doesn't put together to larger ones as the graph grows.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return edges.select("type", "src", "dst").repartition(parts, "src", "dst").groupBy("type", "src", "dst").agg(F.count("*").alias("n"))


def graph_signature(edges: DataFrame) -> DataFrame:
    """(type, n, n_distinct) for comparing graphs."""
    return counted(edges).groupBy("type").agg(F.sum("n").alias("n"), F.count("*").alias("n_distinct"))


def multi_edges(edges: DataFrame) -> DataFrame:
    """(type, src, dst, n) of edges that occur more than once."""
    return counted(edges).where("n > 1")


def same_rows(left: DataFrame, right: DataFrame) -> bool:
    """True if two tables are equal as multisets."""
    columns = left.columns
    return left.exceptAll(right.select(columns)).isEmpty() and right.select(columns).exceptAll(left).isEmpty()


def search_symbols(nodes: DataFrame, fragment: str | Column, limit: int = 20) -> DataFrame:
    """Nodes whose id contains the fragment, case-sensitive, in order of id and label."""
    return nodes.where(F.contains(F.col("id"), F.lit(fragment))).select("id", "label", "name", "file").orderBy("id", "label").limit(limit)


def look_up(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, label, name, file) of ``ids`` (id); where labels share an id, File stands before Function before Class."""
    order = F.when(F.col("label") == "File", 1).when(F.col("label") == "Function", 2).otherwise(3)
    found = nodes.join(ids, "id", "left_semi")
    return found.groupBy("id").agg(F.min_by(F.struct("label", "name", "file"), order).alias("first")).select("id", "first.*")


def seed_layer(nodes: DataFrame, edges: DataFrame, limit: int = 200) -> tuple[DataFrame, DataFrame]:
    """The first ``limit`` File and Class nodes by id, and up to 3 * limit edges of each relation between them."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    shown = nodes.where("label in ('File', 'Class')").withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")
    ids = shown.select("id").distinct()
    inner = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    place = F.row_number().over(Window.partitionBy("rel_table").orderBy("src", "dst"))
    return shown, inner.withColumn("place", place).where(F.col("place") <= 3 * limit).select("src", "dst", "type", "rel_table")


def snapshot_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(file, change): added, changed or deleted between two snapshots (file, sha1)."""
    o, n = old.select("file", F.col("sha1").alias("old_sha1")), new.select("file", F.col("sha1").alias("new_sha1"))
    change = F.when(F.col("old_sha1").isNull(), "added").when(F.col("new_sha1").isNull(), "deleted").when(F.col("old_sha1") != F.col("new_sha1"), "changed")
    return n.join(o, "file", "full_outer").select("file", change.alias("change")).where("change is not null")
