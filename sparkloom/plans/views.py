"""Graph-shaped views over the star schema, for running the operators on tables of any size.

Parts are functions, suppliers files and brands classes. Two lines of an order that follow each other are a call from one
part to the next and an import from one supplier to the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a_part, a_supp, b_part, b_supp, line) of lines of an order that follow each other."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    a = lines.select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("a_part"), F.col("l_suppkey").alias("a_supp"))
    b = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("line"), F.col("l_partkey").alias("b_part"), F.col("l_suppkey").alias("b_supp"))
    return a.join(b, ["l_orderkey", "line"])


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).select(_id("p", "a_part").alias("src"), _id("p", "b_part").alias("dst"))


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _steps(spark, sf_dir).select(_id("s", "a_supp").alias("src"), _id("s", "b_supp").alias("dst"))


def methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_brand").alias("src"), _id("p", "p_partkey").alias("dst"))


def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct().select(_id("s", "l_suppkey").alias("src"), _id("p", "l_partkey").alias("dst"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(type, src, dst, confidence) of all four kinds; calls and imports come of one join of the lines."""
    typed = lambda t, src, dst, c: F.struct(F.lit(t).alias("type"), src.alias("src"), dst.alias("dst"), F.lit(c).alias("confidence"))
    steps = _steps(spark, sf_dir).select("a_part", "b_part", "a_supp", "b_supp")
    both = F.array(typed("CALLS", _id("p", "a_part"), _id("p", "b_part"), 1.0), typed("IMPORTS", _id("s", "a_supp"), _id("s", "b_supp"), 0.9))
    parts = [steps.select(F.inline(both))]
    for df, t in ((methods(spark, sf_dir), "HAS_METHOD"), (contains(spark, sf_dir), "CONTAINS")):
        parts.append(df.select(F.lit(t).alias("type"), "src", "dst", F.lit(1.0).alias("confidence")))
    return parts[0].union(parts[1]).union(parts[2])


def owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, file): the supplier that supplies a part, the one with the least number."""
    first = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.min("l_suppkey").alias("supp"))
    return first.select(_id("p", "l_partkey").alias("id"), _id("s", "supp").alias("file"))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, id, name, file)."""
    files = table(spark, sf_dir, "supplier").select(F.lit("File").alias("label"), _id("s", "s_suppkey").alias("id"), F.col("s_name").alias("name"), _id("s", "s_suppkey").alias("file"))
    parts = table(spark, sf_dir, "part").select(_id("p", "p_partkey").alias("id"), F.col("p_name").alias("name")).join(owners(spark, sf_dir), "id", "left")
    functions = parts.select(F.lit("Function").alias("label"), "id", "name", F.coalesce("file", F.lit("")).alias("file"))
    classes = table(spark, sf_dir, "part").select("p_brand").distinct().select(F.lit("Class").alias("label"), F.col("p_brand").alias("id"), F.col("p_brand").alias("name"), F.lit("").alias("file"))
    return files.union(functions).union(classes)


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, module, name, kind, qualified_name, parent): parts named by their words and size, within their type."""
    name = F.concat(F.replace(F.col("p_name"), F.lit(" "), F.lit("_")), F.lit("_"), F.col("p_size").cast("string"))
    small = F.col("p_type") == "SMALL"
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("seq"), F.col("p_brand").alias("module"), name.alias("name"),
        F.when(small, "class").when(F.col("p_type") == "ECONOMY", "method").otherwise("function").alias("kind"),
        F.when(F.col("p_type") == "ECONOMY", F.concat_ws(".", "p_type", name)).otherwise(name).alias("qualified_name"),
        F.when(F.col("p_type") == "ECONOMY", F.col("p_type")).alias("parent"),
    )


def import_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(module, ord, imported, name, alias): each supplier makes one brand import another, as m and its number."""
    supplier = table(spark, sf_dir, "supplier")
    imported = F.concat(F.lit("Brand#"), F.col("s_nationkey").cast("string"))
    alias = F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("m"), F.col("s_nationkey").cast("string")))
    return supplier.select(F.concat(F.lit("Brand#"), (F.col("s_suppkey") % 25).cast("string")).alias("module"), F.col("s_suppkey").alias("ord"), imported.alias("imported"), imported.alias("name"), alias.alias("alias"))


def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(module, caller, callee_chain): the next part, by its name, by type and name, or through its brand's import name."""
    steps = _steps(spark, sf_dir)
    known = symbols(spark, sf_dir).join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq"), "p_type", "p_brand"), "seq")
    a = known.select(F.col("seq").alias("a_part"), "module", F.concat_ws(".", "module", "qualified_name").alias("caller"))
    b = known.select(F.col("seq").alias("b_part"), "name", "p_type", "p_brand")
    form = F.col("line") % 3
    through = F.concat(F.lit("m"), F.substring_index("p_brand", "#", -1), F.lit("."), F.col("name"))
    chain = F.when(form == 0, F.col("name")).when(form == 1, F.concat_ws(".", "p_type", "name")).otherwise(through)
    return steps.join(a, "a_part").join(b, "b_part").select("module", "caller", chain.alias("callee_chain"))


def text_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, id, name, file, text) of documents."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("id"), F.col("source").alias("name"), F.col("lang").alias("file"), "text")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ord"), F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vec"))
