"""A training-data pipeline over ``documents``: quality rules, line and near-copy deduplication, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the columns
of ``documents``. Null and empty texts, ties, repeated rows, null ids, extra columns and empty tables: as the operators' docstrings
say; in short, a table without rows gives none, and other columns are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, documents
from sparkloom.llm.linededup import dedup_lines
from sparkloom.llm.mixing import take_mix
from sparkloom.llm.nearcopies import drop_near_copies
from sparkloom.llm.packing import pack_documents
from sparkloom.llm.rules import keep_good

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose posterior quality is below a half, go; so do null and empty texts, which have too few words."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that are similar to an earlier line go, null ids first; n_chars follows. A null text stays null; documents that lose all lines stay."""
    return dedup_lines(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies stays, the first by doc_id, null last: texts that operator 1's SimHash links, or whose five-word shingles have a similarity of 0.8. Texts without words are one group."""
    return drop_near_copies(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; documents without words go. Rows that share a doc_id are told apart by all their columns."""
    return take_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of up to 2048 ids; a null text is its end id alone. Copies are packed one by one."""
    return pack_documents(docs, keep_words=False).withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", simhash_near_dedup),
    ("mix_sources", mix_sources),
    ("packing", packing),
]
#: SQL can't express the stages: they train models, draw seeded samples and use a tokenizer.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
