"""Token files against the tokenizer itself, and what their indexes leave out."""

from __future__ import annotations

import glob
import os
import random
import zlib

import numpy as np
import pyarrow.orc
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sparkloom.llm import tokenfiles
from sparkloom.llm.chunks import ByteEncoder, pieces_of
from sparkloom.llm.packing import vocabulary_path

import pyarrow as pa

VOCABULARY, END = tokenfiles.VOCABULARY, tokenfiles.END_ID


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(VOCABULARY))


def written(spark, rows, path, schema="doc_id long, text string", **options):
    tokenfiles.write_token_ids(spark.createDataFrame(rows, schema), path, **options)
    return tokenfiles.read_token_ids(spark, path)


ROWS = [
    (5, "Hello  world,\n\n  it's <|endoftext|> 12 . x"), (3, None), (2, ""), (9, " "), (9, " "), (9, "other"), (None, "no id"), (None, "no id"), (7, " leading and trailing "),
    (8, "naïve café — “quoted” 中文 text　wide space"), (1, "long " * 30_000 + "x" * 5_000), (-4, "a\x1cb \x1d c\tand <|endoftext|>"),
]


def test_files_hold_what_the_tokenizer_gives(spark, tokenizer, tmp_path):
    got = tokenfiles.checksums(written(spark, ROWS, str(tmp_path / "t"))).collect()
    ids = {text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, END] for _, text in ROWS}
    left = sorted((r["start"], r["n_tokens"], r["doc_id"], r["ids_crc32"]) for r in got)
    assert [r[2] for r in left] == sorted((d for d, _ in ROWS), key=lambda d: (d is not None, d))
    assert [r[0] for r in left] == [sum(x[1] for x in left[:i]) for i in range(len(left))]
    key = lambda d, n, c: (d is not None, d or 0, n, c)
    wanted = [key(d, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes())) for d, t in ROWS]
    assert sorted(key(d, n, c) for _, n, d, c in left) == sorted(wanted)


def test_empty_table_and_clashing_columns(spark, tmp_path):
    assert written(spark, [], str(tmp_path / "empty")).count() == 0
    rows = [(1, "a b", 7, "x", "y")]
    schema = "doc_id long, text string, part int, `ids` string, `row.x` string"
    assert [(r["doc_id"], r["start"], r["n_tokens"]) for r in written(spark, rows, str(tmp_path / "c"), schema).collect()] == [(1, 0, 3)]


def test_equal_rows_are_dealt_over_files(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        docs = spark.range(0, 4000, 1, 8).select(F.lit(1).alias("doc_id"), F.lit("same text").alias("text"))
        tokenfiles.write_token_ids(docs, str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = spark.read.orc(str(tmp_path / "t/parts")).collect()
    assert len(parts) > 1 and max(p["n_docs"] for p in parts) < 3000
    starts = sorted(r["start"] for r in tokenfiles.read_token_ids(spark, str(tmp_path / "t")).collect())
    assert starts == list(range(0, 12000, 3))


def read_rows(df):
    """Rows that the scan of the files gave, before the filter above it."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves() if not plan.getClass().getSimpleName().startswith("Adaptive") else plan.finalPhysicalPlan().collectLeaves()
    return leaves.head().metrics().apply("numOutputRows").value()


def test_stripes_indexes_and_bloom_filters(spark, tmp_path):
    rng = random.Random(3)
    rows = [(2 * i, " ".join(f"word{rng.randrange(10**6)}" for _ in range(30))) for i in range(20_000)]
    path = str(tmp_path / "t")
    written(spark, rows, path, stripe_bytes=200_000)
    files = glob.glob(os.path.join(path, "ids", "*.orc"))
    assert max(pyarrow.orc.ORCFile(f).nstripes for f in files) > 1
    every = spark.read.schema(tokenfiles.ROWS).orc(f"{path}/ids").select("doc_id", "n_tokens")
    # ranges of doc_id leave out all but a group of rows
    assert 0 < read_rows(every.where("doc_id = 20000")) <= 4 * tokenfiles.INDEX_STRIDE
    # odd ids lie within the ranges; only Bloom filters can tell that they aren't there
    assert sum(read_rows(every.where(f"doc_id = {i}")) == 0 for i in range(10_001, 10_021, 2)) >= 7
    plan = tokenfiles.read_token_ids(spark, path).where("doc_id = 20000")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,20000)" in plan


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab é×Z9'.,-\n\t  \x1c\x85中s<|>"), max_size=20), min_size=1, max_size=4))
def test_chunks_hold_in_any_text(texts):
    encoder = test_chunks_hold_in_any_text.__dict__.setdefault("encoder", ByteEncoder(VOCABULARY))
    n, pieces = pieces_of(pa.array(texts))
    at = 0
    for text, size in zip(texts, n):
        mine = pieces.slice(at, size)
        at += size
        first = encoder.numbers([mine[0].as_py()], False)
        units = np.r_[first, encoder.units(mine.slice(1)).ravel()] if size > 1 else first
        assert encoder.ids_of(units)[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_whole_table(spark, tokenizer):
    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test data")
    docs = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    wanted, at = [], 0
    for doc_id, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, END]
        wanted.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, tokenfiles.op12_tokenfiles(spark, data).collect())) == wanted
