"""The pipeline's near-copy stage uses operator 1's links."""

from __future__ import annotations

from sparkloom.llm import nearcopies, simhash


def test_what_operator_1_links_is_one_group(spark):
    repeated = " ".join([" ".join(f"r{i}" for i in range(11))] * 100)
    rows = [(i, repeated + " " + " ".join(f"{x}{j}" for j in range(30))) for i, x in enumerate("ab")] + [(7, "some other text of its own"), (8, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["component_id"] for r in simhash.near_duplicate_components(docs).collect()} == {0, 7, 8}
    assert {r["component_id"] for r in nearcopies.near_copy_groups(docs).collect()} == {0, 1, 7, 8}
    assert {r["doc_id"] for r in nearcopies.drop_near_copies(docs).collect()} == {0, 7, 8}


def test_planning_the_grid_takes_the_driver_little_memory(spark):
    from pyspark.sql import functions as F

    from sparkloom.llm import simhash

    threads = spark._jvm.java.lang.management.ManagementFactory.getThreadMXBean()
    own = spark._jvm.java.lang.Thread.currentThread().getId()
    fps = spark.range(200).select(F.xxhash64("id").alias("fp")).distinct()
    cells = simhash._cells(fps).select("cell", "fp").repartition("cell").sortWithinPartitions("cell", "fp")
    before = threads.getThreadAllocatedBytes(own)
    cells._jdf.queryExecution().executedPlan()
    assert threads.getThreadAllocatedBytes(own) - before < 200_000_000
    wanted = set()
    for (fp,) in fps.collect():
        counts = [(fp >> 4 * i & 15).bit_count() for i in range(16)]
        for i, step in [(0, 0)] + [(i, s) for i in range(16) for s in (-1, 1)]:
            if 0 <= counts[i] + step <= 4:
                wanted.add((sum(c * 5**k for k, c in enumerate(counts)) + step * 5**i, fp))
    found = [tuple(r) for r in cells.collect()]
    assert len(found) == len(wanted) and set(found) == wanted
