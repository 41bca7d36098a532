"""What the operators leave on the disks of executors while they run."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm.components import components


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffles(spark):
    """Ids of the shuffles that have files."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(k).getName() for k in range(files.size())]
    return {n.split("_")[1] for n in names if n.startswith("shuffle_")}


@pytest.mark.parametrize("write", [common.keep, common.cut])
def test_written_tables_leave_no_shuffle_files(spark, write):
    """Without a collection of the driver's garbage; the session's setting and the table stay."""
    before, was = shuffles(spark), spark.conf.get(CLEANUP)
    df = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n")).repartition(3)
    made = write(df)
    end = time.time() + 20
    while shuffles(spark) - before and time.time() < end:
        time.sleep(0.1)
    assert not shuffles(spark) - before
    assert spark.conf.get(CLEANUP) == was
    assert sorted(map(tuple, made.collect())) == sorted(map(tuple, df.collect())) == [(k, 100) for k in range(10)]


def test_few_edges_go_through_few_tasks(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200) if k % 20 != 19], "u long, v long").repartition(50)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    coalesced = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", "60")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        few, many = components(edges), components(edges, broadcast=1)
        assert few.rdd.getNumPartitions() <= 8 < many.rdd.getNumPartitions()
        want = [(k, k - k % 20) for k in range(200) if k % 20]
        assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesced)


def test_few_edges_are_not_joined_nor_stepped_over_in_vain(spark, monkeypatch):
    """Of stars nothing is left to do; steps over other edges have no broadcasts, whose plans and tables fill the driver's memory."""
    from tidemark.llm import components as module

    plans = []
    monkeypatch.setattr(module, "cut", lambda df: plans.append(df._jdf.queryExecution().toString()) or common.cut(df))
    stars = spark.createDataFrame([(10 * k, 10 * k + j) for k in range(5) for j in range(1, 9)], "u long, v long")
    assert sorted(map(tuple, module.components(stars).collect())) == [(10 * k + j, 10 * k) for k in range(5) for j in range(1, 9)]
    assert len(plans) == 1
    path = spark.createDataFrame([(k, k + 1) for k in range(6)], "u long, v long")
    assert sorted(map(tuple, module.components(path).collect())) == [(k, 0) for k in range(1, 7)]
    assert len(plans) > 2 and not any("Join" in p for p in plans)


@pytest.mark.parametrize("write", [common.keep, common.cut])
def test_written_tables_go_to_python_in_small_batches(spark, write):
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bytes": [b.nbytes]})

    was = spark.conf.get(common.BATCH)
    texts = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("word "), 200_000).alias("text"))
    assert max(r.bytes for r in write(texts.mapInArrow(sizes, "bytes long")).collect()) <= common.BATCH_BYTES + (2 << 20)
    assert spark.conf.get(common.BATCH) == was
    parts = common.in_arrow(texts, lambda cols: {"n": [len(cols["text"])]}, "n int", 2 << 20)
    assert {r.n for r in write(parts).collect()} <= {1, 2}
