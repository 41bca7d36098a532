"""Bloom layers by counting, and growing files read across restarts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import bloom
from tidemark.sources import tail


def test_no_key_is_lost_and_few_others_pass(spark):
    keys = spark.range(60_000).select(F.md5(F.col("id").cast("string")).alias("k"))
    kept = bloom.bloom_filter(keys, "k", 60_000, 1e-3)
    asked = spark.range(40_000, 400_000).select((F.col("id") < 60_000).alias("there"), F.md5(F.col("id").cast("string")).alias("k"))
    got = {tuple(r) for r in asked.select("there", bloom.maybe_in(asked, "k", kept, 60_000, 1e-3).alias("m")).groupBy("there", "m").count().collect()}
    count = {(there, m): n for there, m, n in got}
    assert (True, False) not in count and count[True, True] == 20_000
    assert 0.0003 < count[False, True] / 340_000 < 0.003


def test_merged_filters_are_the_filter_of_all(spark):
    keys = spark.range(5_000).select(F.col("id").cast("string").alias("k"))
    parts = [bloom.bloom_filter(keys.where(F.col("k").cast("int") % 3 == r), "k", 10_000, 1e-2) for r in range(3)]
    whole = bloom.bloom_filter(keys.unionByName(keys.select(F.lit(None).cast("string").alias("k"))), "k", 10_000, 1e-2)
    assert sorted(map(tuple, bloom.merged(*parts).collect())) == sorted(map(tuple, whole.collect()))


def test_shape_of_the_given_filter():
    assert bloom.shape() == (191_701_184, 13)


def test_layers(spark):
    seen = spark.createDataFrame([("a", "2024-01-01"), ("b", "2024-02-20"), ("b", "2023-01-01")], "url_hash string, d string").select("url_hash", F.to_date("d").alias("seen_at"))
    new = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "c"), (5, None), (6, None)], "id long, url_hash string")
    kept = bloom.bloom_filter(seen, "url_hash", 1000, 1e-4)
    got = {r.id: (r.layer, r.maybe) for r in bloom.url_layers(new, kept, seen, seen, F.lit("2024-03-01").cast("date"), capacity=1000).collect()}
    assert got == {1: ("registry", True), 2: ("cache", True), 3: ("new", False), 4: ("batch", False), 5: ("new", False), 6: ("new", False)}
    everything = bloom.bloom_filter(spark.range(3000).select(F.col("id").cast("string").alias("k")), "k", 64, 0.5)  # all bits set: only look-ups decide
    got = {r.id: r.layer for r in bloom.url_layers(new, everything, seen, seen, F.lit("2024-03-01").cast("date"), capacity=64, rate=0.5).collect()}
    assert got == {1: "registry", 2: "cache", 3: "new", 4: "batch", 5: "new", 6: "new"}


def drained(spark, tmp_path, per_batch=0):
    stream = tail.tail(spark, f"{tmp_path}/in", "k int, v double, d date, s string", per_batch)
    stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    return sorted((r.k, r.v, str(r.d), r.s) for r in spark.read.schema("k int, v double, d date, s string").parquet(f"{tmp_path}/out").collect())


def test_growing_files_give_each_line_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("s,k,v,d\nx,1,7.2%,2024-01-02\nbroken,one,2,2024-01-02\ny,2,\"1,000.5\",2024-01-0")
    (folder / "note.txt").write_text("k\n5\n")
    assert drained(spark, tmp_path) == [(1, 7.2, "2024-01-02", "x")]  # the last line is not whole yet
    with (folder / "a.csv").open("a") as f:
        f.write("3\nz,3,,2024-01-04\n")
    (folder / "b.csv").write_text("k,s\n9,é\n\n10,last\n")
    want = [(1, 7.2, "2024-01-02", "x"), (2, 1000.5, "2024-01-03", "y"), (3, None, "2024-01-04", "z"), (9, None, "None", "é"), (10, None, "None", "last")]
    assert drained(spark, tmp_path) == want and drained(spark, tmp_path) == want


def test_spans_cut_anywhere_give_each_line_once(tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("k,s\n" + "".join(f"{k},{'é' * (k % 13)}\n" for k in range(200)))
    reader = tail.TailReader(fields("k int, s string"), {"path": str(tmp_path)})
    size = reader.latestOffset()[str(path)]
    assert size == path.stat().st_size
    for step in (1, 7, 64, 10_000):
        rows = [r for at in range(0, size, step) for r in reader.read(tail.Span(str(path), at, min(at + step, size), size))]
        assert rows == [(k, "é" * (k % 13) or None) for k in range(200)]
    paced, seen = tail.TailReader(reader.schema, {"path": str(tmp_path), "per_batch": "300"}), {}
    for _ in range(40):
        now = paced.latestOffset()
        paced.partitions(seen, now)
        assert now[str(path)] >= seen.get(str(path), 0)
        seen = now
    assert seen[str(path)] == size


def fields(schema):
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    kinds = {"int": IntegerType(), "string": StringType()}
    return StructType([StructField(n, kinds[t]) for n, t in (c.split(" ") for c in schema.split(", "))])
