"""Stateful streams in shuffled batches against batch results and plain Python, with restarts."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.text import similarity
from tidemark.operators import news
from tidemark.streaming import stateful, streams

START = datetime(2024, 1, 1)
PHRASES = ["central bank raises rates again", "central bank raises rate again today", "oil output falls as storms close ports", "storms close ports and oil output falls", "new chief for the national railway", "short"]


def batches(spark, path, df, order, parts):
    """df as files that a stream takes one at a time, cut by `order`."""
    for k in range(parts):
        df.where(F.pmod(order, F.lit(parts)) == k).coalesce(1).write.mode("append").parquet(path)
    return streams.files(spark, path, df.schema, per_trigger=1)


def run(stream, out, progress):
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()


@pytest.fixture(scope="module")
def articles(spark):
    rng = random.Random(2)
    rows = [(k, f"co{rng.randint(0, 1)}", START.date(), rng.choice(PHRASES) + rng.choice(["", "!", f" {k % 3}"]), START + timedelta(minutes=10 * k)) for k in range(120)]
    return spark.createDataFrame(rows, "id long, company string, day date, title string, seen timestamp").cache()


def test_titles_of_a_replay_in_order_are_those_of_the_batch(spark, articles, tmp_path):
    stream = batches(spark, f"{tmp_path}/in", articles, F.floor(F.col("id") / 20), 6)
    run(stateful.title_clusters(stream), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {r.id: r.cluster for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {r.id: r.cluster for r in news.fuzzy_clusters(articles, ttl_ms=stateful.DAY_MS).collect()} and len(set(got.values())) < 60


def test_titles_expire_and_late_ones_join(spark, tmp_path):
    hours = lambda h: START + timedelta(hours=h)
    first = [(1, "co", START.date(), PHRASES[0], hours(5)), (2, "co", START.date(), PHRASES[2], hours(6))]
    second = [(3, "co", START.date(), PHRASES[1], hours(4.5)), (4, "co", START.date(), PHRASES[3] + " now", hours(28))]
    third = [(5, "co", START.date(), PHRASES[0], hours(30)), (6, "co", START.date(), PHRASES[2], hours(31))]
    kind = "id long, company string, day date, title string, seen timestamp"
    for rows in (first, second, third):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(stateful.title_clusters(streams.files(spark, f"{tmp_path}/in", spark.createDataFrame(rows, kind).schema)), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {r.id: r.cluster for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    alike = similarity(news_title(PHRASES[3] + " now"), news_title(PHRASES[2])) >= 0.65
    assert got[3] == 1 and got[4] == (2 if alike else 4)  # late, and after a restart
    assert got[5] == 5 and got[6] in (6, got[4])  # the first titles are a day old


def news_title(t):
    return " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())


def test_no_more_titles_than_the_bound_are_kept():
    known = news.Titles(0.65, 5)
    for k in range(50):
        known.place(k, f"{k * 7919:010d} {k * 104729:012d} {'abcdefghijklmnopqrstuvwxyz'[k % 26] * 20}", k)
    assert len(known.titles) == 5
    again = news.Titles(0.65, 5)
    again.load(*known.dump())
    assert (again.counts == known.counts).all()


def test_character_counts_hide_no_similar_title():
    rng = random.Random(3)
    for _ in range(300):
        base = "".join(rng.choices("abcdef éü", k=rng.randint(10, 30)))
        other = "".join(c for c in base if rng.random() < 0.8) + rng.choice(["", "xyz", "zzzzzz"])
        known = news.Titles(0.65, 9)
        known.place(1, base)
        want = 1 if len(other) >= 10 and similarity(other, base) >= 0.65 else 2
        assert known.place(2, other) == want


@pytest.mark.parametrize("parts", [1, 4])
def test_interval_windows_are_range_frames(spark, tmp_path, parts):
    rng = random.Random(parts)
    rows = [(k, rng.randint(0, 3), START + timedelta(seconds=rng.randint(0, 864_000), microseconds=rng.randint(0, 3)), rng.choice([None, 1.5, rng.random() * 100])) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, user long, ts timestamp, value double")
    stream = batches(spark, f"{tmp_path}/in", df, F.col("id"), parts)
    late = "20 days"  # the batches are shuffled in time
    run(stateful.interval_windows(stream, "user", "ts", "value", 2 * stateful.DAY_MS, late), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert spark.read.schema("user long").parquet(f"{tmp_path}/out").count() == 0  # the watermark lies before all
    spark.createDataFrame([(999, -1, START + timedelta(days=31), 1.0)], df.schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run(stateful.interval_windows(stream, "user", "ts", "value", 2 * stateful.DAY_MS, late), f"{tmp_path}/out", f"{tmp_path}/cp")
    w = Window.partitionBy("user").orderBy(F.unix_micros("ts")).rangeBetween(-2 * stateful.DAY_MS * 1000, 0)
    want = df.select("user", "ts", F.count("value").over(w).alias("n"), F.avg("value").over(w), F.stddev("value").over(w), F.min("value").over(w), F.max("value").over(w)).collect()
    plain = lambda r: tuple(round(x, 9) if isinstance(x, float) and x == x else None if isinstance(x, float) else x for x in r)
    got = spark.read.parquet(f"{tmp_path}/out").select("user", "ts", "n", "mean", "std", "low", "high").collect()
    assert sorted(map(plain, got), key=str) == sorted(map(plain, want), key=str)


def test_windows_come_once_and_the_state_goes(spark, tmp_path):
    """In order, with a short delay: rows left of all frames are dropped, and each event still has its whole frame."""
    rows = [(k, 1, START + timedelta(hours=k), float(k)) for k in range(200)]
    df = spark.createDataFrame(rows, "id long, user long, ts timestamp, value double")
    stream = batches(spark, f"{tmp_path}/in", df, F.floor(F.col("id") / 20), 10)
    for _ in range(2):  # the second run has nothing new
        run(stateful.interval_windows(stream, "user", "ts", "value", stateful.DAY_MS, "1 hour"), f"{tmp_path}/out", f"{tmp_path}/cp")
    got = {r.ts: (r.n, r.low, r.high) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert len(got) == 199 and all(got[START + timedelta(hours=k)] == (min(k, 24) + 1, float(max(0, k - 24)), float(k)) for k in range(199))
    state = spark.read.format("statestore").load(f"{tmp_path}/cp").collect()
    assert len(state) == 1 and len(state[0].value.groupState.t) <= 26


def test_sums_of_changes_are_the_table(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.randint(0, 9), START + timedelta(microseconds=rng.randint(0, 50)), rng.choice([None, 0.1 + 0.2, rng.random()]), rng.choice([None, "a", 'q"é'])) for _ in range(300)]
    df = spark.createDataFrame(rows, "k long, ts timestamp, x double, s string").withColumn("n", F.monotonically_increasing_id() % 7)
    df.write.parquet(f"{tmp_path}/all")
    df = spark.read.parquet(f"{tmp_path}/all")
    for part in range(3):  # a restart for each
        df.where(F.col("n") % 3 == part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(stateful.changes(streams.files(spark, f"{tmp_path}/in", df.schema), ["k"], "ts"), f"{tmp_path}/out", f"{tmp_path}/cp")
    log = spark.read.parquet(f"{tmp_path}/out")
    best = df.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("ts"), F.desc(F.to_json(F.struct(*df.columns), stateful.JSON))))).where("r = 1").drop("r")
    assert sorted(map(str, stateful.table_at(log).collect())) == sorted(map(str, best.collect()))
    assert log.where("diff = 1").count() - log.where("diff = -1").count() == 10 and log.where("diff = -1").count() > 0
    cut = F.unix_micros(F.lit(START + timedelta(microseconds=25)))
    assert all(r.ts <= START + timedelta(microseconds=25) for r in stateful.table_at(log, cut).collect())


def test_titles_after_the_last_registered_one_are_placed_together():
    """place_rest gives what place gives one by one, for titles of several words of bits, of other letters, and none at all."""
    import random

    from tidemark.operators import news

    rng = random.Random(4)
    base = ["".join(rng.choices("abcdefg hij", k=rng.choice((10, 30, 62, 63, 80, 150)))) for _ in range(30)]
    titles = ["".join(c if rng.random() < 0.75 else rng.choice("klmä\U0001f600") for c in rng.choice(base)) for _ in range(200)] + [*base, None, "", "short"]
    rng.shuffle(titles)
    one, many = news.Titles(0.65, 12), news.Titles(0.65, 12)
    for k, b in enumerate(base):
        assert one.place(k, b) == many.place(k, b)
    assert len(many.titles) == 12
    numbers = list(range(1000, 1000 + len(titles)))
    want = [one.place(n, t) for n, t in zip(numbers, titles)]
    assert many.place_rest(numbers, titles, rows=16) == want and 20 < sum(w < 1000 for w in want) < len(want)
