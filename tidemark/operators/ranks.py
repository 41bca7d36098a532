"""Order statistics of a growing past where no task can hold a key: ranks are found by counts of time and value blocks."""

from __future__ import annotations

import bisect
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import shared_folder


def _written(df: DataFrame, name: str) -> DataFrame:
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def expanding_quantiles_by_rank(df: DataFrame, x: str, quantiles: dict[str, float], key: str = "pair", order: str = "ts_ms", block: int = 1_000_000) -> DataFrame:
    """(key, order, a column for each quantile): as with_expanding_quantiles, for keys of any length; rows are one a key and order.

    Rows are dealt to ranges of about `block` by time and, of those with a value, by value; both dealings are written, as a
    second sampling could deal otherwise. Counts of the value blocks before each time block say, row by row inside it, which
    value block holds the wanted rank and at what place; that block's values up to the row then give it. A task holds a time
    block with one count a value block, or a value block with the questions of one time block. Nulls are no values; rows
    before a key's first value have null quantiles. The questions and answers are two rows a row and quantile.
    """
    kind = {n: t for n, t in df.dtypes}
    name = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("")).cast("binary")  # null keys are a key
    rows = df.select(F.col(key).alias("key"), name.alias("k"), F.col(order).alias("o"), F.col(x).cast("double").alias("x"))
    parts = max(1, math.ceil(rows.count() / block))
    by_time = _written(rows.repartitionByRange(parts, "k", "o").withColumn("p", F.spark_partition_id()), "by-time")
    by_value = _written(by_time.where("x is not null and not isnan(x)").repartitionByRange(parts, "k", "x", "o").withColumn("b", F.spark_partition_id()), "by-value")
    counts = by_value.groupBy("k", "p", "b").agg(F.count("*").alias("n"))
    grid = by_time.select("k", "p").distinct().join(by_value.select("k", "b").distinct(), "k").join(counts, ["k", "p", "b"], "left")
    grid = grid.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("k", "b").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    grid = grid.groupBy("k", "p").agg(F.array_sort(F.collect_list(F.struct("b", "before"))).alias("blocks"))
    timed = by_time.join(by_value.select("k", "o", "b"), ["k", "o"], "left").select("k", "p", "o", "b")
    wanted = list(quantiles.values())
    asked_as = f"k binary, p int, o {kind[order]}, q int, high int, share double, b int, place long"

    def ask(here, blocks):
        import pandas as pd

        if here.empty or blocks.empty:
            return pd.DataFrame({c.split(" ")[0]: [] for c in asked_as.split(", ")})
        here = here.sort_values("o")
        ids = np.array([v["b"] for v in blocks["blocks"].iloc[0]])
        held = np.array([v["before"] for v in blocks["blocks"].iloc[0]], np.int64)
        at = np.searchsorted(ids, here["b"].fillna(-1).to_numpy(np.int64))
        there = here["b"].notna().to_numpy()
        step, out = max(1, (1 << 20) // len(ids)), []
        for s in range(0, len(here), step):
            new = np.zeros((min(step, len(here) - s), len(ids)), np.int64)
            mine = there[s : s + step]
            new[np.flatnonzero(mine), at[s : s + step][mine]] = 1
            up_to = np.cumsum(new, axis=0) + held
            held, below = up_to[-1], np.cumsum(up_to, axis=1)
            total = below[:, -1]
            for q, share in enumerate(wanted):
                exact = share * (total - 1)
                low = np.floor(exact).astype(np.int64)
                for high in (0, 1):
                    rank = np.minimum(low + high, total - 1)
                    j = np.minimum((below <= rank[:, None]).sum(axis=1), len(ids) - 1)
                    place = rank - np.where(j > 0, below[np.arange(len(j)), j - 1], 0)
                    out.append(pd.DataFrame({"o": here["o"].iloc[s : s + step], "q": q, "high": high, "share": exact - low, "b": ids[j], "place": place})[total > 0])
        found = pd.concat(out, ignore_index=True)
        return found.assign(k=[here["k"].iloc[0]] * len(found), p=int(here["p"].iloc[0]))[["k", "p", "o", "q", "high", "share", "b", "place"]]

    asked = _written(timed.groupBy("k", "p").cogroup(grid.toDF("gk", "gp", "blocks").groupBy("gk", "gp")).applyInPandas(ask, asked_as), "asked")
    needed = asked.select("k", "b", "p").distinct().withColumnRenamed("p", "at")
    values = by_value.join(needed, ["k", "b"]).where(F.col("p") <= F.col("at")).select("k", "b", "at", "p", "o", "x").toDF("vk", "vb", "at", "vp", "o", "x")
    told_as = f"k binary, o {kind[order]}, q int, high int, share double, x double"

    def tell(questions, values):
        import pandas as pd

        if questions.empty:
            return pd.DataFrame({c.split(" ")[0]: [] for c in told_as.split(", ")})
        questions, values = questions.sort_values("o"), values.sort_values("o")
        earlier = values["vp"] < questions["p"].iloc[0]
        held = sorted(values["x"][earlier].tolist())
        later = list(zip(values["o"][~earlier], values["x"][~earlier], strict=True))
        found, k = [], 0
        for o, place in zip(questions["o"], questions["place"], strict=True):
            while k < len(later) and later[k][0] <= o:
                bisect.insort(held, later[k][1])
                k += 1
            found.append(held[place])
        return questions.assign(x=found)[["k", "o", "q", "high", "share", "x"]]

    told = asked.groupBy("k", "b", "p").cogroup(values.groupBy("vk", "vb", "at")).applyInPandas(tell, told_as)
    pick = lambda q, high, c: F.max(F.when((F.col("q") == q) & (F.col("high") == high), F.col(c)))
    value = lambda q: pick(q, 0, "x") + (pick(q, 1, "x") - pick(q, 0, "x")) * pick(q, 0, "share")
    answers = told.groupBy("k", "o").agg(*(value(q).alias(n) for q, n in enumerate(quantiles)))
    return by_time.select("key", "k", "o").join(answers, ["k", "o"], "left").drop("k").withColumnsRenamed({"key": key, "o": order})
