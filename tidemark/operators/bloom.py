"""A Bloom filter as a table of words, and the three layers that tell new addresses from seen ones."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys and share of false positives that a filter is made for.
CAPACITY, RATE = 10_000_000, 1e-4


def shape(capacity: int = CAPACITY, rate: float = RATE) -> tuple[int, int]:
    """(bits, places a key): the least filter with that share of false positives at that number of keys, in whole words."""
    bits = math.ceil(-capacity * math.log(rate) / math.log(2) ** 2 / 64) * 64
    return bits, max(1, round(bits / capacity * math.log(2)))


def _halves(key: Column, bits: int) -> tuple[Column, Column]:
    return F.pmod(F.xxhash64(key), F.lit(bits)), F.pmod(F.xxhash64(F.lit(1), key), F.lit(bits - 1)) + 1


def bloom_filter(keys: DataFrame, key: str, capacity: int = CAPACITY, rate: float = RATE) -> DataFrame:
    """(word, bits) of a filter that holds the column `key`; null keys are in none.

    Tasks combine their words before the shuffle, so it moves capacity-bound words and not keys. Filters of one shape are
    merged by `merged`; written as a table, a filter is kept for later runs.
    """
    bits, places = shape(capacity, rate)
    a, b = _halves(F.col(key), bits)
    rows = keys.where(F.col(key).isNotNull()).select(a.alias("a"), b.alias("b"))
    at = rows.select(F.explode(F.array(*(F.pmod(F.col("a") + k * F.col("b"), F.lit(bits)) for k in range(places)))).alias("at"))
    return _merged(at.select(F.floor(F.col("at") / 64).alias("word"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bits")))


def merged(*filters: DataFrame) -> DataFrame:
    """The filter of all keys of filters of one shape."""
    both = filters[0]
    for other in filters[1:]:
        both = both.unionByName(other)
    return _merged(both)


def _merged(rows: DataFrame) -> DataFrame:
    return rows.groupBy("word").agg(F.bit_or("bits").alias("bits"))


def maybe_in(df: DataFrame, key: str, bloom: DataFrame, capacity: int = CAPACITY, rate: float = RATE) -> Column:
    """Whether the filter may hold the key; false is certain. Null keys are in none.

    The filter goes through the driver to the tasks: shape()[0] / 8 bytes, 24 MB at the given capacity, however many keys.
    """
    bits, places = shape(capacity, rate)
    found = bloom.toArrow()
    words = np.zeros(bits // 64, np.int64)
    words[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    shared = df.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def probe(a, b):
        import pandas as pd

        a, b = a.to_numpy(np.int64, na_value=0), b.to_numpy(np.int64, na_value=0)
        hit = np.ones(len(a), bool)
        for k in range(places):
            at = (a + k * b) % bits
            hit &= (shared.value[at >> 6] >> (at & 63) & 1).astype(bool)
        return pd.Series(hit)

    return probe(*_halves(F.col(key), bits)) & F.col(key).isNotNull()


def url_layers(articles: DataFrame, bloom: DataFrame, cache: DataFrame, registry: DataFrame, now: Column, days: int = 30, capacity: int = CAPACITY, rate: float = RATE) -> DataFrame:
    """articles (id, url_hash) with layer and maybe: 'new', 'batch', 'cache' or 'registry', and what the filter said of it.

    The filter holds every known hash; what it does not hold is new without a look-up. The others are looked for in the cache
    (url_hash, seen_at), where entries count for `days` before `now`, then in the registry (url_hash). Of several articles
    with one new address the least id is new and the rest are of the batch; a null address is new each time. Hashes of the
    batch meet in one row before they are probed and looked up.
    """
    one = articles.where("url_hash is not null").groupBy("url_hash").agg(F.min("id").alias("__first"))
    one = one.withColumn("maybe", maybe_in(one, "url_hash", bloom, capacity, rate))
    live = cache.where(F.col("seen_at") >= now - F.expr(f"INTERVAL {int(days)} DAYS")).select("url_hash").distinct().withColumn("__cache", F.lit(True))
    known = registry.select("url_hash").distinct().withColumn("__registry", F.lit(True))
    asked = one.where("maybe").join(live, "url_hash", "left").join(known, "url_hash", "left").select("url_hash", F.when(F.col("__cache"), "cache").when(F.col("__registry"), "registry").alias("__seen"))
    found = articles.join(one, "url_hash", "left").join(asked, "url_hash", "left")
    layer = F.when(F.col("__seen").isNotNull(), F.col("__seen")).when(F.col("id") > F.col("__first"), "batch").otherwise("new")
    return found.select(*articles.columns, layer.alias("layer"), F.coalesce("maybe", F.lit(False)).alias("maybe"))
