"""Window operators over ordered series: rolling, range, exponential, fractional, as-of."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def series(key: str | list[str] = "pair", order: str = "ts_ms") -> WindowSpec:
    return Window.partitionBy(key).orderBy(order)


def rolling(agg, x: Column, w: WindowSpec, n: int, least: int | None = None) -> Column:
    """agg(x) over the last n rows; null unless `least` (n by default) of them have a value, as a dataframe library's rolling windows do."""
    frame = w.rowsBetween(-(n - 1), 0)
    return F.when(F.count(x).over(frame) >= (least or n), agg(x).over(frame))


def rolling_range(agg, x: Column, key: str, ts_ms: str, days: int) -> Column:
    """agg(x) over the rows of the last `days` days, both ends included."""
    return agg(x).over(Window.partitionBy(key).orderBy(ts_ms).rangeBetween(-days * 86_400_000, 0))


def at_offset(x: Column, key: str, ts_ms: str, days: int) -> Column:
    """x of the row exactly `days` days away, if there is one."""
    ms = days * 86_400_000
    return F.first(x).over(Window.partitionBy(key).orderBy(ts_ms).rangeBetween(ms, ms))


def change(x: Column, w: WindowSpec, k: int = 1) -> Column:
    """x / x k rows ago - 1; null for a zero or missing past."""
    return F.try_divide(x - F.lag(x, k).over(w), F.lag(x, k).over(w))


def reach(alpha: float, tiny: float = 1e-18) -> int:
    """Rows after which a weight (1 - alpha)^k is under `tiny`, which no sum of doubles shows."""
    return math.ceil(math.log(tiny) / math.log(1 - alpha))


def _decayed(df: DataFrame, sums: dict[str, Column], seen: Column, alpha: float, key: str, order: str) -> DataFrame:
    """df with sums of values, each times (1 - alpha)^k where k values came after it; seen counts the values up to a row.

    Values are cut into blocks as long as weights last. A row's sum is that of its block so far and of the block before,
    each a plain window sum of values scaled by their place in the block, so no row carries a list of its past.
    """
    keep, block = 1 - alpha, reach(alpha)
    df = df.withColumn("__n", (seen - 1).cast("long"))
    at = F.pmod("__n", F.lit(block)).cast("double")
    df = df.withColumns({"__b": F.floor(F.col("__n") / block), "__j": at, **{f"__v_{n}": x * F.pow(F.lit(1 / keep), at) for n, x in sums.items()}})
    own = Window.partitionBy(key, "__b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    past = Window.partitionBy(key).orderBy("__b").rangeBetween(-1, -1)
    scale = F.pow(F.lit(keep), F.col("__j"))
    out = {n: scale * (F.coalesce(F.sum(f"__v_{n}").over(own), F.lit(0.0)) + keep**block * F.coalesce(F.sum(f"__v_{n}").over(past), F.lit(0.0))) for n in sums}
    return df.withColumns(out).drop("__b", "__j", *(f"__v_{n}" for n in sums))


def with_ewm(df: DataFrame, mean: str, std: str | None, x: Column, alpha: float, key: str = "pair", order: str = "ts_ms") -> DataFrame:
    """df with mean and std under weights (1 - alpha)^i over i values back, normalised; std corrected for bias, null for one value.

    Nulls are no values. Squares are taken around the key's first value, so that a large level costs no digits.
    """
    w = series(key, order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("__x", x.cast("double")).withColumns({"__seen": F.count("__x").over(w), "__first": F.first("__x", ignorenulls=True).over(w)})
    z = F.col("__x") - F.col("__first")
    df = _decayed(df, {"__s1": z, "__s2": z * z}, F.col("__seen"), alpha, key, order)
    keep = 1 - alpha
    n, n2 = ((1 - F.pow(F.lit(q), F.col("__seen"))) / (1 - q) for q in (keep, keep * keep))
    m = F.col("__s1") / n
    out = {mean: F.when(F.col("__seen") > 0, F.col("__first") + m)}
    if std:
        out[std] = F.when(F.col("__seen") > 1, F.sqrt(F.greatest(F.lit(0.0), F.col("__s2") - n * m * m) / (n - n2 / n)))
    return df.withColumns(out).drop("__x", "__n", "__seen", "__first", "__s1", "__s2")


def skew(x: Column, frame: WindowSpec, n: int) -> Column:
    """Bias-corrected skewness of n values."""
    return F.skewness(x).over(frame) * math.sqrt(n * (n - 1)) / (n - 2)


def kurt(x: Column, frame: WindowSpec, n: int) -> Column:
    """Bias-corrected excess kurtosis of n values."""
    return (F.kurtosis(x).over(frame) * (n + 1) + 6) * (n - 1) / ((n - 2) * (n - 3))


def difference_weights(d: float = 0.4, tiny: float = 1e-5, most: int = 500) -> list[float]:
    """Weights of a fractional difference, newest first: w[k] = -w[k-1] * (d - k + 1) / k, while not tiny."""
    w = [1.0]
    while len(w) < most and abs(nxt := -w[-1] * (d - len(w) + 1) / len(w)) >= tiny:
        w.append(nxt)
    return w


def ordered_pass(df: DataFrame, key: str, order: str, reads: list[str], adds: list[str], make: Callable) -> DataFrame:
    """df with the doubles `adds`, by make(arrays of the columns `reads` of one key's next rows, state) -> (arrays, state).

    Rows are dealt by key and sorted by `order`, and stream through in Arrow batches; the state, None at a key's start, is
    carried from batch to batch, so a key needs the memory of a batch and of its state. Only key and `reads` are looked at:
    the other columns pass as they are. Nulls are read as NaN, and NaN is written as null.
    """
    names = df.columns
    at, key_at = [names.index(n) for n in reads], names.index(key)

    def task(batches):
        import numpy as np
        import pyarrow as pa

        last, state = None, None
        for batch in batches:
            keys = batch.column(key_at).to_pylist()
            starts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1]), len(keys)] if keys else []
            columns = [batch.column(k).cast(pa.float64()).to_numpy(zero_copy_only=False) for k in at]
            made = [[] for _ in adds]
            for s, e in itertools.pairwise(starts):
                state = state if s == 0 and last == (keys[0],) else None
                last = (keys[s],)
                found, state = make([c[s:e] for c in columns], state)
                for out, x in zip(made, found, strict=True):
                    out.append(np.asarray(x, float))
            arrays = [pa.array(np.concatenate(x) if x else np.zeros(0), pa.float64(), from_pandas=True) for x in made]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=[*batch.schema.names, *adds])

    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes), *(f"`{n}` double" for n in adds)])
    return df.repartition(key).sortWithinPartitions(key, order).mapInArrow(task, schema)


def with_macd(df: DataFrame, line: str, signal: str, x: str, fast: float, slow: float, smooth: float, key: str = "pair", order: str = "ts_ms") -> DataFrame:
    """df with the difference of two exponential means of x and that difference's own mean, in one pass that carries three numbers.

    A mean is y = y before * (1 - alpha) + x * alpha, from the first value on; a row without a value keeps what was.
    """

    def make(columns, state):
        f, s, m = state or (math.nan, math.nan, math.nan)
        lines, signals = [], []
        for v in columns[0].tolist():
            if v == v:
                f = v if f != f else f * (1 - fast) + v * fast
                s = v if s != s else s * (1 - slow) + v * slow
                m = f - s if m != m else m * (1 - smooth) + (f - s) * smooth
            lines.append(f - s)
            signals.append(m)
        return [lines, signals], (f, s, m)

    return ordered_pass(df, key, order, [x], [line, signal], make)


def with_fractional_differences(df: DataFrame, columns: dict[str, str], key: str = "pair", order: str = "ts_ms", d: float = 0.4, tiny: float = 1e-5, most: int = 500) -> DataFrame:
    """df with, for each {out: column}, the weighted sum over its last rows; null until there are as many as weights.

    One pass in order: what is carried is the last rows of each column. A null makes the sums that hold it null.
    """
    import numpy as np

    weights = np.array(difference_weights(d, tiny, most))

    def make(arrays, state):
        last = state or [np.zeros(0)] * len(arrays)
        out, now = [], []
        for before, new in zip(last, arrays, strict=True):
            x = np.concatenate([before, new])
            full = np.convolve(x, weights, "valid") if len(x) >= len(weights) else np.zeros(0)
            if np.isnan(full).any():
                holes = np.convolve(np.isnan(x), np.ones(len(weights)), "valid") > 0.5
                full = np.where(holes, np.nan, np.convolve(np.nan_to_num(x), weights, "valid"))
            out.append(np.concatenate([np.full(max(0, len(new) - len(full)), np.nan), full[-len(new) :] if len(full) else full]))
            now.append(x[-(len(weights) - 1) :])
        return out, now

    return ordered_pass(df, key, order, list(columns.values()), list(columns), make)


def with_expanding_quantiles(df: DataFrame, x: str, quantiles: dict[str, float], key: str = "pair", order: str = "ts_ms") -> DataFrame:
    """df with exact quantiles, linear between neighbours, of all values of x up to each row; nulls are no values.

    One pass in order that carries the key's values, sorted, as exact quantiles of a growing past need all of it: 8 bytes a
    value. expanding_quantiles_by_rank is for keys of which one task can't hold the values.
    """
    import bisect

    def make(columns, state):
        past = state or []
        found: list[list[float]] = [[] for _ in quantiles]
        for v in columns[0].tolist():
            if v == v:
                bisect.insort(past, v)
            for out, q in zip(found, quantiles.values(), strict=True):
                at = q * (len(past) - 1)
                low = int(at)
                out.append(past[low] + (past[min(low + 1, len(past) - 1)] - past[low]) * (at - low) if past else math.nan)
        return found, past

    return ordered_pass(df, key, order, [x], list(quantiles), make)


def percentile_rank(x: Column, w: WindowSpec, n: int = 120, least: int = 20) -> Column:
    """Percentage of the values before, within n rows, that are under the current one; null under `least` values."""
    past = F.collect_list(x).over(w.rowsBetween(-(n - 1), 0))
    share = F.size(F.filter(past, lambda v: v < x)) / (F.size(past) - 1) * 100
    return F.when(x.isNotNull() & (F.size(past) >= least), share)


def forward_fill(x: Column, w: WindowSpec) -> Column:
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def keep_latest(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first by `order`."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def asof_join(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, values: list[str]) -> DataFrame:
    """left with the values of the latest right row of its key at or before its time; null if there is none.

    Both sides meet in one window per key, a shuffle of the union, with no join and no pairs. At equal times a right row
    comes first; of right rows with equal times, the greatest values count. Without a key the whole table would be one
    window, so that is refused.
    """
    if not on:
        raise ValueError("an as-of join needs a key")
    names = left.columns
    value = F.struct(*(F.col(v) for v in values))
    l = left.select(F.struct(*names).alias("__row"), *(F.col(k) for k in on), F.col(left_time).alias("__t"), F.lit(1).alias("__side"))
    r = right.where(F.col(right_time).isNotNull()).select(*(F.col(k) for k in on), F.col(right_time).alias("__t"), F.lit(0).alias("__side"), value.alias("__value"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*on).orderBy(F.col("__t").asc_nulls_first(), "__side", "__value").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__last", F.last("__value", ignorenulls=True).over(w)).where("__side = 1")
    return both.select("__row.*", *(F.when(F.col("__t").isNotNull(), F.col("__last")[v]).alias(v) for v in values))


def lagged_by_time(df: DataFrame, x: str, time: str, days: list[int], name: str, key: list[str] | None = None) -> DataFrame:
    """df with {name}_{k}: x at exactly k days before, in one window and without self-joins; times are dates or timestamps."""
    w = Window.partitionBy(*(key or [F.lit(0)])).orderBy("__d")
    out = df.withColumn("__d", F.unix_date(F.col(time).cast("date")))
    for k in days:
        out = out.withColumn(f"{name}_{k}", F.first(x).over(w.rangeBetween(-k, -k)))
    return out.drop("__d")
