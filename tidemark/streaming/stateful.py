"""Streams with state of their own: similar titles with expiry, windows at each event, and a log of changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import normal_title
from ..operators.news import Titles

DAY_MS = 86_400_000
#: Times keep their microseconds in the log of changes.
JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}


def title_clusters(articles: DataFrame, late: str = "2 hours", ttl_ms: int = DAY_MS, least: float = 0.65, most: int | None = None) -> DataFrame:
    """(id, company, day, cluster) of a stream of articles (id, company, day, title, seen).

    The state of a company's day is its titles (`most` at most, where given), each for `ttl_ms` from when it was seen: an article that resembles
    one of them joins its cluster, also when it comes late, and else registers. Rows of a batch are taken by time and id.
    The state goes when the watermark has passed its last title's time.
    """

    def place(key, batches, state) -> Iterator:
        import pandas as pd

        known = Titles(least, most, ttl_ms)
        if state.exists:
            known.load(*state.get)
        if state.hasTimedOut:
            known.expire(state.getCurrentWatermarkMs())
        else:
            rows = pd.concat(list(batches)).sort_values(["at", "id"])
            clusters = [known.place(int(i), t, int(at)) for i, t, at in zip(rows["id"], rows["t"], rows["at"], strict=True)]
            yield pd.DataFrame({"id": rows["id"], "company": key[0], "day": key[1], "cluster": clusters})
        ends = known.last() + ttl_ms if known.titles else 0
        if ends > state.getCurrentWatermarkMs():
            state.update(known.dump())
            state.setTimeoutTimestamp(ends)
        elif state.exists:
            state.remove()

    rows = articles.withWatermark("seen", late).select("id", "company", "day", "seen", normal_title(F.col("title")).alias("t"), F.unix_millis("seen").alias("at"))
    return rows.groupBy("company", "day").applyInPandasWithState(place, "id long, company string, day date, cluster long", "titles array<string>, clusters array<bigint>, added array<bigint>", "append", "EventTimeTimeout")


def interval_windows(stream: DataFrame, key: str, time: str, value: str, size_ms: int, late: str = "1 day") -> DataFrame:
    """(key, time, n, mean, std, low, high) at every event of a stream, over the key's events of the last `size_ms`, both ends in.

    An event's row comes once, when the watermark has reached its time, so that late events count. The state of a key is the
    events that a window still to come can hold. Null values count in no window; std is that of a sample, null for one value.
    """
    kind = stream.schema[key].dataType.simpleString()
    size = size_ms * 1000

    def emit(key_, batches, state) -> Iterator:
        import pandas as pd

        t, v = (np.array(x, k) for x, k in zip(state.get[:2], (np.int64, float), strict=True)) if state.exists else (np.zeros(0, np.int64), np.zeros(0))
        done = state.get[2] if state.exists else np.iinfo(np.int64).min
        if not state.hasTimedOut:
            rows = pd.concat(list(batches))
            t, v = np.concatenate((t, rows["at"].to_numpy(np.int64))), np.concatenate((v, rows["v"].to_numpy(float)))
            order = np.argsort(t, kind="stable")
            t, v = t[order], v[order]
        now = state.getCurrentWatermarkMs() * 1000
        a, b = np.searchsorted(t, done, side="right"), np.searchsorted(t, now, side="right")
        if b > a:
            yield windows_at(t, v, a, b, size).assign(k=key_[0])[["k", "at", "n", "mean", "std", "low", "high"]]
            done = int(t[b - 1])
        oldest = (t[b] if b < len(t) else now) - size
        t, v = t[(first := np.searchsorted(t, oldest)) :], v[first:]
        if len(t):
            state.update((t.tolist(), v.tolist(), int(done)))
            pending = t[t > now]
            state.setTimeoutTimestamp(int(max(-(-(pending[0] if len(pending) else t[-1] + size + 1) // 1000), now // 1000 + 1)))
        elif state.exists:
            state.remove()

    rows = stream.withWatermark(time, late).select(F.col(key).alias("k"), time, F.unix_micros(time).alias("at"), F.col(value).cast("double").alias("v"))
    found = rows.groupBy("k").applyInPandasWithState(emit, f"k {kind}, at long, n long, mean double, std double, low double, high double", "t array<bigint>, v array<double>, done bigint", "append", "EventTimeTimeout")
    return found.select(F.col("k").alias(key), F.timestamp_micros("at").alias(time), "n", "mean", "std", "low", "high")


def windows_at(t: np.ndarray, v: np.ndarray, a: int, b: int, size: int):
    """Statistics of v over [t - size, t] for the events a to b of sorted times t, as a pandas table."""
    import pandas as pd

    low, high = np.searchsorted(t, t[a:b] - size), np.searchsorted(t, t[a:b], side="right")
    there = ~np.isnan(v)

    def over(op, x, none):
        pairs = np.stack((low, high), axis=1).ravel()
        return op.reduceat(np.append(x, none), pairs)[::2]

    n = over(np.add, there.astype(np.int64), 0)
    with np.errstate(all="ignore"):
        mean = np.where(n > 0, over(np.add, np.where(there, v, 0.0), 0.0) / n, np.nan)
        std = np.full(len(n), np.nan)
        for k in np.flatnonzero(n > 1):
            x = v[low[k] : high[k]]
            std[k] = np.std(x[~np.isnan(x)], ddof=1)
        least, most = over(np.minimum, np.where(there, v, np.inf), np.inf), over(np.maximum, np.where(there, v, -np.inf), -np.inf)
    nothing = lambda x: np.where(n > 0, x, np.nan)
    return pd.DataFrame({"at": t[a:b], "n": n, "mean": mean, "std": std, "low": nothing(least), "high": nothing(most)})


def changes(stream: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The stream's columns with time and diff: a log in which each key's latest row by `order` replaces the one before.

    A later row of a key gives the old one with diff -1 and itself with diff 1, both at the time of the new one (in
    microseconds, of a time, else the order itself); a row that is no later changes nothing; ties go to the greater row. The
    state of a key is its last row. Sums of diffs over equal rows give the table at any time, whatever was restarted.
    """
    at = F.unix_micros(order) if isinstance(stream.schema[order].dataType, T.TimestampType) else F.col(order).cast("long")

    def log(key, batches, state) -> Iterator:
        import pandas as pd

        last = tuple(state.get) if state.exists else None
        out = []
        rows = pd.concat(list(batches)).sort_values(["at", "row"])
        for now in zip(rows["at"].astype("int64").tolist(), rows["row"].tolist(), strict=True):
            if last is None or now > last:
                if last is not None:
                    out.append((last[1], now[0], -1))
                out.append((now[1], now[0], 1))
                last = now
        state.update(last)
        yield pd.DataFrame(out, columns=["row", "time", "diff"])

    rows = stream.where(at.isNotNull()).select(F.to_json(F.struct(*keys), JSON).alias("key"), at.alias("at"), F.to_json(F.struct(*stream.columns), JSON).alias("row"))
    found = rows.groupBy("key").applyInPandasWithState(log, "row string, time bigint, diff int", "at bigint, row string", "append", "NoTimeout")
    return found.select(F.from_json("row", stream.schema.simpleString(), JSON).alias("r"), "time", "diff").select("r.*", "time", "diff")


def table_at(log: DataFrame, until: Column | None = None) -> DataFrame:
    """The rows of a log of changes that stand, or stood at the time `until`."""
    log = log if until is None else log.where(F.col("time") <= until)
    columns = [n for n in log.columns if n not in ("time", "diff")]
    return log.groupBy(*columns).agg(F.sum("diff").alias("__n")).where("__n > 0").select(*columns)
