"""Walk-forward training: every fold of every pair has a scaler and a boosted model of its own, fitted where Spark deals the fold."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .timeseries import keep_latest

# Bars of training and test, the step, trees, their depth and rate, and the clip in standard deviations.
TRAIN, TEST, STEP = 444, 111, 111
TREES, DEPTH, RATE, RIDGE, CLIP = 200, 4, 0.05, 1.0, 3.0
RESULT = "fold long, day date, train_end date, actual double, predicted double, importance array<double>"


def folds(rows: DataFrame, key: str, order: str, train: int = TRAIN, test: int = TEST, step: int = STEP) -> DataFrame:
    """rows once for each fold that they are in, with fold and part ('train' or 'test').

    Fold k of a key tests the `test` rows after the first effective + k * step, and trains on the `effective` rows before
    them: `train`, or what a shorter key has besides one test. Keys of no more than `test` rows have none.
    """
    w = Window.partitionBy(key)
    i, n = F.col("__i"), F.col("__n")
    rows = rows.withColumns({"__i": (F.row_number().over(w.orderBy(order)) - 1).cast("long"), "__n": F.count("*").over(w)}).where(n > test)
    rows = rows.withColumn("__e", F.least(F.lit(train).cast("long"), n - test))
    first = F.greatest(F.lit(0), F.ceil((i - F.col("__e") - test + 1) / step)).cast("long")
    last = F.least(F.floor(i / step), F.floor((n - test - F.col("__e")) / step)).cast("long")
    rows = rows.withColumns({"__a": first, "__b": last}).where("__a <= __b").withColumn("fold", F.explode(F.sequence("__a", "__b")))
    part = F.when(i < F.col("__e") + F.col("fold") * step, "train").otherwise("test")
    return rows.withColumn("part", part).drop("__i", "__n", "__e", "__a", "__b")


def walk_forward(rows: DataFrame, features: list[str], key: str = "pair", order: str = "day", target: str = "target", train: int = TRAIN, test: int = TEST, step: int = STEP, trees: int = TREES, depth: int = DEPTH, rate: float = RATE) -> DataFrame:
    """(key, fold, day, train_end, actual, predicted, importance) per test row of each fold; of steps under `test` the last fold's row.

    Features are scaled by the fold's training rows and nulls are their mean; training rows without a target are left out, and
    test rows without one have no actual value. Predictions are clipped to 3 deviations of the training targets around their
    mean. importance has each feature's share of the gain. A fold is a group of train + test rows at most; the number of
    groups grows with the data. A fold without training targets has no rows.
    """

    def fit(pdf):
        import pandas as pd

        pdf = pdf.sort_values(order)
        early = pdf[pdf["part"] == "train"]
        late, known = pdf[pdf["part"] == "test"], early[early[target].notna()]
        if known.empty or late.empty:
            return pd.DataFrame({c: [] for c in (key, "fold", "day", "train_end", "actual", "predicted", "importance")})
        x, y = known[features].to_numpy(float), known[target].to_numpy(float)
        mean, std = np.zeros(len(features)), np.ones(len(features))
        for j, column in enumerate(x.T):
            if (there := column[~np.isnan(column)]).size:
                mean[j], std[j] = there.mean(), there.std() or 1.0
        scaled = lambda a: np.nan_to_num((a - mean) / std, nan=0.0, posinf=0.0, neginf=0.0)
        model = Boosted(trees, depth, rate).fit(scaled(x), y)
        deviation = y.std(ddof=1) if len(y) > 1 else 0.0
        found = np.clip(model.predict(scaled(late[features].to_numpy(float))), y.mean() - CLIP * deviation, y.mean() + CLIP * deviation)
        return pd.DataFrame({key: late[key], "fold": late["fold"], "day": late[order], "train_end": early[order].iloc[-1], "actual": late[target], "predicted": found, "importance": [model.importance()] * len(late)})

    used = folds(rows.select(key, order, target, *features), key, order, train, test, step)
    found = used.groupBy(key, "fold").applyInPandas(fit, f"{key} {dict(rows.dtypes)[key]}, {RESULT}")
    return found if step >= test else keep_latest(found, [key, "day"], [F.col("fold").desc()])


def mean_importance(found: DataFrame, features: list[str], key: str = "pair") -> DataFrame:
    """(feature, importance): the mean over the folds of walk_forward's results, given as a written table."""
    name: Column = F.element_at(F.array(*(F.lit(f) for f in features)), F.col("at") + 1)
    one = found.groupBy(key, "fold").agg(F.first("importance").alias("i"))
    return one.select(F.posexplode("i").alias("at", "v")).groupBy(name.alias("feature")).agg(F.avg("v").alias("importance"))


class Boosted:
    """Regression trees grown on each other's residuals, with exact splits by the gain of squared error and ridge-shrunk leaves."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, rate: float = RATE, ridge: float = RIDGE):
        self.trees, self.depth, self.rate, self.ridge = trees, depth, rate, ridge

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        self.base, self.gain, self.forest = float(y.mean()), np.zeros(x.shape[1]), []
        order, rest = np.argsort(x, axis=0, kind="stable"), y - self.base
        for _ in range(self.trees):
            at, feature, cut, value = np.zeros(len(x), np.int64), np.full(2 << self.depth, -1), np.zeros(2 << self.depth), np.zeros(2 << self.depth)
            for node in range((2 << self.depth) - 1):  # node k has the children 2k + 1 and 2k + 2
                mine = at == node
                n = int(mine.sum())
                if not n:
                    continue
                value[node] = self.rate * rest[mine].sum() / (n + self.ridge)
                if node < (1 << self.depth) - 1 and n > 1 and (split := self._split(x, rest, order, mine, n)):
                    feature[node], cut[node] = split[0], split[1]
                    self.gain[split[0]] += split[2]
                    at[mine] = 2 * node + 1 + (x[mine, split[0]] > split[1])
            rest = rest - value[at]
            self.forest.append((feature, cut, value))
        return self

    def _split(self, x, rest, order, mine, n):
        rows = order.T[mine[order.T]].reshape(x.shape[1], n)  # the node's rows in each feature's order
        values = np.take_along_axis(x.T, rows, axis=1)
        left, k = np.cumsum(rest[rows], axis=1)[:, :-1], np.arange(1, n)
        total = rest[mine].sum()
        gain = left**2 / (k + self.ridge) + (total - left) ** 2 / (n - k + self.ridge) - total**2 / (n + self.ridge)
        gain[values[:, 1:] <= values[:, :-1]] = -np.inf
        f, j = np.unravel_index(np.argmax(gain), gain.shape)
        return (int(f), float((values[f, j] + values[f, j + 1]) / 2), float(gain[f, j])) if gain[f, j] > 1e-12 else None

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for feature, cut, value in self.forest:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                f = feature[at]
                at = np.where(f < 0, at, 2 * at + 1 + (x[np.arange(len(x)), np.maximum(f, 0)] > cut[at]))
            out += value[at]
        return out

    def importance(self) -> np.ndarray:
        return self.gain / self.gain.sum() if self.gain.sum() > 0 else self.gain
