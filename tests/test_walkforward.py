"""Walk-forward folds by plain slices, and their models against the same fits outside Spark."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest

from tidemark.operators import walkforward

DAY = date(2020, 1, 1)


def made(n, seed, pair):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2))
    y = np.where(x[:, 0] > 0.3, 1.0, -1.0) + 0.5 * (x[:, 1] > 0) + rng.normal(size=n) * 0.05
    return [(pair, DAY + timedelta(days=k), None if k == 3 else float(x[k, 0]), float(x[k, 1]), None if k in (5, n - 1) else float(y[k])) for k in range(n)]


@pytest.mark.parametrize(("train", "test", "step"), [(40, 10, 10), (40, 10, 4), (30, 10, 17)])
def test_folds_are_slices(spark, train, test, step):
    rows = [(p, k) for p, n in (("a", 97), ("b", 25), ("c", 10), ("d", 11)) for k in range(n)]
    got = {}
    for r in walkforward.folds(spark.createDataFrame(rows, "pair string, day int"), "pair", "day", train, test, step).collect():
        got.setdefault((r.pair, r.fold, r.part), []).append(r.day)
    want = {}
    for p, n in (("a", 97), ("b", 25), ("c", 10), ("d", 11)):
        effective, fold = min(train, n - test), 0
        while n > test and effective + fold * step + test <= n:
            at = effective + fold * step
            want[p, fold, "train"], want[p, fold, "test"] = list(range(at - effective, at)), list(range(at, at + test))
            fold += 1
    assert {k: sorted(v) for k, v in got.items()} == want


def test_each_fold_is_fitted_on_its_past_alone(spark):
    rows = made(120, 1, "a") + made(70, 2, "b")
    df = spark.createDataFrame(rows, "pair string, day date, x double, z double, target double")
    found = walkforward.walk_forward(df, ["x", "z"], train=60, test=20, step=20, trees=30).collect()
    assert len(found) == 3 * 20 + 20 and all(r.train_end < r.day for r in found)
    a = [r for r in rows if r[0] == "a"]
    for fold in range(3):
        past, later = a[20 * fold : 20 * fold + 60], a[20 * fold + 60 : 20 * fold + 80]
        known = [r for r in past if r[4] is not None]
        x = np.array([[np.nan if v is None else v for v in r[2:4]] for r in known])
        mean, std = np.nanmean(x, axis=0), np.nanstd(x, axis=0)
        y = np.array([r[4] for r in known])
        model = walkforward.Boosted(30).fit(np.nan_to_num((x - mean) / std), y)
        want = np.clip(model.predict(np.nan_to_num((np.array([r[2:4] for r in later]) - mean) / std)), y.mean() - 3 * y.std(ddof=1), y.mean() + 3 * y.std(ddof=1))
        got = sorted((r for r in found if r.pair == "a" and r.fold == fold), key=lambda r: r.day)
        assert [r.predicted for r in got] == pytest.approx(want.tolist()) and [r.actual for r in got] == [r[4] for r in later]
    errors = [abs(r.predicted - r.actual) for r in found if r.actual is not None]
    assert np.mean(errors) < 0.5  # the targets' own deviation is above 1
    df = spark.createDataFrame(found)
    importance = {r.feature: r.importance for r in walkforward.mean_importance(df, ["x", "z"]).collect()}
    assert importance["x"] > importance["z"] > 0 and sum(importance.values()) == pytest.approx(1)


def test_trees_cut_where_all_cuts_say():
    rng = np.random.default_rng(3)
    x, y = rng.integers(0, 6, (50, 3)).astype(float), rng.normal(size=50)
    model = walkforward.Boosted(1, 1, 1.0).fit(x, y)
    rest, best = y - y.mean(), None
    for f in range(3):
        for c in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= c
            gain = rest[left].sum() ** 2 / (left.sum() + 1) + rest[~left].sum() ** 2 / ((~left).sum() + 1) - rest.sum() ** 2 / 51
            if best is None or gain > best[0] + 1e-12:
                best = gain, f, left
    feature, cut, _ = model.forest[0]
    assert feature[0] == best[1] and (x[:, feature[0]] <= cut[0]).tolist() == best[2].tolist() and model.gain[best[1]] == pytest.approx(best[0])
    constant = walkforward.Boosted(3).fit(np.ones((5, 2)), np.arange(5.0))
    assert constant.predict(np.ones((1, 2)))[0] == pytest.approx(2.0) and constant.importance().tolist() == [0, 0]


def test_short_keys_and_empty_tables(spark):
    kind = "pair string, day date, x double, z double, target double"
    assert walkforward.walk_forward(spark.createDataFrame(made(20, 1, "a"), kind), ["x", "z"], train=60, test=20).count() == 0
    assert walkforward.walk_forward(spark.createDataFrame([], kind), ["x", "z"]).count() == 0
