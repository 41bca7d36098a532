"""The elastic net of levels against plain Python over one record a day."""

from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pytest

from tidemark.operators import models


def rows_of(days, seed):
    rng, close, out = random.Random(seed), 5.0, []
    for k in range(days):
        opened, close = close, close * (1 + rng.uniform(-0.3, 0.35))
        out.append((seed, date(2024, 1, 1) + timedelta(k), opened, max(opened, close) + rng.random(), min(opened, close), close))
    return out


def plain(rows, days=14):
    """Predicted closes; none from fewer than 30 samples."""
    rows = rows[-365:]
    opens, highs, lows, closes = (np.array([r[k] for r in rows]) for k in (2, 3, 4, 5))
    returns, bodies, ranges = np.diff(closes) / closes[:-1], closes - opens, highs - lows
    mean14 = lambda a, i: a[max(0, i - 13) : i + 1].mean()
    x = np.array([[returns[i - 1], returns[i - 2], bodies[i], ranges[i], mean14(bodies, i), mean14(ranges, i), closes[i]] for i in range(2, len(rows) - 1)])
    if len(x) < 30:
        return []
    y, mean, std = closes[3:], x.mean(0), x.std(0) + 1e-8
    z, w, bias = (x - mean) / std, np.zeros(7), y.mean()
    for _ in range(50):
        for j in range(7):
            rho = (z[:, j] * (y - bias - z @ w + z[:, j] * w[j])).sum()
            w[j] = np.sign(rho) * max(abs(rho) - 0.0005 * len(y), 0) / ((z[:, j] ** 2).sum() + 0.0005 * len(y))
        bias = (y - z @ w).mean()
    close, l1, l2, end, out = closes[-1], returns[-1], returns[-2], len(rows) - 1, []
    for _ in range(days):
        body, span = mean14(bodies, end), mean14(ranges, end)
        new = bias + (np.array([l1, l2, body, span, body, span, close]) - mean) / std @ w
        l1, l2, close = (new - close) / close, l1, new
        out.append(float(new))
    return out


@pytest.mark.parametrize(("days", "some"), [(32, False), (33, True), (400, True)])
def test_elastic_net_predicts_levels(spark, days, some):
    rows = rows_of(days, 7)
    levels = spark.createDataFrame(rows, "maturity long, day date, open double, high double, low double, close double")
    got = models.forecast_levels(models.elastic_net(models.level_samples(levels))).orderBy("step").collect()
    assert [r.predicted_close for r in got] == pytest.approx(plain(rows), rel=1e-6)
    assert bool(got) == some
