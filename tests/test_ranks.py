"""Quantiles of a growing past by ranks against the pass that holds a key's values."""

from __future__ import annotations

import random

import pytest

from tidemark.operators import ranks, timeseries as ts


@pytest.mark.parametrize("block", [7, 40, 10_000])
def test_ranks_give_what_the_pass_gives(spark, block):
    rng = random.Random(block)
    rows = [(p, k, None if rng.random() < 0.1 or (p == "b" and k < 5) else rng.choice([rng.gauss(0, 1), 1.5, -2.0])) for p, n in (("a", 150), ("b", 60), ("c", 1), ("d", 3)) for k in range(n)]
    rows = [(p, k, None if p == "d" else x) for p, k, x in rows]
    df = spark.createDataFrame(rows, "pair string, ts_ms long, x double").repartition(3)
    wanted = {"p0": 0.0, "p5": 0.05, "mid": 0.5, "p95": 0.95, "p100": 1.0}
    want = {(r.pair, r.ts_ms): tuple(r[n] for n in wanted) for r in ts.with_expanding_quantiles(df, "x", wanted).collect()}
    got = {(r.pair, r.ts_ms): tuple(r[n] for n in wanted) for r in ranks.expanding_quantiles_by_rank(df, "x", wanted, block=block).collect()}
    assert got == want and len(got) == len(rows)


def test_no_rows(spark):
    assert ranks.expanding_quantiles_by_rank(spark.createDataFrame([], "pair string, ts_ms long, x double"), "x", {"m": 0.5}).count() == 0
