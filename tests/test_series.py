"""Series operators against a dataframe library and hand-computed numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import bonds, cashflow, market, models, news, ohlc, portfolio, ranking, timeseries as ts
from tidemark.functions import text as tx


@pytest.fixture(scope="module")
def bars():
    rng = np.random.default_rng(3)
    n = 140
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, n)))
    high, low = close * (1 + rng.uniform(0, 0.01, n)), close * (1 - rng.uniform(0, 0.01, n))
    return pd.DataFrame({"pair": "X", "ts_ms": np.arange(n) * 86_400_000, "day": pd.date_range("2024-01-01", periods=n).date, "open": (high + low) / 2, "high": high, "low": low, "close": close, "volume": rng.uniform(1, 9, n)})


def test_features_match_a_dataframe_library(spark, bars):
    got = ohlc.standard_features(spark.createDataFrame(bars)).toPandas().sort_values("ts_ms").reset_index(drop=True)
    c, r = bars["close"], np.log(bars["close"] / bars["close"].shift(1))
    line = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    want = {
        "sma_slow": c.rolling(50).mean(), "macd_line": line, "macd_signal": line.ewm(span=9, adjust=False).mean(), "rolling_skew": r.rolling(20).skew(), "rolling_kurt": r.rolling(20).kurt(), "ewma_ret": r.ewm(alpha=0.25).mean(), "ewma_vol": r.ewm(alpha=0.25).std(),
        "rv_60": r.rolling(60).std() * np.sqrt(60), "log_ret_lag_3": r.shift(3), "roc_5": c.pct_change(5), "volume_ewma": bars["volume"].ewm(alpha=0.25).mean(), "target": np.log(c.shift(-3) / c),
    }
    for name, x in want.items():
        np.testing.assert_allclose(got[name].astype(float), x, rtol=1e-5, atol=1e-8, err_msg=name)


def test_short_flat_and_empty_series(spark, bars):
    flat = bars.head(70).assign(open=5.0, high=5.0, low=5.0, close=5.0)
    got = ohlc.standard_features(spark.createDataFrame(flat)).toPandas().sort_values("ts_ms")
    assert got["rsi"].isna().all() and got["body_ratio"].isna().all()
    assert ohlc.standard_features(spark.createDataFrame(bars).limit(0)).count() == 0
    assert ohlc.clean(ohlc.standard_features(spark.createDataFrame(bars)), ["rv_10", "sma_slow"]).count() == 80


def test_fractional_weights():
    assert len(ts.difference_weights()) == 500
    assert ts.difference_weights()[:3] == pytest.approx([1.0, -0.4, -0.12])


def test_asof_takes_the_latest_at_or_before(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9), ("a", None)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20.0), ("a", 5, 50.0), ("a", 7, 70.0), ("a", None, 1.0)], "k string, u int, x double")
    got = {(r.k, r.t): r.x for r in ts.asof_join(left, right, ["k"], "t", "u", ["x"]).collect()}
    assert got == {("a", 5): 50.0, ("a", 1): None, ("b", 9): None, ("a", None): None}


def test_allocation_scenarios(spark):
    rows = [("BALANCED", "HIGH", "BEARISH", "HIGH", "FLAT", 0.5), ("AGGRESSIVE", "LOW", "BULLISH", "LOW", "FLAT", 0.5)]
    df = spark.createDataFrame(rows, "intent string, liquidity_risk string, sentiment string, volatility string, yield_trend string, forex_opportunity_index double")
    got = {r.intent: (r.stocks, r.bonds, r.forex, r.cash) for r in market.allocation(df).collect()}
    assert got["BALANCED"] == pytest.approx((0.25, 0.45, 0.05, 0.25), abs=0.01)
    assert got["AGGRESSIVE"] == pytest.approx((0.80, 0.13, 0.05, 0.02), abs=0.01)


def test_bond_at_par_and_its_yield(spark):
    b = spark.createDataFrame([(1, 100.0, 0.06)], "bond int, face_value double, coupon_rate double").select("*", F.lit("2034-01-15").cast("date").alias("maturity"))
    flows = bonds.cash_flows(b, F.lit("2024-01-15").cast("date"))
    assert flows.count() == 20
    got = bonds.priced(flows, ["bond"], F.lit(0.0609)).head()
    assert got.price == pytest.approx(100, abs=0.2) and 7 < got.duration < 8
    y = spark.range(1).select(bonds.yield_to_maturity(F.lit(100.0), F.lit(100.0), F.lit(0.06), F.lit(10.0)).alias("y")).head().y
    assert y == pytest.approx(0.06, abs=1e-9)


def test_splines_pass_through_knots_and_fits_are_close():
    m, y = np.array([[1.0, 2, 5, 7, 10], [0.5, 1, 3, 9, 30]]), np.array([[0.05, 0.055, 0.06, 0.062, 0.063], [0.01, 0.03, 0.02, 0.05, 0.04]])
    assert bonds.natural_splines(m, y, m) == pytest.approx(y)
    b, k, _ = bonds.nelson_siegel_fit(m[:1], y[:1], np.array([[5.0]]), ridge=1e-6)
    (b0, b1, b2), k = b[0, 0], k[0, 0]
    e = np.exp(-k * m[0])
    assert np.abs(b0 + b1 * (1 - e) / (k * m[0]) + b2 * ((1 - e) / (k * m[0]) - e) - y[0]).max() < 2e-3


def test_bounded_least_squares_is_the_minimum_of_the_box():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8, 3))
    a, c = np.einsum("rki,rkj->rij", x, x) + 0.01 * np.eye(3), rng.normal(size=(60, 3)) * 8
    low, high = np.array([-1.0, -0.2, 0.1]), np.array([0.5, 0.3, 0.4])
    got = bonds.box_least_squares(a, c, low, high)
    assert ((got >= low) & (got <= high)).all()
    grid = np.stack(np.meshgrid(*(np.linspace(s, e, 25) for s, e in zip(low, high, strict=True))), -1).reshape(-1, 3)
    loss = lambda b: np.einsum("...i,rij,...j->r...", b, a, b) if b.ndim == 2 and len(b) != len(a) else np.einsum("ri,rij,rj->r", b, a, b)
    best = (loss(grid) - 2 * np.einsum("gi,ri->rg", grid, c)).min(1)
    assert (loss(got) - 2 * (got * c).sum(1) <= best + 1e-9).all() and (got == low).any() and (got == high).any()


def test_curve_fits_are_never_above_a_fine_grid_within_bounds():
    rng = np.random.default_rng(2)
    m, y, t = np.array([[1.0, 2, 5, 7, 10]] * 6), rng.uniform(-0.1, 0.4, (6, 5)), np.array([[0.5, 3.0, 20.0]] * 6)
    b, decay, loss = bonds.nelson_siegel_fit(m, y, t)
    assert ((b >= bonds.LOW) & (b <= bonds.HIGH)).all() and ((decay >= 0.1) & (decay <= 3)).all()
    coefficients = np.stack(np.meshgrid(*(np.linspace(s, e, 21) for s, e in zip(bonds.LOW, bonds.HIGH, strict=True))), -1).reshape(-1, 3)
    for r in range(6):
        for k in range(3):
            w = 1 / (1 + np.abs(m[r] - t[r, k]))
            w /= w.sum()
            for d in np.linspace(0.1, 3, 117):
                e = np.exp(-d * m[r])
                x = np.stack((np.ones(5), (1 - e) / (d * m[r]), (1 - e) / (d * m[r]) - e), 1)
                plain = (w * (y[r] - coefficients @ x.T) ** 2).sum(1) + 0.01 * (coefficients[:, 1:] ** 2).sum(1)
                assert loss[r, k] <= plain.min() + 1e-6


def test_curves_of_any_length_and_nulls(spark):
    rows = [(1, [1.0, 2.0, 5.0], [0.01, 0.02, 0.03], [0.1, 3.0]), (2, [1.0], [0.01], [4.0]), (3, None, [0.1], [1.0]), (4, [], [], [1.0]), (5, [1.0, 3.0, 4.0, 9.0], [0.3, 0.1, 0.2, 0.0], []), (6, [1.0, 2.0, 5.0], [0.01, 0.02, 0.03], [0.1, 3.0])]
    got = {r.id: r.curve_yield for r in bonds.curve_yields(spark.createDataFrame(rows, "id int, m array<double>, y array<double>, t array<double>"), "m", "y", "t").collect()}
    assert got[3] is None and got[4] is None and got[5] == [] and got[2] == [0.01] and got[1] == got[6] and got[1][0] == 0.01 and 0.015 < got[1][1] < 0.03


def test_prices_on_the_curve_of_the_day(spark):
    known = spark.createDataFrame([(1, 100.0, 0.06, "2034-01-15"), (2, 100.0, 0.0, "2025-01-15")], "bond int, face_value double, coupon_rate double, maturity string").withColumn("maturity", F.col("maturity").cast("date"))
    curves = spark.createDataFrame([("2024-01-15", [1.0, 10.0], [0.05, 0.05]), ("2024-01-16", [1.0], [0.05]), ("2024-01-17", [0.5, 2.0, 3.0], [-0.1, -0.1, 0.1])], "day string, ms array<double>, ys array<double>").withColumn("day", F.col("day").cast("date"))
    trades = spark.createDataFrame([(1, 1, "2024-01-15"), (2, 2, "2024-01-15"), (3, 1, "2024-01-16"), (4, 2, "2024-01-17"), (5, 2, "2025-01-15"), (6, 9, "2024-01-15"), (7, 1, None)], "trade int, bond int, day string").withColumn("day", F.col("day").cast("date"))
    got = {r.trade: r.price for r in bonds.priced_on_days(trades, known, curves, ["trade"]).collect()}
    flat = bonds.priced(bonds.cash_flows(known, F.lit("2024-01-15").cast("date")), ["bond"], F.lit(0.05)).collect()
    assert [got[1], got[2]] == pytest.approx([r.price for r in sorted(flat, key=lambda r: r.bond)])
    assert got[4] == pytest.approx(100 / 1.01 ** (364 / 365.25)) and [got[k] for k in (3, 5, 6, 7)] == [None] * 4
    knots = np.cumsum(np.random.default_rng(5).uniform(0.1, 1, 127))
    for n in (1, 2, 3, 64, 127):
        ms, ys = knots[:n].tolist(), np.sin(knots[:n]).tolist()
        asked = [0.0, *ms, *(np.array(ms) + 0.05).tolist(), 1e3]
        at = spark.createDataFrame([(ms, ys, t) for t in asked], "ms array<double>, ys array<double>, t double")
        assert [r.y for r in bonds.with_curve_yield(at, "ms", "ys", "t", "y").collect()] == pytest.approx(np.interp(asked, ms, ys).tolist())
    assert "NestedLoop" not in bonds.priced_on_days(trades, known, curves, ["trade"])._jdf.queryExecution().toString()


def test_indel_similarity():
    assert tx.similarity("", "") == 1 and tx.similarity("abc", "") == 0
    assert tx.similarity("kitten", "sitting") == pytest.approx(2 * 4 / 13)


def test_urls(spark):
    rows = [("HTTP://Ex.COM/a/?b=2&utm_source=x&c=&b=3#top",), ("ex.com/a?ref=1",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "u string").select(tx.normal_url(F.col("u"))).collect()]
    assert got == ["http://ex.com/a?b=2&b=3", "https://ex.com/a", None]


def test_fuzzy_clusters_join_the_first_registered(spark):
    rows = [(1, "a", "d", "Markets rally on strong earnings"), (2, "a", "d", "Markets rally on strong earning!"), (3, "a", "d", "Something else entirely here"), (4, "b", "d", "Markets rally on strong earnings"), (5, "a", "d", "short"), (6, "a", "d", None)]
    got = dict(news.fuzzy_clusters(spark.createDataFrame(rows, "id long, company string, day string, title string")).collect())
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}


def plain_clusters(rows, ttl_ms=None):
    """(id, block, title, ms): each row compared with all registered ones of its block, in plain Python."""
    out, known = {}, {}
    for i, block, t, at in sorted(rows, key=lambda r: (r[3] if ttl_ms else 0, r[0])):
        if t is None or len(t) < 10:
            out[i] = i
            continue
        held = known.setdefault(block, [])
        out[i] = next((k for k, x, since in held if (ttl_ms is None or since + ttl_ms > at) and tx.similarity(t, x) >= 0.65), i)
        if out[i] == i:
            held.append((i, t, at))
    return out


@pytest.mark.parametrize("ttl_ms", [None, 60_000])
def test_fuzzy_clusters_register_all_titles(spark, monkeypatch, ttl_ms):
    """Over 200 registered titles in a block, in steps of few, with copies, long titles, equal classes of characters, and null blocks."""
    from datetime import datetime, timedelta

    if ttl_ms is None:
        monkeypatch.setattr(news, "HEAD", 64, raising=False)
    else:
        monkeypatch.setattr(news, "HEAD", 100, raising=False)
    monkeypatch.setattr(news, "SLICE", 48, raising=False)
    rng = np.random.default_rng(3)
    base = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789"), int(n))) for n in rng.choice([12, 30, 63, 64, 65, 80, 128, 129, 200], 300)]
    other = lambda t: "".join(chr(ord(c) + 512) if rng.random() < 0.5 and c.isalpha() else c for c in t)
    change = lambda t: "".join(c for c in t if rng.random() < 0.85)
    titles = base + [change(t) for t in base[150:]] + [other(t) for t in base[:40]] + base[:30] + [None, "", "short"]
    rows = [(k, ("a", None)[k % 7 == 0], t, 1000 * k) for k, t in enumerate(titles)]
    rows += [(len(rows) + k, "b", change("one title that many copies resemble closely"), 0) for k in range(150)]
    want = plain_clusters([(i, b, " ".join(t.lower().split()) if t else t, at) for i, b, t, at in rows], ttl_ms)
    assert sum(1 for i, b, t, _ in rows if b == "a" and t and len(t) > 9 and want[i] == i) > 250
    df = spark.createDataFrame([(i, b, None, t, datetime(2024, 1, 1) + timedelta(milliseconds=at)) for i, b, t, at in rows], "id long, company string, day date, title string, seen timestamp")
    found = news.fuzzy_clusters(df.repartition(3), ttl_ms=ttl_ms).collect()
    assert len(found) == len(rows) and {r.id: r.cluster for r in found} == want


def test_upsert_prefers_new_rows(spark):
    old = spark.createDataFrame([(1, 1, "old"), (2, 5, "old")], "k int, t int, v string")
    new = spark.createDataFrame([(1, 1, "new"), (2, 4, "new"), (3, 1, "new")], "k int, t int, v string")
    assert {r.k: r.v for r in news.upsert(old, new, "k", "t").collect()} == {1: "new", 2: "old", 3: "new"}


def test_global_rank(spark):
    got = ranking.global_rank(spark.range(1000).repartition(7), [F.col("id").desc()], "rank").collect()
    assert {r.id: r["rank"] for r in got} == {k: 1000 - k for k in range(1000)}


def test_yields_are_halved_by_batches(spark):
    """No lambda is interpreted row by row; odd values give what the halving of single values gives."""
    rows = [(95.0, 100.0, 0.05, 7.3), (250.0, 100.0, 0.05, 7.3), (1.0, 100.0, 0.05, 7.3), (95.0, 100.0, 0.05, 0.3), (None, 100.0, 0.05, 7.3), (95.0, 100.0, 0.05, None), (95.0, 0.0, 0.0, 30.0)]
    df = spark.createDataFrame(rows, "price double, face double, c double, years double")
    df = df.select(bonds.yield_to_maturity(*map(F.col, df.columns)).alias("y"))
    assert "lambda" not in df._jdf.queryExecution().toString()

    def single(p, f, c, t):
        if t is not None and int(t * 2) <= 0:
            return c
        lo, hi = 0.0, 0.5
        for _ in range(60):
            mid = (lo + hi) / 2
            v = (1 + mid / 2) ** -int((t or 0) * 2)
            over = None not in (p, t) and f * c / 2 * (1 - v) / (mid / 2) + f * v > p
            lo, hi = (mid, hi) if over else (lo, mid)
        return (lo + hi) / 2

    assert [r.y for r in df.collect()] == pytest.approx([single(*r) for r in rows], abs=1e-12)


def test_rank_quartiles_takes_equal_sums_as_ties(spark, tmp_path):
    """Prices of which the sums as doubles depend on their order: customers with the same prices in other orders are equal."""
    from itertools import permutations

    from tidemark.plans import catalogue

    rows = [(100 * c + k, c, p) for c, prices in enumerate(permutations([397024.82, 344118.66, 49235.09, 133745.38])) for k, p in enumerate(prices)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    got = {r.customer: (r["rank"], r.score) for r in catalogue.QUERIES["rank_quartiles"](spark, str(tmp_path)).collect()}
    assert got == {c: (c + 1, 924123.95) for c in range(24)}
    odd = spark.createDataFrame([(1, float("nan")), (1, 1.0), (2, 1e300), (2, -1e300), (3, None), (4, 0.1), (4, 0.2), (4, None)], "k int, x double")
    found = {r.k: r.s for r in odd.groupBy("k").agg(ranking.exact_sum(F.col("x")).alias("s")).collect()}
    assert np.isnan(found.pop(1)) and found == {2: 0.0, 3: None, 4: 0.3}


def test_category_pivot_fills_gaps(spark):
    df = spark.createDataFrame([("a", 1.0, "2024-01-30"), ("a", 2.0, "2024-01-20")], "category string, amount double, d string").withColumn("day", F.col("d").cast("date"))
    got = {r.category: tuple(r)[1:] for r in cashflow.category_by_week(df, ["a", "z"], F.lit("2024-01-30").cast("date")).collect()}
    assert got == {"a": (1.0, 2.0, 0.0, 0.0), "z": (0.0, 0.0, 0.0, 0.0)}


def test_signals_stop_and_ledger(spark):
    rows = spark.createDataFrame([("x", 1, 0.5, 0.0), ("x", 2, 0.3, -0.2), ("x", 3, 0.1, -0.2), ("x", 4, None, None)], "k string, at long, score double, ret double")
    got = [r.position for r in portfolio.signals(rows, "k", "at", "score", "ret", 0.2, 0.05, 0.3).orderBy("at").collect()]
    assert got == [1, 1, 0, 0]
    trades = spark.createDataFrame([("x", 1, 60.0), ("x", 2, 60.0), ("x", 3, 40.0)], "k string, at long, amount double")
    assert [r.accepted for r in portfolio.ledger(trades, "k", "at", "amount", 100.0, 0.9).orderBy("at").collect()] == [True, False, True]


def test_forecast_skips_weekends_and_clamps(spark):
    model = spark.createDataFrame([(1, 1, 9.0, [0.0] * 7, [0.0] * 7, [1.0] * 7, "2024-01-05", 100.0, [0.0] * 7)], models.MODEL.replace("last_day date", "last_day string")).withColumn("last_day", F.col("last_day").cast("date"))
    got = models.forecast(model, 3).orderBy("step").collect()
    assert [str(r.day) for r in got] == ["2024-01-08", "2024-01-09", "2024-01-10"]
    assert [r.predicted_close for r in got] == pytest.approx([110.0, 121.0, 133.1])


def test_text_helpers(spark):
    r = spark.range(1).select(
        tx.json_or(F.lit('```json\n{"a": 3}\n```'), "a int", F.lit(None).cast("struct<a:int>")).alias("j"), tx.json_or(F.lit("no"), "a int", F.named_struct(F.lit("a"), F.lit(9))).alias("k"), tx.number(F.lit("1,234.5 %")).alias("n"), tx.number(F.lit("x")).alias("m"),
        F.size(tx.sentiment_parts(F.lit("ab " * 700))).alias("parts"), tx.chunks(F.lit("x" * 4000)).alias("c"), tx.chunks(F.lit("")).alias("e"), tx.cluster_id(F.lit("co"), F.lit("f"), F.lit("d"), F.lit("t")).alias("id"),
    ).head()
    assert r.j.a == 3 and r.n == 1234.5 and r.m is None and r.parts == 2 and [len(x) for x in r.c] == [2000, 2000, 400] and r.e == [""]
    assert r.id.startswith("cluster_co_f_d_") and len(r.id) == len("cluster_co_f_d_") + 8


def test_not_a_knot_follows_a_cubic():
    x = np.array([1.0, 3, 7, 14, 21, 30])
    cubic = lambda t: 2 + t - 0.1 * t**2 + 0.003 * t**3
    at = np.arange(1.0, 31)
    assert bonds.not_a_knot(x, cubic(x), at) == pytest.approx(cubic(at))


def test_positions_and_checks(spark):
    targets = spark.createDataFrame([("a", "long", 110.0, 70.0), ("b", "short", 50.0, 40.0), ("c", "flat", 10.0, 5.0), ("d", "long", 8.0, 5.0)], "pair string, direction string, price double, strength double")
    held = spark.createDataFrame([("a", "long", 100.0), ("b", "long", 40.0), ("c", "short", 20.0)], "pair string, direction string, entry_price double").withColumn("entry_date", F.lit("2024-01-01").cast("date"))
    got = {r.pair: r for r in portfolio.updated_positions(targets, held, F.lit("2024-01-11").cast("date")).collect()}
    assert got["a"].entry_price == 100 and got["a"].days_held == 10 and got["a"].unrealized_pnl_pct == pytest.approx(10) and got["a"].closed_pnl_pct is None
    assert got["b"].entry_price == 50 and got["b"].closed_pnl_pct == pytest.approx(25) and got["b"].stop_loss == pytest.approx(50.5)
    assert got["c"].entry_price is None and got["c"].closed_pnl_pct == pytest.approx(50) and got["d"].closed_pnl_pct is None


def test_hurst_is_the_rescaled_range(spark):
    """Against numpy, chunk by chunk: a walk, a short series, and one that is constant."""
    from tidemark.operators.portfolio import hurst

    rng = np.random.default_rng(4)
    walks = {"a": rng.normal(size=300).cumsum() + 50, "b": rng.normal(size=70).cumsum(), "c": np.ones(100), "d": np.arange(9.0)}

    def plain(x):
        lags, values = [], []
        for lag in range(2, min(20, len(x) // 4)):
            found = []
            for k in range(len(x) // lag):
                r = np.diff(x[k * lag : (k + 1) * lag])
                if len(r) > 1 and r.std(ddof=1) > 0:
                    run = (r - r.mean()).cumsum()
                    found.append((run.max() - run.min()) / r.std(ddof=1))
            if found:
                lags.append(lag)
                values.append(np.mean(found))
        return float(np.clip(np.polyfit(np.log(lags), np.log(values), 1)[0], 0, 1)) if len(lags) >= 3 else 0.5

    rows = [(k, i, float(v)) for k, x in walks.items() for i, v in enumerate(x)]
    got = {r.key: r.hurst for r in hurst(spark.createDataFrame(rows, "key string, i int, x double"), "key", "i", "x").collect()}
    assert got == pytest.approx({k: plain(x) for k, x in walks.items()})


def test_ordered_passes_carry_their_state(spark):
    """Batches of few rows: fractional differences, exponential means with gaps and expanding quantiles against pandas and numpy."""
    from tidemark.operators import timeseries as ts

    rng = np.random.default_rng(5)
    rows = [(k, i, None if i % 17 == 3 else float(v)) for k in "ab" for i, v in enumerate(rng.normal(size=900))]
    pdf = pd.DataFrame(rows, columns=["pair", "ts_ms", "x"]).astype({"x": float})
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        df = spark.createDataFrame(rows, "pair string, ts_ms long, x double")
        df = ts.with_fractional_differences(df.withColumn("y", F.coalesce("x", F.lit(1.0))), {"fd": "y"}, most=50)
        df = ts.with_expanding_quantiles(df, "x", {"p5": 0.05})
        df = ts.with_ewm(ts.with_macd(df, "e", "g", "x", 2 / 13, 2 / 27, 0.2), "m", "s", F.col("x"), 0.25)
        got = df.toPandas().sort_values(["pair", "ts_ms"]).reset_index(drop=True)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    w = ts.difference_weights(most=50)
    for _, part in pdf.groupby("pair"):
        mine = got.loc[part.index]
        y = part["x"].fillna(1.0).to_numpy()
        want = np.concatenate([np.full(len(w) - 1, np.nan), np.convolve(y, w, "valid")])
        assert np.allclose(mine["fd"], want, equal_nan=True)
        assert np.allclose(mine["p5"], part["x"].expanding().quantile(0.05))
        known = part["x"].dropna()
        line = known.ewm(alpha=2 / 13, adjust=False).mean() - known.ewm(alpha=2 / 27, adjust=False).mean()
        for name, series in (("e", line), ("g", line.ewm(alpha=0.2, adjust=False).mean()), ("m", known.ewm(alpha=0.25).mean()), ("s", known.ewm(alpha=0.25).std())):
            assert np.allclose(mine[name], series.reindex(part.index).ffill(), equal_nan=True), name


def test_growth_keeps_every_return(spark):
    rows = [("a", 1, 0.1), ("a", 2, -1.5), ("a", 3, 0.2), ("b", 1, 0.5), ("b", 2, -1.0), ("b", 3, 0.3), ("c", 1, -2.0), ("c", 2, -3.0), ("c", 3, None)]
    got = {r.pair: r for r in portfolio.performance(spark.createDataFrame(rows, "pair string, day int, ret double"), ["pair"], "day").collect()}
    assert got["a"].n == 3 and got["a"].annual_return is None and got["a"].max_drawdown == pytest.approx(-0.66 / 1.1 - 1)
    assert got["b"].max_drawdown == -1 and got["b"].annual_return == -1 and got["b"].shortfall_5 == -1.0 and got["c"].n == 2
    df = spark.createDataFrame([("a", k, s, m, p) for k, (s, m, p) in enumerate([(0.1, 0.1, 1), (-0.2, 0.2, -1), (0.0, 0.1, 0), (None, 0.1, 1)])], "pair string, day int, strategy double, actual double, position int")
    r = portfolio.strategy_metrics(df, ["pair"], "day").head()
    excess = np.array([0.0, -0.4, -0.1])
    assert (r.n, r.turnover, r.long_pct) == (3, 1.0, pytest.approx(100 / 3)) and r.information_ratio == pytest.approx(excess.mean() / excess.std(ddof=1) * 252**0.5)
    assert r.total_profit == pytest.approx(1.1 * 0.8 - 1) and r.buy_and_hold == pytest.approx(1.1 * 1.2 * 1.1 - 1)


def test_ordered_passes_leave_other_columns_alone(spark):
    rows = [("a", k, None if k == 1 else 9007199254740993 + k, [k], float(k)) for k in range(5)] + [(None, 1, 7, None, None), (None, 2, None, [1], 3.0)]
    df = spark.createDataFrame(rows, "pair string, ts_ms long, big long, list array<int>, x double")
    got = ts.with_macd(df, "line", "signal", "x", 0.5, 0.25, 0.2)
    assert sorted((tuple(r) for r in got.select(df.columns).collect()), key=str) == sorted(rows, key=str)
    assert got.where("pair is null").orderBy("ts_ms").select("line").collect()[0].line is None


def test_hurst_labels(spark):
    df = spark.createDataFrame([(0.7,), (0.3,), (0.5,), (None,)], "h double")
    assert [r[0] for r in df.select(market.hurst_label(F.col("h"))).collect()] == ["TRENDING", "MEAN_REVERTING", "RANDOM_WALK", None]
