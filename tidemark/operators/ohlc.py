"""Technical features of daily bars: one window per pair, no joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeseries import change, kurt, percentile_rank, rolling, series, skew, with_ewm, with_fractional_differences, with_macd

#: Column order of the standard features.
STANDARD = (
    "body_ratio price_position hl_spread log_ret " + " ".join(f"log_ret_lag_{k}" for k in range(1, 11)) + " sma_fast sma_slow sma_spread sma_slope_10 sma_slope_20 macd_line macd_signal macd_hist rsi atr "
    "plus_di minus_di adx roc_3 roc_5 roc_10 volume_ewma volume_change rv_10 rv_60 rv_ratio ewma_ret ewma_vol rolling_skew rolling_kurt dow_sin dow_cos target"
).split()


def _log(a: Column, b: Column) -> Column:
    """ln(a / b); null where that is no number."""
    return F.ln(F.try_divide(a, b))


def _rsi(x: Column, w, n: int = 14) -> Column:
    """100 - 100 / (1 + mean gain / mean loss) over n changes; the first row's change counts as none."""
    d = x - F.lag(x).over(w)
    gain = rolling(F.avg, F.when(d > 0, d).otherwise(0.0), w, n)
    loss = rolling(F.avg, F.when(d < 0, -d).otherwise(0.0), w, n)
    return F.when(loss > 0, 100 - 100 / (1 + gain / loss)).when(gain > 0, 100.0)


def standard_features(bars: DataFrame, horizon: int = 3, scaling: float = 1.0, alpha: float = 0.25) -> DataFrame:
    """bars with the standard features; nulls where history is short and where a ratio has no value. Bars are one a pair and time."""
    w = series()
    c, o, h, l, v = (F.col(n) for n in ("close", "open", "high", "low", "volume"))
    before = F.lag(c).over(w)
    span = F.when(h != l, h - l)
    df = with_macd(bars, "macd_line", "macd_signal", "close", 2 / 13, 2 / 27, 0.2).withColumns({
        "body_ratio": F.abs(c - o) / span, "price_position": (c - l) / span, "hl_spread": h - l,
        "log_ret": _log(c, before), "__tr": F.greatest(h - l, F.abs(h - before), F.abs(l - before)),
        "__up": h - F.lag(h).over(w), "__down": F.lag(l).over(w) - l,
        "sma_fast": rolling(F.avg, c, w, 10), "sma_slow": rolling(F.avg, c, w, 50), "__sma20": rolling(F.avg, c, w, 20),
        "rsi": _rsi(c, w),
        **{f"roc_{k}": change(c, w, k) for k in (3, 5, 10)},
        "volume_change": v - F.lag(v).over(w),
        "target": _log(F.lead(c, horizon).over(w), c) * scaling,
    })
    df = with_ewm(df, "volume_ewma", None, v, alpha)
    df = with_ewm(df, "ewma_ret", "ewma_vol", F.col("log_ret"), alpha)
    up, down, r = F.col("__up"), F.col("__down"), F.col("log_ret")
    atr = rolling(F.avg, F.col("__tr"), w, 14)
    di = lambda x: 100 * F.try_divide(rolling(F.avg, x, w, 14), atr)
    last20 = w.rowsBetween(-19, 0)
    full = F.count(r).over(last20) == 20
    day = F.weekday("day")
    df = df.withColumns({
        **{f"log_ret_lag_{k}": F.lag(r, k).over(w) for k in range(1, 11)},
        "sma_spread": F.col("sma_fast") - F.col("sma_slow"), "sma_slope_10": change(F.col("sma_fast"), w), "sma_slope_20": change(F.col("__sma20"), w),
        "atr": atr,
        "plus_di": di(F.when((up > down) & (up > 0), up).otherwise(0.0)), "minus_di": di(F.when((down > up) & (down > 0), down).otherwise(0.0)),
        "rv_10": rolling(F.stddev_samp, r, w, 10) * math.sqrt(10), "rv_60": rolling(F.stddev_samp, r, w, 60) * math.sqrt(60),
        "rolling_skew": F.when(full, skew(r, last20, 20)), "rolling_kurt": F.when(full, kurt(r, last20, 20)),
        "dow_sin": F.sin(2 * math.pi * day / 7), "dow_cos": F.cos(2 * math.pi * day / 7),
    })
    dx = 100 * F.try_divide(F.abs(F.col("plus_di") - F.col("minus_di")), F.col("plus_di") + F.col("minus_di"))
    df = df.withColumns({"adx": rolling(F.avg, dx, w, 14), "rv_ratio": F.try_divide("rv_10", "rv_60")})
    df = df.withColumn("macd_hist", F.col("macd_line") - F.col("macd_signal"))
    return df.select(*bars.columns, *STANDARD)


VOLATILITY = "vol_10 vol_20 vol_60 vol_ratio_10_60 vol_ratio_20_60 vol_of_vol log_vol_20 vol_gk_20 vol_gk_60 vol_parkinson_20 vol_yang_zhang_20 vol_yang_zhang_60 vol_rogers_satchell_20 vix_proxy vix_proxy_slow vix_proxy_change vix_proxy_pct_change vix_proxy_momentum_5 vix_proxy_sma_10 vix_proxy_trend vix_proxy_zscore vix_proxy_rsi vix_regime vix_regime_extreme vol_percentile vol_zscore vol_spike overnight_intraday_vol_ratio volatility vol_regime".split()


def volatility_features(bars: DataFrame) -> DataFrame:
    """bars with volatility estimators, the composite index of fear and its derivatives. Range estimators under a root of a negative number are null."""
    w = series()
    c, o, h, l = (F.col(n) for n in ("close", "open", "high", "low"))
    before = F.lag(c).over(w)
    mean = lambda x, n: rolling(F.avg, x, w, n)
    std = lambda x, n: rolling(F.stddev_samp, x, w, n)
    var = lambda x, n: rolling(F.var_samp, x, w, n)
    root = lambda x: F.when(x >= 0, F.sqrt(x))
    hl, co = _log(h, l), _log(c, o)
    ho, lo = _log(h, o), _log(l, o)
    df = bars.withColumns({
        "__r": _log(c, before), "__gk": root(0.5 * hl * hl - (2 * math.log(2) - 1) * co * co), "__pk": F.sqrt(hl * hl / (4 * math.log(2))),
        "__rs": ho * (ho - co) + lo * (lo - co), "__rs2": ho * _log(h, c) + lo * _log(l, c), "__oc": _log(o, before), "__co": co,
    })
    r, oc, co, rs = (F.col(n) for n in ("__r", "__oc", "__co", "__rs"))
    yz = lambda n, k: root(var(oc, n) + k * var(co, n) + (1 - k) * mean(rs, n))
    year = math.sqrt(252)
    df = df.withColumns({
        **{f"vol_{n}": std(r, n) * year for n in (10, 20, 60)}, "vol_gk_20": mean(F.col("__gk"), 20), "vol_gk_60": mean(F.col("__gk"), 60), "vol_parkinson_20": mean(F.col("__pk"), 20),
        "vol_yang_zhang_20": yz(20, 0.34), "vol_yang_zhang_60": yz(60, 0.34 / (1.34 + 61 / 59)), "vol_rogers_satchell_20": F.sqrt(F.greatest(mean(F.col("__rs2"), 20), F.lit(0.0))),
        "overnight_intraday_vol_ratio": F.try_divide(std(oc, 20), std(co, 20)),
    })
    v20 = F.col("vol_20")
    mid = F.array_sort(F.filter(F.array("vol_10", "vol_20", "vol_60", "vol_gk_20", "vol_gk_60", "vol_parkinson_20"), lambda x: x.isNotNull()))
    half = (F.size(mid) / 2).cast("int")
    df = df.withColumns({
        "vol_ratio_10_60": F.try_divide("vol_10", "vol_60"), "vol_ratio_20_60": F.try_divide("vol_20", "vol_60"), "vol_of_vol": std(v20, 20), "log_vol_20": F.ln(F.when(v20 != 0, v20) + 1e-9),
        "vix_proxy": 50 * v20 + 50 * year * F.col("vol_yang_zhang_20"), "vix_proxy_slow": 50 * F.col("vol_60") + 50 * year * F.col("vol_yang_zhang_60"),
        "vol_percentile": percentile_rank(v20, w), "vol_zscore": F.try_divide(v20 - mean(v20, 60), std(v20, 60)), "vol_spike": F.coalesce((v20 > mean(v20, 20) + 2 * std(v20, 20)).cast("double"), F.lit(0.0)),
        "volatility": F.when(F.size(mid) > 0, (F.get(mid, half) + F.get(mid, F.when(F.size(mid) % 2 == 0, half - 1).otherwise(half))) / 2),
    })
    x = F.col("vix_proxy")
    over = lambda x, limit: F.coalesce((x > limit).cast("double"), F.lit(0.0))
    at = lambda q: lambda x: F.percentile(x, q)
    df = df.withColumns({
        "vix_proxy_change": x - F.lag(x).over(w), "vix_proxy_pct_change": change(x, w), "vix_proxy_momentum_5": x - F.lag(x, 5).over(w), "vix_proxy_sma_10": mean(x, 10), "vix_proxy_trend": mean(x, 10) - mean(x, 20),
        "vix_proxy_zscore": F.try_divide(x - mean(x, 60), std(x, 60)), "vix_proxy_rsi": _proxy_rsi(x, w), "vix_regime": over(x, rolling(at(0.5), x, w, 60)), "vix_regime_extreme": over(x, rolling(at(0.8), x, w, 60)),
        "vol_regime": over(F.col("volatility"), rolling(at(0.5), F.col("volatility"), w, 60)),
    })
    return df.select(*bars.columns, *VOLATILITY)


#: The contract's columns in their order.
CONTRACT = (
    "body_ratio price_position hl_spread log_ret " + " ".join(f"log_ret_lag_{k}" for k in range(1, 11)) + " sma_fast sma_slow sma_spread sma_slope_10 sma_slope_20 macd_line macd_signal macd_hist rsi atr plus_di minus_di adx "
    "roc_3 roc_5 roc_10 volume_ewma volume_change rv_10 rv_60 rv_ratio vol_10 vol_20 vol_60 vol_ratio_10_60 vol_ratio_20_60 vol_of_vol log_vol_20 vol_ewma ewma_ret ewma_vol rolling_skew rolling_kurt dow_sin dow_cos "
    "vol_gk_20 vol_gk_60 vol_parkinson_20 vol_yang_zhang_20 vix_proxy"
).split()


def contract_features(bars: DataFrame) -> DataFrame:
    """bars with the contract's columns in their order; vol_ewma is the deviation of log returns with a span of 20."""
    df = with_ewm(standard_features(bars), "__m", "vol_ewma", F.col("log_ret"), 2 / 21)
    return volatility_features(df).select(*bars.columns, *CONTRACT)


def _proxy_rsi(x: Column, w, n: int = 14) -> Column:
    d = x - F.lag(x).over(w)
    gain, loss = (rolling(F.avg, F.when(s, F.abs(d)).otherwise(0.0), w, n) for s in (d > 0, d < 0))
    return F.when(loss > 0, 100 - 100 / (1 + gain / loss))


def fractional_features(bars: DataFrame) -> DataFrame:
    """bars with fractional differences of close, its logarithm and volume."""
    names = {"close_frac_diff": "close", "log_close_frac_diff": "__log", "volume_frac_diff": "volume"}
    return with_fractional_differences(bars.withColumn("__log", F.ln("close")), names).drop("__log")


def clean(features: DataFrame, names: list[str], min_history: int = 60, key: str = "pair", order: str = "ts_ms") -> DataFrame:
    """Without the first min_history rows of a pair; gaps take the value before; rows that still have one go."""
    from .timeseries import forward_fill

    w = series(key, order)
    out = features.withColumn("__n", F.row_number().over(w)).where(F.col("__n") > min_history).drop("__n")
    return out.withColumns({n: forward_fill(F.col(n), w) for n in names}).na.drop(subset=names)
