"""Market aggregates: correlation, beta, breadth, ratios, regimes and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def returns_by_day(bars: DataFrame) -> DataFrame:
    """(pair, day, ret): simple returns of closes."""
    from .timeseries import change, series

    return bars.select("pair", "day", change(F.col("close"), series(order="day")).alias("ret"))


def correlations(returns: DataFrame, high: float = 0.7, low: float = -0.3) -> DataFrame:
    """(a, b, days, corr, level) per pair of keys a < b over their common days; the join meets on days, so a key pairs with others of its day only."""
    a = returns.where("ret is not null").select(F.col("pair").alias("a"), "day", F.col("ret").alias("x"))
    b = returns.where("ret is not null").select(F.col("pair").alias("b"), "day", F.col("ret").alias("y"))
    c = a.join(b, "day").where("a < b").groupBy("a", "b").agg(F.count("*").alias("days"), F.corr("x", "y").alias("corr"))
    return c.withColumn("level", F.when(F.col("corr") > high, "high").when(F.col("corr") < low, "negative").otherwise("normal"))


def beta(asset: DataFrame, market: DataFrame, least: int = 30) -> DataFrame:
    """(pair, days, beta): covariance with the market over its variance, null up to `least` common days."""
    j = asset.where("ret is not null").join(market.where("ret is not null").select("day", F.col("ret").alias("m")), "day")
    g = j.groupBy("pair").agg(F.count("*").alias("days"), F.covar_samp("ret", "m").alias("c"), F.var_samp("m").alias("v"))
    return g.select("pair", "days", F.when(F.col("days") > least, F.try_divide("c", "v")).alias("beta"))


def breadth(changes: DataFrame, change: str = "change", volume: str = "volume") -> list[Column]:
    """Aggregates: advances, declines, unchanged, their ratio, the ratio of their volumes and the share that advances."""
    c, v = F.col(change), F.col(volume)
    up, down = F.count_if(c > 0), F.count_if(c < 0)
    return [
        up.alias("advances"), down.alias("declines"), F.count_if(c == 0).alias("unchanged"), F.try_divide(up.cast("double"), down).alias("ratio"),
        F.try_divide(F.sum(F.when(c > 0, v)), F.sum(F.when(c < 0, v))).alias("volume_ratio"), (F.try_divide(up.cast("double"), F.count(c)) * 100).alias("advance_pct"),
    ]


def with_extremes(bars: DataFrame, near: float = 0.05, days: int = 364) -> DataFrame:
    """bars (pair, ts_ms, close, high, low) with near_52w_high and near_52w_low: whether the close is within `near` of the extreme of the last `days` days."""
    from .timeseries import rolling_range

    high, low = (rolling_range(f, F.col(c), "pair", "ts_ms", days) for f, c in ((F.max, "high"), (F.min, "low")))
    return bars.withColumns({"near_52w_high": F.col("close") >= (1 - near) * high, "near_52w_low": F.col("close") <= (1 + near) * low})


def extremes() -> list[Column]:
    """Aggregates: how many are near their 52-week high and low."""
    return [F.count_if(F.col("near_52w_high")).alias("near_52w_high"), F.count_if(F.col("near_52w_low")).alias("near_52w_low")]


# Fixed values of the labels: the change of 60 bars and the yearly volatility, both in percent, and the Hurst exponent.
def trend_label(change: Column) -> Column:
    return F.when(change > 2, "BULLISH").when(change < -2, "BEARISH").when(change.isNotNull(), "SIDEWAYS")


def volatility_label(volatility: Column) -> Column:
    return F.when(volatility > 15, "HIGH").when(volatility > 8, "MODERATE").when(volatility.isNotNull(), "LOW")


def hurst_label(hurst: Column) -> Column:
    return F.when(hurst > 0.6, "TRENDING").when(hurst < 0.4, "MEAN_REVERTING").when(hurst.isNotNull(), "RANDOM_WALK")


def trends(bars: DataFrame, bars_kept: int = 252, recent: int = 60) -> DataFrame:
    """Per pair of bars (pair, day, close): change over the last `recent` of its last `bars_kept` bars, the yearly volatility of their log returns, and labels."""
    from pyspark.sql import Window

    w = Window.partitionBy("pair").orderBy("day")
    k = F.row_number().over(Window.partitionBy("pair").orderBy(F.desc("day")))
    r = F.ln(F.try_divide("close", F.lag("close").over(w))) * 100
    b = bars.select("pair", "day", "close", r.alias("r"), k.alias("k")).where(F.col("k") <= bars_kept)
    g = b.groupBy("pair").agg(F.count("*").alias("bars"), F.max_by("close", "day").alias("last"), F.min_by("close", F.when(F.col("k") <= recent, F.col("day"))).alias("first"), (F.stddev_pop(F.when(F.col("k") < F.lit(bars_kept), F.col("r"))) * math.sqrt(252)).alias("volatility"))
    g = g.withColumn("change", F.try_divide(F.col("last") - F.col("first"), F.col("first")) * 100)
    return g.select("pair", "bars", "change", trend_label(F.col("change")).alias("trend"), "volatility", volatility_label(F.col("volatility")).alias("level"))


def percentile_of(x: Column, current: Column) -> Column:
    """Aggregate: percentage of x at or under `current`."""
    return F.avg((x <= current).cast("double")) * 100


def percentile_label(p: Column) -> Column:
    return F.when(p >= 80, "VERY_EXPENSIVE").when(p >= 60, "EXPENSIVE").when(p >= 40, "FAIR").when(p >= 20, "CHEAP").otherwise("VERY_CHEAP")


def put_call_label(r: Column) -> Column:
    return F.when(r > 1.3, "EXTREME_FEAR").when(r > 1.0, "BEARISH").when(r > 0.7, "NEUTRAL").when(r > 0.5, "BULLISH").otherwise("EXTREME_GREED")


def steps(x: Column, *limits: tuple[float, int], otherwise: int = 0) -> Column:
    """The value of the first limit that x is over."""
    out = None
    for limit, value in limits:
        out = F.when(x > limit, value) if out is None else out.when(x > limit, value)
    return out.otherwise(otherwise)


def regime_score(vix: Column, flows: Column, breadth: Column, yields: Column) -> Column:
    """0 to 100: fear 25/18/15, outflows 30/20/10, weak breadth 25/15, rising yields 20/10."""
    return (
        F.when(vix > 25, 25).when(vix > 20, 18).when(vix > 15, 15).otherwise(0)
        + F.when(flows < -5000, 30).when(flows < -2000, 20).when(flows < 0, 10).otherwise(0)
        + F.when(breadth < 0.5, 25).when(breadth < 1.0, 15).otherwise(0)
        + F.when(yields > 0.1, 20).when(yields > 0.05, 10).otherwise(0)
    )


def risk_level(score: Column) -> Column:
    return F.when(score > 66, "High").when(score > 33, "Medium").otherwise("Low")


def allocation(signals: DataFrame) -> DataFrame:
    """signals (intent, liquidity_risk, sentiment, volatility, yield_trend, forex_opportunity_index) with stocks, bonds, forex and cash.

    Base anchors by intent, then market rules, forex scaling, liquidity overrides, no negatives, and shares that sum to 1.
    The order of the steps matters: each is a projection of its own.
    """
    base = lambda conservative, balanced, aggressive: F.when(F.col("intent") == "CONSERVATIVE", conservative).when(F.col("intent") == "BALANCED", balanced).otherwise(aggressive)
    df = signals.withColumns({"stocks": base(0.2, 0.4, 0.7), "bonds": base(0.7, 0.5, 0.2), "forex": base(0.0, 0.05, 0.05), "cash": base(0.1, 0.05, 0.05)})
    s, b, f, c = (F.col(n) for n in ("stocks", "bonds", "forex", "cash"))

    def move(df: DataFrame, when: Column, **by: Column | float) -> DataFrame:
        return df.withColumns({n: F.when(when, F.col(n) + x).otherwise(F.col(n)) for n, x in by.items()})

    risk_on = (F.col("sentiment") == "BULLISH") & (F.col("volatility") != "HIGH")
    flight = (F.col("sentiment") == "BEARISH") | (F.col("volatility") == "HIGH")
    df = move(df, risk_on, stocks=0.10, bonds=-0.10)
    df = move(df, flight, stocks=-0.15, bonds=0.10, cash=0.05)
    df = move(df, F.col("yield_trend") == "RISING", bonds=-0.10, cash=0.10)
    df = df.withColumn("__d", F.greatest(F.lit(0.0), 0.10 * F.col("forex_opportunity_index") - f))
    conservative = F.col("intent") == "CONSERVATIVE"
    df = df.withColumns({"forex": f + F.col("__d"), "cash": F.when(conservative, c - F.col("__d")).otherwise(c), "stocks": F.when(conservative, s).otherwise(s - F.col("__d"))})
    df = df.withColumn("__d", F.when((F.col("liquidity_risk") == "HIGH") & (c < 0.25), 0.25 - c).otherwise(0.0))
    df = df.withColumns({"cash": c + F.col("__d"), "bonds": F.when(F.col("__d") > 0, F.greatest(b - F.col("__d"), F.lit(0.0))).otherwise(b), "stocks": F.when((F.col("__d") > 0) & (b < F.col("__d")), s - (F.col("__d") - b)).otherwise(s)})
    df = df.withColumn("__d", F.when((F.col("liquidity_risk") == "LOW") & (F.col("volatility") == "LOW") & (c > 0.02), c - 0.02).otherwise(0.0))
    df = df.withColumns({"cash": c - F.col("__d"), "bonds": b + F.col("__d")}).drop("__d")
    df = df.withColumns({n: F.greatest(F.col(n), F.lit(0.0)) for n in ("stocks", "bonds", "forex", "cash")})
    total = s + b + f + c
    return df.withColumns({n: F.round(F.when(F.abs(total - 1) > 0.001, F.col(n) / total).otherwise(F.col(n)), 3) for n in ("stocks", "bonds", "forex", "cash")})
