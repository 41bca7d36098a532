"""Queries over daily bars: features, windows, as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import ohlc, ranks, timeseries as ts
from ..sources.tables import BARS_SQL, daily_bars, table
from .registry import query, rounded


def _r(names: str, digits: int = 6) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names.split())


_W = "PARTITION BY pair ORDER BY day"


def _roll(agg: str, x: str, n: int, least: int | None = None) -> str:
    frame = f"OVER ({_W} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {frame} >= {least or n} THEN {agg.replace('@', x)} {frame} END"


def _ema_sql(x: str, alpha: str) -> str:
    return f"list_reduce(list({x}) OVER ({_W} ROWS UNBOUNDED PRECEDING), lambda a, v: a * (1 - {alpha}) + v * {alpha})"


_F1 = f"""{BARS_SQL}, f1 AS (SELECT *,
    CASE WHEN high <> low THEN abs(close - open) / (high - low) END AS body_ratio,
    CASE WHEN high <> low THEN (close - low) / (high - low) END AS price_position, high - low AS hl_spread,
    ln(close / lag(close) OVER w) AS log_ret,
    greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) AS tr,
    high - lag(high) OVER w AS up, lag(low) OVER w - low AS down, close - lag(close) OVER w AS d,
    {_roll('avg(@)', 'close', 10)} AS sma_fast, {_roll('avg(@)', 'close', 50)} AS sma_slow, {_roll('avg(@)', 'close', 20)} AS sma20,
    {_ema_sql('close', '(2.0::DOUBLE / 13)')} AS fast, {_ema_sql('close', '(2.0::DOUBLE / 27)')} AS slow,
    {', '.join(f'(close - lag(close, {k}) OVER w) / nullif(lag(close, {k}) OVER w, 0) AS roc_{k}' for k in (3, 5, 10))},
    list(volume) OVER ({_W} ROWS BETWEEN 105 PRECEDING AND CURRENT ROW) AS vl, volume - lag(volume) OVER w AS volume_change,
    ln(lead(close, 3) OVER w / close) AS target
  FROM bars WINDOW w AS ({_W})), f2 AS (SELECT *,
    {', '.join(f'lag(log_ret, {k}) OVER w AS log_ret_lag_{k}' for k in range(1, 11))},
    CASE WHEN d > 0 THEN d ELSE 0.0 END AS g, CASE WHEN d < 0 THEN -d ELSE 0.0 END AS ls,
    CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END AS pdm, CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END AS mdm,
    fast - slow AS macd_line, {_roll('avg(@)', 'tr', 14)} AS atr,
    {_roll('stddev_samp(@)', 'log_ret', 10)} * sqrt(10) AS rv_10, {_roll('stddev_samp(@)', 'log_ret', 60)} * sqrt(60) AS rv_60,
    {_roll('skewness(@)', 'log_ret', 20)} AS rolling_skew, {_roll('kurtosis(@)', 'log_ret', 20)} AS rolling_kurt,
    list(log_ret) FILTER (log_ret IS NOT NULL) OVER ({_W} ROWS BETWEEN 105 PRECEDING AND CURRENT ROW) AS rl
  FROM f1 WINDOW w AS ({_W})), f3 AS (SELECT *, {_roll('avg(@)', 'g', 14)} AS gain, {_roll('avg(@)', 'ls', 14)} AS loss,
    100 * ({_roll('avg(@)', 'pdm', 14)}) / atr AS plus_di, 100 * ({_roll('avg(@)', 'mdm', 14)}) / atr AS minus_di,
    {_ema_sql('macd_line', '0.2::DOUBLE')} AS macd_signal,
    list_sum(list_transform(vl, lambda x, i: x * pow(0.75::DOUBLE, len(vl) - i))) / list_sum(list_transform(vl, lambda x, i: pow(0.75::DOUBLE, len(vl) - i))) AS volume_ewma,
    list_sum(list_transform(rl, lambda x, i: x * pow(0.75::DOUBLE, len(rl) - i))) / list_sum(list_transform(rl, lambda x, i: pow(0.75::DOUBLE, len(rl) - i))) AS ewma_ret,
    list_sum(list_transform(rl, lambda x, i: pow(0.75::DOUBLE, len(rl) - i))) AS sw, list_sum(list_transform(rl, lambda x, i: pow(0.75::DOUBLE, 2 * (len(rl) - i)))) AS sw2
  FROM f2), f4 AS (SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx,
    CASE WHEN len(rl) > 1 THEN sqrt(list_sum(list_transform(rl, lambda x, i: pow(x - ewma_ret, 2) * pow(0.75::DOUBLE, len(rl) - i))) / (sw - sw2 / sw)) END AS ewma_vol,
    CASE WHEN loss > 0 THEN 100 - 100 / (1 + gain / loss) WHEN gain > 0 THEN 100.0 END AS rsi FROM f3)"""

_STANDARD_SQL = f"""WITH {_F1} SELECT pair, day, {_r('open high low close hl_spread volume', 8)}, {_r(' '.join(n for n in ohlc.STANDARD if n not in ('hl_spread', 'sma_spread', 'sma_slope_10', 'sma_slope_20', 'macd_hist', 'adx', 'rv_ratio', 'dow_sin', 'dow_cos')))},
  round(sma_fast - sma_slow, 6) + 0.0 AS sma_spread, round((sma_fast - lag(sma_fast) OVER w) / lag(sma_fast) OVER w, 6) + 0.0 AS sma_slope_10, round((sma20 - lag(sma20) OVER w) / lag(sma20) OVER w, 6) + 0.0 AS sma_slope_20,
  round(macd_line - macd_signal, 6) + 0.0 AS macd_hist, round({_roll('avg(@)', 'dx', 14)}, 6) + 0.0 AS adx, round(rv_10 / nullif(rv_60, 0), 6) + 0.0 AS rv_ratio,
  round(sin(2 * pi() * (isodow(day) - 1) / 7), 6) + 0.0 AS dow_sin, round(cos(2 * pi() * (isodow(day) - 1) / 7), 6) + 0.0 AS dow_cos
  FROM f4 WINDOW w AS ({_W})"""


@query(_STANDARD_SQL)
def ohlc_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ohlc.standard_features(daily_bars(spark, sf_dir)).drop("ts_ms"), exact=("open", "high", "low", "close", "hl_spread", "volume"))


_V1 = f"""{BARS_SQL}, v1 AS (SELECT *, ln(close / lag(close) OVER w) AS r, ln(open / lag(close) OVER w) AS oc, ln(close / open) AS co,
    0.5 * pow(ln(high / low), 2) - (2 * ln(2) - 1) * pow(ln(close / open), 2) AS gk2, sqrt(pow(ln(high / low), 2) / (4 * ln(2))) AS pk,
    ln(high / open) * (ln(high / open) - ln(close / open)) + ln(low / open) * (ln(low / open) - ln(close / open)) AS rs,
    ln(high / open) * ln(high / close) + ln(low / open) * ln(low / close) AS rs2 FROM bars WINDOW w AS ({_W})),
  v2 AS (SELECT *, CASE WHEN gk2 >= 0 THEN sqrt(gk2) END AS gk, 0.34 / (1.34 + 61.0::DOUBLE / 59) AS k60 FROM v1),
  v3 AS (SELECT *, {', '.join(f"({_roll('stddev_samp(@)', 'r', n)}) * sqrt(252) AS vol_{n}" for n in (10, 20, 60))},
    {_roll('avg(@)', 'gk', 20)} AS vol_gk_20, {_roll('avg(@)', 'gk', 60)} AS vol_gk_60, {_roll('avg(@)', 'pk', 20)} AS vol_parkinson_20,
    ({_roll('var_samp(@)', 'oc', 20)}) + 0.34 * ({_roll('var_samp(@)', 'co', 20)}) + 0.66 * ({_roll('avg(@)', 'rs', 20)}) AS yz20,
    ({_roll('var_samp(@)', 'oc', 60)}) + k60 * ({_roll('var_samp(@)', 'co', 60)}) + (1 - k60) * ({_roll('avg(@)', 'rs', 60)}) AS yz60,
    sqrt(CASE WHEN ({_roll('avg(@)', 'rs2', 20)}) > 0 THEN ({_roll('avg(@)', 'rs2', 20)}) ELSE 0.0 END) AS vol_rogers_satchell_20,
    ({_roll('stddev_samp(@)', 'oc', 20)}) / nullif({_roll('stddev_samp(@)', 'co', 20)}, 0) AS overnight_intraday_vol_ratio FROM v2),
  v4 AS (SELECT *, CASE WHEN yz20 >= 0 THEN sqrt(yz20) END AS vol_yang_zhang_20, CASE WHEN yz60 >= 0 THEN sqrt(yz60) END AS vol_yang_zhang_60,
    list(vol_20) FILTER (vol_20 IS NOT NULL) OVER ({_W} ROWS BETWEEN 119 PRECEDING AND CURRENT ROW) AS past FROM v3),
  v5 AS (SELECT *, vol_10 / nullif(vol_60, 0) AS vol_ratio_10_60, vol_20 / nullif(vol_60, 0) AS vol_ratio_20_60, {_roll('stddev_samp(@)', 'vol_20', 20)} AS vol_of_vol, ln(nullif(vol_20, 0) + 1e-9) AS log_vol_20,
    50 * vol_20 + 50 * sqrt(252) * vol_yang_zhang_20 AS vix_proxy, 50 * vol_60 + 50 * sqrt(252) * vol_yang_zhang_60 AS vix_proxy_slow,
    CASE WHEN vol_20 IS NOT NULL AND len(past) >= 20 THEN len(list_filter(past, lambda x: x < vol_20)) / (len(past) - 1)::DOUBLE * 100 END AS vol_percentile,
    (vol_20 - ({_roll('avg(@)', 'vol_20', 60)})) / nullif({_roll('stddev_samp(@)', 'vol_20', 60)}, 0) AS vol_zscore,
    coalesce((vol_20 > ({_roll('avg(@)', 'vol_20', 20)}) + 2 * ({_roll('stddev_samp(@)', 'vol_20', 20)}))::INT, 0)::DOUBLE AS vol_spike,
    list_aggregate([x FOR x IN [vol_10, vol_20, vol_60, vol_gk_20, vol_gk_60, vol_parkinson_20] IF x IS NOT NULL], 'median') AS volatility FROM v4),
  v6 AS (SELECT *, vix_proxy - lag(vix_proxy) OVER w AS vix_proxy_change, vix_proxy / nullif(lag(vix_proxy) OVER w, 0) - 1 AS vix_proxy_pct_change, vix_proxy - lag(vix_proxy, 5) OVER w AS vix_proxy_momentum_5,
    {_roll('avg(@)', 'vix_proxy', 10)} AS vix_proxy_sma_10, ({_roll('avg(@)', 'vix_proxy', 10)}) - ({_roll('avg(@)', 'vix_proxy', 20)}) AS vix_proxy_trend,
    (vix_proxy - ({_roll('avg(@)', 'vix_proxy', 60)})) / nullif({_roll('stddev_samp(@)', 'vix_proxy', 60)}, 0) AS vix_proxy_zscore,
    coalesce((vix_proxy > ({_roll('quantile_cont(@, 0.5)', 'vix_proxy', 60)}))::INT, 0)::DOUBLE AS vix_regime, coalesce((vix_proxy > ({_roll('quantile_cont(@, 0.8)', 'vix_proxy', 60)}))::INT, 0)::DOUBLE AS vix_regime_extreme,
    coalesce((volatility > ({_roll('quantile_cont(@, 0.5)', 'volatility', 60)}))::INT, 0)::DOUBLE AS vol_regime FROM v5 WINDOW w AS ({_W})),
  v7 AS (SELECT *, {_roll('avg(@)', 'CASE WHEN vix_proxy_change > 0 THEN vix_proxy_change ELSE 0.0 END', 14)} AS gain, {_roll('avg(@)', 'CASE WHEN vix_proxy_change < 0 THEN -vix_proxy_change ELSE 0.0 END', 14)} AS loss FROM v6)"""


_VOLATILITY_SQL = f"WITH {_V1} SELECT pair, day, {_r(' '.join(n for n in ohlc.VOLATILITY if n != 'vix_proxy_rsi'))}, round(CASE WHEN loss > 0 THEN 100 - 100 / (1 + gain / loss) END, 6) + 0.0 AS vix_proxy_rsi FROM v7"


@query(_VOLATILITY_SQL)
def ohlc_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ohlc.volatility_features(daily_bars(spark, sf_dir)).drop("ts_ms", "open", "high", "low", "close", "volume"))


_EWMA_VOL = f"""WITH {BARS_SQL}, r AS (SELECT pair, day, ln(close / lag(close) OVER ({_W})) AS r FROM bars), l AS (SELECT pair, day, list(r) FILTER (r IS NOT NULL) OVER ({_W} ROWS BETWEEN 320 PRECEDING AND CURRENT ROW) AS l FROM r),
  w AS (SELECT pair, day, l, list_transform(l, lambda x, i: pow(19.0::DOUBLE / 21, len(l) - i)) AS w FROM l), m AS (SELECT *, list_sum(w) AS sw, list_sum(list_transform(w, lambda x: x * x)) AS sw2, list_sum(list_transform(l, lambda x, i: x * w[i])) / list_sum(w) AS mean FROM w)
  SELECT pair, day, CASE WHEN len(l) > 1 THEN round(sqrt(list_sum(list_transform(l, lambda x, i: pow(x - mean, 2) * w[i])) / (sw - sw2 / sw)), 6) + 0.0 END AS vol_ewma FROM m"""


@query(f"SELECT pair, day, {', '.join(ohlc.CONTRACT)} FROM ({_STANDARD_SQL}) s JOIN ({_VOLATILITY_SQL}) v USING (pair, day) JOIN ({_EWMA_VOL}) e USING (pair, day)")
def feature_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns in their order, for every bar."""
    return rounded(ohlc.contract_features(daily_bars(spark, sf_dir)).drop("ts_ms", "open", "high", "low", "close", "volume"), exact=("hl_spread",))


_FD = f"list_sum(list_transform(range(1, 501), lambda i: l[500 - i + 1] * wts[i]))"


@query(
    f"""WITH RECURSIVE wk(k, w) AS (SELECT 0, 1.0::DOUBLE UNION ALL SELECT k + 1, -w * (0.4 - (k + 1) + 1) / (k + 1) FROM wk WHERE k < 499),
    {BARS_SQL}, l AS (SELECT pair, day, {', '.join(f'list({x}) OVER ({_W} ROWS BETWEEN 499 PRECEDING AND CURRENT ROW) AS {n}' for n, x in (('a', 'close'), ('b', 'ln(close)'), ('c', 'volume')))} FROM bars),
    ws AS (SELECT list(w ORDER BY k) AS wts FROM wk)
    SELECT pair, day, {', '.join(f"CASE WHEN len({n}) = 500 THEN round(list_sum(list_transform({n}, lambda x, i: x * wts[501 - i])), 6) + 0.0 END AS {m}" for n, m in (('a', 'close_frac_diff'), ('b', 'log_close_frac_diff'), ('c', 'volume_frac_diff')))} FROM l, ws"""
)
def fractional_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(ohlc.fractional_features(daily_bars(spark, sf_dir)).select("pair", "day", "close_frac_diff", "log_close_frac_diff", "volume_frac_diff"))


_RANGE = "OVER (PARTITION BY pair ORDER BY day RANGE BETWEEN INTERVAL 10 DAY PRECEDING AND CURRENT ROW)"


@query(
    f"""WITH {BARS_SQL} SELECT pair, day, count(*) {_RANGE} AS n, round(avg(close) {_RANGE}, 8) AS mean_10d, CASE WHEN count(*) {_RANGE} >= 3 THEN round(stddev_pop(close) {_RANGE}, 6) END AS std_10d, round(max(high) {_RANGE}, 8) AS high_10d, round(min(low) {_RANGE}, 8) AS low_10d,
    round(first(close) OVER (PARTITION BY pair ORDER BY day RANGE BETWEEN INTERVAL 3 DAY FOLLOWING AND INTERVAL 3 DAY FOLLOWING), 8) AS close_in_3d FROM bars"""
)
def range_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval windows: the bars of the last 10 days with both ends, and the bar exactly 3 days ahead."""
    roll = lambda f, x: ts.rolling_range(f, F.col(x), "pair", "ts_ms", 10)
    bars = daily_bars(spark, sf_dir)
    return rounded(bars.select("pair", "day", roll(F.count, "close").alias("n"), roll(F.avg, "close").alias("mean_10d"), F.when(roll(F.count, "close") >= 3, roll(F.stddev_pop, "close")).alias("std_10d"), roll(F.max, "high").alias("high_10d"), roll(F.min, "low").alias("low_10d"), ts.at_offset(F.col("close"), "pair", "ts_ms", 3).alias("close_in_3d")), exact=("mean_10d", "high_10d", "low_10d", "close_in_3d"))


@query(
    f"""WITH {BARS_SQL}, r AS (SELECT *, close / lag(close) OVER ({_W}) - 1 AS ret FROM bars), c AS (SELECT *, exp(sum(ln(1 + ret)) OVER w) AS growth, sum(ret) OVER w AS total FROM r WINDOW w AS ({_W} ROWS UNBOUNDED PRECEDING))
    SELECT pair, day, {_r('ret growth total')}, round(max(growth) OVER w, 6) AS peak, round(growth / max(growth) OVER w - 1, 6) + 0.0 AS drawdown,
      round(quantile_cont(ret, 0.05) OVER w, 6) + 0.0 AS p5, round(quantile_cont(ret, 0.95) OVER w, 6) + 0.0 AS p95 FROM c WINDOW w AS ({_W} ROWS UNBOUNDED PRECEDING)"""
)
def expanding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative return and product, running peak and drawdown, expanding percentiles."""
    w = ts.series()
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    df = daily_bars(spark, sf_dir).withColumn("ret", ts.change(F.col("close"), w))
    df = df.withColumns({"growth": F.exp(F.sum(F.ln(1 + F.col("ret"))).over(past)), "total": F.sum("ret").over(past)})
    peak = F.max("growth").over(past)
    df = df.select("pair", "day", "ret", "growth", "total", peak.alias("peak"), (F.col("growth") / peak - 1).alias("drawdown"))
    return rounded(ts.with_expanding_quantiles(df, "ret", {"p5": 0.05, "p95": 0.95}, order="day"))


@query(f"WITH {BARS_SQL} SELECT pair, day, round(quantile_cont(close, 0.1) OVER w, 8) AS p10, round(quantile_cont(close, 0.5) OVER w, 8) AS p50, round(quantile_cont(close, 0.9) OVER w, 8) AS p90 FROM bars WINDOW w AS ({_W} ROWS UNBOUNDED PRECEDING)")
def expanding_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of each pair's closes so far, by ranks that many tasks count."""
    return rounded(ranks.expanding_quantiles_by_rank(daily_bars(spark, sf_dir), "close", {"p10": 0.1, "p50": 0.5, "p90": 0.9}, order="day"), exact=("p10", "p50", "p90"))


@query(
    f"""WITH {BARS_SQL}, m AS (SELECT pair, day, close, volume, CASE WHEN day(day) % 5 = 0 THEN NULL ELSE close END AS gap, row_number() OVER ({_W}) AS n, count(*) OVER (PARTITION BY pair) AS total FROM bars),
    g AS (SELECT *, last_value(gap IGNORE NULLS) OVER ({_W} ROWS UNBOUNDED PRECEDING) AS filled FROM m)
    SELECT pair, day, n, round(filled, 8) AS filled, CASE WHEN n <= floor(0.8 * total) THEN 'train' ELSE 'test' END AS part FROM g WHERE n > 60 AND filled IS NOT NULL"""
)
def gaps_and_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward fill, rows before enough history dropped, and an ordered train and test split."""
    w = ts.series()
    df = daily_bars(spark, sf_dir).withColumns({"n": F.row_number().over(w).cast("long"), "total": F.count("*").over(Window.partitionBy("pair")), "gap": F.when(F.day("day") % 5 != 0, F.col("close"))})
    df = df.withColumn("filled", ts.forward_fill(F.col("gap"), w)).where("n > 60 and filled is not null")
    return rounded(df.select("pair", "day", "n", "filled", F.when(F.col("n") <= F.floor(F.col("total") * F.lit(0.8)), "train").otherwise("test").alias("part")), exact=("filled",))


@query(
    f"""WITH {BARS_SQL}, n AS (SELECT pair, day, row_number() OVER ({_W}) - 1 AS i, count(*) OVER (PARTITION BY pair) AS total FROM bars),
    f AS (SELECT *, unnest(range(0, ((total - 666) // 111 + 1)::BIGINT)) AS fold FROM n WHERE total >= 666)
    SELECT pair, fold, CASE WHEN i - 111 * fold < 444 THEN 'train' WHEN i - 111 * fold < 555 THEN 'validation' ELSE 'test' END AS part, count(*) AS bars, min(day) AS first_day, max(day) AS last_day
    FROM f WHERE i >= 111 * fold AND i < 111 * fold + 666 GROUP BY ALL"""
)
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Walk-forward folds of 444, 111 and 111 bars, moving by 111."""
    total = F.count("*").over(Window.partitionBy("pair"))
    df = daily_bars(spark, sf_dir).select("pair", "day", (F.row_number().over(ts.series()) - 1).cast("long").alias("i"), total.alias("total")).where("total >= 666")
    df = df.withColumn("fold", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(total - 666) div 111")))).withColumn("at", F.col("i") - 111 * F.col("fold")).where("at >= 0 and at < 666")
    part = F.when(F.col("at") < 444, "train").when(F.col("at") < 555, "validation").otherwise("test")
    return df.groupBy("pair", "fold", part.alias("part")).agg(F.count("*").alias("bars"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


@query(
    f"""WITH {BARS_SQL}, l AS (SELECT pair, day, close, day + 1 AS tomorrow, day - 1 AS yesterday FROM bars)
    SELECT l.pair, l.day, round(a.close, 8) AS close_before, round(b.close, 8) AS close_next, round((b.close - l.close) / l.close, 6) + 0.0 AS next_return
    FROM l ASOF LEFT JOIN bars a ON l.pair = a.pair AND l.yesterday >= a.day ASOF LEFT JOIN bars b ON l.pair = b.pair AND l.tomorrow >= b.day"""
)
def asof_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of joins of the bars with themselves, a day back and a day ahead: the latest bar at or before that day."""
    bars = daily_bars(spark, sf_dir).select("pair", "day", "close")
    left = bars.withColumns({"yesterday": F.date_sub("day", 1), "tomorrow": F.date_add("day", 1)})
    one = ts.asof_join(left, bars.select("pair", F.col("day").alias("d"), F.col("close").alias("close_before")), ["pair"], "yesterday", "d", ["close_before"])
    two = ts.asof_join(one, bars.select("pair", F.col("day").alias("d"), F.col("close").alias("close_next")), ["pair"], "tomorrow", "d", ["close_next"])
    return rounded(two.select("pair", "day", "close_before", "close_next", ((F.col("close_next") - F.col("close")) / F.col("close")).alias("next_return")), exact=("close_before", "close_next"))


@query(
    f"""WITH d AS (SELECT user_id % 5 AS maturity, CAST(ts AS DATE) AS day, avg(value) AS level FROM events WHERE value IS NOT NULL GROUP BY ALL)
    SELECT maturity, day, round(level, 6) AS level, {', '.join(f"round(lag(level, {k}) OVER w, 6) AS lag_{k}" for k in (1, 2))},
      round(avg(level) OVER r, 6) AS mean_14d, round(coalesce(stddev_samp(level) OVER r, 0.0), 6) AS std_14d, count(*) OVER r AS days_14d, round(lead(level) OVER w, 6) AS target
    FROM d WINDOW w AS (PARTITION BY maturity ORDER BY day), r AS (PARTITION BY maturity ORDER BY day RANGE BETWEEN INTERVAL 13 DAY PRECEDING AND CURRENT ROW)"""
)
def yield_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily level per maturity with lags, the mean of 14 days and the next level as the target."""
    days = table(spark, sf_dir, "events").where("value is not null").groupBy((F.col("user_id") % 5).alias("maturity"), F.to_date("ts").alias("day")).agg(F.avg("value").alias("level"))
    w = Window.partitionBy("maturity").orderBy("day")
    r = Window.partitionBy("maturity").orderBy(F.unix_date("day")).rangeBetween(-13, 0)
    return rounded(days.select("maturity", "day", "level", *(F.lag("level", k).over(w).alias(f"lag_{k}") for k in (1, 2)), F.avg("level").over(r).alias("mean_14d"), F.coalesce(F.stddev_samp("level").over(r), F.lit(0.0)).alias("std_14d"), F.count("*").over(r).alias("days_14d"), F.lead("level").over(w).alias("target")))


@query(
    """WITH s AS (SELECT o_custkey AS customer, sum(o_totalprice) AS score, count(*) AS orders FROM orders GROUP BY ALL), n AS (SELECT *, row_number() OVER (ORDER BY score DESC, customer) AS rank, count(*) OVER () AS total FROM s)
    SELECT customer, round(score, 2) AS score, rank, CASE WHEN rank - 1 < total // 4 THEN 'Q1' WHEN rank - 1 < total // 2 THEN 'Q2' WHEN rank - 1 < 3 * total // 4 THEN 'Q3' ELSE 'Q4' END AS quartile FROM n"""
)
def rank_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank by score and quartile by rank with whole-number limits. Scores are exact sums, so that equal ones go by customer however the rows are dealt; the ranks of a global order are computed by range partitions, not in one task."""
    from ..operators.ranking import exact_sum, global_rank

    s = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(exact_sum(F.col("o_totalprice")).alias("score"))
    n = global_rank(s, [F.col("score").desc(), F.col("customer").asc()], "rank")
    total = s.agg(F.count("*").alias("total"))
    q = F.when(F.expr("rank - 1 < total div 4"), "Q1").when(F.expr("rank - 1 < total div 2"), "Q2").when(F.expr("rank - 1 < 3 * total div 4"), "Q3").otherwise("Q4")
    return rounded(n.join(F.broadcast(total)).select("customer", "score", "rank", q.alias("quartile")), 2)
