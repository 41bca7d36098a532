"""Queries on cash flows, joins and aggregates of markets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bloom, cashflow, market, timeseries as ts
from ..operators.ranking import page, top_per_key
from ..sources.tables import BARS_SQL, daily_bars, table
from .registry import query, rounded


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as bank transactions."""
    return as_transactions(table(spark, sf_dir, "events"))


def as_transactions(e: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    return e.select(
        "ts", F.col("event_id").alias("seq"), F.when(kind == "purchase", "INCOME").when(kind == "click", "EXPENSE").when(kind == "error", "WITHDRAWAL").otherwise("OTHER").alias("type"),
        F.element_at(F.array(*(F.lit(o) for o in cashflow.OPERATIONS)), (F.col("event_id") % 5 + 1).cast("int")).alias("operation"), F.col("value").alias("amount"), (1000 + F.col("value") * (F.col("user_id") % 7)).alias("balance"),
        F.element_at(F.array(*(F.lit(o) for o in cashflow.SYMBOLS.values())), (F.col("user_id") % 8 + 1).cast("int")).alias("k_symbol"),
        F.when(F.col("user_id") % 3 == 0, "").otherwise((F.col("user_id") % 11).cast("string")).alias("bank"), (F.col("user_id") % 13).cast("string").alias("account"), F.col("user_id").alias("account_id"),
    )


_TX = f"""tx AS (SELECT ts, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'INCOME' WHEN 'click' THEN 'EXPENSE' WHEN 'error' THEN 'WITHDRAWAL' ELSE 'OTHER' END AS type,
  ([{', '.join(f"'{o}'" for o in cashflow.OPERATIONS)}])[event_id % 5 + 1] AS operation, value AS amount, 1000 + value * (user_id % 7) AS balance,
  ([{', '.join(f"'{o}'" for o in cashflow.SYMBOLS.values())}])[user_id % 8 + 1] AS k_symbol,
  CASE WHEN user_id % 3 = 0 THEN '' ELSE (user_id % 11)::VARCHAR END AS bank, (user_id % 13)::VARCHAR AS account, user_id AS account_id FROM events)"""
_WIN = "win AS (SELECT *, unnest(generate_series(date_trunc('day', ts) - INTERVAL 6 DAY, date_trunc('day', ts), INTERVAL 1 DAY)) AS ws FROM tx)"
_SUM3 = "coalesce(sum(amount) FILTER (type = 'INCOME'), 0.0) AS income_amount, coalesce(sum(amount) FILTER (type = 'EXPENSE'), 0.0) AS expense_amount, coalesce(sum(amount) FILTER (type = 'WITHDRAWAL'), 0.0) AS withdrawal_amount"
_FEATURES = f"""feat AS (SELECT ws AS window_start, ws + INTERVAL 7 DAY AS window_end, {_SUM3}, avg(balance) AS balance_mean, quantile_cont(balance, 0.5) AS balance_median, coalesce(stddev_samp(balance), 0.0) AS balance_std,
  arg_max(balance, row(ts, seq)) AS balance_eod, avg(amount) AS amount_mean, quantile_cont(amount, 0.5) AS amount_median, coalesce(stddev_samp(amount), 0.0) AS amount_std, min(amount) AS amount_min, max(amount) AS amount_max,
  {', '.join(f"count(*) FILTER (type = '{t}') AS type_{t}_count" for t in cashflow.TYPES)}, {', '.join(f'''count(*) FILTER (operation = '{o}') AS "operation_{o}_count"''' for o in cashflow.OPERATIONS)},
  {', '.join(f'''count(*) FILTER (k_symbol = '{v}') AS "k_symbol_{k}_count"''' for k, v in cashflow.SYMBOLS.items())},
  count(DISTINCT nullif(bank, '')) AS unique_bank_count, count(DISTINCT nullif(account, '')) AS unique_transfer_account_count, count(DISTINCT account_id) AS unique_account_id_count FROM win GROUP BY ws)"""
_DOUBLES = "income_amount expense_amount withdrawal_amount balance_mean balance_median balance_std balance_eod amount_mean amount_median amount_std amount_min amount_max".split()


@query(
    f"""WITH {_TX}, {_WIN}, {_FEATURES} SELECT * EXCLUDE (window_start, window_end, {', '.join(_DOUBLES)}), CAST(window_start AS DATE) AS window_start, CAST(window_end AS DATE) AS window_end, {', '.join(f'round({d}, 4) + 0.0 AS {d}' for d in _DOUBLES)},
    {', '.join(f'{p}({c})::INT AS history_{c}_{p}' for c in ('window_start', 'window_end') for p in ('year', 'month', 'day'))} FROM feat"""
)
def cashflow_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cashflow.window_features(transactions(spark, sf_dir))
    return rounded(df.withColumns({c: F.to_date(c) for c in ("window_start", "window_end")}), 4)


@query(
    f"""WITH {_TX}, {_WIN}, t AS (SELECT ws, income_amount - expense_amount - withdrawal_amount AS target, income_amount FROM (SELECT ws, {_SUM3} FROM win GROUP BY ws)),
    j AS (SELECT a.ws + INTERVAL 7 DAY AS window_end, a.income_amount, b.target FROM t a JOIN t b ON a.ws + INTERVAL 7 DAY = b.ws)
    SELECT CAST(j.window_end AS DATE) AS window_end, round(j.income_amount, 4) AS income_amount, round(j.target, 4) + 0.0 AS target, {', '.join(f'round(l{k}.target, 4) + 0.0 AS lag_{k}' for k in range(1, 8))}
    FROM j {' '.join(f'LEFT JOIN j l{k} ON l{k}.window_end + INTERVAL {k} DAY = j.window_end' for k in range(1, 8))}"""
)
def cashflow_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows joined with the next window's cash flow and with seven lagged targets, in one window instead of seven self-joins."""
    df = cashflow.dataset(transactions(spark, sf_dir))
    t = "target_next_window_cashflow"
    return rounded(df.select(F.to_date("window_end").alias("window_end"), "income_amount", F.col(t).alias("target"), *(F.col(f"{t}_lag_{k}").alias(f"lag_{k}") for k in range(1, 8))), 4)


@query(
    """WITH f AS (SELECT event_type AS category, value AS amount, (DATE '2024-01-30' - CAST(ts AS DATE)) // 7 AS week FROM events WHERE CAST(ts AS DATE) <= DATE '2024-01-30')
    SELECT c.category, """
    + ", ".join(f"round(coalesce(sum(amount) FILTER (week = {k}), 0.0), 4) AS week_{k}" for k in range(4))
    + " FROM (SELECT unnest(['view', 'signup', 'purchase', 'click', 'error', 'refund']) AS category) c LEFT JOIN f USING (category) GROUP BY c.category"
)
def category_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by category and week before a day, with every category and week present."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("category"), F.col("value").alias("amount"), F.to_date("ts").alias("day")).where("day <= date'2024-01-30'")
    return rounded(cashflow.category_by_week(e, ["view", "signup", "purchase", "click", "error", "refund"], F.lit("2024-01-30").cast("date")), 4)


@query(
    """WITH b AS (SELECT ts, event_id AS seq, value AS balance FROM events WHERE value IS NOT NULL), d AS (SELECT CAST(ts AS DATE) AS day, arg_min(balance, row(ts, seq)) AS opening, arg_max(balance, row(ts, seq)) AS closing FROM b GROUP BY 1)
    SELECT day, round(opening, 6) AS opening, round(closing, 6) AS closing, round(closing - opening, 6) + 0.0 AS net_flow, round(closing * (1 - 0.045), 6) AS buffer FROM d"""
)
def daily_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null").select("ts", F.col("event_id").alias("seq"), F.col("value").alias("balance"))
    return rounded(cashflow.daily_balance(e))


@query(
    "SELECT o_custkey AS customer, o_orderkey AS order_key, row_number() OVER w AS n, round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE -o_totalprice END) OVER w, 5) + 0.0 AS balance, round(100000 + sum(o_totalprice * 0.01) OVER w, 5) AS capital_after FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING)"
)
def running_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running balance and capital of each customer's orders."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    signed = F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    o = table(spark, sf_dir, "orders")
    return rounded(o.select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order_key"), F.row_number().over(w).cast("long").alias("n"), F.sum(signed).over(past).alias("balance"), (100000 + F.sum(F.col("o_totalprice") * 0.01).over(past)).alias("capital_after")), 5)


_RET = f"{BARS_SQL}, ret AS (SELECT pair, day, close / lag(close) OVER (PARTITION BY pair ORDER BY day) - 1 AS ret, volume FROM bars)"


@query(
    f"""WITH {_RET} SELECT a.pair AS a, b.pair AS b, count(*) AS days, round(corr(a.ret, b.ret), 6) + 0.0 AS corr, CASE WHEN corr(a.ret, b.ret) > 0.7 THEN 'high' WHEN corr(a.ret, b.ret) < -0.3 THEN 'negative' ELSE 'normal' END AS level
    FROM ret a JOIN ret b ON a.day = b.day AND a.pair < b.pair WHERE a.ret IS NOT NULL AND b.ret IS NOT NULL GROUP BY ALL"""
)
def correlation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(market.correlations(market.returns_by_day(daily_bars(spark, sf_dir))))


@query(
    f"""WITH {_RET}, m AS (SELECT day, avg(ret) AS m FROM ret WHERE ret IS NOT NULL GROUP BY day)
    SELECT pair, count(*) AS days, CASE WHEN count(*) > 30 THEN round(covar_samp(ret, m) / var_samp(m), 6) END AS beta FROM ret JOIN m USING (day) WHERE ret IS NOT NULL GROUP BY pair"""
)
def betas(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = market.returns_by_day(daily_bars(spark, sf_dir))
    return rounded(market.beta(r, r.where("ret is not null").groupBy("day").agg(F.avg("ret").alias("ret"))))


@query(
    f"""WITH {_RET}, w AS (SELECT day, max(ret) FILTER (pair = 'A') AS a, max(ret) FILTER (pair = 'N') AS n, max(ret) FILTER (pair = 'R') AS r FROM ret GROUP BY day)
    SELECT day, round(a, 6) + 0.0 AS a, round(n, 6) + 0.0 AS n, round(r, 6) + 0.0 AS r FROM w WHERE a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL"""
)
def returns_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of all pairs side by side, days complete in all of them."""
    r = market.returns_by_day(daily_bars(spark, sf_dir)).groupBy("day").pivot("pair", ["A", "N", "R"]).agg(F.max("ret"))
    return rounded(r.select("day", F.col("A").alias("a"), F.col("N").alias("n"), F.col("R").alias("r")).na.drop())


@query(
    f"""WITH {_RET} SELECT day, count(*) FILTER (ret > 0) AS advances, count(*) FILTER (ret < 0) AS declines, count(*) FILTER (ret = 0) AS unchanged, round(count(*) FILTER (ret > 0)::DOUBLE / nullif(count(*) FILTER (ret < 0), 0), 6) AS ratio,
    round(sum(volume) FILTER (ret > 0) / nullif(sum(volume) FILTER (ret < 0), 0), 6) AS volume_ratio, round(count(*) FILTER (ret > 0)::DOUBLE / nullif(count(ret), 0) * 100, 6) AS advance_pct FROM ret GROUP BY day"""
)
def market_breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = ts.series(order="day")
    r = daily_bars(spark, sf_dir).select("day", "volume", ts.change(F.col("close"), w).alias("change"))
    return rounded(r.groupBy("day").agg(*market.breadth(r)))


@query(
    f"""WITH {BARS_SQL}, e AS (SELECT *, max(high) OVER w AS top, min(low) OVER w AS bottom FROM bars WINDOW w AS (PARTITION BY pair ORDER BY day RANGE BETWEEN INTERVAL 364 DAY PRECEDING AND CURRENT ROW))
    SELECT day, count(*) FILTER (close >= (1 - 0.3::DOUBLE) * top) AS near_52w_high, count(*) FILTER (close <= (1 + 0.3::DOUBLE) * bottom) AS near_52w_low FROM e GROUP BY day"""
)
def market_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pairs close near the highest high or lowest low of their year."""
    return market.with_extremes(daily_bars(spark, sf_dir), 0.3).groupBy("day").agg(*market.extremes())


@query(
    f"""WITH {BARS_SQL}, r AS (SELECT pair, day, close, ln(close / lag(close) OVER w) * 100 AS r, row_number() OVER (PARTITION BY pair ORDER BY day DESC) AS k FROM bars WINDOW w AS (PARTITION BY pair ORDER BY day)),
    g AS (SELECT pair, count(*) AS bars, arg_max(close, day) AS last, arg_min(close, day) FILTER (k <= 60) AS first, stddev_pop(r) FILTER (k < 252) * sqrt(252) AS volatility FROM r WHERE k <= 252 GROUP BY pair), c AS (SELECT *, (last - first) / first * 100 AS change FROM g)
    SELECT pair, bars, round(change, 6) AS change, CASE WHEN change > 2 THEN 'BULLISH' WHEN change < -2 THEN 'BEARISH' ELSE 'SIDEWAYS' END AS trend, round(volatility, 6) AS volatility, CASE WHEN volatility > 15 THEN 'HIGH' WHEN volatility > 8 THEN 'MODERATE' ELSE 'LOW' END AS level FROM c"""
)
def market_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trend and volatility labels of each pair's last bars."""
    return rounded(market.trends(daily_bars(spark, sf_dir)))


@query(
    """WITH o AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'PE' ELSE 'CE' END AS side, l_shipdate, l_quantity FROM lineitem), r AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS expiry, sum(l_quantity) FILTER (side = 'PE') AS pe, sum(l_quantity) FILTER (side = 'CE') AS ce FROM o GROUP BY 1)
    SELECT expiry, round(pe / nullif(ce, 0), 6) AS ratio, CASE WHEN pe / nullif(ce, 0) > 1.3 THEN 'EXTREME_FEAR' WHEN pe / nullif(ce, 0) > 1.0 THEN 'BEARISH' WHEN pe / nullif(ce, 0) > 0.7 THEN 'NEUTRAL' WHEN pe / nullif(ce, 0) > 0.5 THEN 'BULLISH' ELSE 'EXTREME_GREED' END AS regime FROM r"""
)
def put_call_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open interest of puts over that of calls, from nested records that are exploded first."""
    l = table(spark, sf_dir, "lineitem").select(F.trunc("l_shipdate", "month").alias("expiry"), F.array(F.struct(F.when(F.col("l_linestatus") == "O", "PE").otherwise("CE").alias("side"), F.col("l_quantity").alias("oi"))).alias("records"))
    o = l.select("expiry", F.explode("records").alias("r")).groupBy("expiry").agg(F.sum(F.when(F.col("r.side") == "PE", F.col("r.oi"))).alias("pe"), F.sum(F.when(F.col("r.side") == "CE", F.col("r.oi"))).alias("ce"))
    r = F.try_divide("pe", "ce")
    return rounded(o.select("expiry", r.alias("ratio"), market.put_call_label(r).alias("regime")))


@query(
    f"""WITH {BARS_SQL}, c AS (SELECT *, last_value(close) OVER (PARTITION BY pair ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS now FROM bars), p AS (SELECT pair, round(max(now), 8) AS current, avg((close <= now)::INT::DOUBLE) * 100 AS pct FROM c GROUP BY pair)
    SELECT pair, current, round(pct, 6) AS pct, CASE WHEN pct >= 80 THEN 'VERY_EXPENSIVE' WHEN pct >= 60 THEN 'EXPENSIVE' WHEN pct >= 40 THEN 'FAIR' WHEN pct >= 20 THEN 'CHEAP' ELSE 'VERY_CHEAP' END AS label FROM p"""
)
def valuation_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of history at or under the latest close, with a label."""
    b = daily_bars(spark, sf_dir)
    now = b.groupBy("pair").agg(F.max_by("close", "day").alias("current"))
    p = b.join(now, "pair").groupBy("pair").agg(F.max("current").alias("current"), market.percentile_of(F.col("close"), F.col("current")).alias("pct"))
    return rounded(p.withColumn("label", market.percentile_label(F.col("pct"))), exact=("current",))


@query(
    """WITH s AS (SELECT c_custkey AS id, (['CONSERVATIVE', 'BALANCED', 'AGGRESSIVE'])[c_custkey % 3 + 1] AS intent, (['HIGH', 'MEDIUM', 'LOW'])[c_nationkey % 3 + 1] AS liquidity_risk, (['BULLISH', 'NEUTRAL', 'BEARISH'])[c_custkey % 7 % 3 + 1] AS sentiment,
      (['HIGH', 'MEDIUM', 'LOW'])[c_custkey % 5 % 3 + 1] AS volatility, (['RISING', 'FLAT'])[c_custkey % 2 + 1] AS yield_trend, (c_custkey % 11) / 10.0::DOUBLE AS fx FROM customer),
    a0 AS (SELECT *, CASE intent WHEN 'CONSERVATIVE' THEN 0.2::DOUBLE WHEN 'BALANCED' THEN 0.4::DOUBLE ELSE 0.7::DOUBLE END AS s, CASE intent WHEN 'CONSERVATIVE' THEN 0.7::DOUBLE WHEN 'BALANCED' THEN 0.5::DOUBLE ELSE 0.2::DOUBLE END AS b, CASE intent WHEN 'CONSERVATIVE' THEN 0.0::DOUBLE ELSE 0.05::DOUBLE END AS f, CASE intent WHEN 'CONSERVATIVE' THEN 0.1::DOUBLE ELSE 0.05::DOUBLE END AS c FROM s),
    a1 AS (SELECT * REPLACE (CASE WHEN sentiment = 'BULLISH' AND volatility <> 'HIGH' THEN s + 0.1::DOUBLE ELSE s END AS s, CASE WHEN sentiment = 'BULLISH' AND volatility <> 'HIGH' THEN b - 0.1::DOUBLE ELSE b END AS b) FROM a0),
    a2 AS (SELECT * REPLACE (CASE WHEN sentiment = 'BEARISH' OR volatility = 'HIGH' THEN s - 0.15::DOUBLE ELSE s END AS s, CASE WHEN sentiment = 'BEARISH' OR volatility = 'HIGH' THEN b + 0.1::DOUBLE ELSE b END AS b, CASE WHEN sentiment = 'BEARISH' OR volatility = 'HIGH' THEN c + 0.05::DOUBLE ELSE c END AS c) FROM a1),
    a3 AS (SELECT * REPLACE (CASE WHEN yield_trend = 'RISING' THEN b - 0.1::DOUBLE ELSE b END AS b, CASE WHEN yield_trend = 'RISING' THEN c + 0.1::DOUBLE ELSE c END AS c), greatest(0.0::DOUBLE, 0.1::DOUBLE * fx - f) AS d FROM a2),
    a4 AS (SELECT * EXCLUDE d REPLACE (f + d AS f, CASE WHEN intent = 'CONSERVATIVE' THEN c - d ELSE c END AS c, CASE WHEN intent = 'CONSERVATIVE' THEN s ELSE s - d END AS s) FROM a3),
    a5 AS (SELECT *, CASE WHEN liquidity_risk = 'HIGH' AND c < 0.25::DOUBLE THEN 0.25::DOUBLE - c ELSE 0.0::DOUBLE END AS d FROM a4),
    a6 AS (SELECT * EXCLUDE d REPLACE (c + d AS c, CASE WHEN d > 0 THEN greatest(b - d, 0.0::DOUBLE) ELSE b END AS b, CASE WHEN d > 0 AND b < d THEN s - (d - b) ELSE s END AS s) FROM a5),
    a7 AS (SELECT *, CASE WHEN liquidity_risk = 'LOW' AND volatility = 'LOW' AND c > 0.02::DOUBLE THEN c - 0.02::DOUBLE ELSE 0.0::DOUBLE END AS d FROM a6),
    a8 AS (SELECT id, greatest(s, 0.0::DOUBLE) AS s, greatest(b + d, 0.0::DOUBLE) AS b, greatest(f, 0.0::DOUBLE) AS f, greatest(c - d, 0.0::DOUBLE) AS c FROM a7), a9 AS (SELECT *, CASE WHEN abs(s + b + f + c - 1) > 0.001 THEN s + b + f + c ELSE 1.0::DOUBLE END AS t FROM a8)
    SELECT id, round(s / t, 3) AS stocks, round(b / t, 3) AS bonds, round(f / t, 3) AS forex, round(c / t, 3) AS cash FROM a9"""
)
def allocation_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pick = lambda at, *names: F.element_at(F.array(*(F.lit(n) for n in names)), (at + 1).cast("int"))
    k = F.col("c_custkey")
    s = table(spark, sf_dir, "customer").select(
        k.alias("id"), pick(k % 3, "CONSERVATIVE", "BALANCED", "AGGRESSIVE").alias("intent"), pick(F.col("c_nationkey") % 3, "HIGH", "MEDIUM", "LOW").alias("liquidity_risk"), pick(k % 7 % 3, "BULLISH", "NEUTRAL", "BEARISH").alias("sentiment"),
        pick(k % 5 % 3, "HIGH", "MEDIUM", "LOW").alias("volatility"), pick(k % 2, "RISING", "FLAT").alias("yield_trend"), ((k % 11) / F.lit(10.0)).alias("forex_opportunity_index"),
    )
    return market.allocation(s).select("id", "stocks", "bonds", "forex", "cash")


@query(
    """WITH x AS (SELECT s_suppkey AS id, 10 + abs(s_acctbal) / 500 AS vix, s_acctbal AS flows, (s_suppkey % 20) / 10.0::DOUBLE AS breadth, (s_suppkey % 7) / 50.0::DOUBLE AS yields FROM supplier),
    y AS (SELECT id, (CASE WHEN vix > 25 THEN 25 WHEN vix > 20 THEN 18 WHEN vix > 15 THEN 15 ELSE 0 END + CASE WHEN flows < -5000 THEN 30 WHEN flows < -2000 THEN 20 WHEN flows < 0 THEN 10 ELSE 0 END + CASE WHEN breadth < 0.5 THEN 25 WHEN breadth < 1.0 THEN 15 ELSE 0 END + CASE WHEN yields > 0.1 THEN 20 WHEN yields > 0.05 THEN 10 ELSE 0 END)::INT AS score FROM x)
    SELECT id, score, CASE WHEN score > 66 THEN 'High' WHEN score > 33 THEN 'Medium' ELSE 'Low' END AS level FROM y"""
)
def market_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    k = F.col("s_suppkey")
    score = market.regime_score(10 + F.abs("s_acctbal") / 500, F.col("s_acctbal"), (k % 20) / F.lit(10.0), (k % 7) / F.lit(50.0))
    return s.select(k.alias("id"), score.alias("score"), market.risk_level(score).alias("level"))


@query(
    f"""WITH {BARS_SQL}, n AS (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY day DESC) AS k, avg(close) OVER (PARTITION BY pair ORDER BY day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS ma FROM bars), l AS (SELECT pair, day, close, ma, lag(close) OVER (PARTITION BY pair ORDER BY day) AS before, k FROM n)
    SELECT pair, day, round(close, 8) AS close, round(close - before, 8) + 0.0 AS change, round((close - before) / before * 100, 6) + 0.0 AS change_pct, round(ma, 6) AS ma_20 FROM l WHERE k = 1"""
)
def last_bar_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest bar against the one before, with the moving average at the end."""
    w = ts.series(order="day")
    b = daily_bars(spark, sf_dir).select("pair", "day", "close", F.lag("close").over(w).alias("before"), F.avg("close").over(w.rowsBetween(-19, 0)).alias("ma_20"))
    b = top_per_key(b, ["pair"], [F.col("day").desc()], 1)
    return rounded(b.select("pair", "day", "close", (F.col("close") - F.col("before")).alias("change"), ((F.col("close") - F.col("before")) / F.col("before") * 100).alias("change_pct"), "ma_20"), exact=("close", "change"))


@query("SELECT o_orderkey AS order_key, o_totalprice AS price FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_totalprice DESC, o_orderkey OFFSET 40 LIMIT 20")
def paginated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of a sorted result; the limit is the feature."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").alias("price"))
    return page(o, [F.col("price").desc(), F.col("order_key").asc()], 40, 20)


@query("SELECT o_custkey AS customer, o_orderkey AS order_key, o_totalprice AS price FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) <= 10")
def recent_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten newest rows of each key."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order_key"), F.col("o_totalprice").alias("price"), "o_orderdate")
    return top_per_key(o, ["customer"], [F.col("o_orderdate").desc(), F.col("order_key").desc()], 10).drop("o_orderdate")


@query("SELECT c_custkey AS customer, c_name AS name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000) AND c_custkey IN (SELECT o_custkey FROM orders)")
def seen_and_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Semi and anti joins: customers with orders and without large ones."""
    c, o = table(spark, sf_dir, "customer").where(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")), table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return c.join(o, "c_custkey", "left_semi").join(o.where("o_totalprice > 400000"), "c_custkey", "left_anti").select(F.col("c_custkey").alias("customer"), F.col("c_name").alias("name"))


@query(
    """WITH a AS (SELECT c_custkey AS id, md5('https://shop.example.com/c/' || (c_custkey // 2)) AS url_hash FROM customer), o AS (SELECT md5('https://shop.example.com/c/' || (o_custkey // 3)) AS url_hash, CAST(o_orderdate AS DATE) AS seen FROM orders),
    n AS (SELECT max(seen) AS now FROM o), c AS (SELECT DISTINCT url_hash FROM o, n WHERE seen >= now - INTERVAL 30 DAY), r AS (SELECT DISTINCT url_hash FROM o)
    SELECT id, url_hash, CASE WHEN c.url_hash IS NOT NULL THEN 'cache' WHEN r.url_hash IS NOT NULL THEN 'registry' WHEN id > min(id) OVER (PARTITION BY a.url_hash) THEN 'batch' ELSE 'new' END AS layer FROM a LEFT JOIN c USING (url_hash) LEFT JOIN r USING (url_hash)"""
)
def url_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New addresses by a Bloom filter, a cache of 30 days and a registry: pages of customers against those of orders."""
    address = lambda k: F.md5(F.concat(F.lit("https://shop.example.com/c/"), F.expr(k).cast("string")))
    seen = table(spark, sf_dir, "orders").select(address("o_custkey div 3").alias("url_hash"), F.to_date("o_orderdate").alias("seen_at"))
    new = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), address("c_custkey div 2").alias("url_hash"))
    now = F.lit(seen.agg(F.max("seen_at")).head()[0])
    return bloom.url_layers(new, bloom.bloom_filter(seen, "url_hash"), seen, seen, now).drop("maybe")


@query(
    """SELECT n_name AS nation, c_mktsegment AS segment, grouping_id(n_name, c_mktsegment)::BIGINT AS level, count(*) AS customers, round(sum(c_acctbal), 2) AS balance, count(DISTINCT r_name) AS regions FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (n_name, c_mktsegment)"""
)
def exposure_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup joins of small dimensions and a rollup."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    j = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, n["n_regionkey"] == r["r_regionkey"])
    return rounded(j.rollup(F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment")).agg(F.grouping_id().alias("level"), F.count("*").alias("customers"), F.sum("c_acctbal").alias("balance"), F.count_distinct("r_name").alias("regions")), 2)


@query(
    """SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.05), 6) AS p5, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(stddev_samp(value), 6) AS std, count(*) FILTER (value > 100) AS large, count(DISTINCT user_id) AS users, round(arg_max(value, row(ts, event_id)), 6) AS latest
    FROM events WHERE value IS NOT NULL GROUP BY event_type"""
)
def event_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("value is not null")
    return rounded(e.groupBy("event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), *(F.percentile("value", q / 100).alias(f"p{q}") for q in (5, 50, 95)), F.stddev_samp("value").alias("std"), F.count_if(F.col("value") > 100).alias("large"), F.count_distinct("user_id").alias("users"), F.max_by("value", F.struct("ts", "event_id")).alias("latest")))


@query(
    """SELECT 'supplier' AS kind, s_suppkey AS key, s_name AS name FROM supplier UNION ALL SELECT 'customer', c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT s_suppkey FROM supplier INTERSECT SELECT o_custkey FROM orders EXCEPT SELECT n_nationkey FROM nation)"""
)
def set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Union of two relations, one restricted by an intersection and a difference of keys."""
    s, c, o, n = (table(spark, sf_dir, t) for t in ("supplier", "customer", "orders", "nation"))
    keys = s.select(F.col("s_suppkey").alias("key")).intersect(o.select("o_custkey")).exceptAll(n.select("n_nationkey")).distinct()
    one = s.select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"))
    return one.unionByName(c.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name")).join(keys, "key", "left_semi"))
