"""Queries on bonds and portfolios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import bonds, portfolio, timeseries as ts
from ..operators.ranking import top_per_key
from ..sources.tables import BARS_SQL, daily_bars, table
from .registry import query, rounded

def as_of() -> F.Column:
    """The day that bonds are valued at."""
    return F.lit("2024-01-15").cast("date")


def bond_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as bonds: size gives the tenor, the price per hundred comes from the retail price."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("bond"), F.lit(100.0).alias("face_value"), (0.02 + (k % 60) / F.lit(1000.0)).alias("coupon_rate"), F.add_months(F.lit("2024-06-15").cast("date"), (F.col("p_size") * 6).cast("int")).alias("maturity"),
        (85 + F.col("p_retailprice") % 30).alias("price"), F.element_at(F.array(*(F.lit(r) for r in bonds.RATING_SCORE)), (k % 13 + 1).cast("int")).alias("rating"), "p_name", "p_brand", "p_type",
    )


_BONDS = f"""bond AS (SELECT p_partkey AS bond, 100.0::DOUBLE AS face_value, 0.02::DOUBLE + (p_partkey % 60) / 1000.0::DOUBLE AS coupon_rate, CAST(DATE '2024-06-15' + to_months((p_size * 6)::INT) AS DATE) AS maturity, 85 + p_retailprice % 30 AS price,
  ([{', '.join(f"'{r}'" for r in bonds.RATING_SCORE)}])[p_partkey % 13 + 1] AS rating, p_name, p_brand, p_type FROM part)"""
_FLOWS = """flow AS (SELECT b.*, CAST(maturity - to_months((6 * k)::INT) AS DATE) AS pay_date, k FROM bond b, range(0, 120) r(k) WHERE CAST(maturity - to_months((6 * k)::INT) AS DATE) > DATE '2024-01-15'),
  pv AS (SELECT *, (pay_date - DATE '2024-01-15') / 365.25::DOUBLE AS years, face_value * coupon_rate / 2 + CASE WHEN k = 0 THEN face_value ELSE 0 END AS amount, 0.03::DOUBLE + 0.001 * (bond % 40) AS y FROM flow)"""


@query(
    f"""WITH {_BONDS}, {_FLOWS}, g AS (SELECT bond, sum(amount / pow(1 + y, years)) AS price, sum(years * amount / pow(1 + y, years)) AS t, sum(years * (years + 1) * amount / pow(1 + y, years)) AS t2, max(y) AS y FROM pv GROUP BY bond)
    SELECT bond, round(price, 6) AS price, round(t / price, 6) AS duration, round(t / price / (1 + y), 6) AS modified_duration, round(t2 / (price * pow(1 + y, 2)), 6) AS convexity, round(t / price / (1 + y) * price * 1e-4, 8) AS dv01,
      round(-(t / price / (1 + y)) * price * 0.01 + 0.5 * (t2 / (price * pow(1 + y, 2))) * price * 0.0001, 6) AS up_100bp, CASE WHEN t / price / (1 + y) > 7 THEN 'High' WHEN t / price / (1 + y) > 4 THEN 'Medium' ELSE 'Low' END AS rate_risk FROM g"""
)
def bond_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cash flows exploded and discounted: price, durations, convexity, value of a basis point and sensitivity."""
    flows = bonds.cash_flows(bond_table(spark, sf_dir), as_of())
    p = bonds.priced(flows, ["bond"], 0.03 + 0.001 * (F.col("bond") % 40))
    return rounded(p.select("*", bonds.rate_sensitivity(F.col("price"), F.col("modified_duration"), F.col("convexity")).alias("up_100bp"), bonds.duration_class(F.col("modified_duration")).alias("rate_risk")), exact=("dv01",))


@query(
    f"""WITH RECURSIVE {_BONDS}, b AS (SELECT bond, price, face_value AS f, coupon_rate AS c, greatest(0.0, (maturity - DATE '2024-01-15') / 365.25::DOUBLE) AS years FROM bond),
    s AS (SELECT *, 0 AS i, 0.0::DOUBLE AS lo, 0.5::DOUBLE AS hi FROM b UNION ALL
      SELECT bond, price, f, c, years, i + 1, CASE WHEN p > price THEN mid ELSE lo END, CASE WHEN p > price THEN hi ELSE mid END FROM (SELECT *, f * c / 2 * (1 - pow(1 + mid / 2, -n)) / (mid / 2) + f * pow(1 + mid / 2, -n) AS p FROM (SELECT *, (lo + hi) / 2 AS mid, floor(years * 2) AS n FROM s WHERE i < 60)))
    SELECT bond, round(years, 6) AS years, round(CASE WHEN floor(years * 2) <= 0 THEN c ELSE (lo + hi) / 2 END, 6) AS ytm, round(c * f / price, 6) AS current_yield FROM s WHERE i = 60"""
)
def bond_yields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yield to maturity by sixty halvings of whole batches, and the current yield."""
    b = bond_table(spark, sf_dir).withColumn("years", bonds.years_to(F.col("maturity"), as_of()))
    ytm = bonds.yield_to_maturity(F.col("price"), F.col("face_value"), F.col("coupon_rate"), F.col("years"))
    return rounded(b.select("bond", "years", ytm.alias("ytm"), (F.col("coupon_rate") * F.col("face_value") / F.col("price")).alias("current_yield")))


_SCORE = "CASE rating " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in bonds.RATING_SCORE.items()) + " ELSE 0.5::DOUBLE END"


@query(
    f"""WITH {_BONDS}, x AS (SELECT *, price - 100 AS gap, coupon_rate * 100 - 4 AS er, (bond % 10) / 10.0::DOUBLE AS cr, (bond % 7) / 7.0::DOUBLE AS liq FROM bond), q AS (SELECT bond, rating, gap, er, liq, greatest(0.0, least(1.0, 0.5 - gap / 10)) AS v, greatest(0.0, least(1.0, (er + 2) / 5)) AS r, 0.6::DOUBLE * {_SCORE} + 0.4::DOUBLE * (1 - cr) AS q FROM x),
    t AS (SELECT bond, rating, round(v, 4) AS valuation, round(r, 4) AS ret, round(q, 4) AS quality, round(0.3::DOUBLE * v + 0.3::DOUBLE * r + 0.2::DOUBLE * q + 0.2::DOUBLE * liq, 4) AS total, CASE WHEN er / 100 - 0.01 * gap / 10 > 0.10 THEN 'STRONG_BUY' WHEN er / 100 - 0.01 * gap / 10 > 0.05 THEN 'BUY' WHEN er / 100 - 0.01 * gap / 10 < -0.05 THEN 'SELL' ELSE 'HOLD' END AS signal FROM q)
    SELECT * FROM t WHERE total >= 0.4 QUALIFY row_number() OVER (PARTITION BY rating ORDER BY total DESC, bond) <= 5"""
)
def bond_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composite scores and signals; the five best of each rating over a least score."""
    b = bond_table(spark, sf_dir)
    gap, er = F.col("price") - 100, F.col("coupon_rate") * 100 - 4
    s = bonds.score(gap, er, F.col("rating"), (F.col("bond") % 10) / F.lit(10.0), (F.col("bond") % 7) / F.lit(7.0))
    t = b.select("bond", "rating", s.alias("s"), bonds.signal(er / 100, gap / 10).alias("signal")).select("bond", "rating", "s.*", "signal").where("total >= 0.4")
    return top_per_key(t, ["rating"], [F.col("total").desc(), F.col("bond").asc()], 5)


@query(
    f"""WITH {_BONDS}, b AS (SELECT *, greatest(0.0, (maturity - DATE '2024-01-15') / 365.25::DOUBLE) AS years FROM bond) SELECT bond, p_name AS name, coupon_rate, round(years, 6) AS years FROM b
    WHERE coupon_rate * 100 BETWEEN 3 AND 6 AND years BETWEEN 2 AND 12 AND face_value <= 1000 AND upper(p_name) LIKE '%A%' AND rating IN ('AAA', 'AA+', 'AA')"""
)
def bond_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bond_table(spark, sf_dir).withColumn("years", bonds.years_to(F.col("maturity"), as_of()))
    keep = F.col("years").between(2, 12) & (F.col("coupon_rate") * 100).between(3, 6) & (F.col("face_value") <= 1000) & F.upper("p_name").contains("A") & F.col("rating").isin("AAA", "AA+", "AA")
    return b.where(keep).select("bond", F.col("p_name").alias("name"), "coupon_rate", F.round("years", 6).alias("years"))


@query(
    f"""WITH {_BONDS}, t AS (SELECT bond, (9 - bond % 5)::VARCHAR || '.25 FV RS 100 ' || upper(p_name) AS d, lpad((bond % 28 + 1)::VARCHAR, 2, '0') || (['JA','FB','MR','AP','MY','JN','JL','AU','SP','OC','NV','DC'])[bond % 12 + 1] || lpad((bond % 100)::VARCHAR, 2, '0') AS code, (['GS', 'TB', 'SG', 'N1'])[bond % 4 + 1] AS series FROM bond)
    SELECT bond, round((9 - bond % 5 + 0.25::DOUBLE) / 100, 6) AS coupon, trim(regexp_replace(d, '\\d+\\.\\d+\\s*FV\\s*RS\\s*\\d+', '')) AS name, make_date((CASE WHEN bond % 100 < 50 THEN 2000 ELSE 1900 END + bond % 100)::INT, (bond % 12 + 1)::INT, (bond % 28 + 1)::INT) AS code_date,
      CASE WHEN series IN ('GS', 'TB') THEN 'Government' WHEN series = 'SG' THEN 'State Government' WHEN d LIKE '%GOI%' THEN 'Government' WHEN d LIKE '%SDL%' THEN 'State Government' ELSE 'Corporate' END AS bond_type FROM t"""
)
def bond_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coupon, name, date code and class parsed from text."""
    k = F.col("bond")
    months = F.array(*(F.lit(m) for m in bonds.MONTHS))
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    t = bond_table(spark, sf_dir).select(
        "bond", F.concat((9 - k % 5).cast("string"), F.lit(".25 FV RS 100 "), F.upper("p_name")).alias("d"), F.concat(two(k % 28 + 1), F.element_at(months, (k % 12 + 1).cast("int")), two(k % 100)).alias("code"), F.element_at(F.array(F.lit("GS"), F.lit("TB"), F.lit("SG"), F.lit("N1")), (k % 4 + 1).cast("int")).alias("series")
    )
    return rounded(t.select("bond", bonds.coupon(F.col("d")).alias("coupon"), bonds.bond_name(F.col("d"), F.lit("S"), F.lit("I")).alias("name"), bonds.date_code(F.col("code")).alias("code_date"), bonds.classify(F.col("series"), F.col("d"))["bond_type"].alias("bond_type")))


@query(
    f"""WITH {_BONDS}, c AS (SELECT s_suppkey AS curve, 0.03::DOUBLE + 0.0001 * (s_suppkey % 50) AS a, 0.02::DOUBLE AS b FROM supplier), p AS (SELECT curve, m, a + b * (1 - exp(-m / 5.0::DOUBLE)) AS y FROM c, (VALUES (1.0::DOUBLE), (2.0::DOUBLE), (5.0::DOUBLE), (7.0::DOUBLE), (10.0::DOUBLE)) k(m)),
    t AS (SELECT curve, tau FROM c, (VALUES (0.5::DOUBLE), (1.5::DOUBLE), (3.0::DOUBLE), (7.0::DOUBLE), (12.0::DOUBLE)) q(tau)), e AS (SELECT t.curve, tau, max(m) FILTER (m <= tau) AS m1, min(m) FILTER (m >= tau) AS m2, arg_max(y, m) FILTER (m <= tau) AS y1, arg_min(y, m) FILTER (m >= tau) AS y2 FROM t JOIN p ON p.curve = t.curve GROUP BY ALL)
    SELECT curve, tau, round(CASE WHEN m1 IS NULL THEN y2 WHEN m2 IS NULL OR m1 = m2 THEN y1 ELSE y1 + (y2 - y1) * (tau - m1) / (m2 - m1) END, 8) AS y FROM e"""
)
def curve_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear interpolation on curves held as sorted arrays; every curve is asked at every target."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("curve"), (0.03 + 0.0001 * (F.col("s_suppkey") % 50)).alias("a"))
    point = lambda m: F.named_struct(F.lit("m"), F.lit(m), F.lit("y"), F.col("a") + 0.02 * (1 - F.exp(F.lit(-m / 5))))
    c = s.select("curve", F.array(*(point(m) for m in (1.0, 2.0, 5.0, 7.0, 10.0))).alias("points"), F.explode(F.array(*(F.lit(t) for t in (0.5, 1.5, 3.0, 7.0, 12.0)))).alias("tau"))
    return rounded(c.select("curve", "tau", bonds.linear(F.col("points"), F.col("tau")).alias("y")), exact=("y",))


@query()
def curve_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nelson-Siegel, spline and linear yields combined, for curves of a table."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("curve"), (0.03 + 0.0001 * (F.col("s_suppkey") % 50)).alias("a"))
    ms = (1.0, 2.0, 5.0, 7.0, 10.0)
    c = s.select("curve", F.array(*(F.lit(m) for m in ms)).alias("m"), F.array(*(F.col("a") + 0.02 * (1 - F.exp(F.lit(-m / 5))) for m in ms)).alias("y"), F.array(*(F.lit(t) for t in (0.1, 0.5, 3.0, 12.0))).alias("t"))
    return rounded(bonds.curve_yields(c, "m", "y", "t").select("curve", F.posexplode("curve_yield").alias("at", "y")), 8)


_KNOTS = (1.0, 2.0, 5.0, 10.0, 30.0)


@query(
    f"""WITH {_BONDS}, o AS (SELECT o_orderkey AS trade, o_custkey AS bond, CAST(CAST(o_orderdate AS DATE) + to_months(336) AS DATE) AS day, o_totalprice FROM orders),
    c AS (SELECT day, {', '.join(f"0.01::DOUBLE + avg(o_totalprice) / 10000000.0::DOUBLE + 0.004::DOUBLE * ln(1 + {m}::DOUBLE) AS y{k}" for k, m in enumerate(_KNOTS))} FROM o GROUP BY day),
    f AS (SELECT trade, face_value * coupon_rate / 2 + CASE WHEN k = 0 THEN face_value ELSE 0 END AS amount, (CAST(maturity - to_months((6 * k)::INT) AS DATE) - o.day) / 365.25::DOUBLE AS t, c.* FROM o JOIN bond USING (bond) JOIN c USING (day), range(0, 70) r(k)
      WHERE maturity > o.day AND CAST(maturity - to_months((6 * k)::INT) AS DATE) > o.day),
    v AS (SELECT trade, amount, t, CASE WHEN t < {_KNOTS[0]} THEN y0 {' '.join(f"WHEN t < {b} THEN y{k} + (y{k + 1} - y{k}) * (t - {a}::DOUBLE) / {b - a}::DOUBLE" for k, (a, b) in enumerate(zip(_KNOTS, _KNOTS[1:])))} ELSE y{len(_KNOTS) - 1} END AS y FROM f),
    p AS (SELECT trade, sum(amount / pow(1 + CASE WHEN y > 0 THEN y ELSE 0.01 END, t)) AS price FROM v GROUP BY 1) SELECT trade, bond, o.day, round(p.price, 6) AS price FROM o JOIN bond USING (bond) LEFT JOIN p USING (trade)"""
)
def trade_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonds of trades priced on the curve of each trade's day."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trade"), F.col("o_custkey").alias("bond"), F.add_months(F.to_date("o_orderdate"), 336).alias("day"), "o_totalprice")
    level = F.lit(0.01) + F.avg("o_totalprice") / 10000000.0
    curves = o.groupBy("day").agg(level.alias("level")).select("day", F.array(*(F.lit(m) for m in _KNOTS)).alias("ms"), F.array(*(F.col("level") + 0.004 * F.log(F.lit(1 + m)) for m in _KNOTS)).alias("ys"))
    known = bond_table(spark, sf_dir).select("bond", "face_value", "coupon_rate", "maturity")
    trades = o.join(known.select("bond"), "bond").select("trade", "bond", "day")
    return rounded(bonds.priced_on_days(trades, known, curves, ["trade"]))


_TR = f"{BARS_SQL}, tr AS (SELECT pair, day, close / lag(close) OVER (PARTITION BY pair ORDER BY day) - 1 AS ret FROM bars)"


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(spark, sf_dir).select("pair", "day", ts.change(F.col("close"), ts.series(order="day")).alias("ret"))


@query(
    f"""WITH {_TR} SELECT pair, count(ret) AS trades, count(*) FILTER (ret > 0) AS wins, count(*) FILTER (ret < 0) AS losses, round(count(*) FILTER (ret > 0)::DOUBLE / count(ret), 6) AS win_rate, round(avg(ret) FILTER (ret > 0), 6) AS avg_win, round(avg(ret) FILTER (ret < 0), 6) AS avg_loss,
    round(sum(ret) FILTER (ret > 0) / -sum(ret) FILTER (ret < 0), 6) AS profit_factor, round(sum(ret), 6) + 0.0 AS total_pnl FROM tr GROUP BY pair"""
)
def trade_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(returns(spark, sf_dir).groupBy("pair").agg(*portfolio.trade_statistics(F.col("ret"))))


@query(
    f"""WITH {_TR}, g AS (SELECT *, exp(sum(ln(1 + ret)) OVER w) AS growth FROM tr WHERE ret IS NOT NULL WINDOW w AS (PARTITION BY pair ORDER BY day ROWS UNBOUNDED PRECEDING)), d AS (SELECT *, growth / max(growth) OVER (PARTITION BY pair ORDER BY day ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM g),
    a AS (SELECT pair, count(*) AS n, avg(ret) - 0.04::DOUBLE / 252 AS ex, stddev_samp(ret) AS s, stddev_samp(ret) FILTER (ret < 0) AS sd, min(dd) AS max_drawdown, pow(exp(sum(ln(1 + ret))), 252.0::DOUBLE / count(*)) - 1 AS annual_return, quantile_cont(ret, 0.05) AS var_5 FROM d GROUP BY pair)
    SELECT pair, n, round(annual_return, 6) + 0.0 AS annual_return, round(s * sqrt(252), 6) AS volatility, round(ex / s * sqrt(252), 6) + 0.0 AS sharpe, round(ex / sd * sqrt(252), 6) + 0.0 AS sortino, round(annual_return / -max_drawdown, 6) + 0.0 AS calmar, round(max_drawdown, 6) AS max_drawdown, round(var_5, 6) AS var_5, round((SELECT avg(ret) FROM d WHERE d.pair = a.pair AND ret <= a.var_5), 6) AS shortfall_5 FROM a"""
)
def risk_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.performance(returns(spark, sf_dir), ["pair"], "day"))


@query(
    f"""WITH {_TR}, p AS (SELECT pair, day, ret AS actual, sign(lag(ret) OVER (PARTITION BY pair ORDER BY day))::DOUBLE AS position FROM tr WHERE ret IS NOT NULL), s AS (SELECT *, position * actual AS strategy, coalesce(abs(position - lag(position) OVER (PARTITION BY pair ORDER BY day)), 0) AS t FROM p WHERE position IS NOT NULL)
    SELECT pair, count(*) AS n, round(CASE WHEN bool_or(strategy = -1) THEN 0 ELSE pow(-1, count(*) FILTER (strategy < -1) % 2) * exp(sum(ln(nullif(abs(1 + strategy), 0)))) END - 1, 6) + 0.0 AS total_profit, round(exp(sum(ln(1 + actual))) - 1, 6) + 0.0 AS buy_and_hold, round(avg(strategy - actual) / stddev_samp(strategy - actual) * sqrt(252), 6) + 0.0 AS information_ratio,
      round(avg(t), 6) AS turnover, round(avg((position > 0)::INT) * 100, 6) AS long_pct, round(avg((position < 0)::INT) * 100, 6) AS short_pct, round(avg((position = 0)::INT) * 100, 6) AS flat_pct FROM s GROUP BY pair"""
)
def strategy_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A strategy that follows the last return's sign against holding."""
    r = returns(spark, sf_dir).where("ret is not null")
    position = F.signum(F.lag("ret").over(ts.series(order="day")))
    days = r.select("pair", "day", F.col("ret").alias("actual"), position.alias("position")).where("position is not null").withColumn("strategy", F.col("position") * F.col("actual"))
    return rounded(portfolio.strategy_metrics(days, ["pair"], "day"))


@query(
    f"""WITH {_TR}, a AS (SELECT pair, count(*) AS n, count(*) FILTER (ret > 0) AS w, count(*) FILTER (ret < 0) AS l, avg(ret) FILTER (ret > 0) AS aw, avg(-ret) FILTER (ret < 0) AS al, avg(ret) AS m, var_samp(ret) AS v FROM tr WHERE ret IS NOT NULL GROUP BY pair), k AS (SELECT *, w::DOUBLE / n AS p, aw / al AS b FROM a), d AS (SELECT *, greatest((p * b - (1 - p)) / b, 0.0) AS kd, greatest(m / v, 0.0) AS kc FROM k)
    SELECT pair, round(p, 6) AS win_rate, round(b, 6) AS payoff_ratio, round(kd, 6) AS kelly_discrete, round(kc, 6) AS kelly_continuous, round(greatest(0.01::DOUBLE, least(0.25::DOUBLE, (kd + kc) / 2 * 0.5)), 6) AS fractional_kelly FROM d"""
)
def kelly_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.kelly(returns(spark, sf_dir), ["pair"]))


@query(
    f"""WITH {_TR}, v AS (SELECT pair, stddev_samp(ret) * sqrt(252) AS vol FROM tr GROUP BY pair), s AS (SELECT *, greatest(0.01::DOUBLE, least(0.6::DOUBLE, 0.02::DOUBLE / (vol / sqrt(252)))) AS size FROM v)
    SELECT pair, round(vol, 6) AS volatility, round(size, 6) AS size, round(CASE WHEN sum(size) OVER () > 0.05 THEN size / sum(size) OVER () * 0.05 ELSE size END, 6) AS normalised FROM s"""
)
def volatility_sizing(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = returns(spark, sf_dir).groupBy("pair").agg((F.stddev_samp("ret") * 252**0.5).alias("volatility"))
    s = v.withColumn("size", portfolio.volatility_target(F.col("volatility"), most=0.6))
    return rounded(s.withColumn("normalised", portfolio.normalised("size", most=0.05)))


@query(
    f"""WITH RECURSIVE {_TR}, n AS (SELECT pair, row_number() OVER (PARTITION BY pair ORDER BY day) AS seq, coalesce(ret, 0.0) AS ret, coalesce(lag(ret) OVER (PARTITION BY pair ORDER BY day), 0.0) AS score FROM tr),
    s AS (SELECT pair, 0::BIGINT AS seq, 0 AS pos, 0.0::DOUBLE AS held FROM (SELECT DISTINCT pair FROM n) UNION ALL
      SELECT pair, seq, now, CASE WHEN now = pos THEN h ELSE 0.0 END FROM (SELECT *, CASE WHEN pos <> 0 AND h < -0.3 THEN 0 WHEN pos = 0 THEN go WHEN abs(score) < 0.05 THEN 0 WHEN go <> 0 AND go <> pos THEN go ELSE pos END AS now
        FROM (SELECT s.pair, n.seq, s.pos, n.score, CASE WHEN s.pos <> 0 THEN s.held + s.pos * n.ret ELSE 0.0 END AS h, CASE WHEN n.score > 0.2 THEN 1 WHEN n.score < -0.2 THEN -1 ELSE 0 END AS go FROM s JOIN n ON n.pair = s.pair AND n.seq = s.seq + 1)))
    SELECT pair, seq, pos AS position FROM s WHERE seq > 0"""
)
def trading_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with hysteresis and a stop: an ordered fold per pair."""
    w = Window.partitionBy("pair").orderBy("day")
    r = returns(spark, sf_dir).select("pair", F.row_number().over(w).cast("long").alias("seq"), "ret", F.lag("ret").over(w).alias("score"))
    return portfolio.signals(r, "pair", "seq", "score", "ret", enter=0.2, leave=0.05, stop=0.3)


@query(
    """WITH RECURSIVE t AS (SELECT o_custkey AS customer, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, o_totalprice AS amount FROM orders), s AS (SELECT customer, 0::BIGINT AS seq, 1000000.0::DOUBLE AS cash, false AS accepted FROM (SELECT DISTINCT customer FROM t) UNION ALL
      SELECT s.customer, t.seq, CASE WHEN t.amount <= 300000 AND t.amount <= s.cash THEN s.cash - t.amount ELSE s.cash END, t.amount <= 300000 AND t.amount <= s.cash FROM s JOIN t ON t.customer = s.customer AND t.seq = s.seq + 1)
    SELECT customer, seq, accepted, round(cash, 4) AS cash FROM s WHERE seq > 0"""
)
def trade_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger that takes trades in order while cash lasts."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    t = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("customer"), F.row_number().over(w).cast("long").alias("seq"), F.col("o_totalprice").alias("amount"))
    return rounded(portfolio.ledger(t, "customer", "seq", "amount", 1_000_000.0, 0.3), 4)


@query(
    f"""WITH {_TR}, s AS (SELECT pair, day, sign(ret) AS s FROM tr WHERE ret <> 0), l AS (SELECT pair, arg_max(s, day) AS last FROM s GROUP BY pair), b AS (SELECT s.pair, max(day) FILTER (s <> last) AS broke FROM s JOIN l USING (pair) GROUP BY s.pair)
    SELECT s.pair, max(s)::INT AS sign, count(*) AS length FROM s JOIN b ON b.pair = s.pair WHERE broke IS NULL OR day > broke GROUP BY s.pair"""
)
def streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return portfolio.streaks(returns(spark, sf_dir).where("ret != 0"), "pair", ["day"], "ret")


@query(
    f"""WITH {BARS_SQL}, n AS (SELECT pair, close, row_number() OVER (PARTITION BY pair ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY pair) AS n FROM bars),
    l AS (SELECT pair, k, i // k AS c, i, close - lag(close) OVER (PARTITION BY pair, k, i // k ORDER BY i) AS ret FROM n, range(2, 20) t(k) WHERE k < n // 4 AND i // k < n // k),
    d AS (SELECT *, ret - avg(ret) OVER (PARTITION BY pair, k, c) AS dev FROM l WHERE ret IS NOT NULL), s AS (SELECT *, sum(dev) OVER (PARTITION BY pair, k, c ORDER BY i) AS cum FROM d),
    r AS (SELECT pair, k, c, (max(cum) - min(cum)) / nullif(stddev_samp(ret), 0) AS rs FROM s GROUP BY ALL), m AS (SELECT pair, k, avg(rs) AS rs FROM r WHERE rs IS NOT NULL GROUP BY ALL)
    SELECT pair, round(greatest(0.0, least(1.0, CASE WHEN count(*) >= 3 THEN regr_slope(ln(rs), ln(k)) ELSE 0.5 END)), 6) AS hurst FROM m GROUP BY pair"""
)
def hurst_exponents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(portfolio.hurst(daily_bars(spark, sf_dir), "pair", "day", "close"))


@query(
    f"""WITH {_BONDS}, w AS (SELECT bond, rating, p_brand AS sector, price / sum(price) OVER (PARTITION BY p_brand) AS weight, coupon_rate, greatest(0.0, (maturity - DATE '2024-01-15') / 365.25::DOUBLE) AS years FROM bond)
    SELECT sector, count(*) AS bonds, round(sum(weight * coupon_rate), 6) AS coupon, round(sum(weight * years), 6) AS years, round(max(weight), 6) AS largest, round(coalesce(sum(weight) FILTER (rating LIKE 'A%'), 0.0), 6) AS a_rated FROM w GROUP BY sector"""
)
def portfolio_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights within a portfolio and weighted sums."""
    b = bond_table(spark, sf_dir).withColumns({"weight": F.col("price") / F.sum("price").over(Window.partitionBy("p_brand")), "years": bonds.years_to(F.col("maturity"), as_of())})
    return rounded(b.groupBy(F.col("p_brand").alias("sector")).agg(F.count("*").alias("bonds"), F.sum(F.col("weight") * F.col("coupon_rate")).alias("coupon"), F.sum(F.col("weight") * F.col("years")).alias("years"), F.max("weight").alias("largest"), F.coalesce(F.sum(F.when(F.col("rating").startswith("A"), F.col("weight"))), F.lit(0.0)).alias("a_rated")))


@query(
    f"""WITH {_BONDS}, c AS (SELECT *, greatest(0.0, (maturity - DATE '2024-01-15') / 365.25::DOUBLE) AS years, bond % 7 / 7.0::DOUBLE AS liq FROM bond), s AS (SELECT p_brand AS desk, 'short' AS leg, bond, coupon_rate, years FROM c WHERE years < 3 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY liq DESC, coupon_rate DESC, bond) = 1), l AS (SELECT p_brand AS desk, 'long' AS leg, bond, coupon_rate, years FROM c WHERE years > 7 QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY coupon_rate DESC, bond) = 1)
    SELECT desk, leg, bond, coupon_rate, round(years, 6) AS years FROM (SELECT * FROM s UNION ALL SELECT * FROM l)"""
)
def barbell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best short and the best long bond of each desk."""
    c = bond_table(spark, sf_dir).select(F.col("p_brand").alias("desk"), "bond", "coupon_rate", bonds.years_to(F.col("maturity"), as_of()).alias("years"), (F.col("bond") % 7 / F.lit(7.0)).alias("liq"))
    best = lambda df, leg, order: top_per_key(df, ["desk"], order, 1).select("desk", F.lit(leg).alias("leg"), "bond", "coupon_rate", F.round("years", 6).alias("years"))
    rate = [F.col("coupon_rate").desc(), F.col("bond").asc()]
    return best(c.where("years < 3"), "short", [F.col("liq").desc(), *rate]).unionByName(best(c.where("years > 7"), "long", rate))
