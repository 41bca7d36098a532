"""Queries on rules, lookups, scalar functions and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import bonds, cashflow, portfolio
from ..operators.ranking import top_per_key
from ..sources.shared import shared_folder
from ..sources.tables import BARS_SQL, daily_bars, table
from .finance_queries import _BONDS, as_of, bond_table
from .market_queries import transactions
from .registry import query, rounded

#: Days that a period reaches back; YTD and MAX are apart.
PERIODS = {"1D": 1, "1W": 7, "1M": 30, "3M": 90, "1Y": 365}


def cutoff(period: str, today: F.Column) -> F.Column:
    """First day of a period that ends today; an unknown one is a day."""
    if period == "YTD":
        return F.trunc(today, "year")
    if period == "MAX":
        return F.lit("0001-01-01").cast("date")
    return F.date_sub(today, PERIODS.get(period, 1))


@query(
    f"""WITH {BARS_SQL}, p AS (SELECT * FROM (VALUES ('1W', DATE '2001-06-23'), ('3M', DATE '2001-04-01'), ('1Y', DATE '2000-06-30'), ('YTD', DATE '2001-01-01')) t(period, since))
    SELECT pair, period, count(*) AS bars, round(arg_min(close, day), 8) AS first_close, round(arg_max(close, day), 8) AS last_close, round(max(high), 8) AS high, round(min(low), 8) AS low FROM bars JOIN p ON day >= since AND day <= DATE '2001-06-30' GROUP BY ALL"""
)
def period_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of the periods that end on a day: first and last close, high and low."""
    today = F.lit("2001-06-30").cast("date")
    bars = daily_bars(spark, sf_dir).where(F.col("day") <= today)
    named = F.explode(F.array_compact(F.array(*(F.when(F.col("day") >= cutoff(p, today), F.lit(p)) for p in ("1W", "3M", "1Y", "YTD")))))
    g = bars.withColumn("period", named).groupBy("pair", "period").agg(F.count("*").alias("bars"), F.min_by("close", "day").alias("first_close"), F.max_by("close", "day").alias("last_close"), F.max("high").alias("high"), F.min("low").alias("low"))
    return rounded(g, 8)


@query(
    f"""WITH {_BONDS}, m AS (SELECT bond, CASE WHEN bond % 3 = 0 THEN NULL ELSE maturity END AS maturity, p_name || ' ' || (2025 + bond % 30) AS name FROM bond), d AS (SELECT bond, coalesce(maturity, make_date(regexp_extract(name, '\\b(20\\d{{2}})\\b', 1)::INT, 6, 30)) AS until FROM m)
    SELECT bond, until FROM d WHERE until <= DATE '2024-01-15' + 3652 ORDER BY bond"""
)
def maturity_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonds that mature within ten years; without a date, by a year in the name."""
    k = F.col("bond")
    m = bond_table(spark, sf_dir).select("bond", F.when(k % 3 != 0, F.col("maturity").cast("string")).alias("maturity"), F.concat_ws(" ", "p_name", (2025 + k % 30).cast("string")).alias("name"))
    return m.select("bond", bonds.maturity_or_year(F.col("maturity"), F.col("name")).alias("until")).where(F.col("until") <= F.date_add(as_of(), 3652))


@query(
    f"""WITH {_BONDS}, x AS (SELECT bond, face_value, coupon_rate, price, maturity, greatest(0.0, (maturity - DATE '2024-01-15') / 365.25::DOUBLE) AS years, price - 0.1 * (bond % 9) AS bid, price + 0.1 * (bond % 7) AS ask, (bond % 100) * 1e7 AS volume, DATE '2024-02-01' + (bond % 200)::INT AS nxt FROM bond)
    SELECT bond, round(0.6 * greatest(0.0, 1 - (ask - bid) / ((bid + ask) / 2) * 100 / 2) + 0.4 * CASE WHEN volume > 0 THEN least(1.0, volume / 1e9) ELSE 0.3 END, 6) AS liquidity,
      CASE WHEN years < 1 THEN 'ultra_short' WHEN years < 3 THEN 'short' WHEN years < 5 THEN 'medium' WHEN years < 7 THEN 'long' ELSE 'ultra_long' END AS bucket, round(1 - greatest(0.0, least(1.0, (5 - 2) / nullif(years - 2, 0))), 6) + 0.0 AS short_weight,
      round(CASE WHEN DATE '2024-01-15' - (nxt - 182) > 0 AND DATE '2024-01-15' - (nxt - 182) < 182 THEN face_value * coupon_rate / 2 * (DATE '2024-01-15' - (nxt - 182)) / 182 ELSE face_value * coupon_rate / 4 END, 6) AS accrued, round(coupon_rate * 100 / (price / 100) - 5, 6) + 0.0 AS carry,
      round(greatest(0.30, least(0.95, 0.85::DOUBLE + CASE WHEN years > 10 THEN -0.15 WHEN years > 7 THEN -0.10 WHEN years < 3 THEN 0.05 ELSE 0 END + CASE WHEN years < 1 THEN 0.05 WHEN years > 15 THEN -0.10 ELSE 0 END - 0.10 + CASE WHEN abs(price / 100 - 1) > 0.10 THEN -0.10 ELSE 0 END)), 6) AS confidence FROM x"""
)
def bond_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Liquidity, duration bucket, barbell weight, accrued interest, carry and confidence."""
    k = F.col("bond")
    x = bond_table(spark, sf_dir).withColumns({"years": bonds.years_to(F.col("maturity"), as_of()), "bid": F.col("price") - 0.1 * (k % 9), "ask": F.col("price") + 0.1 * (k % 7), "volume": (k % 100) * F.lit(1e7), "nxt": F.date_add(F.lit("2024-02-01").cast("date"), (k % 200).cast("int"))})
    years = F.col("years")
    return rounded(x.select(
        "bond", bonds.liquidity_score(F.col("bid"), F.col("ask"), F.col("volume")).alias("liquidity"), bonds.duration_bucket(years).alias("bucket"), bonds.barbell_weights(F.lit(5.0), F.lit(2.0), years)["short"].alias("short_weight"),
        bonds.accrued_interest(F.col("face_value"), F.col("coupon_rate"), F.col("nxt"), as_of()).alias("accrued"), bonds.carry(F.col("coupon_rate") * 100, F.col("price"), F.lit(5.0)).alias("carry"), bonds.confidence(years, years, F.lit(0.015), F.col("price") / 100 - 1).alias("confidence"),
    ))


@query(
    f"""WITH {BARS_SQL}, r AS (SELECT pair, close / lag(close) OVER (PARTITION BY pair ORDER BY day) - 1 AS ret FROM bars), s AS (SELECT pair, (avg(ret) - 0.04::DOUBLE / 252) / stddev_samp(ret) * sqrt(252) AS sharpe FROM r GROUP BY pair)
    SELECT pair, round(sharpe, 6) AS sharpe, round(greatest(sharpe, 0.0) / nullif(sum(greatest(sharpe, 0.0)) OVER (), 0), 6) AS position_pct, round(greatest(sharpe, 0.0) / nullif(sum(greatest(sharpe, 0.0)) OVER (), 0) * 100000, 4) AS position_value FROM s"""
)
def sharpe_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .finance_queries import returns

    s = portfolio.performance(returns(spark, sf_dir), ["pair"], "day").select("pair", "sharpe")
    a = portfolio.sharpe_allocation(s)
    return rounded(a.withColumn("position_value", F.round("position_value", 4)))


@query(
    f"""WITH {BARS_SQL}, l AS (SELECT pair, arg_max(close, day) AS price, max(day) AS today FROM bars GROUP BY pair), o AS (SELECT pair, arg_min(close, day) AS was_price FROM bars GROUP BY pair), j AS (SELECT l.pair, CASE l.pair WHEN 'A' THEN 'long' WHEN 'N' THEN 'short' ELSE 'flat' END AS direction, price, was_price FROM l JOIN o USING (pair)),
    e AS (SELECT *, CASE WHEN direction = 'flat' THEN NULL WHEN direction = 'long' THEN was_price ELSE price END AS entry FROM j)
    SELECT pair, direction, round(entry, 8) AS entry_price, round(CASE WHEN direction = 'long' THEN price - entry ELSE entry - price END / entry * 100, 6) + 0.0 AS unrealized_pnl_pct, round(entry * CASE WHEN direction = 'long' THEN 0.99::DOUBLE ELSE 1.01::DOUBLE END, 6) AS stop_loss, round(entry * CASE WHEN direction = 'long' THEN 1.02::DOUBLE ELSE 0.98::DOUBLE END, 6) AS take_profit,
      CASE WHEN direction <> 'long' THEN round((price - was_price) / was_price * 100, 6) + 0.0 END AS closed_pnl_pct FROM e"""
)
def position_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held long positions against new targets: kept, turned or closed."""
    bars = daily_bars(spark, sf_dir)
    now = bars.groupBy("pair").agg(F.max_by("close", "day").alias("price"))
    targets = now.select("pair", F.when(F.col("pair") == "A", "long").when(F.col("pair") == "N", "short").otherwise("flat").alias("direction"), "price", F.lit(50.0).alias("strength"))
    held = bars.groupBy("pair").agg(F.lit("long").alias("direction"), F.min_by("close", "day").alias("entry_price"), F.min("day").alias("entry_date"))
    u = portfolio.updated_positions(targets, held, F.lit("2002-01-01").cast("date"))
    return rounded(u.select("pair", "direction", "entry_price", "unrealized_pnl_pct", "stop_loss", "take_profit", "closed_pnl_pct"), exact=("entry_price",))


@query(
    """WITH rec AS (SELECT o_orderkey AS rec, o_custkey AS portfolio, o_orderkey % 20 AS isin, (['BUY', 'SELL', 'SWITCH', 'BUY'])[o_orderkey % 4 + 1] AS action, (o_orderkey % 50)::DOUBLE AS quantity, o_totalprice / 1000 AS price, (o_orderkey % 10) / 10.0::DOUBLE AS risk_score, (o_orderkey % 5)::VARCHAR AS sector FROM orders),
    p AS (SELECT c_custkey AS portfolio, abs(c_acctbal) AS cash, abs(c_acctbal) * 4 AS total FROM customer), h AS (SELECT o_custkey AS portfolio, o_orderkey % 20 AS isin, count(*)::DOUBLE AS held FROM orders WHERE o_orderstatus = 'F' GROUP BY ALL)
    SELECT rec.portfolio, rec.isin, action, CASE WHEN action = 'SELL' AND quantity > held THEN held ELSE quantity END AS quantity, CASE WHEN action = 'BUY' AND quantity * price > cash - total * 0.05 THEN 'cash' WHEN action = 'BUY' AND risk_score > 0.6 THEN 'risk' WHEN action = 'BUY' AND quantity * price / nullif(total + quantity * price, 0) > 0.10 THEN 'position'
      WHEN action = 'BUY' AND 0.25 + coalesce(quantity * price / nullif(total + quantity * price, 0), 0) > 0.30 THEN 'sector' WHEN action IN ('SELL', 'SWITCH') AND held IS NULL THEN 'not held' ELSE '' END AS reason FROM rec JOIN p USING (portfolio) LEFT JOIN h ON h.portfolio = rec.portfolio AND h.isin = rec.isin"""
)
def recommendation_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations against cash, risk, position and sector limits."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rec = o.select(F.col("o_custkey").alias("portfolio"), (k % 20).alias("isin"), F.element_at(F.array(F.lit("BUY"), F.lit("SELL"), F.lit("SWITCH"), F.lit("BUY")), (k % 4 + 1).cast("int")).alias("action"), (k % 50).cast("double").alias("quantity"), (F.col("o_totalprice") / 1000).alias("price"), ((k % 10) / F.lit(10.0)).alias("risk_score"), (k % 5).cast("string").alias("sector"))
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("portfolio"), F.abs("c_acctbal").alias("cash"), (F.abs("c_acctbal") * 4).alias("total_value"))
    h = o.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("portfolio"), (k % 20).alias("isin")).agg(F.count("*").cast("double").alias("held_quantity"))
    s = p.select("portfolio", F.explode(F.array(*(F.lit(str(n)) for n in range(5)))).alias("sector"), F.lit(0.25).alias("exposure"))
    return portfolio.checked(rec, p, h, s)


@query(
    """WITH d AS (SELECT doc_id, text, trim(text) AS t FROM documents WHERE text IS NOT NULL) SELECT doc_id, array_to_string([left(s, 512) FOR s IN ([trim(x) FOR x IN regexp_split_to_array(text, '[.!?]+') IF contains(lower(x), 'the') AND length(trim(x)) > 20])[1:5]], '|') AS found,
      length(trim(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\\S+', '', 'g'), '[^\\p{L}\\p{N}_\\s.,!?:$%-]', '', 'g'), '\\s+', ' ', 'g'))) AS clean_chars FROM d"""
)
def sentence_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences with a word, and cleaned text."""
    t = F.col("text")
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.array_join(tx.sentences_with(t, "the"), "|").alias("found"), F.char_length(tx.clean(t)).cast("long").alias("clean_chars"))


@query(
    """SELECT p_partkey AS part, round((p_partkey % 1000 + 0.5::DOUBLE), 4) AS number, left(upper(p_brand), 3) || '/' || substr(upper(p_brand), 4, 3) AS label, split_part(p_name, ' ', 1) AS company, CASE WHEN p_size % 3 = 0 THEN 'AAA' WHEN p_size % 3 = 1 THEN 'BBB+' END AS rating, '("' || split_part(p_name, ' ', 1) || '" OR "' || p_brand || CASE WHEN p_size % 5 <= 2 THEN '") AND ' ELSE '") OR ' END || 'bonds' AS search,
      CASE WHEN (p_size % 10) / 10.0 >= 0.6 THEN 'Bullish' WHEN (p_size % 10) / 10.0 >= 0.4 THEN 'Neutral' WHEN (p_size % 10) / 10.0 >= 0.2 THEN 'Slightly Bearish' ELSE 'Bearish' END AS mood FROM part"""
)
def scalar_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers with commas, pair labels, name parts, ratings of another agency, boolean queries and labels."""
    k, size = F.col("p_partkey"), F.col("p_size")
    s = (size % 10) / F.lit(10.0)
    first = F.split_part("p_name", F.lit(" "), F.lit(1))
    return table(spark, sf_dir, "part").select(
        k.alias("part"), F.round(tx.number(F.concat(F.format_number((k % 1000).cast("long"), 0), F.lit(".5%"))), 4).alias("number"), tx.pair_label(F.upper("p_brand")).alias("label"), first.alias("company"),
        bonds.mapped(F.when(size % 3 == 0, "Aaa").when(size % 3 == 1, "Baa1").otherwise("?"), bonds.MOODYS).alias("rating"), tx.boolean_query(F.array(first, "p_brand"), F.lit("bonds"), size % 5).alias("search"),
        F.when(s >= 0.6, "Bullish").when(s >= 0.4, "Neutral").when(s >= 0.2, "Slightly Bearish").otherwise("Bearish").alias("mood"),
    )


@query(
    """WITH l AS (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, CAST(embedding[3] AS DOUBLE) AS c FROM embeddings), e AS (SELECT vec_id, exp(a) / (exp(a) + exp(b) + exp(c)) AS p, exp(b) / (exp(a) + exp(b) + exp(c)) AS n, exp(c) / (exp(a) + exp(b) + exp(c)) AS u FROM l)
    SELECT vec_id, CASE WHEN p >= n AND p >= u THEN 'positive' WHEN n >= u THEN 'negative' ELSE 'neutral' END AS label, round(greatest(p, n, u), 5) AS score, round(0.7 * p + 0.3 / 2 * (n + u), 5) AS weighted FROM e"""
)
def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax and label of three logits, and the weighted mean of a text's chunks: the first counts 0.7."""
    x = F.transform(F.slice("embedding", 1, 3), lambda v: F.exp(v.cast("double")))
    total = F.aggregate("x", F.lit(0.0), lambda a, v: a + v)
    e = table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x")).select("vec_id", F.transform("x", lambda v: v / total).alias("p"))
    best = F.array_position("p", F.array_max("p"))
    rest = F.aggregate(F.slice("p", 2, 10), F.lit(0.0), lambda a, v: a + v)
    return rounded(e.select("vec_id", F.element_at(F.array(F.lit("positive"), F.lit("negative"), F.lit("neutral")), best.cast("int")).alias("label"), F.array_max("p").alias("score"), (0.7 * F.col("p")[0] + 0.3 / 2 * rest).alias("weighted")), 5)


#: Desks that every day may meet.
MOST_DESKS = 10_000


@query(
    f"""WITH {_BONDS}, curve AS (SELECT day, y FROM (SELECT CAST(ts AS DATE) AS day, 0.03 + avg(value) / 10000 AS y FROM events WHERE value IS NOT NULL GROUP BY 1)) SELECT day, p_brand AS desk, count(*) AS bonds, round((avg(coupon_rate) - avg(y)) * 10000 + 1e-8, 4) + 0.0 AS spread_bps FROM bond CROSS JOIN curve GROUP BY ALL"""
)
def curve_spreads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day's level against every desk's bonds: desks are aggregated first, so days meet desks and not bonds.

    Means of a few decimals end in exact halves of the last digit; 1e-8 more, here and in the SQL, rounds them alike.
    """
    days = table(spark, sf_dir, "events").where("value is not null").groupBy(F.to_date("ts").alias("day")).agg((0.03 + F.avg("value") / 10000).alias("y"))
    desks = bond_table(spark, sf_dir).groupBy(F.col("p_brand").alias("desk")).agg(F.count("*").alias("bonds"), F.avg("coupon_rate").alias("c"))
    if desks.limit(MOST_DESKS + 1).count() > MOST_DESKS:
        raise ValueError(f"every day meets every desk: over {MOST_DESKS} desks are no dimension")
    out = days.join(F.broadcast(desks.withColumn("one", F.lit(1))), F.lit(1) == F.col("one"))
    return rounded(out.select("day", "desk", "bonds", ((F.col("c") - F.col("y")) * 10000 + 1e-8).alias("spread_bps")), 4)


@query()
def liquidity_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling liquidity features of cash-flow windows and the chance of a stressed state tomorrow, with given parameters."""
    f = cashflow.liquidity_features(cashflow.window_features(transactions(spark, sf_dir)))
    risk = cashflow.state_risk([F.col(n) for n in ("imbalance", "volatility", "intensity")], [(-1, 1), (0, 1), (0, 1)], [0.0, 0.2, 0.5], [0.5, 0.1, 0.2], [[0.5, 0, 0], [0, 0, 0], [-0.5, 1, 1]], [[0.8, 0.15, 0.05], [0.2, 0.6, 0.2], [0.05, 0.25, 0.7]], 2)
    return rounded(f.select(F.to_date("window_end").alias("window_end"), "imbalance", "volatility", "intensity", risk.alias("risk")))


@query()
def balance_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty days of each account's balance through six forecasts, by a spline."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("account"), F.array(*(F.lit(d) for d in (1.0, 3.0, 7.0, 14.0, 21.0, 30.0))).alias("d"), F.array(*(F.col("c_acctbal") * m for m in (1.0, 1.02, 0.97, 1.05, 1.01, 1.1))).alias("b"))
    return rounded(bonds.balance_curve(c, "d", "b").select("account", F.posexplode("curve").alias("at", "balance")), 4)


@query(
    """WITH g AS (SELECT o_custkey AS customer, o_orderpriority AS feature, round(sum(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice ELSE -o_totalprice END), 2) + 0.0 AS effect FROM orders GROUP BY ALL)
    SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY customer ORDER BY abs(effect) DESC, feature) <= 3"""
)
def top_attributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three largest effects of each key by size."""
    signed = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_totalprice")).otherwise(-F.col("o_totalprice"))
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("customer"), F.col("o_orderpriority").alias("feature")).agg((F.round(F.sum(signed), 2) + 0.0).alias("effect"))
    return top_per_key(g, ["customer"], [F.abs("effect").desc(), F.col("feature").asc()], 3)


@query("WITH c AS (SELECT event_id, user_id, ts, value, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS diff FROM events), m AS (SELECT user_id, max(CAST(ts AS DATE)) AS latest FROM c GROUP BY 1) SELECT c.user_id, event_id, round(value, 6) AS value FROM c JOIN m ON c.user_id = m.user_id AND CAST(ts AS DATE) = latest WHERE diff = 1")
def changelog_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insertions of the latest generation of each key in a log of changes."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "value", F.to_date("ts").alias("day"), F.when(F.col("event_type") == "error", -1).otherwise(1).alias("diff"))
    latest = e.groupBy("user_id").agg(F.max("day").alias("latest"))
    return rounded(e.join(latest, "user_id").where("day = latest and diff = 1").select("user_id", "event_id", "value"))


@query(f"WITH {BARS_SQL} SELECT pair, count(*) AS bars, round(sum(volume), 4) AS volume, round(max(high), 6) AS high FROM bars GROUP BY pair")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars written as CSV files by pair and read back with the schema, the pair taken from the file's name."""
    folder = shared_folder(spark, "bars")
    bars = daily_bars(spark, sf_dir).select("pair", "ts_ms", "open", "high", "low", "close", "volume")
    bars.write.partitionBy("pair").option("header", True).csv(folder)
    name = F.regexp_extract(F.col("_metadata.file_path"), r"pair=([^/]+)/", 1)
    from ..sources.tables import OHLCV

    back = spark.read.schema(OHLCV).option("header", True).csv(f"{folder}/*/*.csv").select("*", name.alias("pair"))
    return back.groupBy("pair").agg(F.count("*").alias("bars"), F.round(F.sum("volume"), 4).alias("volume"), F.round(F.max("high"), 6).alias("high"))
