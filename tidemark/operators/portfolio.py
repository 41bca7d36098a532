"""Trades, performance, position sizing and ordered ledgers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

YEAR = 252
RISK_FREE = 0.04


def trade_statistics(pnl: Column) -> list[Column]:
    """Aggregates over trades: counts, win rate, average win and loss, profit factor, gross sums."""
    win, loss = F.when(pnl > 0, pnl), F.when(pnl < 0, pnl)
    return [
        F.count(pnl).alias("trades"), F.count(win).alias("wins"), F.count(loss).alias("losses"), F.try_divide(F.count(win).cast("double"), F.count(pnl)).alias("win_rate"), F.coalesce(F.avg(win), F.lit(0.0)).alias("avg_win"),
        F.coalesce(F.avg(loss), F.lit(0.0)).alias("avg_loss"), F.try_divide(F.sum(win), -F.sum(loss)).alias("profit_factor"), F.sum(pnl).alias("total_pnl"),
    ]


def product(x: Column, w: WindowSpec | None = None) -> Column:
    """The product of x as an aggregate, or over a window; nulls are no factors."""
    over = (lambda a: a.over(w)) if w is not None else (lambda a: a)
    size = F.exp(over(F.sum(F.when(x != 0, F.ln(F.abs(x))))))
    sign = F.when(over(F.count_if(x < 0)) % 2 == 1, -1.0).otherwise(1.0)
    return F.when(over(F.count_if(x == 0)) > 0, 0.0).otherwise(sign * size)


def performance(returns: DataFrame, key: list[str], order: str, ret: str = "ret") -> DataFrame:
    """Per key: annual return, volatility, Sharpe, Sortino, Calmar, worst drawdown, 5 % value at risk and its expected shortfall.

    Null returns are none. Growth is the product of 1 + return also where that is 0 or less; a negative one has no annual return.
    """
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    r = returns.where(F.col(ret).isNotNull())
    r = r.withColumn("__g", product(1 + F.col(ret), w))
    r = r.withColumn("__dd", F.try_divide("__g", F.max("__g").over(w)) - 1)
    down = F.when(F.col(ret) < 0, F.col(ret))
    g = r.groupBy(*key).agg(F.count("*").alias("n"), F.avg(ret).alias("m"), F.stddev_samp(ret).alias("s"), F.stddev_samp(down).alias("d"), F.min("__dd").alias("max_drawdown"), product(1 + F.col(ret)).alias("growth"), F.percentile(ret, 0.05).alias("var_5"))
    tail = returns.select(*(F.col(k).alias(f"__{k}") for k in key), F.col(ret).alias("__r"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    worst = tail.join(g.select(*key, "var_5"), same & (F.col("__r") <= F.col("var_5"))).groupBy(*(f"__{k}" for k in key)).agg(F.avg("__r").alias("shortfall_5"))
    g = g.join(worst, same, "left")
    excess = F.col("m") - RISK_FREE / YEAR
    annual = F.when(F.col("growth") >= 0, F.pow("growth", F.lit(float(YEAR)) / F.col("n")) - 1)
    root = math.sqrt(YEAR)
    return g.select(
        *key, "n", annual.alias("annual_return"), (F.col("s") * root).alias("volatility"), (F.try_divide(excess, F.col("s")) * root).alias("sharpe"), (F.try_divide(excess, F.col("d")) * root).alias("sortino"), F.try_divide(annual, -F.col("max_drawdown")).alias("calmar"), "max_drawdown", "var_5", "shortfall_5",
    )


def strategy_metrics(days: DataFrame, key: list[str], order: str, strategy: str = "strategy", actual: str = "actual", position: str = "position") -> DataFrame:
    """Per key of strategies' and markets' returns and positions: both growths, information ratio, turnover and shares of positions.

    The information ratio is of the yearly excess over the market, 0 without deviation; turnover is the mean change of the
    position, the first one no change. Rows without a return of either are none.
    """
    w = Window.partitionBy(*key).orderBy(order)
    d = days.where(F.col(strategy).isNotNull() & F.col(actual).isNotNull())
    d = d.withColumns({"__x": F.col(strategy) - F.col(actual), "__t": F.coalesce(F.abs(F.col(position) - F.lag(position).over(w)), F.lit(0.0))})
    grown = lambda c: product(1 + F.col(c)) - 1
    share = lambda v: (F.avg((F.signum(position) == v).cast("double")) * 100)
    ratio = F.when(F.stddev_samp("__x") > 0, F.avg("__x") / F.stddev_samp("__x") * math.sqrt(YEAR)).otherwise(0.0)
    return d.groupBy(*key).agg(F.count("*").alias("n"), grown(strategy).alias("total_profit"), grown(actual).alias("buy_and_hold"), ratio.alias("information_ratio"), F.avg("__t").alias("turnover"), share(1).alias("long_pct"), share(-1).alias("short_pct"), share(0).alias("flat_pct"))


def kelly(returns: DataFrame, key: list[str], ret: str = "ret", fraction: float = 0.5, least: float = 0.01, most: float = 0.25) -> DataFrame:
    """Per key: discrete and continuous Kelly fractions, their mean times `fraction` within [least, most]; 0 without wins or losses."""
    r = F.col(ret)
    g = returns.where(r.isNotNull()).groupBy(*key).agg(F.count("*").alias("n"), F.count_if(r > 0).alias("w"), F.count_if(r < 0).alias("l"), F.avg(F.when(r > 0, r)).alias("aw"), F.avg(F.when(r < 0, -r)).alias("al"), F.avg(r).alias("m"), F.var_samp(r).alias("v"))
    p, b = F.col("w") / F.col("n"), F.try_divide("aw", "al")
    discrete = F.greatest(F.try_divide(p * b - (1 - p), b), F.lit(0.0))
    continuous = F.greatest(F.coalesce(F.try_divide("m", "v"), F.lit(0.0)), F.lit(0.0))
    both = (F.col("w") > 0) & (F.col("l") > 0)
    size = F.greatest(F.lit(least), F.least(F.lit(most), (discrete + continuous) / 2 * fraction))
    none = lambda x: F.when(both, x).otherwise(0.0)
    return g.select(*key, p.alias("win_rate"), none(b).alias("payoff_ratio"), none(discrete).alias("kelly_discrete"), none(continuous).alias("kelly_continuous"), none(size).alias("fractional_kelly"))


def volatility_target(volatility: Column, target: float = 0.02, least: float = 0.01, most: float = 0.25) -> Column:
    """Target over daily volatility, within [least, most]."""
    return F.when(volatility == 0, least).otherwise(F.greatest(F.lit(least), F.least(F.lit(most), target / (volatility / math.sqrt(YEAR)))))


def normalised(size: str, key: list[str] | None = None, most: float = 1.0) -> Column:
    """size, scaled down where the sizes of a key sum to over `most`."""
    total = F.sum(size).over(Window.partitionBy(*(key or [F.lit(0)])))
    return F.when(total > most, F.col(size) / total * most).otherwise(F.col(size))


def signals(rows: DataFrame, key: str, order: str, score: str, ret: str, enter: float, leave: float, stop: float) -> DataFrame:
    """rows with position (-1, 0, 1) by key in order: enter over |enter|, leave under |leave|, out when the loss since entry passes `stop`.

    The state depends on the row before, so each key is one ordered fold over its own rows; keys are independent.
    """
    state = "struct<position:int,held:double,out:array<struct<at:bigint,position:int>>>"
    start = F.from_json(F.lit('{"position":0,"held":0.0,"out":[]}'), state)

    def step(a: Column, x: Column) -> Column:
        held = F.when(a["position"] != 0, a["held"] + a["position"] * x["ret"]).otherwise(0.0)
        go = F.when(x["score"] > enter, 1).when(x["score"] < -enter, -1).otherwise(0)
        now = F.when((a["position"] != 0) & (held < -stop), 0).when(a["position"] == 0, go).when(F.abs(x["score"]) < leave, 0).when((go != 0) & (go != a["position"]), go).otherwise(a["position"]).cast("int")
        return F.struct(now.alias("position"), F.when(now == a["position"], held).otherwise(0.0).alias("held"), F.concat(a["out"], F.array(F.struct(x["at"].alias("at"), now.alias("position")))).alias("out"))

    item = F.struct(F.col(order).cast("long").alias("at"), F.coalesce(F.col(score), F.lit(0.0)).alias("score"), F.coalesce(F.col(ret), F.lit(0.0)).alias("ret"))
    folded = rows.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("__x")).select(key, F.explode(F.aggregate("__x", start, step, lambda a: a["out"])).alias("o"))
    return folded.select(key, F.col("o.at").alias(order), F.col("o.position").alias("position"))


def ledger(trades: DataFrame, key: str, order: str, amount: str, cash: float, most: float) -> DataFrame:
    """trades (in order by key) with accepted and the cash left: a trade is taken if it is at most `most` of the start and the free cash covers it."""
    state = "struct<cash:double,out:array<struct<at:bigint,accepted:boolean,cash:double>>>"
    start = F.from_json(F.lit(f'{{"cash":{cash},"out":[]}}'), state)

    def step(a: Column, x: Column) -> Column:
        take = (x["amount"] <= most * cash) & (x["amount"] <= a["cash"])
        left = F.when(take, a["cash"] - x["amount"]).otherwise(a["cash"])
        return F.struct(left.alias("cash"), F.concat(a["out"], F.array(F.struct(x["at"].alias("at"), take.alias("accepted"), left.alias("cash")))).alias("out"))

    item = F.struct(F.col(order).cast("long").alias("at"), F.col(amount).cast("double").alias("amount"))
    out = trades.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("__x")).select(key, F.explode(F.aggregate("__x", start, step, lambda a: a["out"])).alias("o"))
    return out.select(key, F.col("o.at").alias(order), F.col("o.accepted").alias("accepted"), F.col("o.cash").alias("cash"))


def streaks(rows: DataFrame, key: str, order: list[str], x: str) -> DataFrame:
    """(key, sign, length): the latest run of one sign, by the number of sign changes seen from the end."""
    back = Window.partitionBy(key).orderBy(*(F.col(o).desc() for o in order))
    r = rows.withColumn("__s", F.signum(x)).withColumn("__c", F.when(F.col("__s") != F.lag("__s").over(back), 1).otherwise(0))
    r = r.withColumn("__r", F.sum("__c").over(back.rowsBetween(Window.unboundedPreceding, 0))).where("__r = 0")
    return r.groupBy(key).agg(F.max("__s").cast("int").alias("sign"), F.count("*").alias("length"))


def hurst(prices: DataFrame, key: str, order: str, x: str, most: int = 20) -> DataFrame:
    """(key, hurst): the exponent of the rescaled range, within [0, 1]; 0.5 if under three lags have one.

    For each lag from 2 to under min(most, a quarter of the key's rows), whole chunks of so many rows, one after another,
    give the range of the running sum of their changes about the mean, by the changes' standard deviation. The slope of
    the logarithm of the chunks' mean over that of the lag is the exponent. A chunk is one array of under `most` numbers.
    """
    w = Window.partitionBy(key).orderBy(order)
    rows = prices.select(key, F.col(x).alias("x"), (F.row_number().over(w) - 1).alias("i"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    rows = rows.withColumn("lag", F.explode(F.array(*(F.lit(k) for k in range(2, most))))).where("lag < n div 4 and i div lag < n div lag")
    chunks = rows.groupBy(key, "lag", F.expr("i div lag").alias("c")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    chunks = chunks.where("lag > 2").withColumn("r", F.zip_with(F.slice("v", 2, most), F.slice("v", 1, F.size("v") - 1), lambda a, b: a - b))
    chunks = chunks.withColumn("m", F.aggregate("r", F.lit(0.0), lambda a, v: a + v) / F.size("r"))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), F.lit(0.0).alias("q"))

    def step(a: Column, v: Column) -> Column:
        s = a["s"] + (v - F.col("m"))
        return F.struct(s.alias("s"), F.least(a["low"], s).alias("low"), F.greatest(a["high"], s).alias("high"), (a["q"] + (v - F.col("m")) * (v - F.col("m"))).alias("q"))

    chunks = chunks.withColumn("f", F.aggregate("r", start, step)).withColumn("std", F.sqrt(F.col("f.q") / (F.size("r") - 1)))
    lags = chunks.where("std > 0").groupBy(key, "lag").agg(F.avg((F.col("f.high") - F.col("f.low")) / F.col("std")).alias("rs"))
    fit = lags.groupBy(key).agg(F.when(F.count("*") >= 3, F.regr_slope(F.ln("rs"), F.ln("lag"))).alias("h"))
    fit = prices.select(key).distinct().join(fit, key, "left")
    return fit.select(key, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("h", F.lit(0.5)))).alias("hurst"))


def sharpe_allocation(sharpes: DataFrame, key: list[str] | None = None, sharpe: str = "sharpe", capital: float = 100_000.0) -> DataFrame:
    """sharpes with position_pct, in proportion to positive Sharpe ratios, and position_value; none is positive: 0."""
    good = F.greatest(F.coalesce(F.col(sharpe), F.lit(0.0)), F.lit(0.0))
    pct = F.coalesce(F.try_divide(good, F.sum(good).over(Window.partitionBy(*(key or [F.lit(0)])))), F.lit(0.0))
    return sharpes.select("*", pct.alias("position_pct"), (pct * capital).alias("position_value"))


def trade_pnl(side: Column, entry: Column, exit: Column) -> Column:
    """Percent gained by a long or short trade."""
    return F.try_divide(F.when(side == "long", exit - entry).otherwise(entry - exit), entry) * 100


def updated_positions(targets: DataFrame, held: DataFrame, as_of: Column, stop: float = 0.01) -> DataFrame:
    """targets (pair, direction, price, strength) against held (pair, direction, entry_price, entry_date): one row a pair with its state.

    The same direction keeps its entry, another one enters anew at the price; flat after a position closes it. Stops are
    `stop` against the entry, take-profits twice that in favour.
    """
    h = held.select("pair", F.col("direction").alias("was"), F.col("entry_price").alias("was_price"), F.col("entry_date").alias("was_date"))
    j = targets.join(h, "pair", "left")
    flat = F.col("direction") == "flat"
    same = F.col("direction") == F.col("was")
    j = j.withColumns({"entry_price": F.when(flat, None).when(same, F.col("was_price")).otherwise(F.col("price")), "entry_date": F.when(flat, None).when(same, F.col("was_date")).otherwise(as_of)})
    sign = F.when(F.col("direction") == "long", 1).otherwise(-1)
    return j.select(
        "pair", "direction", "entry_price", "entry_date", trade_pnl(F.col("direction"), F.col("entry_price"), F.col("price")).alias("unrealized_pnl_pct"), F.datediff(as_of, "entry_date").alias("days_held"),
        (F.col("entry_price") * (1 - sign * stop)).alias("stop_loss"), (F.col("entry_price") * (1 + sign * 2 * stop)).alias("take_profit"),
        F.when(F.col("strength") < 30, "weak").when(F.col("strength") < 60, "moderate").otherwise("strong").alias("signal_strength"),
        F.when(~same & F.col("was").isNotNull() & (F.col("was") != "flat"), trade_pnl(F.col("was"), F.col("was_price"), F.col("price"))).alias("closed_pnl_pct"),
    )


def checked(recommendations: DataFrame, portfolios: DataFrame, held: DataFrame, sectors: DataFrame, buffer: float = 0.05, single: float = 0.10, sector: float = 0.30, risk: float = 0.6) -> DataFrame:
    """recommendations (portfolio, isin, action, quantity, price, risk_score, sector) with reason: '' or why one is rejected, first rule first.

    portfolios (portfolio, cash, total_value); held (portfolio, isin, held_quantity); sectors (portfolio, sector, exposure).
    All three grow with the portfolios, so none is broadcast: by the size of its files a table of sectors seems small when
    it is not. What the portfolio alone decides is settled first, so that less is sorted for the other two.
    """
    cost = F.col("quantity") * F.col("price")
    buy, away = F.col("action") == "BUY", F.col("action").isin("SELL", "SWITCH")
    weight = F.coalesce(F.try_divide(cost, F.col("total_value") + cost), F.lit(0.0))
    first = F.when(buy & (cost > F.col("cash") - F.col("total_value") * buffer), "cash").when(buy & (F.col("risk_score") > risk), "risk").when(buy & (weight > single), "position")
    j = recommendations.join(portfolios.hint("merge"), "portfolio").select("portfolio", "isin", "action", "quantity", "sector", weight.alias("__weight"), first.alias("__first"))
    j = j.join(held.hint("merge"), ["portfolio", "isin"], "left").join(sectors.hint("merge"), ["portfolio", "sector"], "left")
    over = F.coalesce("exposure", F.lit(0.0)) + F.col("__weight") > sector
    reason = F.when(F.col("__first").isNotNull(), F.col("__first")).when(buy & over, "sector").when(away & F.col("held_quantity").isNull(), "not held").otherwise("")
    return j.select("portfolio", "isin", "action", F.when((F.col("action") == "SELL") & (F.col("quantity") > F.col("held_quantity")), F.col("held_quantity")).otherwise(F.col("quantity")).alias("quantity"), reason.alias("reason"))
