"""Sliding-window cash-flow features, targets and lags, as native aggregates over event-time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeseries import lagged_by_time

TYPES = ("INCOME", "EXPENSE", "WITHDRAWAL")
OPERATIONS = ("DEPOSIT", "WITHDRAWAL", "CARD WITHDRAWAL", "TRANSFER TO ACCOUNT", "TRANSFER FROM ACCOUNT")
#: Column name and value of the symbols; the penalty column counts another spelling.
SYMBOLS = {"PENSION": "PENSION", "INTEREST": "INTEREST", "SIPO PAYMENT": "SIPO PAYMENT", "SERVICES": "SERVICES", "INSURANCE": "INSURANCE", "LOAN": "LOAN", "PENALTY INTEREST": "PENALTY", "UNKNOWN": "UNKNOWN"}


def _sum(kind: str) -> Column:
    return F.coalesce(F.sum(F.when(F.col("type") == kind, F.col("amount"))), F.lit(0.0))


def window_features(transactions: DataFrame, days: int = 7, watermark: str | None = None) -> DataFrame:
    """One row per daily-hopping window of `days` days that has a transaction (ts, seq, type, operation, amount, balance, k_symbol, bank, account, account_id).

    All accounts share a window. With a watermark the same plan runs on a stream. Balances at the end are those of the last
    (ts, seq). Distinct counts skip null and empty text.
    """
    if watermark:
        transactions = transactions.withWatermark("ts", watermark)
    count = lambda c, v: F.count_if(F.col(c) == v)
    distinct = lambda c: F.size(F.collect_set(F.nullif(F.col(c), F.lit("")))).cast("long")
    w = transactions.groupBy(F.window("ts", f"{days} days", "1 day").alias("w")).agg(
        _sum("INCOME").alias("income_amount"), _sum("EXPENSE").alias("expense_amount"), _sum("WITHDRAWAL").alias("withdrawal_amount"),
        F.avg("balance").alias("balance_mean"), F.percentile("balance", 0.5).alias("balance_median"), F.coalesce(F.stddev_samp("balance"), F.lit(0.0)).alias("balance_std"),
        F.max_by("balance", F.struct("ts", "seq")).alias("balance_eod"),
        F.avg("amount").alias("amount_mean"), F.percentile("amount", 0.5).alias("amount_median"), F.coalesce(F.stddev_samp("amount"), F.lit(0.0)).alias("amount_std"), F.min("amount").alias("amount_min"), F.max("amount").alias("amount_max"),
        *(count("type", t).alias(f"type_{t}_count") for t in TYPES), *(count("operation", o).alias(f"operation_{o}_count") for o in OPERATIONS), *(count("k_symbol", v).alias(f"k_symbol_{k}_count") for k, v in SYMBOLS.items()),
        distinct("bank").alias("unique_bank_count"), distinct("account").alias("unique_transfer_account_count"), F.size(F.collect_set("account_id")).cast("long").alias("unique_account_id_count"),
    )
    part = lambda c, n: [F.year(c).alias(f"{n}_year"), F.month(c).alias(f"{n}_month"), F.day(c).alias(f"{n}_day")]
    return w.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *part("w.start", "history_window_start"), *part("w.end", "history_window_end"), *(c for c in w.columns if c != "w"))


def window_targets(transactions: DataFrame, days: int = 7) -> DataFrame:
    """(window_start, window_end, target): income less expense and withdrawal of each window."""
    w = transactions.groupBy(F.window("ts", f"{days} days", "1 day").alias("w")).agg((_sum("INCOME") - _sum("EXPENSE") - _sum("WITHDRAWAL")).alias("target_next_window_cashflow"))
    return w.select(F.col("w.start").alias("target_start"), F.col("w.end").alias("target_end"), "target_next_window_cashflow")


def dataset(transactions: DataFrame, history: int = 7, ahead: int = 7, lags: int = 7, safe: bool = False) -> DataFrame:
    """Features joined with the target of the window that starts where theirs ends, and the targets of earlier windows as lags.

    A lag of k days reaches into the future of its own row by ahead - k days; safe=True starts at k = ahead.
    """
    joined = window_features(transactions, history).join(window_targets(transactions, ahead), F.col("window_end") == F.col("target_start")).drop("target_start", "target_end")
    first = ahead if safe else 1
    return lagged_by_time(joined, "target_next_window_cashflow", "window_end", list(range(first, first + lags)), "target_next_window_cashflow_lag")


def category_by_week(flows: DataFrame, categories: list[str], as_of: Column, weeks: int = 4) -> DataFrame:
    """(category, week_0 ...): sums of amount by category and whole weeks before `as_of`; every category has a row, gaps are 0."""
    week = F.floor(F.datediff(as_of, F.col("day")) / 7).cast("int")
    sums = flows.where(F.col("category").isin(categories)).groupBy("category").pivot("week", list(range(weeks))).sum("amount") if "week" in flows.columns else flows.withColumn("week", week).where(F.col("category").isin(categories)).groupBy("category").pivot("week", list(range(weeks))).sum("amount")
    rows = flows.sparkSession.createDataFrame([(c,) for c in categories], "category string")
    return rows.join(sums, "category", "left").na.fill(0.0).select("category", *(F.col(str(k)).alias(f"week_{k}") for k in range(weeks)))


def daily_balance(ledger: DataFrame) -> DataFrame:
    """(day, opening, closing, net_flow, buffer): first and last balance of a day by (ts, seq); the buffer keeps 4.5 % back."""
    by = F.struct("ts", "seq")
    d = ledger.groupBy(F.to_date("ts").alias("day")).agg(F.min_by("balance", by).alias("opening"), F.max_by("balance", by).alias("closing"))
    return d.select("day", "opening", "closing", (F.col("closing") - F.col("opening")).alias("net_flow"), (F.col("closing") * (1 - 0.045)).alias("buffer"))


def liquidity_features(windows: DataFrame, n: int = 7) -> DataFrame:
    """(window_end, imbalance, volatility, intensity): rolling mean of net flow by volume, ln(1 + its deviation), and share of withdrawals among operations."""
    from pyspark.sql import Window

    from .timeseries import rolling

    w = Window.partitionBy(F.lit(0)).orderBy("window_end")
    out = F.col("expense_amount") + F.col("withdrawal_amount")
    taken = F.col("operation_WITHDRAWAL_count") + F.col("operation_CARD WITHDRAWAL_count")
    raw = windows.select("window_end", ((F.col("income_amount") - out) / (F.col("income_amount") + out + 1e-9)).alias("i"), (taken / (F.col("operation_DEPOSIT_count") + taken + 1e-9)).alias("t"))
    return raw.select("window_end", rolling(F.avg, F.col("i"), w, n).alias("imbalance"), F.log1p(rolling(F.stddev_samp, F.col("i"), w, n)).alias("volatility"), rolling(F.avg, F.col("t"), w, n).alias("intensity"))


def state_risk(features: list[Column], limits: list[tuple[float, float]], means: list[float], scales: list[float], centres: list[list[float]], moves: list[list[float]], risk: int) -> Column:
    """Chance of state `risk` tomorrow: features within limits and scaled, softmax of minus half their squared distance to each state's centre, then one step of `moves`."""
    z = [(F.greatest(F.lit(lo), F.least(F.lit(hi), f)) - m) / s for f, (lo, hi), m, s in zip(features, limits, means, scales, strict=True)]
    weight = []
    for c in centres:
        d = F.lit(0.0)
        for x, y in zip(z, c, strict=True):
            d = d + (x - y) * (x - y)
        weight.append(F.exp(-0.5 * d))
    total, out = sum(weight[1:], weight[0]), F.lit(0.0)
    for w, row in zip(weight, moves, strict=True):
        out = out + w / total * row[risk]
    return out
