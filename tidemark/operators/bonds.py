"""Bond arithmetic as column expressions: parsing, cash flows, price, yield, duration, risk, score; curves in one Arrow kernel."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Two-letter months as the exchange writes them (JN is June), rating scores, and Moody's names.
MONTHS = {"JA": 1, "FB": 2, "MR": 3, "AP": 4, "MY": 5, "JN": 6, "JL": 7, "AU": 8, "SP": 9, "OC": 10, "NV": 11, "DC": 12}
RATING_SCORE = {"AAA": 1.0, "AA+": 0.95, "AA": 0.9, "AA-": 0.85, "A+": 0.75, "A": 0.7, "A-": 0.65, "BBB+": 0.55, "BBB": 0.5, "BBB-": 0.4, "BB+": 0.3, "BB": 0.2, "UNRATED": 0.25}
MOODYS = {"Aaa": "AAA", "Aa1": "AA+", "Aa2": "AA", "Aa3": "AA-", "A1": "A+", "A2": "A", "A3": "A-", "Baa1": "BBB+", "Baa2": "BBB", "Baa3": "BBB-", "Ba1": "BB+", "Ba2": "BB"}


def mapped(x: Column, table: dict) -> Column:
    """The table's value for x, else null."""
    return F.create_map(*(F.lit(v) for kv in table.items() for v in kv))[x]


def coupon(description: Column) -> Column:
    """Coupon from a description, as a fraction: the number before FV, or else the first decimal from 2 to 20; outside 0.1 % to 25 %: null."""
    named = F.regexp_extract(description, r"(\d+\.\d+)\s*FV", 1).try_cast("double")
    every = F.transform(F.regexp_extract_all(description, F.lit(r"(\d+\.\d+)"), F.lit(1)), lambda x: x.try_cast("double"))
    c = F.coalesce(named, F.get(F.filter(every, lambda x: (x >= 2) & (x <= 20)), F.lit(0))) / 100
    return F.when((c >= 0.001) & (c <= 0.25), c)


def bond_name(description: Column, symbol: Column, isin: Column) -> Column:
    name = F.trim(F.regexp_replace(description, r"\d+\.\d+\s*FV\s*RS\s*\d+", ""))
    return F.when(name != "", name).otherwise(F.concat(symbol, F.lit(" ("), isin, F.lit(")")))


def date_code(text: Column) -> Column:
    """The date of a code such as 11JN37: day, two-letter month, year (under 50: 20yy); null if it is none."""
    year = F.regexp_extract(text, r"(\d{2})([A-Z]{2})(\d{2})", 3).try_cast("int")
    month = mapped(F.regexp_extract(text, r"(\d{2})([A-Z]{2})(\d{2})", 2), MONTHS)
    day = F.regexp_extract(text, r"(\d{2})([A-Z]{2})(\d{2})", 1)
    return F.try_to_date(F.concat_ws("-", F.when(year < 50, 2000 + year).otherwise(1900 + year).cast("string"), F.lpad(month.cast("string"), 2, "0"), day), "yyyy-MM-dd")


def classify(series: Column, description: Column) -> Column:
    """struct(bond_type, rating, risk_level) by series, or else by words of the description."""
    text = F.upper(description)
    kind = F.when(series.isin("GS", "TB"), "Government").when(series == "SG", "State Government").when(text.contains("GOVERNMENT OF INDIA") | text.contains("GOI"), "Government").when(text.contains("STATE DEVELOPMENT LOAN") | text.contains("SDL"), "State Government").otherwise("Corporate")
    state = kind != "Corporate"
    return F.struct(kind.alias("bond_type"), F.when(state, "AAA").otherwise("A").alias("rating"), F.when(state, "Low").otherwise("Medium").alias("risk_level"))


def years_to(maturity: Column, as_of: Column) -> Column:
    return F.greatest(F.lit(0.0), F.datediff(maturity, as_of) / F.lit(365.25))


def maturity_or_year(maturity: Column, name: Column) -> Column:
    """The maturity, or June 30 of a year 20yy in the name."""
    year = F.regexp_extract(name, r"\b(20\d{2})\b", 1).try_cast("int")
    return F.coalesce(F.try_to_date(maturity, "yyyy-MM-dd"), F.when(year.isNotNull(), F.make_date(year, F.lit(6), F.lit(30))))


def cash_flows(bonds: DataFrame, as_of: Column, frequency: int = 2) -> DataFrame:
    """A row per payment after `as_of`: bonds (face_value, coupon_rate, maturity) with pay_date, years and amount; the last has the face value."""
    every = F.sequence(F.col("maturity"), as_of, F.expr(f"interval -{12 // frequency} months"))
    rows = bonds.where(F.col("maturity") > as_of).withColumn("pay_date", F.explode(every)).where(F.col("pay_date") > as_of)
    amount = F.col("face_value") * F.col("coupon_rate") / frequency + F.when(F.col("pay_date") == F.col("maturity"), F.col("face_value")).otherwise(0.0)
    return rows.withColumns({"years": years_to(F.col("pay_date"), as_of), "amount": amount})


def priced(flows: DataFrame, key: list[str], rate: Column) -> DataFrame:
    """Per key: price, Macaulay and modified duration, convexity and the value of a basis point, at the rate of each flow (under 0: 1 %)."""
    y = F.when(rate > 0, rate).otherwise(0.01)
    pv = F.col("amount") / F.pow(1 + y, F.col("years"))
    g = flows.withColumns({"__y": y, "__pv": pv}).groupBy(*key).agg(F.sum("__pv").alias("price"), F.sum(F.col("years") * F.col("__pv")).alias("t"), F.sum(F.col("years") * (F.col("years") + 1) * F.col("__pv")).alias("t2"), F.max("__y").alias("y"))
    mac = F.col("t") / F.col("price")
    return g.select(*key, "price", mac.alias("duration"), (mac / (1 + F.col("y"))).alias("modified_duration"), (F.col("t2") / (F.col("price") * F.pow(1 + F.col("y"), 2))).alias("convexity"), (mac / (1 + F.col("y")) * F.col("price") * 1e-4).alias("dv01"))


def annuity_price(face: Column, coupon_rate: Column, years: Column, y: Column, frequency: int = 2) -> Column:
    """Price from whole periods: n = int(years * frequency) coupons and the face value."""
    n = F.floor(years * frequency)
    k = face * coupon_rate / frequency
    v = F.pow(1 + y / frequency, -n)
    return F.when(y == 0, k * n + face).otherwise(k * (1 - v) / (y / frequency) + face * v)


def yield_to_maturity(price: Column, face: Column, coupon_rate: Column, years: Column, steps: int = 60) -> Column:
    """The rate in [0, 0.5] at which the annuity price is `price`, by halving; under one period to go: the coupon rate.

    Each step takes an Arrow batch at once: a lambda over the steps would be interpreted for every row.
    """

    @F.arrow_udf("double")
    def halved(price: pa.Array, face: pa.Array, coupon_rate: pa.Array, years: pa.Array) -> pa.Array:
        p, f, c, t = (x.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for x in (price, face, coupon_rate, years))
        known = np.all([x.is_valid().to_numpy(zero_copy_only=False) for x in (price, face, coupon_rate, years)], axis=0)
        n, lo, hi = np.floor(t * 2), np.zeros(len(p)), np.full(len(p), 0.5)
        with np.errstate(all="ignore"):
            for _ in range(steps):
                mid = (lo + hi) / 2
                v = np.power(1 + mid / 2, -n)
                worth = f * c / 2 * (1 - v) / (mid / 2) + f * v
                over = known & ((worth > p) | (np.isnan(worth) & ~np.isnan(p)))  # not a number is the greatest, as in SQL
                lo, hi = np.where(over, mid, lo), np.where(over, hi, mid)
        return pa.array((lo + hi) / 2)

    return F.when(F.floor(years * 2) <= 0, coupon_rate).otherwise(halved(price, face, coupon_rate, years))


def rate_sensitivity(price: Column, duration: Column, convexity: Column, move: float = 0.01) -> Column:
    return -duration * price * move + 0.5 * convexity * price * move * move


def duration_class(duration: Column) -> Column:
    return F.when(duration > 7, "High").when(duration > 4, "Medium").otherwise("Low")


def score(valuation_gap: Column, expected_return: Column, rating: Column, credit_risk: Column, liquidity: Column, weights: tuple[float, ...] = (0.3, 0.3, 0.2, 0.2)) -> Column:
    """struct(valuation, ret, quality, total), each from 0 to 1 and rounded to 4 digits."""
    clip = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    v, r = clip(0.5 - valuation_gap / 10), clip((expected_return + 2) / 5)
    q = 0.6 * F.coalesce(mapped(rating, RATING_SCORE), F.lit(0.5)) + 0.4 * (1 - credit_risk)
    a, b, c, d = weights
    return F.struct(F.round(v, 4).alias("valuation"), F.round(r, 4).alias("ret"), F.round(q, 4).alias("quality"), F.round(a * v + b * r + c * q + d * liquidity, 4).alias("total"))


def signal(expected_return: Column, gap: Column) -> Column:
    s = expected_return - 0.01 * gap
    return F.when(s > 0.10, "STRONG_BUY").when(s > 0.05, "BUY").when(s < -0.05, "SELL").otherwise("HOLD")


def nelson_siegel(t: Column, b0: Column, b1: Column, b2: Column, decay: Column) -> Column:
    x = (1 - F.exp(-decay * t)) / (decay * t)
    return F.when(t <= 0, b0).otherwise(b0 + b1 * x + b2 * (x - F.exp(-decay * t)))


def linear(curve: Column, t: Column) -> Column:
    """Linear interpolation of t on curve: array<struct<m, y>> by m; flat outside."""
    below = F.element_at(F.filter(curve, lambda p: p["m"] <= t), -1)
    above = F.get(F.filter(curve, lambda p: p["m"] >= t), F.lit(0))
    inside = below["y"] + (above["y"] - below["y"]) * F.coalesce(F.try_divide(t - below["m"], above["m"] - below["m"]), F.lit(0.0))
    return F.when(F.size(F.filter(curve, lambda p: p["m"] <= t)) == 0, F.get(curve, F.lit(0))["y"]).when(F.size(F.filter(curve, lambda p: p["m"] >= t)) == 0, F.element_at(curve, -1)["y"]).otherwise(inside)


#: Knots of the longest curve that is searched.
KNOTS = 127


def with_curve_yield(df: DataFrame, ms: str, ys: str, t: str, out: str) -> DataFrame:
    """df with the linear interpolation of t between the knots ms (rising, up to KNOTS) with the yields ys; flat outside.

    The last knot at or before t is found by halving steps, one projection each, so that all of it compiles: a lambda over
    the knots would be interpreted for every row.
    """
    lo = F.col("__lo")
    df = df.withColumn("__lo", F.when(F.size(ms) > KNOTS, F.raise_error(F.lit(f"a curve has over {KNOTS} knots")).cast("int")).otherwise(F.lit(-1)))
    for step in (64, 32, 16, 8, 4, 2, 1):
        df = df.withColumn("__lo", F.when(F.get(ms, lo + step) <= F.col(t), lo + step).otherwise(lo))
    return df.withColumn(out, _between(F.col(ms), F.col(ys), lo, F.col(t))).drop("__lo")


def _between(ms: Column, ys: Column, k: Column, t: Column) -> Column:
    m1, m2, y1, y2 = F.get(ms, k), F.get(ms, k + 1), F.get(ys, k), F.get(ys, k + 1)
    return F.when(k < 0, F.get(ys, F.lit(0))).when(m2.isNull(), y1).otherwise(y1 + (y2 - y1) * (t - m1) / (m2 - m1))


def priced_on_days(trades: DataFrame, bonds: DataFrame, curves: DataFrame, key: list[str], frequency: int = 2) -> DataFrame:
    """trades (key, bond, day) with price: the payments of the bond after the day, discounted on the day's curve.

    bonds has bond, face_value, coupon_rate and maturity; curves a row a day: day, ms and ys, the sorted knots and their
    yields. A day's curve comes to its trades whole, by day, and each payment finds its place in it by halving: trades never
    meet knots, nor days bonds. A yield of 0 or less counts as 1 %. No price where the bond has ended, the day has no curve,
    or the curve under two knots.
    """
    flows = cash_flows(trades.join(bonds, "bond").join(curves.where(F.size("ms") > 1), "day"), F.col("day"), frequency)
    flows = with_curve_yield(flows, "ms", "ys", "years", "y").select(*key, "amount", "years", "y").withColumn("y", F.when(F.col("y") > 0, F.col("y")).otherwise(0.01))
    value = flows.groupBy(*key).agg(F.sum(F.col("amount") / F.pow(1 + F.col("y"), F.col("years"))).alias("price"))
    return trades.join(value, key, "left")


# The bounds of level, slope, curvature and decay, and the weight of the ridge.
LOW, HIGH, DECAYS, RIDGE = np.array([0.0, -0.15, -0.15]), np.array([0.20, 0.15, 0.15]), (0.1, 3.0), 0.01


def box_least_squares(a: np.ndarray, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The minimum of b'ab - 2b'c over the box, for stacks of positive matrices a (..., n, n) and vectors c (..., n).

    Where the free minimum lies outside, each choice of variables on a lower or upper bound is solved for the others; the
    least of those inside the box is the minimum, as the sum is convex.
    """
    n = c.shape[-1]
    b = np.linalg.solve(a, c[..., None])[..., 0]
    out = ((b < low) | (b > high)).any(-1)
    if out.any():
        a, c = a[out], c[out]
        best, least = np.zeros(c.shape), np.full(len(c), np.inf)
        for states in product((0, 1, 2), repeat=n):
            free = [k for k in range(n) if states[k] == 0]
            x = np.broadcast_to(np.array([0.0 if s == 0 else low[k] if s == 1 else high[k] for k, s in enumerate(states)]), c.shape).copy()
            if free:
                rest = c[:, free] - np.einsum("rij,rj->ri", a, x)[:, free]
                x[:, free] = np.linalg.solve(a[:, free][:, :, free], rest[..., None])[..., 0]
            loss = np.einsum("ri,rij,rj->r", x, a, x) - 2 * (x * c).sum(-1)
            loss[((x < low - 1e-12) | (x > high + 1e-12)).any(-1)] = np.inf
            better = loss < least
            best[better], least[better] = x[better], loss[better]
        b[out] = np.clip(best, low, high)
    return b


def nelson_siegel_fit(m: np.ndarray, y: np.ndarray, t: np.ndarray, ridge: float = RIDGE, steps: int = 59, rounds: int = 3) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(b, decay, loss) of the weighted ridge fits of curves (rows of m and y) around each target (rows of t), within bounds.

    For a given decay the model is linear and its best coefficients in the box are exact; decays are a grid, made finer
    around its best point `rounds` times. All curves and targets are one array program.
    """
    w = 1 / (1 + np.abs(m[:, None, :] - t[:, :, None]))
    w = w / w.sum(-1, keepdims=True)
    total = np.einsum("rtk,rk->rt", w, y * y)
    rows, targets = np.arange(len(m))[:, None], np.arange(t.shape[1])[None, :]
    decay = np.broadcast_to(np.linspace(*DECAYS, steps), (*t.shape, steps))
    for k in range(rounds + 1):
        z = decay[..., None] * m[:, None, None, :]
        e = np.exp(-z)
        x = np.stack((np.ones_like(z), (1 - e) / z, (1 - e) / z - e), axis=-1)
        a = np.einsum("rtk,rtgki,rtgkj->rtgij", w, x, x) + np.diag([1e-12, ridge, ridge])
        c = np.einsum("rtk,rtgki,rk->rtgi", w, x, y)
        b = box_least_squares(a, c, LOW, HIGH)
        loss = total[..., None] - 2 * (b * c).sum(-1) + np.einsum("rtgi,rtgij,rtgj->rtg", b, a, b)
        at = loss.argmin(-1)
        best = b[rows, targets, at], decay[rows, targets, at], loss[rows, targets, at]
        half = (DECAYS[1] - DECAYS[0]) / (steps - 1) / 5**k
        decay = np.clip(best[1][..., None] + np.linspace(-half, half, 11), *DECAYS)
    return best


def natural_splines(m: np.ndarray, y: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Natural cubic splines through curves (rows of m and y) at the targets (rows of t); the end cubics continue outside."""
    n, h = m.shape[1], np.diff(m, axis=1)
    a, b = np.zeros((len(m), n, n)), np.zeros(m.shape)
    a[:, 0, 0] = a[:, -1, -1] = 1
    for i in range(1, n - 1):
        a[:, i, i - 1], a[:, i, i], a[:, i, i + 1] = h[:, i - 1], 2 * (h[:, i - 1] + h[:, i]), h[:, i]
        b[:, i] = 3 * ((y[:, i + 1] - y[:, i]) / h[:, i] - (y[:, i] - y[:, i - 1]) / h[:, i - 1])
    c = np.linalg.solve(a, b[..., None])[..., 0]
    i = np.clip((m[:, None, :] < t[:, :, None]).sum(-1) - 1, 0, n - 2)
    at = lambda v, k: np.take_along_axis(v, k, axis=1)
    step, c0, c1, y0, y1 = at(h, i), at(c, i), at(c, i + 1), at(y, i), at(y, i + 1)
    x = t - at(m, i)
    return y0 + ((y1 - y0) / step - step * (2 * c0 + c1) / 3) * x + c0 * x * x + (c1 - c0) / (3 * step) * x**3


def curve_yields(df: DataFrame, maturities: str, yields: str, targets: str) -> DataFrame:
    """df with `curve_yield`: array<double>, for each target 0.4 Nelson-Siegel + 0.4 spline + 0.2 linear (linear alone under a quarter year).

    maturities, yields and targets are array columns of a row, the maturities rising; curves of one or two points are linear.
    Rows of an Arrow batch with equally long curves and targets are fitted together, in blocks of bounded size.
    """
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<double>")
    def kernel(m, y, t):
        import pandas as pd

        out: list = [None] * len(m)
        groups: dict[tuple[int, int], list[int]] = {}
        for k, (a, b, c) in enumerate(zip(m, y, t, strict=True)):
            if a is not None and b is not None and c is not None and len(a):
                groups.setdefault((len(a), len(c)), []).append(k)
        block = {size: max(1, 100_000 // (size[0] * max(1, size[1]))) // 8 + 1 for size in groups}
        for rows in (rows[at : at + block[size]] for size, rows in groups.items() for at in range(0, len(rows), block[size])):
            x = [np.array([v.iloc[k] for k in rows], float) for v in (m, y, t)]
            for k, found in zip(rows, ensemble(*x), strict=True):
                out[k] = found
        return pd.Series(out)

    return df.withColumn("curve_yield", kernel(F.col(maturities), F.col(yields), F.col(targets)))


def ensemble(m: np.ndarray, y: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Combined yields of curves (rows of m and y) at the targets (rows of t)."""
    flat = np.array([np.interp(*x) for x in zip(t, m, y, strict=True)]).reshape(t.shape)
    if m.shape[1] < 3 or not t.shape[1]:
        return flat
    later = np.maximum(t, 1e-9)
    b, decay, _ = nelson_siegel_fit(m, y, later)
    e = np.exp(-decay * later)
    ns = b[..., 0] + b[..., 1] * (1 - e) / (decay * later) + b[..., 2] * ((1 - e) / (decay * later) - e)
    return np.where(t >= 0.25, 0.4 * ns + 0.4 * natural_splines(m, y, later) + 0.2 * flat, flat)


def liquidity_score(bid: Column, ask: Column, volume: Column, widest: float = 2.0, largest: float = 1e9) -> Column:
    """0.6 for a tight spread and 0.4 for volume; 0.3 without quotes."""
    spread = (ask - bid) / ((bid + ask) / 2) * 100
    tight = F.greatest(F.lit(0.0), 1 - spread / widest)
    busy = F.when(F.coalesce(volume, F.lit(0.0)) > 0, F.least(F.lit(1.0), volume / largest)).otherwise(0.3)
    return F.when((bid > 0) & (ask > 0), 0.6 * tight + 0.4 * busy).otherwise(0.3)


def duration_bucket(duration: Column) -> Column:
    return F.when(duration < 1, "ultra_short").when(duration < 3, "short").when(duration < 5, "medium").when(duration < 7, "long").otherwise("ultra_long")


def barbell_weights(target: Column, short: Column, long: Column) -> Column:
    """struct(short, long) of weights that meet a target duration, each from 0 to 1."""
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(target - short, long - short), F.lit(0.5))))
    return F.struct((1 - w).alias("short"), w.alias("long"))


def accrued_interest(face: Column, coupon_rate: Column, next_coupon: Column, as_of: Column) -> Column:
    """Share of a half-year's coupon since the last one, 182 days before the next; a quarter of the annual coupon where that says nothing."""
    since = F.datediff(as_of, F.date_sub(next_coupon, 182))
    half = face * coupon_rate / 2
    return F.when((since > 0) & (since < 182), half * since / 182).otherwise(half / 2)


def carry(coupon_rate: Column, price: Column, funding: Column) -> Column:
    return coupon_rate / (price / 100) - funding


def rolldown(now: Column, ahead: Column, duration: Column) -> Column:
    return duration * (now - ahead)


def confidence(duration: Column, years: Column, yield_change: Column, price_change: Column) -> Column:
    """0.85, less for long durations, long maturities, moving yields and prices, more for short and calm ones; from 0.30 to 0.95."""
    c = (
        F.lit(0.85)
        + F.when(duration > 10, -0.15).when(duration > 7, -0.10).when(duration < 3, 0.05).otherwise(0.0)
        + F.when(years < 1, 0.05).when(years > 15, -0.10).otherwise(0.0)
        + F.when(yield_change > 0.02, -0.15).when(yield_change > 0.01, -0.10).when(yield_change < 0.005, 0.05).otherwise(0.0)
        + F.when(F.abs(price_change) > 0.10, -0.10).otherwise(0.0)
    )
    return F.greatest(F.lit(0.30), F.least(F.lit(0.95), c))


def balance_curve(df: DataFrame, days: str, balances: str, until: int = 30) -> DataFrame:
    """df with `curve`: array<double> of days 1 to `until` on the not-a-knot cubic through (days, balances); null for under four points."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("array<double>")
    def kernel(d, b):
        import pandas as pd

        return pd.Series([None if x is None or len(x) < 4 else not_a_knot(np.asarray(x, float), np.asarray(y, float), np.arange(1.0, until + 1)).tolist() for x, y in zip(d, b, strict=True)])

    return df.withColumn("curve", kernel(F.col(days), F.col(balances)))


def not_a_knot(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The cubic spline whose first two and last two pieces are one cubic each; the end cubics continue outside."""
    n, h = len(x), np.diff(x)
    a, b = np.zeros((n, n)), np.zeros(n)
    for i in range(1, n - 1):
        a[i, i - 1 : i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i] = 6 * ((y[i + 1] - y[i]) / h[i] - (y[i] - y[i - 1]) / h[i - 1])
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]
    a[-1, -3:] = h[-1], -(h[-1] + h[-2]), h[-2]
    m = np.linalg.solve(a, b)
    i = np.clip(np.searchsorted(x, at) - 1, 0, n - 2)
    t = at - x[i]
    slope = (y[i + 1] - y[i]) / h[i] - h[i] * (2 * m[i] + m[i + 1]) / 6
    return y[i] + slope * t + m[i] / 2 * t**2 + (m[i + 1] - m[i]) / (6 * h[i]) * t**3
