"""Models of yields: online regression, elastic net, boosted trees, and recursive forecasts over business days."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FEATURES = ("lag_1_return", "lag_2_return", "body", "range", "avg_body_14", "avg_range_14", "current_close")
MODEL = "maturity bigint, n bigint, intercept double, weights array<double>, means array<double>, vars array<double>, last_day date, last_close double, last array<double>"
FORECAST = "array<struct<day:date,predicted_close:double,predicted_return:double>>"


def samples(levels: DataFrame) -> DataFrame:
    """levels (maturity, day, open, high, low, close) with the features and the next return as the target; one window per maturity."""
    w = Window.partitionBy("maturity").orderBy("day")
    last14 = w.rowsBetween(-13, 0)
    ret = F.try_divide(F.col("close") - F.lag("close").over(w), F.lag("close").over(w))
    df = levels.withColumns({"lag_1_return": ret, "body": F.col("close") - F.col("open"), "range": F.col("high") - F.col("low"), "current_close": F.col("close")})
    return df.withColumns({"lag_2_return": F.lag("lag_1_return").over(w), "avg_body_14": F.avg("body").over(last14), "avg_range_14": F.avg("range").over(last14), "target": F.lead("lag_1_return").over(w)})


def level_samples(levels: DataFrame, most: int = 365) -> DataFrame:
    """samples() of the last `most` days of each maturity with the next close as the target; the first two days, which lack lags, have none."""
    w = Window.partitionBy("maturity")
    last = levels.withColumn("__r", F.row_number().over(w.orderBy(F.desc("day")))).where(F.col("__r") <= most).drop("__r")
    w = w.orderBy("day")
    return samples(last).withColumn("target", F.when(F.row_number().over(w) > 2, F.lead("close").over(w)))


class Online:
    """Running standardisation and linear regression by stochastic gradient: a step of `rate`, weights shrunk by `l2`; the intercept is not shrunk.

    Means and variances take a sample in before it is scaled; a feature without variance counts as 0.
    """

    def __init__(self, size: int = len(FEATURES), rate: float = 0.01, l2: float = 0.001) -> None:
        self.rate, self.l2, self.n, self.bias = rate, l2, 0, 0.0
        self.w, self.mean, self.dev = np.zeros(size), np.zeros(size), np.zeros(size)

    def learn(self, x: np.ndarray, y: float) -> None:
        self.n += 1
        off = x - self.mean
        self.mean = self.mean + off / self.n
        self.dev = self.dev + off * (x - self.mean)
        z = self.scaled(x)
        slope = 2 * (self.bias + z @ self.w - y)
        self.w = self.w - self.rate * (np.clip(slope, -1e12, 1e12) * z + self.l2 * self.w)
        self.bias -= self.rate * slope

    def scaled(self, x: np.ndarray) -> np.ndarray:
        std = np.sqrt(self.dev / max(1, self.n))
        return np.where(std > 0, (x - self.mean) / np.where(std > 0, std, 1), 0.0)


def train_online(rows: DataFrame) -> DataFrame:
    """One MODEL row per maturity of samples(); rows without a target only update the last features. Missing features are 0.

    A maturity is a series of one row a day, so its group is bounded by its history.
    """

    def fit(pdf):
        import pandas as pd

        pdf = pdf.sort_values("day")
        model, x = Online(), pdf[list(FEATURES)].fillna(0.0).to_numpy(float)
        for xi, y in zip(x, pdf["target"], strict=True):
            if y is not None and y == y:
                model.learn(xi, float(y))
        return pd.DataFrame([{"maturity": pdf["maturity"].iloc[0], "n": model.n, "intercept": model.bias, "weights": model.w, "means": model.mean, "vars": model.dev / max(1, model.n), "last_day": pdf["day"].iloc[-1], "last_close": pdf["close"].iloc[-1], "last": x[-1]}])

    return rows.select("maturity", "day", "close", "target", *FEATURES).groupBy("maturity").applyInPandas(fit, MODEL)


def elastic_net(rows: DataFrame, alpha: float = 0.001, ratio: float = 0.5, sweeps: int = 50) -> DataFrame:
    """One MODEL row per maturity: standardised features and `sweeps` rounds of coordinate descent with soft thresholds, on rows with a target."""

    def fit(pdf):
        import pandas as pd

        pdf = pdf.sort_values("day")
        every = pdf[list(FEATURES)].fillna(0.0).to_numpy(float)
        known = pdf["target"].notna().to_numpy()
        x, y = every[known], pdf["target"].to_numpy(float)[known]
        mean, std = (x.mean(0), x.std(0) + 1e-8) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
        z, bias, w = (x - mean) / std, float(y.mean()) if len(y) else 0.0, np.zeros(len(FEATURES))
        rest = y - bias
        for _ in range(sweeps if len(y) else 0):
            for j in range(len(w)):
                rest = rest + z[:, j] * w[j]
                c = float(z[:, j] @ rest) / len(y)
                w[j] = np.sign(c) * max(abs(c) - alpha * ratio, 0.0) / (float(z[:, j] @ z[:, j]) / len(y) + alpha * (1 - ratio) + 1e-12)
                rest = rest - z[:, j] * w[j]
        return pd.DataFrame([{"maturity": pdf["maturity"].iloc[0], "n": len(y), "intercept": bias, "weights": w, "means": mean, "vars": std**2, "last_day": pdf["day"].iloc[-1], "last_close": pdf["close"].iloc[-1], "last": every[-1]}])

    return rows.select("maturity", "day", "close", "target", *FEATURES).groupBy("maturity").applyInPandas(fit, MODEL)


def next_business_day(day: Column) -> Column:
    """The next day that is neither Saturday nor Sunday."""
    return F.date_add(day, F.when(F.weekday(day) == 4, 3).when(F.weekday(day) == 5, 2).otherwise(1))


def forecast(models: DataFrame, days: int = 21, most: float = 0.10) -> DataFrame:
    """(maturity, step, day, predicted_close, predicted_return): each predicted return, within +-most, feeds the next step's lags and level.

    One fold over the steps, native; then the array becomes rows.
    """
    state = f"struct<day:date,close:double,l1:double,l2:double,out:{FORECAST}>"
    start = F.struct(F.col("last_day").alias("day"), F.col("last_close").alias("close"), F.col("last")[0].alias("l1"), F.col("last")[1].alias("l2"), F.expr(f"cast(array() as {FORECAST})").alias("out")).cast(state)

    def step(a: Column, _: Column) -> Column:
        x = F.array(a["l1"], a["l2"], *(F.col("last")[k] for k in range(2, 6)), a["close"])
        scaled = F.transform(F.arrays_zip("weights", "means", "vars", x.alias("x")), lambda p: p["weights"] * F.when(p["vars"] > 0, (p["x"] - p["means"]) / F.sqrt(p["vars"])).otherwise(0.0))
        ret = F.greatest(F.lit(-most), F.least(F.lit(most), F.aggregate(scaled, F.col("intercept"), lambda s, v: s + v)))
        close, day = a["close"] * (1 + ret), next_business_day(a["day"])
        row = F.struct(day.alias("day"), close.alias("predicted_close"), ret.alias("predicted_return"))
        return F.struct(day.alias("day"), close.alias("close"), ret.alias("l1"), a["l1"].alias("l2"), F.concat(a["out"], F.array(row)).alias("out")).cast(state)

    folded = models.select("maturity", F.aggregate(F.sequence(F.lit(1), F.lit(days)), start, step, lambda a: a["out"]).alias("f"))
    return folded.select("maturity", F.posexplode("f").alias("step", "f")).select("maturity", (F.col("step") + 1).cast("long").alias("step"), "f.*")


def forecast_levels(models: DataFrame, days: int = 14, least: int = 30) -> DataFrame:
    """forecast() for models of the next close: the predicted level, not clamped, gives the return that feeds the lags.

    Body and range are the last 14-day means at every step. Models of fewer than `least` samples forecast nothing.
    """
    state = f"struct<day:date,close:double,l1:double,l2:double,out:{FORECAST}>"
    start = F.struct(F.col("last_day").alias("day"), F.col("last_close").alias("close"), F.col("last")[0].alias("l1"), F.col("last")[1].alias("l2"), F.expr(f"cast(array() as {FORECAST})").alias("out")).cast(state)

    def step(a: Column, _: Column) -> Column:
        x = F.array(a["l1"], a["l2"], *(F.col("last")[k] for k in (4, 5, 4, 5)), a["close"])
        scaled = F.transform(F.arrays_zip("weights", "means", "vars", x.alias("x")), lambda p: p["weights"] * F.when(p["vars"] > 0, (p["x"] - p["means"]) / F.sqrt(p["vars"])).otherwise(0.0))
        close, day = F.aggregate(scaled, F.col("intercept"), lambda s, v: s + v), next_business_day(a["day"])
        ret = F.coalesce(F.try_divide(close - a["close"], a["close"]), F.lit(0.0))
        row = F.struct(day.alias("day"), close.alias("predicted_close"), ret.alias("predicted_return"))
        return F.struct(day.alias("day"), close.alias("close"), ret.alias("l1"), a["l1"].alias("l2"), F.concat(a["out"], F.array(row)).alias("out")).cast(state)

    folded = models.where(F.col("n") >= least).select("maturity", F.aggregate(F.sequence(F.lit(1), F.lit(days)), start, step, lambda a: a["out"]).alias("f"))
    return folded.select("maturity", F.posexplode("f").alias("step", "f")).select("maturity", (F.col("step") + 1).cast("long").alias("step"), "f.*")


def boosted_trees(rows: DataFrame, share: float = 0.8, rounds: int = 10, depth: int = 3):
    """(predictions on the last part of each maturity's days, importance by feature) of gradient-boosted trees trained on the first part."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    w = Window.partitionBy("maturity").orderBy("day")
    known = rows.na.drop(subset=["target", *FEATURES]).withColumn("__p", F.percent_rank().over(w))
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(known)
    model = GBTRegressor(labelCol="target", maxIter=rounds, maxDepth=depth, seed=7).fit(data.where(F.col("__p") < share))
    importance = rows.sparkSession.createDataFrame([(f, float(v)) for f, v in zip(FEATURES, model.featureImportances.toArray(), strict=True)], "feature string, importance double")
    return model.transform(data.where(F.col("__p") >= share)).select("maturity", "day", F.col("target").alias("actual"), F.col("prediction").alias("predicted")), importance
