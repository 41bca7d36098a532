"""Checks of recommendations: each rule, and joins that hold no table of portfolios whole in a task."""

from __future__ import annotations

from tidemark.operators import portfolio


def test_rules_and_no_broadcast(spark, tmp_path):
    rec = spark.createDataFrame(
        [(1, 1, "BUY", 60.0, 10.0, 0.1, "a"), (1, 2, "BUY", 1.0, 10.0, 0.9, "a"), (2, 1, "BUY", 20.0, 10.0, 0.1, "a"), (1, 3, "BUY", 8.0, 10.0, 0.1, "a"), (1, 4, "BUY", 8.0, 10.0, 0.1, "b"), (1, 5, "SELL", 9.0, 1.0, 0.1, "b"), (1, 6, "SWITCH", 9.0, 1.0, 0.1, None), (9, 1, "BUY", 1.0, 1.0, 0.0, "a")],
        "portfolio long, isin long, action string, quantity double, price double, risk_score double, sector string",
    )
    portfolios = spark.createDataFrame([(1, 500.0, 1000.0), (2, 900.0, 1000.0)], "portfolio long, cash double, total_value double")
    held = spark.createDataFrame([(1, 5, 4.0)], "portfolio long, isin long, held_quantity double")
    sectors = spark.createDataFrame([(1, "a", 0.25)], "portfolio long, sector string, exposure double")
    for name, df in (("p", portfolios), ("h", held), ("s", sectors)):  # small files, whose size would make Spark broadcast them
        df.write.parquet(f"{tmp_path}/{name}")
    got = portfolio.checked(rec, *(spark.read.parquet(f"{tmp_path}/{name}") for name in "phs"))
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.portfolio, r.isin, r.quantity, r.reason) for r in got.collect()) == [(1, 1, 60.0, "cash"), (1, 2, 1.0, "risk"), (1, 3, 8.0, "sector"), (1, 4, 8.0, ""), (1, 5, 4.0, ""), (1, 6, 9.0, "not held"), (2, 1, 20.0, "position")]
