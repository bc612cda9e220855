"""Closed forms of the learning operators."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from barloom.operators import ml as L


def data(n=400, k=4, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, k)) * np.array([1.0, 5.0, 0.1, 2.0]) + 3
    x[rng.random((n, k)) < 0.05] = np.nan
    y = np.nan_to_num(x) @ np.array([0.5, -0.2, 3.0, 0.1]) + rng.normal(size=n) * 0.3
    pdf = pd.DataFrame(x, columns=[f"x{i}" for i in range(k)])
    pdf["label"], pdf["date"] = y, pd.to_datetime("2020-01-31") + pd.to_timedelta((np.arange(n) // 40) * 31, "D")
    pdf["date"] = pdf["date"].dt.date
    return pdf


def closed(pdf, cols, alpha=1.0):
    med = pdf[cols].median()
    x = pdf[cols].fillna(med)
    z = (x - x.mean()) / x.std(ddof=0)
    y = pdf.label - pdf.label.mean()
    return np.linalg.solve(z.T @ z + alpha * np.eye(len(cols)), z.T @ y), pdf.label.mean(), med


def frame(spark, pdf):
    import math
    rows = [tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r) for r in pdf.itertuples(index=False, name=None)]
    return spark.createDataFrame(rows, "x0 double, x1 double, x2 double, x3 double, label double, date date")


def test_ridge_equals_closed_form(spark):
    pdf, cols = data(), ["x0", "x1", "x2", "x3"]
    m = L.fit_ridge(frame(spark, pdf), cols).first()
    w, b, med = closed(pdf, cols)
    np.testing.assert_allclose(m.coefs, w, rtol=1e-8)
    np.testing.assert_allclose(m.intercept, b, rtol=1e-10)
    np.testing.assert_allclose(m.medians, med.values, rtol=1e-12)


def test_expanding_ridge_equals_closed_form_per_cutoff(spark):
    pdf, cols = data(), ["x0", "x1", "x2", "x3"]
    df = frame(spark, pdf)
    got = {r.cutoff: r for r in L.expanding_ridge(df, df.select("date"), cols).collect()}
    days = sorted(set(pdf.date))
    assert set(got) == {d for i, d in enumerate(days) if i * 40 >= 100}
    for d, r in got.items():
        w, b, _ = closed(pdf[pdf.date < d], cols)
        np.testing.assert_allclose(r.coefs, w, rtol=1e-7)
        np.testing.assert_allclose(r.intercept, b, rtol=1e-9)


def test_stored_model_scores_like_numpy(spark):
    pdf, cols = data(), ["x0", "x1", "x2", "x3"]
    df = frame(spark, pdf)
    m = L.fit_ridge(df, cols)
    got = [r.prediction for r in L.score_linear(df, m, cols).collect()]
    row = m.first()
    x = pdf[cols].fillna(pd.Series(row.medians, index=cols))
    want = row.intercept + ((x - row.means) / row.scales) @ np.array(row.coefs)
    np.testing.assert_allclose(sorted(got), sorted(want), rtol=1e-9)


def test_expanding_ridge_with_missing_features_equals_a_fit_per_cutoff(spark):
    rng = np.random.default_rng(4)
    rows = [(f"2020-{1 + i // 28:02d}-{1 + i % 28:02d}", f"T{t}", *[float(x) if rng.random() > 0.2 else None for x in rng.normal(size=3)], float(rng.normal()))
            for i in range(60) for t in range(3)]
    df = spark.createDataFrame(rows, "date string, ticker string, a double, b double, c double, label double").withColumn("date", F.to_date("date"))
    cols = ["a", "b", "c"]
    got = {r.cutoff: r for r in L.expanding_ridge(df, df.select("date"), cols, min_rows=100).collect()}
    data = df.toPandas()
    for day in sorted(set(data["date"])):
        part = data[data["date"] < day]
        if len(part) < 100:
            assert day not in got
            continue
        x = part[cols].fillna(part[cols].median())
        z, y = ((x - x.mean()) / x.std(ddof=0)).to_numpy(), part["label"].to_numpy()
        want = np.linalg.solve(z.T @ z + np.eye(3), z.T @ (y - y.mean()))
        assert got[day].n == len(part) and np.allclose(got[day].coefs, want) and np.isclose(got[day].intercept, y.mean())


def _reversal_rows(spark, n_days=620, tickers=12):
    """Stretched rows whose label hangs on z_velocity; the last date is live."""
    rng = np.random.default_rng(9)
    rows = []
    for t in range(n_days):
        for k in range(tickers):
            v = float(rng.normal())
            rows.append((f"T{k:02d}", t, n_days, 2.5, 2.5, v, 0.1, 1.0, 0.5, 50.0, 1.0, 0.0, int(v > 0)))
    df = spark.createDataFrame(rows, "ticker string, t int, n int, z double, abs_z double, z_velocity double, resid_vol double, beta double, r2 double, rsi double, vol_ratio double, sum5 double, label int")
    return df.withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), F.col("t")))


def test_gate_zeroes_weak_reversals_by_the_fit_valid_at_the_date(spark):
    rows = _reversal_rows(spark)
    days = rows.select("date").distinct()
    weekly = days.where(F.dayofweek("date") == 4)
    live = rows.where(F.col("t") == F.col("n") - 1)
    used = {r.date: r.valid_from for r in L.model_dates(weekly.unionByName(live.select("date").distinct()).distinct()).collect()}
    assert len(set(used.values())) == 2 and all(v <= d for d, v in used.items())
    conf = L.walk_forward_confidence(rows, weekly.unionByName(live.select("date").distinct()), live, trees=20)
    got = {r.ticker: r for r in conf.collect()}
    truth = {r.ticker: r.label for r in live.collect()}
    assert {t: r.confidence > 0.55 for t, r in got.items()} == {t: bool(v) for t, v in truth.items()}
    sig = live.select("ticker", F.lit(0.02).alias("position"), F.when(F.col("ticker") == "T00", "pairs_long").otherwise("mean_reversion").alias("signal_type"))
    gated = {r.ticker: r.position for r in L.confidence_gate(sig, conf).collect()}
    assert gated == {t: 0.02 if v or t == "T00" else 0.0 for t, v in truth.items()} and 0.0 in gated.values()


def test_training_windows_end_before_labels_look_behind_the_fit(spark):
    days = spark.range(700).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("date"))
    models = days.where("date IN ('2020-01-20', '2020-03-01', '2021-11-20')").select(F.col("date").alias("valid_from"))
    got = sorted((str(r.valid_from), r.begin, r.stop) for r in L.training_windows(models, days).collect())
    assert got == [("2020-01-20", 25, 4), ("2020-03-01", 25, 45), ("2021-11-20", 186, 674)]
    none = L.walk_forward_confidence(_reversal_rows(spark, 30, 2), days.where("date = '2025-01-01'"), _reversal_rows(spark, 30, 2).where("t = 29"))
    assert {r.confidence for r in none.collect()} == {None}


def test_complete_history_after_filling(spark):
    from barloom.operators.clean import fill_forward
    from barloom.operators.gates import complete_history

    bars = spark.createDataFrame([("A", 1, 10.0), ("A", 4, 13.0), ("B", 2, 5.0), ("B", 3, 6.0), ("C", 1, 1.0)], "ticker string, date int, close double")
    got = sorted(tuple(r) for r in fill_forward(bars).collect())
    assert got == [("A", 1, 10.0), ("A", 2, 10.0), ("A", 3, 10.0), ("A", 4, 13.0), ("B", 2, 5.0), ("B", 3, 6.0), ("B", 4, 6.0), ("C", 1, 1.0), ("C", 2, 1.0), ("C", 3, 1.0), ("C", 4, 1.0)]
    assert {r.ticker for r in complete_history(fill_forward(bars)).collect()} == {"A", "C"}
