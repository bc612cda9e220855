"""Tabular learning: features, imputation, scaling, ridge and trees on MLlib, scoring."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import clean_number, div, finite, truthy
from ..functions.orderstats import expanding_quantile, quantiles
from ..functions.windows import lag, rolling, rolling_at
from ..sources.scratch import cut
from .indicators import ret, return_sequence
from .rank import top_n

# The feature list of the ridge screen, in model order.
FEATURES = ["ret21", "ret63", "ret126", "ret252", "vol20", "vol60", "turnover_ratio20",
            "price_to_sma50", "price_to_sma200", "risk_adj_mom"]
# Features of the reversal classifier.
REVERSAL_FEATURES = ["abs_z", "z_velocity", "resid_vol", "beta", "r2", "rsi", "vol_ratio", "sum5"]

MODEL = T.StructType([
    T.StructField("features", T.ArrayType(T.StringType())), T.StructField("coefs", T.ArrayType(T.DoubleType())),
    T.StructField("intercept", T.DoubleType()), T.StructField("means", T.ArrayType(T.DoubleType())),
    T.StructField("scales", T.ArrayType(T.DoubleType())), T.StructField("medians", T.ArrayType(T.DoubleType())),
])


RETURNS = (21, 63, 126, 252)


def _yearly(deviation):
    return clean_number(deviation * F.sqrt(F.lit(252.0)), 0.20, True)


def _turnover_ratio(turnover, mean):
    return turnover / F.coalesce(F.nullif(mean, F.lit(0.0)), F.lit(1e6))


def features(bars: DataFrame) -> DataFrame:
    """Bars with the ten features; one exchange for all windows."""
    df = bars
    for n in RETURNS:
        df = df.withColumn(f"ret{n}", finite(ret(n)))
    df = df.withColumn("_r", F.coalesce(finite(ret(1)), F.lit(0.0)))
    for n in (20, 60):
        df = df.withColumn(f"vol{n}", _yearly(rolling(F.stddev_samp, "_r", n)))
    turnover = F.col("close") * F.col("volume")
    df = df.withColumn("turnover_ratio20", _turnover_ratio(turnover, rolling(F.avg, turnover, 20)))
    for n in (50, 200):
        df = df.withColumn(f"price_to_sma{n}", div("close", rolling(F.avg, "close", n)))
    return df.withColumn("risk_adj_mom", div("ret252", "vol60")).drop("_r")


def feature_matrix(bars: DataFrame, rebalance: DataFrame) -> DataFrame:
    """Features on rebalance dates. Moving frames are worked out on those dates only; the dates are a calendar's, so they travel."""
    due = rebalance.select("date").distinct().withColumn("_due", F.lit(True))
    df = bars.withColumn("_turnover", F.col("close") * F.col("volume")).withColumn("_r", F.coalesce(finite(ret(1)), F.lit(0.0)))
    for n in RETURNS:
        df = df.withColumn(f"ret{n}", finite(ret(n)))
    df = df.join(F.broadcast(due), "date", "left").withColumn("_due", truthy("_due"))
    stats = {f"_sd{n}": ("stddev_samp", "_r", n) for n in (20, 60)}
    stats |= {"_turnover20": ("avg", "_turnover", 20)} | {f"_sma{n}": ("avg", "close", n) for n in (50, 200)}
    df = rolling_at(df, "_due", stats, ["date", "ticker", "close", "_turnover", *[f"ret{n}" for n in RETURNS]])
    for n in (20, 60):
        df = df.withColumn(f"vol{n}", _yearly(F.col(f"_sd{n}")))
    df = df.withColumn("turnover_ratio20", _turnover_ratio(F.col("_turnover"), F.col("_turnover20")))
    for n in (50, 200):
        df = df.withColumn(f"price_to_sma{n}", div("close", f"_sma{n}"))
    return df.withColumn("risk_adj_mom", div("ret252", "vol60")).select("date", "ticker", *FEATURES)


def fit_medians(train: DataFrame, cols: list[str]) -> DataFrame:
    """One row of exact medians."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in cols])
    long = train.select(F.inline(cells))
    med = quantiles(long, ["feature"], "x", {"m": 0.5})
    return med.agg(*[F.max(F.when(F.col("feature") == c, F.col("m"))).alias(c) for c in cols])


def impute(df: DataFrame, medians: DataFrame, cols: list[str]) -> DataFrame:
    m = medians.select(F.struct(*cols).alias("m")).scalar()
    out = df.withColumn("_m", m)
    for c in cols:
        out = out.withColumn(c, F.coalesce(F.col(c), F.col(f"_m.{c}")))
    return out.drop("_m")


def fit_scaler(train: DataFrame, cols: list[str]) -> DataFrame:
    """One row: <col>_mean and <col>_std (population; a constant column scales by 1)."""
    aggs = []
    for c in cols:
        sd = F.stddev_pop(c)
        aggs += [F.avg(c).alias(f"{c}_mean"), F.when(sd > 0, sd).otherwise(1.0).alias(f"{c}_std")]
    return train.agg(*aggs)


def scale(df: DataFrame, params: DataFrame, cols: list[str]) -> DataFrame:
    p = params.select(F.struct(*params.columns).alias("p")).scalar()
    out = df.withColumn("_p", p)
    for c in cols:
        out = out.withColumn(c, (F.col(c) - F.col(f"_p.{c}_mean")) / F.col(f"_p.{c}_std"))
    return out.drop("_p")


def _vector(df: DataFrame, cols: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=cols, outputCol="_x").transform(df)


def fit_ridge(train: DataFrame, cols: list[str], label: str = "label", alpha: float = 1.0) -> DataFrame:
    """Ridge with intercept on imputed and standardised features: a one-row model table.

    MLlib's normal-equation solver minimises the mean squared loss on a
    standardised label, so alpha becomes alpha / n * std(y).
    """
    medians = cut(fit_medians(train, cols), "medians")
    filled = impute(train, medians, cols)
    scaler = cut(fit_scaler(filled, cols), "scaler")
    ready = scale(filled, scaler, cols).select(*cols, F.col(label).alias("_y"))
    stats = ready.agg(F.count("_y").alias("n"), F.stddev_pop("_y").alias("sd")).first()
    model = LinearRegression(
        featuresCol="_x", labelCol="_y", solver="normal", regParam=alpha / stats["n"] * stats["sd"],
        elasticNetParam=0.0, standardization=False,
    ).fit(_vector(ready, cols))
    arr = lambda suffix: F.array(*[F.col(f"{c}{suffix}") for c in cols])
    coefs = F.array(*[F.lit(float(x)) for x in model.coefficients])
    names = F.array(*[F.lit(c) for c in cols])
    params = scaler.withColumn("_med", medians.select(F.struct(*cols).alias("m")).scalar())
    return params.select(
        names.alias("features"), coefs.alias("coefs"), F.lit(float(model.intercept)).alias("intercept"),
        arr("_mean").alias("means"), arr("_std").alias("scales"),
        F.array(*[F.col(f"_med.{c}") for c in cols]).alias("medians"),
    )


def score_linear(df: DataFrame, model: DataFrame, cols: list[str], out: str = "prediction") -> DataFrame:
    """intercept + sum of coef * (coalesce(x, median) - mean) / scale, in the JVM."""
    m = model.select(F.struct("coefs", "intercept", "means", "scales", "medians").alias("m")).scalar()
    rows = df.withColumn("_m", m)
    total = F.col("_m.intercept")
    for i, c in enumerate(cols):
        at = lambda f: F.get(F.col(f"_m.{f}"), F.lit(i))
        total = total + at("coefs") * (F.coalesce(F.col(c), at("medians")) - at("means")) / at("scales")
    return rows.withColumn(out, total).drop("_m")


def top_predictions(scored: DataFrame, n: int, part=("date",)) -> DataFrame:
    return top_n(scored, "prediction", n, part)


def expanding_ridge(train: DataFrame, dates: DataFrame, cols: list[str], label: str = "label",
                    alpha: float = 1.0, min_rows: int = 100) -> DataFrame:
    """A ridge model per cut-off, from the rows before it.

    Rows are summed once, per date and set of missing features, into counts, sums and
    products. Running sums over the calendar give every cut-off its own; the medians (from
    counts per date and value range) stand in for the missing features algebraically: a
    filled feature adds median x count and median x sum. No row meets a cut-off, and what
    is shuffled grows with dates x sets. Each small system is solved on the executors.
    """
    k = len(cols)
    cuts = dates.select("date").distinct().agg(F.array_sort(F.collect_list("date")).alias("a")).scalar()
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in cols])
    med = expanding_quantile(train.select("date", F.inline(cells)), ["feature"], "date", cuts, "x", 0.5, "m")
    wide = med.groupBy("cutoff").agg(F.array(*[F.max(F.when(F.col("feature") == c, F.col("m"))) for c in cols]).alias("medians"))

    missing = sum((F.when(F.col(c).isNull(), 1 << i).otherwise(0) for i, c in enumerate(cols)), F.lit(0))
    z = [F.lit(1.0), *[F.coalesce(F.col(c), F.lit(0.0)) for c in cols], F.col(label)]
    pairs = [(i, j) for i in range(k + 2) for j in range(i, k + 2)]
    names = [f"s_{i}_{j}" for i, j in pairs]
    by_date = train.groupBy("date", missing.alias("missing")).agg(*[F.sum(z[i] * z[j]).alias(n) for (i, j), n in zip(pairs, names)])
    by_date = cut(by_date, "moments").withColumn("asks", F.lit(False))
    asked = by_date.select("missing").distinct().select(F.explode(cuts).alias("date"), "missing", *[F.lit(0.0).alias(n) for n in names], F.lit(True).alias("asks"))
    # A cut-off comes before the rows of its own date.
    so_far = W.partitionBy("missing").orderBy("date", F.desc("asks")).rowsBetween(W.unboundedPreceding, 0)
    moments = by_date.unionByName(asked).select(F.col("date").alias("cutoff"), "missing", "asks", *[F.sum(n).over(so_far).alias(n) for n in names]).where("asks")
    schema = T.StructType([T.StructField("cutoff", T.DateType()), T.StructField("n", T.LongType()), *MODEL.fields])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        g, medians = np.zeros((k + 2, k + 2)), np.array(pdf["medians"].iloc[0], dtype=float)
        for row in pdf.to_dict("records"):
            s = np.zeros((k + 2, k + 2))
            for (i, j), n in zip(pairs, names):
                s[i, j] = s[j, i] = row[n]
            # x = seen + m, where m is the median of a missing feature and 0 else: s + m 1' + 1 m' + n m m' in sums.
            m = np.zeros(k + 2)
            gone = [i for i in range(k) if int(row["missing"]) >> i & 1]
            m[[i + 1 for i in gone]] = medians[gone]
            g += s + np.outer(m, s[0]) + np.outer(s[0], m) + s[0, 0] * np.outer(m, m)
        n = g[0, 0]
        if n < min_rows:
            return pd.DataFrame([], columns=schema.names)
        mean, my = g[0, 1:k + 1] / n, g[0, k + 1] / n
        cov = g[1:k + 1, 1:k + 1] - n * np.outer(mean, mean)
        sd = np.sqrt(np.maximum(np.diag(cov) / n, 0.0))
        sd[sd == 0] = 1.0
        b = (g[1:k + 1, k + 1] - n * mean * my) / sd
        w = np.linalg.solve(cov / np.outer(sd, sd) + alpha * np.eye(k), b)
        return pd.DataFrame([(pdf["cutoff"].iloc[0], int(n), cols, w.tolist(), float(my), mean.tolist(), sd.tolist(), medians.tolist())], columns=schema.names)

    return moments.join(wide, "cutoff").groupBy("cutoff").applyInPandas(solve, schema)


def fit_rf_regressor(train: DataFrame, cols: list[str], label: str = "label", trees: int = 100, depth: int = 6, seed: int = 42):
    """Random forest on imputed features; returns a function that scores a frame."""
    return _fit_trees(RandomForestRegressor(featuresCol="_x", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed), train, cols)


def fit_gbt_regressor(train: DataFrame, cols: list[str], label: str = "label", trees: int = 100, depth: int = 4,
                      rate: float = 0.05, seed: int = 42):
    return _fit_trees(GBTRegressor(featuresCol="_x", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed), train, cols)


def _fit_trees(estimator, train: DataFrame, cols: list[str]):
    medians = cut(fit_medians(train, cols), "medians")
    model = estimator.fit(_vector(cut(impute(train, medians, cols), "train"), cols))

    def ready(df: DataFrame) -> DataFrame:
        return impute(df, medians, cols)

    def score(df: DataFrame) -> DataFrame:
        return model.transform(_vector(ready(df), cols)).drop("_x")

    score.model, score.ready = model, ready
    return score


def reversal_rows(resid: DataFrame, betas: DataFrame, bars: DataFrame, horizon: int = 15) -> DataFrame:
    """Every residual row: place t of its date among n, score z, the eight features, and whether the
    next `horizon` residuals sum to the opposite sign."""
    dates = resid.select("date").distinct()
    t = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("date")) - 1
    idx = dates.select("date", t.alias("t"), F.count(F.lit(1)).over(W.partitionBy(F.lit(0))).alias("n"))
    rows = resid.join(idx, "date")
    w = W.partitionBy("ticker").orderBy("date")
    diff = F.col("resid") - F.lag("resid").over(w)
    up = F.when(diff.isNotNull(), F.greatest(diff, F.lit(0.0)))
    dn = F.when(diff.isNotNull(), F.greatest(-diff, F.lit(0.0)))
    rows = (
        rows.withColumn("sum5", F.sum("resid").over(w.rowsBetween(-4, 0)))
        .withColumn("_up", rolling(F.avg, up, 14)).withColumn("_dn", rolling(F.avg, dn, 14))
        .withColumn("rsi", F.coalesce(100.0 - 100.0 / (1.0 + F.col("_up") / (F.col("_dn") + 1e-10)), F.lit(50.0)))
        .withColumn("_next", F.sum("resid").over(w.rowsBetween(1, horizon)))
    )
    rows = cut(rows.select("ticker", "date", "t", "n", "sum5", "rsi", "_next"), "reversal")
    from .aggregates import median_mad

    mm = median_mad(rows, ["date"], "sum5")
    z = rows.join(mm, "date").withColumn("z", div(F.col("sum5") - F.col("median"), 1.4826 * F.col("mad")))
    z = z.withColumn("_pz", F.coalesce(F.lag("z", 5).over(w), F.lit(0.0)))
    vol = bars.select(
        "ticker", "date", F.coalesce(div("volume", rolling(F.avg, "volume", 20)), F.lit(1.0)).alias("vol_ratio")
    )
    label = truthy((F.col("z") > 0) & (F.col("_next") < 0)) | truthy((F.col("z") < 0) & (F.col("_next") > 0))
    out = z.join(betas.select("ticker", "resid_vol", "beta", "r2"), "ticker").join(vol, ["ticker", "date"], "left")
    return out.select(
        "ticker", "date", "t", "n", "z", F.abs("z").alias("abs_z"), (F.col("z") - F.col("_pz")).alias("z_velocity"), "resid_vol", "beta", "r2",
        "rsi", F.coalesce("vol_ratio", F.lit(1.0)).alias("vol_ratio"), "sum5", label.cast("int").alias("label"),
    )


def reversal_training_set(resid: DataFrame, betas: DataFrame, bars: DataFrame, z_entry: float = 2.0,
                          step: int = 5, horizon: int = 15, start: int = 25, window: int | None = None) -> DataFrame:
    """Every `step`-th date (of the last `window`), stretched names only: eight features and label."""
    begin = F.lit(start) if window is None else F.greatest(F.lit(start), F.col("n") - window)
    picked = reversal_rows(resid, betas, bars, horizon).where(
        (F.col("t") >= begin) & (F.col("t") < F.col("n") - horizon - 1) & ((F.col("t") - begin) % step == 0) & (F.col("abs_z") >= z_entry)
    )
    return picked.select("ticker", "date", *REVERSAL_FEATURES, "label")


# How often the reversal classifier is fitted anew, on how many rows, and when it rejects.
REFIT_EVERY, REFIT_WINDOW, MIN_CONFIDENCE = 52, 504, 0.55


def model_dates(rebalances: DataFrame, every: int = REFIT_EVERY) -> DataFrame:
    """date, valid_from: which fit each rebalance uses. The first rebalance fits, then every `every`-th; a
    date takes the last fit that is not behind it. A calendar, so one partition is small at any data size."""
    w = W.partitionBy(F.lit(0)).orderBy("date")
    numbered = rebalances.select("date").distinct().withColumn("_i", F.row_number().over(w) - 1)
    return numbered.select("date", F.last(F.when(F.col("_i") % every == 0, F.col("date")), ignorenulls=True).over(w).alias("valid_from"))


def training_windows(models: DataFrame, calendar: DataFrame, window: int = REFIT_WINDOW, horizon: int = 15, start: int = 25) -> DataFrame:
    """valid_from, begin, stop: places in the calendar of the rows that a fit may learn from, stop exclusive.

    A label looks `horizon` rows ahead, so the last rows before a fit carry none.
    """
    w = W.partitionBy(F.lit(0)).orderBy("date")
    place = calendar.select("date").distinct().withColumn("t", F.row_number().over(w) - 1)
    fits = models.select(F.col("valid_from").alias("date")).distinct().join(place, "date")
    return fits.select(F.col("date").alias("valid_from"), F.greatest(F.lit(start), F.col("t") + 1 - window).alias("begin"), (F.col("t") - horizon).alias("stop"))


def windowed_training_rows(rows: DataFrame, windows: DataFrame, z_entry: float = 2.0, step: int = 5, window: int = REFIT_WINDOW) -> DataFrame:
    """valid_from and the rows of reversal_rows in its window: stretched names on every `step`-th date.

    Rows meet windows by blocks of `window` dates, of which a window touches two.
    """
    blocks = windows.where(F.col("begin") < F.col("stop")).withColumn(
        "_b", F.explode(F.sequence(F.floor(F.col("begin") / window), F.floor((F.col("stop") - 1) / window))))
    near = rows.where(F.col("abs_z") >= z_entry).withColumn("_b", F.floor(F.col("t") / window))
    inside = (F.col("t") >= F.col("begin")) & (F.col("t") < F.col("stop")) & ((F.col("t") - F.col("begin")) % step == 0)
    return near.join(blocks, "_b").where(inside).drop("_b", "begin", "stop")


def walk_forward_confidence(rows: DataFrame, rebalances: DataFrame, live: DataFrame, z_entry: float = 2.0, min_rows: int = 100,
                            trees: int = 200, depth: int = 5) -> DataFrame:
    """ticker, date, valid_from, confidence of the live rows of reversal_rows, each by the fit valid at its date.

    Only fits that a live row asks for are made, one after the other: their number is bounded by the
    calendar, their rows by the window. Null where no fit is valid or its window holds under min_rows rows.
    """
    used = model_dates(rebalances)
    asked = live.join(used, "date", "left")
    fits = asked.select("valid_from").distinct().where(F.col("valid_from").isNotNull())
    train = cut(windowed_training_rows(rows, training_windows(fits, rows), z_entry), "windows")
    asked = cut(asked.select("ticker", "date", "valid_from", *REVERSAL_FEATURES), "live")
    out = asked.where(F.col("valid_from").isNull()).select("ticker", "date", "valid_from", F.lit(None).cast("double").alias("confidence"))
    for (day,) in fits.orderBy("valid_from").collect():
        score = fit_balanced_rf(train.where(F.col("valid_from") == F.lit(day)), REVERSAL_FEATURES, trees=trees, depth=depth, min_rows=min_rows)
        part = score(asked.where(F.col("valid_from") == F.lit(day)))
        out = out.unionByName(part.select("ticker", "date", "valid_from", "confidence"))
    return out


def fit_balanced_rf(train: DataFrame, cols: list[str], label: str = "label", trees: int = 200, depth: int = 5,
                    min_leaf: int = 10, seed: int = 42, min_rows: int = 100):
    """Random-forest classifier with class weights n / (2 * n_class).

    Below min_rows rows nothing is fitted and every confidence is null.
    """
    if train.limit(min_rows).count() < min_rows:
        def none(df: DataFrame) -> DataFrame:
            return df.withColumn("confidence", F.lit(None).cast("double"))

        none.model = None
        return none
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("_nc"))
    n = train.agg(F.count(F.lit(1)).alias("n")).scalar()
    ready = cut(train.join(counts, label).withColumn("_w", n / (2.0 * F.col("_nc"))).fillna(0.0, cols), "train")
    model = RandomForestClassifier(
        featuresCol="_x", labelCol=label, weightCol="_w", numTrees=trees, maxDepth=depth,
        minInstancesPerNode=min_leaf, seed=seed,
    ).fit(_vector(ready, cols))

    def score(df: DataFrame) -> DataFrame:
        out = model.transform(_vector(df.fillna(0.0, cols), cols))
        return out.withColumn("confidence", vector_to_array("probability")[1]).drop("_x", "rawPrediction", "probability")

    score.model = model
    return score


def confidence_gate(signals: DataFrame, scored: DataFrame, min_conf: float = MIN_CONFIDENCE) -> DataFrame:
    """Mean-reversion positions below the confidence are zeroed; unscored ones stay."""
    j = signals.join(scored.select("ticker", "confidence"), "ticker", "left")
    weak = (F.col("signal_type") == "mean_reversion") & truthy(F.col("confidence") < min_conf)
    return j.withColumn("position", F.when(weak, 0.0).otherwise(F.col("position")))


def top_importances(model, cols: list[str], n: int = 3) -> list[tuple[str, float]]:
    """Largest feature importances of a fitted tree model."""
    pairs = sorted(zip(cols, model.featureImportances.toArray().tolist()), key=lambda p: (-p[1], p[0]))
    return pairs[:n]


def split_by_date(df: DataFrame, train_end, test_start) -> tuple[DataFrame, DataFrame]:
    return (
        df.where(F.col("date") <= F.lit(train_end).cast("date")),
        df.where(F.col("date") >= F.lit(test_start).cast("date")),
    )


def sequence_dataset(bars: DataFrame, labels: DataFrame, n: int = 21) -> DataFrame:
    """Fixed-length return sequences with forward labels."""
    seq = return_sequence(bars, n).where(F.col("seq").isNotNull()).select("ticker", "date", "seq")
    return seq.join(labels, ["ticker", "date"])


def compare_models(results: dict[str, DataFrame], ann: int = 12) -> DataFrame:
    """Strategy metrics per model: results map a name to (date, ret) returns."""
    from .robustness import path_metrics

    out = None
    for name, df in results.items():
        part = df.select(F.lit(name).alias("model"), F.col("date").alias("pos"), "ret")
        out = part if out is None else out.unionByName(part)
    return path_metrics(out, ann, ("model",))
