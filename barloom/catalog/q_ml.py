"""Learning queries."""

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..operators import attribution as AT
from ..operators import calendar as CAL
from ..operators import factors as FA
from ..operators import ml as L
from ..operators import trees as T
from ..sources import adapters as A
from . import frames as X
from .base import BARS, BRAND_BARS, frame, lagx, over, query, r6, ret_sql, roll, with_
from .q_factors import RES, alpha_signals, log_frames, neutral, positions
from .q_joins import LABEL_SQL, labels
from .q_portfolio import r

FT = L.FEATURES
#: Models are fitted up to the first date and scored from the second on.
TRAIN_END, TEST_START = "1999-12-31", "2000-02-01"
RB = "rb AS (SELECT max(date) AS date FROM bars GROUP BY date_trunc('month', date))"
FEATS = f"""fr0 AS (SELECT *, coalesce({ret_sql()}, 0) AS r FROM bars),
ft AS MATERIALIZED (SELECT ticker, date, close, {ret_sql(21)} AS ret21, {ret_sql(63)} AS ret63, {ret_sql(126)} AS ret126, {ret_sql(252)} AS ret252,
  coalesce(nullif({roll('stddev_samp', 'r', 20)} * sqrt(252.0::double), 0), 0.20::double) AS vol20, coalesce(nullif({roll('stddev_samp', 'r', 60)} * sqrt(252.0::double), 0), 0.20::double) AS vol60,
  close * volume / coalesce(nullif({roll('avg', 'close * volume', 20)}, 0), 1000000) AS turnover_ratio20, close / {roll('avg', 'close', 50)} AS price_to_sma50, close / {roll('avg', 'close', 200)} AS price_to_sma200 FROM fr0),
fm AS MATERIALIZED (SELECT *, ret252 / vol60 AS risk_adj_mom FROM ft WHERE date IN (SELECT date FROM rb))"""


def matrix(s, d):
    """Month ends are read off the lines, which a bar's date is one of."""
    return L.feature_matrix(A.bars(s, d), CAL.month_end_dates(A.priced_lines(s, d)))


def train(s, d):
    """Brands trade on most days, so their month ends carry labels."""
    b = A.brand_bars(s, d)
    return L.feature_matrix(b, CAL.month_end_dates(b)).join(labels(s, d), ["date", "ticker"])


@query("ml01_feature_matrix", with_(BARS, RB, FEATS, body="SELECT date, ticker, " + ", ".join(f"{r6(c)} AS {c}" for c in FT) + " FROM fm"))
def _1(s, d):
    return r(matrix(s, d), *FT)


MED = "md AS MATERIALIZED (SELECT " + ", ".join(f"median({c}) AS {c}" for c in FT) + " FROM fm WHERE date <= date '1999-12-31')"


@query("ml02_median_imputation", with_(BARS, RB, FEATS, MED, body="SELECT date, ticker, " + ", ".join(f"{r6(f'coalesce(fm.{c}, md.{c})')} AS {c}" for c in FT) + " FROM fm, md"))
def _2(s, d):
    from ..sources.scratch import cut
    m = cut(matrix(s, d), "features")
    return r(L.impute(m, L.fit_medians(L.split_by_date(m, TRAIN_END, TEST_START)[0], FT), FT), *FT)


IMP = "im AS MATERIALIZED (SELECT date, ticker, " + ", ".join(f"coalesce(fm.{c}, md.{c}) AS {c}" for c in FT) + " FROM fm, md)"


@query("ml03_standard_scaling", with_(BARS, RB, FEATS, MED, IMP, body="SELECT date, ticker, " + ", ".join(f"{r6(f'(im.{c} - sc_.{c}_m) / sc_.{c}_s', 5)} AS {c}" for c in FT) + " FROM im, (SELECT " + ", ".join(
    f"avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s" for c in FT) + " FROM im WHERE date <= date '1999-12-31') sc_"))
def _3(s, d):
    from ..sources.scratch import cut
    m = cut(matrix(s, d), "features")
    early = lambda df: L.split_by_date(df, TRAIN_END, TEST_START)[0]
    f = cut(L.impute(m, L.fit_medians(early(m), FT), FT), "filled")
    return r(L.scale(f, L.fit_scaler(early(f), FT), FT), *FT, places=5)


def ridge(s, d):
    from ..sources.scratch import cut
    return L.fit_ridge(cut(train(s, d), "train"), FT)


def ridge_sql(cutoffs: str) -> str:
    """Ridge per cut-off by its definition: medians, standardised features, and the normal equations by Gauss steps over a matrix."""
    each = lambda f, sep=", ": sep.join(f(c) for c in FT)
    rows = ", ".join("[" + ", ".join([f"sum({a} * {b})" + (" + 1.0" if a == b else "") for b in FT] + [f"sum({a} * y)"]) + "]" for a in FT)
    return f"""tr AS MATERIALIZED (SELECT fm.*, label FROM fm JOIN labels_ l ON l.date = fm.date AND l.ticker = fm.ticker),
ct AS ({cutoffs}),
ex AS MATERIALIZED (SELECT cutoff, tr.* FROM tr JOIN ct ON tr.date < cutoff),
md AS MATERIALIZED (SELECT cutoff, count(*) AS n, {each(lambda c: f"median({c}) AS {c}")} FROM ex GROUP BY cutoff HAVING count(*) >= 100),
im AS MATERIALIZED (SELECT cutoff, label, {each(lambda c: f"coalesce(ex.{c}, md.{c}) AS {c}")} FROM ex JOIN md USING (cutoff)),
sc_ AS MATERIALIZED (SELECT cutoff, avg(label) AS y_m, {each(lambda c: f"avg({c}) AS {c}_m, CASE WHEN stddev_pop({c}) > 0 THEN stddev_pop({c}) ELSE 1 END AS {c}_s")} FROM im GROUP BY cutoff),
zs AS (SELECT cutoff, label - y_m AS y, {each(lambda c: f"({c} - {c}_m) / {c}_s AS {c}")} FROM im JOIN sc_ USING (cutoff)),
m0 AS (SELECT cutoff, [{rows}] AS m FROM zs GROUP BY cutoff),
gs AS (SELECT cutoff, 1 AS j, m FROM m0 UNION ALL SELECT cutoff, j + 1, list_transform(m, lambda r, i: CASE WHEN i = j THEN list_transform(r, lambda x: x / r[j])
  ELSE list_transform(r, lambda x, c: x - r[j] / m[j][j] * m[j][c]) END) FROM gs WHERE j <= {len(FT)}),
cf AS (SELECT cutoff, unnest([{each(lambda c: f"'{c}'")}]) AS feature, unnest([{", ".join(f"m[{i + 1}][{len(FT) + 1}]" for i in range(len(FT)))}]) AS coef,
  unnest([{each(lambda c: f"{c}_m")}]) AS mean, unnest([{each(lambda c: f"{c}_s")}]) AS scale, unnest([{each(lambda c: f"md.{c}")}]) AS median, y_m, n
  FROM gs JOIN sc_ USING (cutoff) JOIN md USING (cutoff) WHERE j = {len(FT) + 1})"""


@query("ml04_ridge_fit", with_(BRAND_BARS, LABEL_SQL, FEATS, ridge_sql("SELECT DATE '9999-01-01' AS cutoff"), recursive=True, body=f"""SELECT feature, {r6('coef')} AS coef,
  {r6('mean')} AS mean, {r6('scale')} AS scale, {r6('median')} AS median, {r6('y_m')} AS intercept FROM cf"""))
def _4(s, d):
    m = ridge(s, d)
    return m.select(F.explode(F.arrays_zip("features", "coefs", "means", "scales", "medians")).alias("z"), "intercept").select(
        F.col("z.features").alias("feature"), rnd("z.coefs").alias("coef"), rnd("z.means").alias("mean"), rnd("z.scales").alias("scale"),
        rnd("z.medians").alias("median"), rnd("intercept").alias("intercept"))


# A stored model for the scoring query.
STORED = {"coefs": [0.4, -0.2, 0.3, 0.1, -0.5, 0.2, 0.05, 0.6, -0.3, 0.15], "intercept": 0.02,
          "means": [0.01 * i for i in range(10)], "scales": [1.0 + 0.5 * i for i in range(10)], "medians": [0.02 * i for i in range(10)]}


def stored_model(s, d):
    """The stored coefficients carried on the table's own one-row summary."""
    arr = lambda k: F.array(*[F.lit(float(v)) for v in STORED[k]])
    return A.table(s, d, "region").agg(F.count(F.lit(1)).alias("n")).select(
        F.array(*[F.lit(c) for c in FT]).alias("features"), arr("coefs").alias("coefs"), F.lit(STORED["intercept"]).alias("intercept"),
        arr("means").alias("means"), arr("scales").alias("scales"), arr("medians").alias("medians"))


_LIN = "0.02::double + " + " + ".join(
    f"{STORED['coefs'][i]}::double * (coalesce({c}, {STORED['medians'][i]}::double) - {STORED['means'][i]}::double) / {STORED['scales'][i]}::double" for i, c in enumerate(FT))


@query("ml05_score_linear", with_(BARS, RB, FEATS, body=f"SELECT date, ticker, {r6(_LIN)} AS prediction FROM fm"))
def _5(s, d):
    return r(L.score_linear(matrix(s, d), stored_model(s, d), FT), "prediction").select("date", "ticker", "prediction")


@query("ml06_top_predictions", with_(BARS, RB, FEATS, f"sc AS (SELECT date, ticker, {_LIN} AS prediction FROM fm)", body=f"""SELECT date, ticker, rank, {r6('prediction')} AS prediction FROM (
  SELECT *, row_number() OVER (PARTITION BY date ORDER BY prediction DESC, ticker) AS rank FROM sc) WHERE rank <= 5"""))
def _6(s, d):
    return r(L.top_predictions(L.score_linear(matrix(s, d), stored_model(s, d), FT), 5), "prediction").select("date", "ticker", "rank", "prediction")


@query("ml07_expanding_ridge", with_(BRAND_BARS, LABEL_SQL, FEATS, ridge_sql("SELECT DISTINCT date AS cutoff FROM tr"), recursive=True,
    body=f"SELECT cutoff, n, feature, {r6('coef')} AS coef, {r6('y_m')} AS intercept FROM cf"))
def _7(s, d):
    from ..sources.scratch import cut
    t = cut(train(s, d), "train")
    m = L.expanding_ridge(t, t.select("date").distinct(), FT)
    return m.select("cutoff", "n", F.explode(F.arrays_zip("features", "coefs")).alias("z"), rnd("intercept").alias("intercept")).select(
        "cutoff", "n", F.col("z.features").alias("feature"), rnd("z.coefs").alias("coef"), "intercept")


def parts(df):
    """Rows to fit on and later rows to score; written, as both are read several times."""
    from ..sources.scratch import cut
    return L.split_by_date(cut(df, "labelled"), TRAIN_END, TEST_START)


@query("ml08_random_forest")
def _8(s, d):
    fit, later = parts(train(s, d))
    return L.fit_rf_regressor(fit, FT)(later).select("date", "ticker", rnd("prediction").alias("prediction"))


@query("ml09_gradient_boosting")
def _9(s, d):
    fit, later = parts(train(s, d))
    return L.fit_gbt_regressor(fit, FT)(later).select("date", "ticker", rnd("prediction").alias("prediction"))


def reversal(s, d):
    ret, mkt = log_frames(s, d)
    return L.reversal_training_set(neutral(s, d), FA.market_beta(ret, mkt), A.brand_bars(s, d), 1.0)


_W = lambda a, b: f"(PARTITION BY ticker ORDER BY date ROWS BETWEEN {a} AND {b})"
_W5 = _W("4 PRECEDING", "CURRENT ROW")
REV = f"""dx AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS t, count(*) OVER () AS nn FROM (SELECT DISTINCT date FROM fn)),
rv0 AS (SELECT fn.*, t, nn, resid - lag(resid) OVER {over()} AS df FROM fn JOIN dx USING (date)),
rv1 AS MATERIALIZED (SELECT *, sum(resid) OVER {_W5} AS sum5, {roll('avg', 'CASE WHEN df IS NOT NULL THEN greatest(df, 0) END', 14)} AS up, {roll('avg', 'CASE WHEN df IS NOT NULL THEN greatest(-df, 0) END', 14)} AS dn,
  sum(resid) OVER {_W('1 FOLLOWING', '15 FOLLOWING')} AS nx FROM rv0),
rm AS (SELECT date, median(sum5) AS med, stddev_samp(sum5) AS sd FROM rv1 GROUP BY 1),
rq AS (SELECT rv1.date, median(abs(sum5 - med)) AS mad FROM rv1 JOIN rm USING (date) GROUP BY 1),
rz AS (SELECT rv1.*, (sum5 - med) / (1.4826 * CASE WHEN mad <> 0 THEN mad ELSE sd END) AS z FROM rv1 JOIN rm USING (date) JOIN rq USING (date)),
rp AS (SELECT *, coalesce(lag(z, 5) OVER {over()}, 0) AS pz FROM rz),
rb_ AS (SELECT fb.ticker, beta, r2, stddev_samp(resid) AS resid_vol FROM fb JOIN fr USING (ticker) GROUP BY 1, 2, 3),
vr AS (SELECT ticker, date, coalesce(volume / nullif({roll('avg', 'volume', 20)}, 0), 1) AS vol_ratio FROM bars)"""


@query("ml10_reversal_training_set", with_(*RES, REV, body=f"""SELECT rp.ticker, rp.date, {r6('abs(z)')} AS abs_z, {r6('z - pz')} AS z_velocity, {r6('resid_vol')} AS resid_vol, {r6('beta')} AS beta, {r6('r2')} AS r2,
  {r6('coalesce(100.0 - 100.0 / (1.0 + up / (dn + 1e-10::double)), 50.0)', 4)} AS rsi, {r6('vol_ratio')} AS vol_ratio, {r6('sum5')} AS sum5,
  CASE WHEN (z > 0 AND nx < 0) OR (z < 0 AND nx > 0) THEN 1 ELSE 0 END AS label FROM rp JOIN rb_ ON rb_.ticker = rp.ticker JOIN vr ON vr.ticker = rp.ticker AND vr.date = rp.date
  WHERE t >= 25 AND t < nn - 16 AND (t - 25) % 5 = 0 AND abs(z) >= 1.0"""))
def _10(s, d):
    return r(r(reversal(s, d), "abs_z", "z_velocity", "resid_vol", "beta", "r2", "vol_ratio", "sum5"), "rsi", places=4)


@query("ml11_balanced_forest")
def _11(s, d):
    fit, later = parts(reversal(s, d))
    return L.fit_balanced_rf(fit, L.REVERSAL_FEATURES)(later).select("ticker", "date", "label", rnd("confidence").alias("confidence"))


@query("ml12_confidence_gate")
def _12(s, d):
    fit, live = parts(reversal(s, d))
    scored = L.fit_balanced_rf(fit, L.REVERSAL_FEATURES)(live).groupBy("ticker").agg(F.max_by("confidence", "date").alias("confidence"))
    sig = live.groupBy("ticker").agg(F.max_by("abs_z", "date").alias("z")).select("ticker", (F.col("z") * 0.01).alias("position"), F.lit("mean_reversion").alias("signal_type"))
    return L.confidence_gate(sig, scored)


@query("ml13_top_importances")
def _13(s, d):
    t, _ = parts(train(s, d))
    top = L.top_importances(L.fit_rf_regressor(t, FT).model, FT)
    cells = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("feature"), F.lit(v).alias("importance")) for i, (n, v) in enumerate(top, 1)])
    return t.agg(F.count(F.lit(1)).alias("rows")).select("rows", F.inline(cells))


@query("ml14_split_by_date", with_(BARS, RB, FEATS, body="SELECT 'train' AS part, count(*) AS n FROM fm WHERE date <= date '1999-12-31' UNION ALL SELECT 'test', count(*) FROM fm WHERE date >= date '2000-02-01'"))
def _14(s, d):
    a, b = L.split_by_date(matrix(s, d), "1999-12-31", "2000-02-01")
    n = lambda df, p: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(p).alias("part"), "n")
    return n(a, "train").unionByName(n(b, "test"))


@query("ml15_sequence_dataset", with_(BARS, LABEL_SQL, f"""sq AS (SELECT ticker, date, CASE WHEN count(r) OVER {frame(21)} = 21 THEN list(r) OVER {frame(21)} END AS seq FROM (SELECT *, {ret_sql()} AS r FROM bars))""",
    body=f"SELECT sq.ticker, sq.date, {r6('label')} AS label, {r6('seq[1]')} AS oldest, {r6('seq[21]')} AS newest FROM sq JOIN labels_ l ON l.ticker = sq.ticker AND l.date = sq.date WHERE seq IS NOT NULL"))
def _15(s, d):
    q = L.sequence_dataset(A.bars(s, d), labels(s, d, brands=False))
    return q.select("ticker", "date", rnd("label").alias("label"), rnd(F.get("seq", F.lit(0))).alias("oldest"), rnd(F.get("seq", F.lit(20))).alias("newest"))


@query("ml16_compare_models")
def _16(s, d):
    fit, later = parts(train(s, d))
    basket = lambda scored: L.top_predictions(scored, 5).groupBy("date").agg(F.avg("label").alias("ret"))
    out = L.compare_models({
        "ridge": basket(L.score_linear(later, L.fit_ridge(fit, FT), FT)), "forest": basket(L.fit_rf_regressor(fit, FT)(later)),
        "boosting": basket(L.fit_gbt_regressor(fit, FT)(later))})
    return r(out, "final", "cagr", "max_drawdown", "sharpe")


@query("ml17_model_windows", with_(*RES, REV, """wk AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i FROM (SELECT DISTINCT max(date) AS date FROM fn GROUP BY date_trunc('week', date))),
us AS MATERIALIZED (SELECT date, last_value(CASE WHEN i % 52 = 0 THEN date END IGNORE NULLS) OVER (ORDER BY date) AS valid_from FROM wk),
wd AS (SELECT date AS valid_from, greatest(25, t + 1 - 504) AS b, t - 15 AS e FROM dx WHERE date IN (SELECT valid_from FROM us)),
tn AS (SELECT valid_from, count(*) AS n_rows, sum(CASE WHEN (z > 0 AND nx < 0) OR (z < 0 AND nx > 0) THEN 1 ELSE 0 END)::bigint AS n_reverted
  FROM wd JOIN rz ON rz.t >= b AND rz.t < e AND (rz.t - b) % 5 = 0 AND isfinite(z) AND abs(z) >= 2.0 JOIN rb_ ON rb_.ticker = rz.ticker GROUP BY 1)""",
    body="SELECT us.date, us.valid_from, coalesce(n_rows, 0) AS n_rows, coalesce(n_reverted, 0) AS n_reverted FROM us LEFT JOIN tn USING (valid_from)"))
def _17(s, d):
    """Which fit of the reversal classifier each weekly rebalance uses, and the rows that it learns from."""
    from ..sources.scratch import cut
    ret, mkt = log_frames(s, d)
    n = neutral(s, d)
    rows = cut(L.reversal_rows(n, FA.market_beta(ret, mkt), A.brand_bars(s, d)), "reversal-rows")
    used = L.model_dates(CAL.week_end_dates(rows))
    found = L.windowed_training_rows(rows, L.training_windows(used, rows)).groupBy("valid_from").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("n_reverted"))
    return used.join(found, "valid_from", "left").select("date", "valid_from", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("n_reverted", F.lit(0)).alias("n_reverted"))


def agreeing(s, scored, by_nodes, value):
    """Rows of a model's own scores, and whether the node table gives the same to nine places."""
    both = scored.select("date", "ticker", F.col(value).alias("own")).join(by_nodes, ["date", "ticker"])
    return both.select("date", "ticker", (F.abs(F.col("own") - F.col(value)) < 1e-9).alias("agrees"))


LATER = f"SELECT fm.date, fm.ticker, true AS agrees FROM fm JOIN labels_ l ON l.date = fm.date AND l.ticker = fm.ticker WHERE fm.date >= DATE '{TEST_START}'"


@query("ml18_forest_as_table", with_(BRAND_BARS, LABEL_SQL, FEATS, body=LATER))
def _18(s, d):
    fit, later = parts(train(s, d))
    forest = L.fit_rf_regressor(fit, FT)
    return agreeing(s, forest(later), T.score_mean(forest.ready(later), T.node_table(s, forest.model), FT, ["date", "ticker"], 6), "prediction")


@query("ml19_boosting_as_table", with_(BRAND_BARS, LABEL_SQL, FEATS, body=LATER))
def _19(s, d):
    fit, later = parts(train(s, d))
    boosted = L.fit_gbt_regressor(fit, FT)
    return agreeing(s, boosted(later), T.score_sum(boosted.ready(later), T.node_table(s, boosted.model), FT, ["date", "ticker"], 4), "prediction")


@query("ml20_classifier_as_table", with_(*RES, REV, body="""SELECT rp.date, rp.ticker, true AS agrees FROM rp JOIN rb_ ON rb_.ticker = rp.ticker
  WHERE t >= 25 AND t < nn - 16 AND (t - 25) % 5 = 0 AND abs(z) >= 1.0"""))
def _20(s, d):
    """Fitted on all rows and scored on them: what is checked is the table, not the forecast."""
    from ..sources.scratch import cut
    rows = cut(reversal(s, d), "labelled")
    judge = L.fit_balanced_rf(rows, L.REVERSAL_FEATURES)
    filled = rows.fillna(0.0, L.REVERSAL_FEATURES)
    return agreeing(s, judge(rows), T.score_share(filled, T.node_table(s, judge.model), L.REVERSAL_FEATURES, ["date", "ticker"], 5), "confidence")
