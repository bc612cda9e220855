"""Factor and position-rule queries."""

from pyspark.sql import functions as F

from ..functions.columns import div, rnd
from ..functions.windows import lag, rolling
from ..operators import factors as FA
from ..operators import gates as G
from ..operators import indicators as I
from ..operators import joins as J
from ..operators import positions as PO
from ..operators import regime as R
from ..sources import adapters as A
from ..sources.scratch import cut
from . import frames as X
from .base import BARS, BRAND_BARS, BRAND_SECTORS, INDEX, SECTORS, frame, key_sql, lagx, over, query, r6, ret_sql, roll, with_
from .q_joins import PAIRS_SQL, filled_bars
from .q_portfolio import r
from .q_regime import SIGNALS_SQL, STATE_SQL, raw_signals

K = lambda c="ticker": F.substring(c, 2, 10).cast("long")
KS = "cast(substring(ticker, 2, 10) AS bigint)"


def log_frames(s, d):
    b = A.brand_bars(s, d)
    ret = I.log_ret(b).select("ticker", "date", F.col("log_ret").alias("ret"))
    idx = R.synthetic_index(b)
    mkt = idx.select("date", F.ln(div("close", lag("close", 1, "index_id"))).alias("mkt"))
    return ret, mkt


def resid(s, d):
    ret, mkt = log_frames(s, d)
    return FA.residuals(ret, mkt, FA.market_beta(ret, mkt))


def neutral(s, d):
    """Sector-neutral residuals, written once: every signal reads them several times."""
    return cut(FA.sector_neutral(resid(s, d), A.brand_sectors(s, d)), "residuals")


RES = (BRAND_BARS, INDEX, BRAND_SECTORS, f"""fj AS MATERIALIZED (SELECT * FROM (SELECT ticker, date, ln(close / {lagx('close')}) AS ret FROM bars)
  JOIN (SELECT date, ln(close / lag(close) OVER (ORDER BY date)) AS mkt FROM idx) USING (date) WHERE ret IS NOT NULL AND mkt IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 252),
fb AS MATERIALIZED (SELECT ticker, regr_intercept(ret, mkt) AS alpha, regr_slope(ret, mkt) AS beta, regr_r2(ret, mkt) AS r2, count(*) AS n FROM fj GROUP BY 1),
fr AS MATERIALIZED (SELECT ticker, date, ret - alpha - beta * mkt AS resid FROM fj JOIN fb USING (ticker)),
fn AS MATERIALIZED (SELECT ticker, date, sector, CASE WHEN m >= 3 THEN resid - avg(resid) OVER (PARTITION BY date, sector) ELSE resid END AS resid
  FROM fr JOIN sectors USING (ticker) JOIN (SELECT sector, count(DISTINCT ticker) AS m FROM fr JOIN sectors USING (ticker) GROUP BY 1) USING (sector))""")
FZ = """ff AS MATERIALIZED (SELECT ticker, sum(resid) AS formation FROM (SELECT * FROM fn QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 5) GROUP BY 1),
fz AS MATERIALIZED (SELECT ticker, formation, (formation - med) / (1.4826 * mad) AS z FROM ff, (SELECT median(formation) AS med FROM ff),
  (SELECT median(abs(formation - (SELECT median(formation) FROM ff))) AS mad FROM ff))"""


@query("fac01_market_beta", with_(*RES, body=f"""SELECT fb.ticker, {r6('alpha', 8)} AS alpha, {r6('beta')} AS beta, {r6('r2')} AS r2, {r6('stddev_samp(resid)')} AS resid_vol, any_value(n) AS n
  FROM fb JOIN fr USING (ticker) GROUP BY fb.ticker, alpha, beta, r2"""))
def _1(s, d):
    return r(r(FA.market_beta(*log_frames(s, d)), "beta", "r2", "resid_vol"), "alpha", places=8)


@query("fac02_residuals", with_(*RES, body=f"SELECT ticker, date, {r6('resid')} AS resid FROM fr"))
def _2(s, d):
    return r(resid(s, d), "resid")


@query("fac03_sector_neutral", with_(*RES, body=f"SELECT ticker, date, sector, {r6('resid')} AS resid FROM fn"))
def _3(s, d):
    return r(neutral(s, d), "resid")


@query("fac04_robust_z", with_(*RES, FZ, body=f"SELECT ticker, {r6('formation')} AS formation, {r6('z')} AS z_score FROM fz"))
def _4(s, d):
    return r(FA.robust_z(neutral(s, d)), "formation", "z_score")


CS = """fv AS (SELECT ticker, 1.0::double / nullif(stddev_samp(resid) * sqrt(252.0::double), 0) AS inv FROM fn GROUP BY 1),
fc AS (SELECT ticker, z, coalesce(inv, (SELECT median(inv) FROM fv)) AS inv FROM fz LEFT JOIN fv USING (ticker)),
cs AS MATERIALIZED (SELECT ticker, z AS z_score, CASE WHEN z > 0.5 THEN -1 WHEN z < -0.5 THEN 1 ELSE 0 END AS raw_alpha,
  CASE WHEN z > 0.5 THEN -1 WHEN z < -0.5 THEN 1 ELSE 0 END * inv / sum(inv) OVER () * count(*) OVER () AS alpha_signal FROM fc)"""


@query("fac05_mean_reversion", with_(*RES, FZ, CS, body=f"SELECT ticker, raw_alpha, {r6('z_score')} AS z_score, {r6('alpha_signal')} AS alpha_signal FROM cs"))
def _5(s, d):
    n = neutral(s, d)
    return r(FA.mean_reversion(FA.robust_z(n), n, 0.5), "z_score", "alpha_signal")


MO = """fm AS (SELECT ticker, sum(CASE WHEN rn >= 22 THEN resid END) AS cum FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM fn)
  WHERE rn <= 252 GROUP BY 1 HAVING count(*) >= 252),
mo AS MATERIALIZED (SELECT ticker, cum, pr, CASE WHEN pr > 0.9 THEN 1 WHEN pr < 0.1 THEN -1 ELSE 0 END AS alpha_signal, (pr - 0.5) * 4 AS z_score
  FROM (SELECT *, rank() OVER (ORDER BY cum) / count(*) OVER ()::double AS pr FROM fm))"""


@query("fac06_residual_momentum", with_(*RES, MO, body=f"SELECT ticker, {r6('cum')} AS cum, {r6('pr')} AS pct_rank, alpha_signal, {r6('z_score')} AS z_score FROM mo"))
def _6(s, d):
    return r(FA.residual_momentum(neutral(s, d)), "cum", "pct_rank", "z_score")


def pairs(s, d):
    return J.pair_series(filled_bars(s, d), A.brand_pairs(s, d))


SPREAD = """ph AS (SELECT pair_id, regr_slope(p1, p2) AS h FROM ps GROUP BY 1),
sd AS MATERIALIZED (SELECT pair_id, any_value(leg1) AS leg1, any_value(leg2) AS leg2, any_value(h) AS h, stddev_samp(p1 - h * p2) AS sd,
  (arg_max(p1 - h * p2, date) - avg(p1 - h * p2)) / stddev_samp(p1 - h * p2) AS z, count(*) AS n FROM ps JOIN ph USING (pair_id) GROUP BY 1)"""


@query("fac07_pair_spread", with_(BRAND_BARS, PAIRS_SQL, SPREAD, body=f"SELECT pair_id, leg1, leg2, {r6('h')} AS hedge_ratio, {r6('sd', 5)} AS spread_std, {r6('z')} AS z, n FROM sd"))
def _7(s, d):
    return r(r(FA.pair_spread(pairs(s, d)), "hedge_ratio", "z"), "spread_std", places=5)


@query("fac08_adf_gate", with_(BRAND_BARS, PAIRS_SQL, """ph AS (SELECT pair_id, regr_slope(p1, p2) AS h, regr_intercept(p1, p2) AS a FROM ps GROUP BY 1),
e0 AS (SELECT pair_id, date, p1 - a - h * p2 AS e FROM ps JOIN ph USING (pair_id)),
e1 AS (SELECT *, lag(e) OVER w AS l, e - lag(e) OVER w AS d FROM e0 WINDOW w AS (PARTITION BY pair_id ORDER BY date)),
e2 AS (SELECT *, lag(d) OVER (PARTITION BY pair_id ORDER BY date) AS q FROM e1),
ss AS (SELECT pair_id, sum(l * l) AS s11, sum(l * q) AS s12, sum(q * q) AS s22, sum(l * d) AS b1, sum(q * d) AS b2, sum(d * d) AS yy, count(*) AS n FROM e2 WHERE q IS NOT NULL GROUP BY 1),
fit AS (SELECT *, (b1 * s22 - b2 * s12) / (s11 * s22 - s12 * s12) AS g, (b2 * s11 - b1 * s12) / (s11 * s22 - s12 * s12) AS c FROM ss)""",
    body=f"""SELECT pair_id, {r6('g / sqrt((yy - g * b1 - c * b2) / (n - 2) * s22 / (s11 * s22 - s12 * s12))')} AS t_stat,
  g / sqrt((yy - g * b1 - c * b2) / (n - 2) * s22 / (s11 * s22 - s12 * s12)) < -3.34 AS cointegrated FROM fit"""))
def _8(s, d):
    return r(FA.adf_gate(pairs(s, d)), "t_stat").select("pair_id", "t_stat", "cointegrated")


PSIG = """pg AS MATERIALIZED (SELECT leg1 AS ticker, -sign(z) * least(abs(z) / 3.0, 1.0) AS alpha_signal, z AS z_score, h AS hedge_ratio, CASE WHEN z < 0 THEN 'pairs_long' ELSE 'pairs_short' END AS signal_type
  FROM sd WHERE abs(z) > 0.5 UNION ALL SELECT leg2, sign(z) * least(abs(z) / 3.0, 1.0) * h, -z, 1.0 / nullif(h, 0), CASE WHEN z < 0 THEN 'pairs_short' ELSE 'pairs_long' END FROM sd WHERE abs(z) > 0.5)"""


@query("fac09_pair_signals", with_(BRAND_BARS, PAIRS_SQL, SPREAD, PSIG, body=f"SELECT ticker, {r6('alpha_signal')} AS alpha_signal, {r6('z_score')} AS z_score, {r6('hedge_ratio', 4)} AS hedge_ratio, signal_type FROM pg"))
def _9(s, d):
    p = FA.pair_signals(FA.pair_spread(pairs(s, d)), 0.5)
    return r(r(p, "alpha_signal", "z_score"), "hedge_ratio", places=4).select("ticker", "alpha_signal", "z_score", "hedge_ratio", "signal_type")


COMB = """cm0 AS (SELECT cs.ticker, cs.alpha_signal AS ca, cs.z_score AS cs_z, coalesce(pg.alpha_signal, 0) AS pa, coalesce(pg.z_score, 0) AS pairs_z, pg.signal_type AS pt,
  coalesce(mo.alpha_signal, 0) AS ma, coalesce(mo.z_score, 0) AS mom_z FROM cs LEFT JOIN pg USING (ticker) LEFT JOIN mo ON mo.ticker = cs.ticker),
cm AS MATERIALIZED (SELECT ticker, 0.40 * (ca - avg(ca) OVER ()) + 0.35 * (pa - avg(pa) OVER ()) + 0.25 * (ma - avg(ma) OVER ()) AS alpha_signal, cs_z, pairs_z, mom_z, pt,
  greatest(abs(cs_z), abs(pairs_z), abs(mom_z)) AS z_score FROM cm0)"""
ALL = (*RES, FZ, CS, MO, PAIRS_SQL, SPREAD, PSIG, COMB)


def combined(s, d):
    n = neutral(s, d)
    return FA.combine(FA.mean_reversion(FA.robust_z(n), n, 0.5), FA.pair_signals(FA.pair_spread(pairs(s, d)), 0.5), FA.residual_momentum(n))


@query("fac10_combine", with_(*ALL, body=f"SELECT ticker, {r6('alpha_signal')} AS alpha_signal, {r6('z_score')} AS z_score FROM cm"))
def _10(s, d):
    return r(combined(s, d), "alpha_signal", "z_score").select("ticker", "alpha_signal", "z_score")


@query("fac11_dominant_type", with_(*ALL, body="SELECT ticker, CASE WHEN abs(pairs_z) > 0.5 THEN pt WHEN abs(mom_z) > 1.5 THEN 'residual_momentum' ELSE 'mean_reversion' END AS signal_type FROM cm"))
def _11(s, d):
    return FA.dominant_type(combined(s, d), 0.5).select("ticker", "signal_type")


SIG2 = SIGNALS_SQL + f""",
sg AS MATERIALIZED (SELECT ticker, position AS alpha_signal, signal_type, coalesce(ret_12m, 0) * 10 AS z_score, ({KS} % 9) / 4.0::double AS beta FROM sig JOIN st USING (ticker)),
sz AS MATERIALIZED (SELECT *, greatest(least(alpha_signal / sum(abs(alpha_signal)) OVER () * 2.0, 0.03), -0.03) AS position FROM sg)"""
S2 = (BARS, STATE_SQL, SIG2)


def alpha_signals(s, d):
    st = G.last_state(A.bars(s, d))
    k = K()
    return st.select(
        "ticker", (F.coalesce("ret_12m", F.lit(0.0)) * 0.1).alias("alpha_signal"),
        F.when(k % 3 == 0, "residual_momentum").otherwise("mean_reversion").alias("signal_type"),
        (F.coalesce("ret_12m", F.lit(0.0)) * 10).alias("z_score"), ((k % 9) / F.lit(4.0)).alias("beta"))


def positions(s, d):
    return FA.size_positions(alpha_signals(s, d))


def betas(s, d):
    return A.table(s, d, "supplier").select(A.ticker_of("s_suppkey").alias("ticker"), ((F.col("s_suppkey") % 9) / F.lit(4.0)).alias("beta"))


@query("fac12_size_positions", with_(*S2, body=f"SELECT ticker, {r6('position')} AS position FROM sz"))
def _12(s, d):
    return r(positions(s, d), "position").select("ticker", "position")


@query("fac13_beta_cap", with_(*S2, "pb AS (SELECT sum(position * beta) AS b FROM sz)", body=f"""SELECT ticker, {r6('position * CASE WHEN abs(b) > 0.05 THEN 0.04 / abs(b) ELSE 1 END')} AS position,
  {r6('b * CASE WHEN abs(b) > 0.05 THEN 0.04 / abs(b) ELSE 1 END')} AS beta_exposure FROM sz, pb"""))
def _13(s, d):
    return r(FA.beta_cap(positions(s, d), betas(s, d)), "position", "beta_exposure").select("ticker", "position", "beta_exposure")


@query("fac14_edge_filter", with_(*S2, body=f"SELECT ticker, {r6('CASE WHEN abs(z_score) * 0.02 > 0.02 THEN position ELSE 0 END')} AS position FROM sz"))
def _14(s, d):
    return r(FA.edge_filter(positions(s, d), 0.005), "position").select("ticker", "position")


@query("fac15_restrict_shorts", with_(*S2, body=f"SELECT ticker, {r6(f'CASE WHEN position < -0.001 AND {KS} % 2 = 1 THEN 0 ELSE position END')} AS position FROM sz"))
def _15(s, d):
    e = A.table(s, d, "supplier").where("s_suppkey % 2 = 0").select(A.ticker_of("s_suppkey").alias("ticker"))
    return r(FA.restrict_shorts(positions(s, d), e), "position").select("ticker", "position")


@query("fac16_sector_limit", with_(*S2, SECTORS, body=f"""SELECT ticker, sector, {r6('position * CASE WHEN abs(n) > 0.05 THEN 0.05 / abs(n) ELSE 1 END')} AS position
  FROM (SELECT *, sum(position) OVER (PARTITION BY sector) AS n FROM sz JOIN sectors USING (ticker))"""))
def _16(s, d):
    return r(FA.sector_limit(positions(s, d), A.sector_map(s, d), 0.05), "position").select("ticker", "sector", "position")


_HOT = f"hot AS (SELECT ticker, max(abs(r)) AS m FROM (SELECT ticker, date, {ret_sql()} AS r FROM bars QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 4) GROUP BY 1)"


@query("fac17_limit_haircut", with_(*S2, _HOT, body=f"""SELECT ticker, {r6('CASE WHEN m > 0.09 THEN position * 0.5 ELSE position END')} AS position,
  CASE WHEN m > 0.09 THEN signal_type || '_circuit_warning' ELSE signal_type END AS signal_type FROM sz JOIN hot USING (ticker)"""))
def _17(s, d):
    return r(FA.limit_haircut(positions(s, d), A.bars(s, d)), "position").select("ticker", "position", "signal_type")


@query("fac18_effective_cost", with_(*S2, body=f"SELECT ticker, {r6('CASE WHEN position < 0 THEN 0.001::double + 0.003::double / 21 ELSE 0.001::double END', 9)} AS effective_cost FROM sz"))
def _18(s, d):
    return r(FA.effective_cost(positions(s, d)), "effective_cost", places=9).select("ticker", "effective_cost")


@query("fac19_vol_liquidity", with_(BARS, f"rr AS (SELECT *, {ret_sql()} AS r, row_number() OVER (PARTITION BY ticker ORDER BY date DESC) AS rn FROM bars)",
    body=f"SELECT ticker, {r6('avg(CASE WHEN rn <= 20 THEN close END) * stddev_samp(r)')} AS liquidity FROM rr GROUP BY 1"))
def _19(s, d):
    return r(FA.vol_liquidity(A.bars(s, d)), "liquidity")


@query("fac20_lot_table", with_(*S2, body=f"""SELECT ticker, {r6('position', 4)} AS position_fraction, {r6('abs(position) * 10000000', 0)} AS notional,
  CASE WHEN {KS} % 4 = 0 THEN 250 ELSE 500 END AS lot_size, CASE WHEN position > 0 THEN 'LONG' ELSE 'SHORT FUTURES' END AS direction FROM sz WHERE abs(position) > 0.001"""))
def _20(s, d):
    lots = A.table(s, d, "supplier").where("s_suppkey % 4 = 0").select(A.ticker_of("s_suppkey").alias("ticker"), F.lit(250).alias("lot_size"))
    return r(FA.lot_table(positions(s, d), lots, 1e7), "position_fraction", places=4).drop("signal_type")


@query("fac21_rupee_liquidity", with_(BARS, body=f"""SELECT ticker, {r6('CASE WHEN count(*) = 20 THEN avg(close * volume) END', 3)} AS liquidity FROM (SELECT * FROM bars WHERE date <= date '2000-06-30'
  QUALIFY row_number() OVER (PARTITION BY ticker ORDER BY date DESC) <= 20) GROUP BY 1"""))
def _21(s, d):
    return r(FA.rupee_liquidity(A.bars(s, d), as_of="2000-06-30"), "liquidity", places=3)


# ---- positions

def book(s, d):
    """Open positions entered at each ticker's first close of 2001."""
    k = K()
    b = A.bars(s, d).where("date >= date'2001-01-01'").groupBy("ticker").agg(
        F.min("date").alias("entry_date"), F.min_by("close", "date").alias("entry_price"))
    kind = (F.when(k % 3 == 0, "mean_reversion").when(k % 3 == 1, F.when(k % 2 == 0, "pairs_long").otherwise("pairs_short"))
            .otherwise("residual_momentum"))
    partner = F.concat(F.lit("S"), F.lpad(F.when(k % 2 == 0, k + 1).otherwise(k - 1).cast("string"), 10, "0"))
    return b.select("ticker", kind.alias("signal_type"), F.when(k % 2 == 0, 1).otherwise(-1).alias("direction"), "entry_date", "entry_price",
                    (F.lit(2.0) - (k % 5)).alias("entry_z"), F.lit(0.02).alias("size"), F.when(k % 3 == 1, partner).alias("pair_partner"), (k % 40).cast("int").alias("days_held"))


BOOK_SQL = f"""bk AS MATERIALIZED (SELECT ticker, k, CASE WHEN k % 3 = 0 THEN 'mean_reversion' WHEN k % 3 = 1 THEN CASE WHEN k % 2 = 0 THEN 'pairs_long' ELSE 'pairs_short' END ELSE 'residual_momentum' END AS signal_type,
  CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END AS direction, entry_date, entry_price, 2.0::double - k % 5 AS entry_z, 0.02::double AS size,
  CASE WHEN k % 3 = 1 THEN 'S' || lpad(cast(CASE WHEN k % 2 = 0 THEN k + 1 ELSE k - 1 END AS varchar), 10, '0') END AS pair_partner, cast(k % 40 AS int) AS days_held
  FROM (SELECT ticker, {KS} AS k, min(date) AS entry_date, arg_min(close, date) AS entry_price FROM bars WHERE date >= date '2001-01-01' GROUP BY 1)),
lt AS MATERIALIZED (SELECT ticker, max(date) AS date, arg_max(close, date) AS price FROM bars GROUP BY 1)"""


def last_prices(s, d):
    return A.bars(s, d).groupBy("ticker").agg(F.max("date").alias("date"), F.max_by("close", "date").alias("price"))


EXITS_SQL = """xs AS (SELECT bk.*, lt.price, (lt.price / entry_price - 1) * direction AS pnl, 1.0::double - k % 4 AS z_now, ((k - k % 2) % 7) / 8.0::double AS sp
  FROM bk LEFT JOIN (SELECT * FROM lt WHERE cast(substring(ticker, 2, 10) AS bigint) % 17 <> 0) lt USING (ticker)),
xr AS MATERIALIZED (SELECT ticker, pnl, CASE WHEN price IS NULL THEN 'delisted_or_missing' WHEN signal_type = 'mean_reversion' THEN
    CASE WHEN entry_z * z_now < 0 THEN 'z_reversal' WHEN days_held >= 15 THEN 'time_stop' WHEN pnl <= -0.03 THEN 'loss_stop' END
  WHEN signal_type LIKE 'pairs%' THEN CASE WHEN abs(sp) < 0.5 THEN 'spread_close' WHEN days_held >= 30 THEN 'time_stop' WHEN pnl <= -0.04 THEN 'loss_stop' END
  WHEN days_held >= 21 THEN CASE WHEN entry_z * z_now < 0 THEN 'mom_exit' WHEN pnl <= -0.05 THEN 'loss_stop' END END AS exit_reason FROM xs)"""


@query("pos01_exit_reasons", with_(BARS, BOOK_SQL, EXITS_SQL, body=f"SELECT ticker, {r6('pnl')} AS pnl, exit_reason FROM xr"))
def _q1(s, d):
    k = F.col("s_suppkey")
    sup = A.table(s, d, "supplier")
    z = sup.select(A.ticker_of("s_suppkey").alias("ticker"), (F.lit(1.0) - k % 4).alias("z_now"))
    from .q_regime import supplier_pairs
    sp = supplier_pairs(s, d).select("leg1", "leg2", ((K("leg1") % 7) / F.lit(8.0)).alias("z"))
    px = last_prices(s, d).where(K() % 17 != 0)
    return r(PO.exit_reasons(book(s, d), px, z, sp), "pnl").select("ticker", "pnl", "exit_reason")


@query("pos02_new_entries", with_(*S2, BOOK_SQL, body=f"""SELECT ticker, signal_type, CASE WHEN position > 0 THEN 1 ELSE -1 END AS direction, {r6('price')} AS entry_price,
  {r6('z_score * CASE WHEN position > 0 THEN 1 ELSE -1 END')} AS entry_z, {r6('abs(position)')} AS size FROM sz JOIN lt USING (ticker)
  WHERE abs(position) >= 0.001 AND ticker NOT IN (SELECT ticker FROM bk WHERE k % 4 = 0)"""))
def _q2(s, d):
    e = PO.new_entries(positions(s, d), book(s, d).where(K() % 4 == 0), last_prices(s, d), "2001-11-05")
    return r(e, "entry_price", "entry_z", "size").select("ticker", "signal_type", "direction", "entry_price", "entry_z", "size")


@query("pos03_age_and_carry", with_(*S2, BOOK_SQL, "hb AS (SELECT * FROM bk WHERE k % 4 = 0)", body=f"""SELECT sz.ticker, {r6('coalesce(size * direction, position)')} AS position,
  coalesce(hb.signal_type, sz.signal_type) AS signal_type, coalesce(days_held + 1, 0) AS days_held FROM sz LEFT JOIN hb ON hb.ticker = sz.ticker"""))
def _q3(s, d):
    return r(PO.age_and_carry(book(s, d).where(K() % 4 == 0), positions(s, d)), "position")


@query("pos04_book_summary", with_(BARS, BOOK_SQL, body=f"""SELECT ticker, signal_type, CASE WHEN direction = 1 THEN 'LONG' ELSE 'SHORT FUT' END AS direction, entry_date, days_held,
  {r6('size', 4)} AS size, {r6('entry_z', 2)} AS entry_z, coalesce(pair_partner, '') AS pair_partner FROM bk"""))
def _q4(s, d):
    return r(r(PO.book_summary(book(s, d)), "size", places=4), "entry_z", places=2)


@query("pos05_stop_target", with_(BARS, BOOK_SQL, body=f"""SELECT ticker, {r6('(price / entry_price - 1) * 100')} AS pnl_pct, cast(lt.date - entry_date AS int) AS held_days,
  CASE WHEN price <= entry_price * 0.95::double THEN 'stop_loss' WHEN price >= entry_price * 1.05::double THEN 'target' WHEN lt.date - entry_date >= 300 THEN 'max_hold' END AS exit_reason FROM bk JOIN lt USING (ticker)"""))
def _q5(s, d):
    b = book(s, d).select("ticker", "entry_date", "entry_price", (F.col("entry_price") * 0.95).alias("stop_loss"), (F.col("entry_price") * 1.05).alias("target"))
    x = PO.stop_target_exits(b, last_prices(s, d).withColumnRenamed("price", "close"), 300)
    return r(x, "pnl_pct").select("ticker", "pnl_pct", "held_days", "exit_reason")


@query("pos06_fill_slots", with_(*S2, BOOK_SQL, body="""SELECT ticker FROM sz WHERE ticker NOT IN (SELECT ticker FROM bk WHERE k % 25 = 0) ORDER BY z_score DESC, ticker
  LIMIT 10 - (SELECT count(*) FROM bk WHERE k % 25 = 0)"""))
def _q6(s, d):
    held = book(s, d).where(K() % 25 == 0)
    return PO.fill_slots(positions(s, d).withColumn("score", F.col("z_score")), held, 10).select("ticker")


def monthly_entries(s, d, ind):
    """An entry at every ticker's first row of each month, with the ATR known there."""
    return ind.groupBy("ticker", F.trunc("date", "month").alias("m")).agg(F.min_by(F.struct("date", "close", "atr14"), "date").alias("e")).where(
        F.col("e.atr14").isNotNull()).select("ticker", F.col("e.date").alias("entry_date"), F.col("e.close").alias("entry_price"), F.col("e.atr14").alias("atr"))


ATR_SQL = f"""tr AS (SELECT *, greatest(high - low, abs(high - {lagx('close')}), abs(low - {lagx('close')})) AS tr FROM bars),
atx AS MATERIALIZED (SELECT *, {roll('avg', 'tr', 14)} AS atr14, {roll('avg', 'close', 10)} AS ma, row_number() OVER {over()} AS pos FROM tr),
en AS MATERIALIZED (SELECT ticker, date AS entry_date, close AS entry_price, atr14 AS atr, pos AS at_ FROM (SELECT * FROM atx QUALIFY row_number() OVER (PARTITION BY ticker, date_trunc('month', date) ORDER BY date) = 1) WHERE atr14 IS NOT NULL)"""


@query("pos07_barrier_exits", with_(BARS, ATR_SQL, """hx AS (SELECT en.ticker, entry_date, a.date, a.close, a.pos - at_ AS step, CASE WHEN a.low <= entry_price - 1.5 * atr THEN 'Stop Loss'
    WHEN a.high >= entry_price + 2.5 * atr THEN 'Target' WHEN a.close < ma - 0.5 * atr14 THEN 'Trend Death' WHEN a.pos - at_ = 30 THEN 'Timeout' END AS reason
  FROM en JOIN atx a ON a.ticker = en.ticker AND a.pos > at_ AND a.pos <= at_ + 30),
fx AS (SELECT * FROM hx WHERE reason IS NOT NULL QUALIFY row_number() OVER (PARTITION BY ticker, entry_date ORDER BY step) = 1)""",
    body=f"SELECT en.ticker, en.entry_date, fx.date AS exit_date, reason, {r6('fx.close')} AS exit_close, step AS rows_held FROM en LEFT JOIN fx ON fx.ticker = en.ticker AND fx.entry_date = en.entry_date"))
def _q7(s, d):
    ind = I.atr(A.bars(s, d), 14).withColumn("kama", rolling(F.avg, "close", 10))
    ind = cut(ind.select("ticker", "date", "close", "low", "high", "kama", "atr14"), "series")
    e = monthly_entries(s, d, ind)
    x = PO.barrier_exits(e, ind.withColumnRenamed("atr14", "atr_now"))
    return r(x, "exit_close").select("ticker", "entry_date", "exit_date", "reason", "exit_close", F.col("rows_held").cast("long").alias("rows_held"))


@query("pos08_trailing_stop", with_(BARS, ATR_SQL, """tx AS (SELECT en.ticker, entry_date, a.date, a.low, greatest(entry_price, max(a.high) OVER (PARTITION BY en.ticker, entry_date ORDER BY a.pos
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) * 0.9::double AS trig FROM en JOIN atx a ON a.ticker = en.ticker AND a.pos > at_),
ty AS (SELECT ticker, entry_date, min(date) AS exit_date, arg_min(trig, date) * 0.998 AS fill FROM tx WHERE low <= trig GROUP BY 1, 2)""",
    body=f"SELECT en.ticker, en.entry_date, exit_date, {r6('fill')} AS fill FROM en LEFT JOIN ty ON ty.ticker = en.ticker AND ty.entry_date = en.entry_date"))
def _q8(s, d):
    ind = I.atr(A.bars(s, d), 14)
    x = PO.trailing_stop(monthly_entries(s, d, ind), A.bars(s, d).select("ticker", "date", "low", "high"))
    return r(x, "fill").select("ticker", "entry_date", "exit_date", "fill")


@query("pos09_cooldown", with_(BARS, """cd AS MATERIALIZED (SELECT ticker, date, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM bars WHERE close > open),
wk AS (SELECT ticker, date, i, date AS last, true AS keep FROM cd WHERE i = 1 UNION ALL
  SELECT c.ticker, c.date, c.i, CASE WHEN c.date - w.last > 5 THEN c.date ELSE w.last END, c.date - w.last > 5 FROM wk w JOIN cd c ON c.ticker = w.ticker AND c.i = w.i + 1)""",
    recursive=True, body="SELECT ticker, date FROM wk WHERE keep"))
def _q9(s, d):
    return PO.cooldown(A.bars(s, d).where("close > open").select("ticker", "date"))


@query("pos10_momentum_exits", with_(BARS, X.PANEL_SQL, """md AS (SELECT date, median(mom) AS m FROM panel WHERE mom IS NOT NULL GROUP BY date)""", body=f"""SELECT ticker, p.date,
  {r6('greatest(p.sma200 - 60.0::double, p.sma200 * 0.92::double)')} AS stop, CASE WHEN p.close < greatest(p.sma200 - 60.0::double, p.sma200 * 0.92::double) THEN 'stop' WHEN p.mom < m THEN 'momentum' END AS exit_reason
  FROM panel p LEFT JOIN md ON md.date = p.date WHERE sma200 IS NOT NULL"""))
def _q10(s, d):
    from ..functions.orderstats import quantiles
    pan = X.panel(s, d)
    med = quantiles(pan, ["date"], "mom", {"mom_median": 0.5})
    ind = pan.join(med, "date", "left")
    bk = pan.where("sma200 is not null").select("ticker", "date", F.col("sma200").alias("entry_price"), F.lit(20.0).alias("atr"))
    return r(PO.momentum_exits(bk, ind), "stop").select("ticker", "date", "stop", "exit_reason")
