"""Resampling and sweep queries."""

import re

from pyspark.sql import functions as F

from ..functions.columns import rnd
from ..functions.draws import lcg_sql, normal_sql
from ..operators import resampling as R
from ..operators import robustness as B
from ..sources import adapters as A
from . import frames as X
from ..operators.calendar import month_end_dates
from ..sources.scratch import cut
from .base import BARS, BRAND_BARS, lagx, query, r6, regime_sql, ret_sql, roll, with_
from .q_portfolio import r

# Paths per test as published.
NOISE_SIMS = SHUFFLE_SIMS = 200
CRASH_SIMS, BOOT_SIMS = 100, 2000
NUM = """nu AS MATERIALIZED (SELECT portfolio, row_number() OVER (PARTITION BY portfolio ORDER BY date) - 1 AS idx, ret, count(*) OVER (PARTITION BY portfolio) AS n FROM equity WHERE ret IS NOT NULL)"""


def base(n):
    return BRAND_BARS, X.EQUITY_SQL, NUM, f"si AS (SELECT unnest(range(0, {n})) AS sim)"


def digest_sql(paths):
    return f"SELECT portfolio, sim, count(*) AS n, {r6('sum(ret)')} AS total, {r6('sum(ret * pos)', 3)} AS placed FROM ({paths}) GROUP BY portfolio, sim"


def _digest(s, d, n_sim, draw):
    return r(r(R.path_digest(X.brand_equity(s, d), n_sim, draw), "total"), "placed", places=3)


@query("rob01_noise_paths", with_(*base(NOISE_SIMS), body=digest_sql(f"SELECT portfolio, sim, idx AS pos, ret + 0.005::double * {normal_sql('sim', 'idx')} AS ret FROM nu, si")))
def _1(s, d):
    return _digest(s, d, NOISE_SIMS, R.noise())


@query("rob02_shuffle_paths", with_(*base(SHUFFLE_SIMS), body=digest_sql(f"""SELECT portfolio, sim, row_number() OVER (PARTITION BY portfolio, sim ORDER BY {lcg_sql('sim', 'idx')}, idx) - 1 AS pos, ret FROM nu, si""")))
def _2(s, d):
    return _digest(s, d, SHUFFLE_SIMS, R.shuffle())


@query("rob03_crash_paths", with_(*base(CRASH_SIMS), f"cr AS (SELECT *, {lcg_sql('sim')} % greatest(1, n - 5) AS st FROM nu, si)",
    body=digest_sql("SELECT portfolio, sim, idx AS pos, CASE WHEN idx BETWEEN st AND st + 4 THEN ret - 0.10::double ELSE ret END AS ret FROM cr")))
def _3(s, d):
    return _digest(s, d, CRASH_SIMS, R.crash())


BLOCK = f"""ln AS (SELECT portfolio, any_value(n) AS n FROM nu GROUP BY 1),
sl AS (SELECT portfolio, n, sim, unnest(range(0, n)) AS pos FROM ln, si),
sr AS (SELECT *, {lcg_sql('sim', '(pos // 63)')} % greatest(1, n - 63) + pos % 63 AS src FROM sl),
bp AS (SELECT sr.portfolio, sim, pos, ret FROM sr JOIN nu ON nu.portfolio = sr.portfolio AND nu.idx = src)"""


@query("rob04_block_bootstrap", with_(*base(BOOT_SIMS), BLOCK, body=digest_sql("SELECT * FROM bp")))
def _4(s, d):
    return _digest(s, d, BOOT_SIMS, R.blocks())


@query("rob05_var_block_bootstrap", with_(*base(BOOT_SIMS), f"""ln AS (SELECT portfolio, any_value(n) AS n FROM nu GROUP BY 1),
b0 AS (SELECT portfolio, n, sim, unnest(range(0, cast(ceil(n / 3.0::double) AS bigint) + 1)) AS b FROM ln, si),
b1 AS (SELECT *, 3 + {lcg_sql('sim', 'b')} % 4 AS len, {lcg_sql('sim', 'b', seed=49)} AS dr FROM b0),
b2 AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY portfolio, sim ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM b1),
b3 AS (SELECT portfolio, n, sim, off, dr % greatest(1, n - len) AS st, unnest(range(0, len)) AS j FROM b2 WHERE off < n)""",
    body=digest_sql("SELECT b3.portfolio, sim, cast(off + j AS bigint) AS pos, ret FROM b3 JOIN nu ON nu.portfolio = b3.portfolio AND nu.idx = st + j WHERE off + j < b3.n")))
def _5(s, d):
    return _digest(s, d, BOOT_SIMS, R.variable_blocks())


PM = """pg AS (SELECT *, exp(sum(ln(1 + ret)) OVER (PARTITION BY portfolio, sim ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS g FROM bp),
pd AS (SELECT *, g / max(g) OVER (PARTITION BY portfolio, sim ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM pg),
pm AS MATERIALIZED (SELECT portfolio, sim, arg_max(g, pos) AS final, pow(arg_max(g, pos), 252.0::double / count(*)) - 1 AS cagr, min(dd) AS mdd, avg(ret) * sqrt(252.0::double) / stddev_samp(ret) AS sharpe FROM pd GROUP BY 1, 2)"""


def metrics(s, d):
    return R.path_measures(X.brand_equity(s, d), BOOT_SIMS, R.blocks())


@query("rob06_path_metrics", with_(*base(BOOT_SIMS), BLOCK, PM, body=f"SELECT portfolio, sim, {r6('cagr')} AS cagr, {r6('mdd')} AS max_drawdown, {r6('sharpe')} AS sharpe FROM pm"))
def _6(s, d):
    m = r(metrics(s, d), "cagr", "max_drawdown", "sharpe")
    return m.select("portfolio", "sim", "cagr", "max_drawdown", "sharpe")


@query("rob07_path_summary", with_(*base(BOOT_SIMS), BLOCK, PM, body=f"""SELECT portfolio, count(*) AS sims, {r6('quantile_cont(cagr, 0.5)')} AS cagr_median, {r6('quantile_cont(cagr, 0.05)')} AS cagr_p05,
  {r6('min(cagr)')} AS cagr_worst, {r6('quantile_cont(mdd, 0.5)')} AS dd_median, {r6('quantile_cont(mdd, 0.05)')} AS dd_p05,
  {r6('avg(CASE WHEN mdd <= -0.5 THEN 1.0 ELSE 0.0 END)')} AS ruin_prob, {r6('avg(CASE WHEN final < 1 THEN 1.0 ELSE 0.0 END)')} AS loss_prob,
  quantile_cont(cagr, 0.5) > 0 AND avg(CASE WHEN final < 1 THEN 1.0 ELSE 0.0 END) <= 0.5 AS passed FROM pm GROUP BY 1"""))
def _7(s, d):
    p = B.path_summary(metrics(s, d))
    return r(p, *[c for c in p.columns if c not in ("portfolio", "sims", "passed")])


# ---- configurations

def cfg(i, window=252, skip=21, top_n=5, hold_rank=15, regime_sma=100, leverage=1.0):
    """hold_rank 0: no buffer. The turnover floor is that of the screen, as the tables' prices are small."""
    return {"config_id": i, "window": window, "skip": skip, "top_n": top_n, "hold_rank": hold_rank, "regime_sma": regime_sma,
            "min_turnover": 20000.0, "leverage": leverage}


# The published grids; the first changes each value alone against the base.
ONE = [cfg(0)] + [cfg(i, **kw) for i, kw in enumerate(
    [{"top_n": 3}, {"top_n": 7}, {"hold_rank": 0}, {"hold_rank": 10}, {"hold_rank": 20}, {"window": 126}, {"window": 189}, {"window": 315},
     {"skip": 0}, {"skip": 31}, {"regime_sma": 50}, {"regime_sma": 150}], 1)]
TWO_D = [cfg(3 * i + j, window=w, top_n=n) for i, w in enumerate((126, 189, 252)) for j, n in enumerate((3, 5, 7))]
FACTORIAL = [cfg(k, window=w, skip=sk, top_n=n, hold_rank=h, regime_sma=g) for k, (n, w, sk, h, g) in enumerate(
    (n, w, sk, h, g) for n in (5, 10, 20) for w in (90, 126, 252) for sk in (0, 21) for h in (0, 15) for g in (100, 200))]
FORWARD = [cfg(0, leverage=1.1), cfg(1, window=126, top_n=10, hold_rank=20, leverage=1.1), cfg(2, window=126, skip=0, regime_sma=200, leverage=1.1)]


def _state_sql(n):
    """regime_sql with its own names for a window."""
    return re.sub(r"\b(idx|reg[0-4]|regime)\b", rf"\1_{n}", regime_sql(n))


def sweep_sql(grid, year=False):
    """From bars to cfr(config_id[, year], date, ret): daily net returns, written from the rule."""
    pairs, states = B.grid_pairs(grid), sorted({c["regime_sma"] for c in grid})
    moms = ", ".join(f"{lagx('close', s) if s else 'close'} / nullif({lagx('close', w)}, 0) - 1 AS mom_{w}_{s}" for w, s in pairs)
    rows = ", ".join(f"({c['config_id']}, {c['window']}, {c['skip']}, {c['top_n']}, {c['hold_rank']}, {c['regime_sma']}, {c['leverage']}::double)" for c in grid)
    mom = "CASE " + " ".join(f"WHEN w = {w} AND sk = {s} THEN mom_{w}_{s}" for w, s in pairs) + " END"
    bull = "CASE " + " ".join(f"WHEN rg = {n} THEN coalesce(bull_{n}, false)" for n in states) + " END"
    yy = lambda d: f"year({d})" if year else "0"
    kept = "list_filter({n}[1:{b}], lambda x: list_contains({h}, x))"
    step = lambda h, n, t, b: (lambda k: f"list_concat({k}, list_filter({n}, lambda x: NOT list_contains({k}, x))[1:greatest(0, {t} - len({k}))])")(kept.format(n=n, b=b, h=h))
    none = "cast([] AS varchar[])"
    return ",\n".join(_state_sql(n) for n in states) + f""",
sp0 AS (SELECT ticker, date, close, {moms}, {roll('avg', 'close', 200)} AS sma200, {roll('avg', 'close * volume', 20)} AS to20,
  coalesce({roll('stddev_samp', 'r', 60)} * sqrt(252.0::double), 0.3::double) AS vol60 FROM (SELECT *, coalesce({ret_sql()}, 0) AS r FROM bars)),
sme AS MATERIALIZED (SELECT month, date, {yy('date')} AS yy, lead(date) OVER (PARTITION BY {yy('date')} ORDER BY date) AS nd FROM (SELECT date_trunc('month', date) AS month, max(date) AS date FROM bars GROUP BY 1)),
spn AS MATERIALIZED (SELECT sme.date, sme.yy, q.* EXCLUDE (date, month), {', '.join(f'r{n}.bullish AS bull_{n}' for n in states)} FROM (SELECT *, date_trunc('month', date) AS month FROM sp0
  QUALIFY row_number() OVER (PARTITION BY ticker, date_trunc('month', date) ORDER BY date DESC) = 1) q JOIN sme ON sme.month = q.month
  {' '.join(f'LEFT JOIN regime_{n} r{n} ON r{n}.date = sme.date' for n in states)}),
cfg(cid, w, sk, tn, bf, rg, lev) AS (VALUES {rows}),
sc AS (SELECT cid, yy, tn, bf, date, ticker, coalesce({mom} / (vol60 + 1e-6::double), {mom}) AS score FROM spn, cfg
  WHERE {bull} AND close > sma200 AND to20 > 20000 AND close > 10 AND {mom} IS NOT NULL),
srk AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cid, date ORDER BY score DESC, ticker) AS rank FROM sc) WHERE rank <= tn + bf),
sdy AS MATERIALIZED (SELECT cfg.cid, sme.yy, tn, bf, lev, sme.date, coalesce(nm.names, {none}) AS names, row_number() OVER (PARTITION BY cfg.cid, sme.yy ORDER BY sme.date) AS i
  FROM cfg CROSS JOIN sme LEFT JOIN (SELECT cid, date, list(ticker ORDER BY rank) AS names FROM srk GROUP BY ALL) nm ON nm.cid = cfg.cid AND nm.date = sme.date),
swk AS (SELECT cid, yy, lev, i, date, {step(none, 'names', 'tn', 'bf')} AS book FROM sdy WHERE i = 1
  UNION ALL SELECT n.cid, n.yy, n.lev, n.i, n.date, {step('k.book', 'n.names', 'n.tn', 'n.bf')} FROM swk k JOIN sdy n ON n.cid = k.cid AND n.yy = k.yy AND n.i = k.i + 1),
sbk AS MATERIALIZED (SELECT cid, yy, date, unnest(book) AS ticker, lev / len(book) AS weight FROM swk WHERE len(book) > 0),
sfs AS (SELECT cid, yy, min(date) AS f FROM sbk GROUP BY ALL),
spd AS MATERIALIZED (SELECT cid, sme.yy, sme.date, nd FROM sfs JOIN sme ON sme.yy = sfs.yy AND sme.date >= f),
sod AS (SELECT b.cid, b.yy, nd AS date, ticker, weight AS w0 FROM sbk b JOIN sme ON sme.date = b.date WHERE nd IS NOT NULL),
sdr AS (SELECT coalesce(b.cid, o.cid) AS cid, coalesce(b.date, o.date) AS date, sum(abs(coalesce(weight, 0) - coalesce(w0, 0))) * 0.00175 AS drag
  FROM sbk b FULL JOIN sod o ON o.cid = b.cid AND o.date = b.date AND o.ticker = b.ticker GROUP BY 1, 2),
sdz AS (SELECT cid, entry, date, sum(weight * coalesce(close / prev - 1, 0)) AS ret FROM (
  SELECT b.cid, b.date AS entry, b.weight, x.date, x.close, lag(x.close) OVER (PARTITION BY b.cid, b.ticker, b.date ORDER BY x.date) AS prev
  FROM sbk b JOIN sme ON sme.date = b.date JOIN bars x ON x.ticker = b.ticker AND x.date > b.date AND x.date <= nd) GROUP BY ALL),
sdd AS (SELECT p.cid, p.yy, p.date AS entry, c.date, coalesce(ret, 0) AS ret FROM spd p JOIN (SELECT DISTINCT date FROM bars) c ON c.date > p.date AND c.date <= nd
  LEFT JOIN sdz z ON z.cid = p.cid AND z.entry = p.date AND z.date = c.date),
cfr AS MATERIALIZED (SELECT d.cid AS config_id, d.yy AS year, d.date, ret - CASE WHEN row_number() OVER (PARTITION BY d.cid, entry ORDER BY d.date) = 1 THEN coalesce(drag, 0) ELSE 0 END AS ret
  FROM sdd d LEFT JOIN sdr ON sdr.cid = d.cid AND sdr.date = entry)"""


def metrics_sql(src="cfr", out="cm", keys="config_id", where="true"):
    rows = f"(PARTITION BY {keys} ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""{out}g AS (SELECT *, exp(sum(ln(1 + ret)) OVER {rows}) AS g FROM {src} WHERE {where}),
{out}d AS (SELECT *, g / max(g) OVER {rows} - 1 AS dd FROM {out}g),
{out} AS MATERIALIZED (SELECT {keys}, pow(arg_max(g, date), 252.0::double / count(*)) - 1 AS cagr, min(dd) AS mdd, avg(ret) * sqrt(252.0::double) / nullif(stddev_samp(ret), 0) AS sharpe FROM {out}d GROUP BY {keys})"""


def inputs(s, d, grid):
    """Bars, panel and rebalance dates; bars and panel are read several times and written once."""
    bars = cut(A.bars(s, d), "bars")
    return bars, B.sweep_panel(bars, grid), cut(month_end_dates(bars), "rebalances")


def rets(s, d, grid):
    bars, panel, dates = inputs(s, d, grid)
    return B.config_returns(panel, bars, grid, dates)


@query("rob08_one_at_a_time", with_(BARS, sweep_sql(ONE), metrics_sql(), recursive=True, body=f"""SELECT config_id, {r6('cagr')} AS cagr, {r6('sharpe')} AS sharpe, {r6('mdd')} AS max_drawdown,
  {r6('cagr - (SELECT cagr FROM cm WHERE config_id = 0)')} AS delta_cagr FROM cm"""))
def _8(s, d):
    m = B.one_at_a_time(B.config_metrics(rets(s, d, ONE)))
    return r(m, "cagr", "sharpe", "max_drawdown", "delta_cagr").drop("final")


@query("rob09_grid_2d", with_(BARS, sweep_sql(TWO_D), metrics_sql(), recursive=True, body=f"""SELECT CASE config_id // 3 WHEN 0 THEN 126 WHEN 1 THEN 189 ELSE 252 END AS "window",
  {', '.join(f"max(CASE WHEN config_id % 3 = {j} THEN {r6('sharpe')} END) AS n{n}" for j, n in enumerate((3, 5, 7)))} FROM cm GROUP BY 1"""))
def _9(s, d):
    g = B.grid_2d(B.config_metrics(rets(s, d, TWO_D)), TWO_D, "window", "top_n")
    return g.select("window", *[rnd(F.col(f"`{n}`")).alias(f"n{n}") for n in (3, 5, 7)])


@query("rob10_factorial_blind_test", with_(BARS, sweep_sql(FACTORIAL), metrics_sql(out="tr", where="date < date '2000-01-01'"), metrics_sql(out="te", where="date >= date '2000-01-01'"), recursive=True,
    body=f"""SELECT te.config_id, {r6('tr.sharpe')} AS train_sharpe, {r6('te.sharpe')} AS sharpe, {r6('te.cagr')} AS cagr FROM te JOIN (SELECT * FROM tr ORDER BY round(sharpe, 9) DESC, config_id LIMIT 1) tr ON tr.config_id = te.config_id"""))
def _10(s, d):
    return r(B.blind_test(rets(s, d, FACTORIAL), "2000-01-01"), "train_sharpe", "sharpe", "cagr").select("config_id", "train_sharpe", "sharpe", "cagr")


#: The operator's window is five years; the tables hold too few years for it.
TRAIN_YEARS = 3


@query("rob11_walk_forward", with_(BARS, sweep_sql(FORWARD), f"""wt AS (SELECT y.year, config_id, avg(ret) * sqrt(252.0::double) / nullif(stddev_samp(ret), 0) AS s FROM cfr JOIN (SELECT DISTINCT year(date) AS year FROM cfr WHERE year(date) >= (SELECT min(year(date)) FROM cfr) + {TRAIN_YEARS}) y
  ON year(cfr.date) BETWEEN y.year - {TRAIN_YEARS} AND y.year - 1 GROUP BY 1, 2),
wb AS (SELECT year, arg_max(config_id, row(round(s, 9), -config_id)) AS config_id, max(s) AS s FROM wt WHERE s IS NOT NULL GROUP BY 1)""", recursive=True,
    body=f"""SELECT cast(wb.year AS int) AS year, wb.config_id, {r6('any_value(s)')} AS train_sharpe, {r6('exp(sum(ln(1 + ret))) - 1')} AS ret, count(*) AS days
  FROM wb JOIN cfr ON cfr.config_id = wb.config_id AND year(cfr.date) = wb.year GROUP BY 1, 2"""))
def _11(s, d):
    return r(B.walk_forward(rets(s, d, FORWARD), TRAIN_YEARS), "train_sharpe", "ret").select("year", "config_id", "train_sharpe", "ret", "days")


@query("rob12_isolated_years", with_(BARS, sweep_sql(FORWARD, True), metrics_sql(keys="config_id, year"), recursive=True, body=f"SELECT config_id, cast(year AS int) AS year, {r6('cagr')} AS cagr, {r6('mdd')} AS max_drawdown FROM cm"))
def _12(s, d):
    bars, panel, dates = inputs(s, d, FORWARD)
    return r(B.isolated_years(panel, bars, FORWARD, dates), "cagr", "max_drawdown").select("config_id", "year", "cagr", "max_drawdown")


@query("rob13_ab_variants", with_(BARS, sweep_sql(ONE), metrics_sql(), recursive=True, body="""SELECT config_id, round(sharpe, 9) > (SELECT round(sharpe, 9) FROM cm WHERE config_id = 0) AND round(mdd, 9) > (SELECT round(mdd, 9) FROM cm WHERE config_id = 0) AS wins FROM cm WHERE config_id <> 0"""))
def _13(s, d):
    return B.ab_variants(B.config_metrics(rets(s, d, ONE))).select("config_id", "wins")


@query("rob14_share_profitable", with_(BARS, sweep_sql(FACTORIAL), metrics_sql(), recursive=True, body=f"SELECT count(*) AS configs, count(*) FILTER (cagr > 0) AS profitable, {r6('avg(CASE WHEN cagr > 0 THEN 1.0::double ELSE 0.0::double END)')} AS share FROM cm"))
def _14(s, d):
    return r(B.share_profitable(B.config_metrics(rets(s, d, FACTORIAL))), "share")
