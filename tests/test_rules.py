"""Edge rules on hand-written frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from barloom.operators import clean as C
from barloom.operators import gates as G
from barloom.operators import indicators as I
from barloom.operators import ledger as L
from barloom.operators import metrics as M
from barloom.operators import portfolio as P
from barloom.operators import positions as PO
from barloom.operators import rank as K
from barloom.operators import regime as R
from barloom.schemas import BreakerLimits

D0 = dt.date(2024, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def bars(spark, closes, ticker="T", volume=100.0):
    rows = [(ticker, day(i), float(c), float(c), float(c), float(c), volume) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")


def column(df, name, order="date"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_sma_is_null_until_full(spark):
    out = column(I.sma(bars(spark, [1, 2, 3, 4]), n=3), "sma3")
    assert out == [None, None, 2.0, 3.0]


def test_min_periods(spark):
    out = column(I.sma(bars(spark, [1, 2, 3, 4]), n=5, min_periods=3), "sma5")
    assert out == [None, None, 2.0, 2.5]


def test_zero_close_gives_null_return(spark):
    assert column(I.ret_n(bars(spark, [0, 2, 4]), 1), "ret1") == [None, None, 1.0]


def test_nan_never_passes_a_gate(spark):
    f = spark.createDataFrame([("A", float("nan"))], "ticker string, x double")
    from barloom.functions.columns import clean_number
    assert f.select(clean_number("x", 0.2)).first()[0] == 0.2
    assert f.select(clean_number("x")).first()[0] is None


def test_candle_rules_and_last_accepted_baseline(spark):
    rows = [("T", day(0), 10., 11., 9., 10., 5.), ("T", day(1), 10., 11., 9., .5, 5.), ("T", day(2), 10., 11., 9., 10., 0.),
            ("T", day(3), 10., 8., 9., 10., 5.), ("T", day(4), 10., 9.5, 9., 9.2, 5.), ("T", day(5), 10., 20., 10.5, 11., 5.),
            ("T", day(6), 13., 14., 13., 14., 5.), ("T", day(7), 13., 14., 13., 13.5, 5.), ("T", day(8), 12., 12.4, 12., 12.3, 5.)]
    b = spark.createDataFrame(rows, "ticker string, date date, open double, high double, low double, close double, volume double")
    out = C.validate_sequential(b)
    assert column(out, "reason") == [None, "close_below_one", "no_volume", "high_below_low", "high_below_body",
                                     "low_above_body", "jump", "jump", None]
    assert column(out, "baseline")[-1] == 10.0
    ok, bad = C.split_rejects(out)
    assert ok.count() == 2 and bad.count() == 7


def test_baseline_from_store(spark):
    base = spark.createDataFrame([("T", 20.0)], "ticker string, close double")
    assert column(C.validate_sequential(bars(spark, [10, 19]), base), "reason") == ["jump", None]


def test_regime_flips_after_three(spark):
    pattern = "AABAAABBABBB"
    df = spark.createDataFrame([("IDX", day(i), c == "A") for i, c in enumerate(pattern)], "index_id string, date date, above boolean")
    out = R.bull_streak(R.hysteresis(df))
    assert column(out, "bullish") == [False] * 5 + [True] * 6 + [False]
    assert column(out, "streak") == [0, 0, 0, 0, 0, 3, 0, 0, 1, 0, 0, 0]


def test_hold_buffer_and_empty_months(spark):
    names = [["a", "b", "c"], ["c", "d", "a"], ["e", "d", "c"]]
    rows = [(1, day(i), t, k + 1) for i, ns in enumerate(names) for k, t in enumerate(ns)]
    ranked = spark.createDataFrame(rows, "config_id int, date date, ticker string, rank int")
    out = P.hold_buffer(ranked, 2, 3).orderBy("date", "slot").collect()
    by_day = {}
    for r in out:
        by_day.setdefault(r.date, []).append(r.ticker)
    assert sorted(by_day[day(0)]) == ["a", "b"] and sorted(by_day[day(1)]) == ["a", "c"] and sorted(by_day[day(2)]) == ["c", "e"]


def test_capped_weights(spark):
    df = spark.createDataFrame([(day(0), t, m) for t, m in zip("abcde", [10.0, 6.0, 2.0, 1.0, 1.0])], "date date, ticker string, mom double")
    out = {r.ticker: r.weight for r in P.cap_weights(P.momentum_weights(df), 0.30, 5).collect()}
    assert max(out.values()) <= 0.30 + 1e-12
    assert sum(out.values()) == pytest.approx(1.0)
    zero = df.withColumn("mom", F.lit(-1.0))
    assert {round(r.weight, 9) for r in P.momentum_weights(zero).collect()} == {0.2}


def test_average_cost(spark):
    ts = lambda i: dt.datetime(2024, 1, 1, 9, i)
    rows = [("A", "X", "buy", 10., 100., ts(0), "1"), ("A", "X", "buy", 10., 120., ts(1), "2"), ("A", "X", "sell", 5., 130., ts(2), "3"),
            ("A", "X", "sell", 15., 90., ts(59), "4"), ("A", "X", "buy", 2., 50., dt.datetime(2024, 1, 3), "5")]
    t = spark.createDataFrame(rows, "strategy string, symbol string, side string, qty double, price double, ts timestamp_ntz, trade_id string")
    out = L.average_cost(t).orderBy("trade_id").collect()
    assert [r.avg_cost for r in out] == [100.0, 110.0, 110.0, None, 50.0]
    assert [r.realised for r in out] == [None, None, 100.0, -300.0, None]
    assert L.open_positions(t).first().qty == 2.0


def test_average_cost_matches_a_plain_walk_on_a_hot_symbol(spark):
    import random
    rnd = random.Random(5)
    rows, qty, avg, want, clock = [], 0.0, 0.0, [], dt.datetime(2024, 1, 1)
    for i in range(3000):
        clock += dt.timedelta(seconds=rnd.randint(1, 200))
        price = 50 + rnd.random() * 100
        if qty > 0 and rnd.random() < 0.5:
            q = qty if rnd.random() < 0.05 else float(rnd.randint(1, int(qty)))
            want.append((price - avg) * q)
            qty -= q
            side = "sell"
        else:
            q = float(rnd.randint(1, 40))
            avg = (qty * avg + q * price) / (qty + q) if qty > 0 else price
            qty += q
            want.append(avg)
            side = "buy"
        rows.append(("A", "HOT", side, q, price, clock, f"{i:06d}"))
    t = spark.createDataFrame(rows, "strategy string, symbol string, side string, qty double, price double, ts timestamp_ntz, trade_id string")
    out = L.average_cost(t).orderBy("trade_id").collect()
    got = [r.realised if r.side == "sell" else r.avg_cost for r in out]
    assert got == pytest.approx(want, rel=1e-9, abs=1e-6)


def test_order_validation(spark):
    ts = lambda i: dt.datetime(2024, 1, 1, 9, i)
    rows = [("a", "X", "buy", 10., 10., ts(0), "1"), ("a", "X", "buy", 1., 10., ts(1), "2"), ("a", "X", "sell", 20., 10., ts(2), "3"),
            ("a", "X", "sell", 10., 11., ts(3), "4"), ("a", "X", "buy", 0., 11., ts(4), "5"), ("b", "X", "buy", 1., 1., ts(0), "6")]
    o = spark.createDataFrame(rows, "account string, symbol string, side string, qty double, price double, ts timestamp_ntz, order_id string")
    out = L.validate_orders(o, 100.0).orderBy("order_id").collect()
    assert [r.status for r in out] == ["ok", "no_cash", "no_shares", "ok", "bad_qty", "ok"]
    assert [r.cash_after for r in out] == [0.0, 0.0, 0.0, 110.0, 110.0, 99.0]


def test_breaker(spark):
    caps = [(0, 100.0), (21, 91.0), (30, 91.0), (47, 100.0), (50, 79.0), (51, 100.0)]
    e = spark.createDataFrame([("p", day(i), c) for i, c in caps], "portfolio string, date date, capital double")
    assert column(L.breaker_state(e), "status") == ["OK", "BREAKER_TRIPPED", "BREAKER_ACTIVE", "OK", "KILL_SWITCH", "KILL_SWITCH"]
    assert BreakerLimits().kill_drawdown == -0.20


def test_drawdown_with_base(spark):
    e = spark.createDataFrame([("p", day(i), c) for i, c in enumerate([90.0, 95.0, 80.0])], "portfolio string, date date, capital double")
    assert M.max_drawdown(e).first().max_drawdown == pytest.approx((80 / 95 - 1) * 100)
    assert M.max_drawdown(e, 100.0).first().max_drawdown == pytest.approx(-20.0)


def test_exit_reasons(spark):
    cols = "ticker string, signal_type string, direction int, entry_price double, entry_z double, pair_partner string, days_held int"
    rows = [("A", "mean_reversion", 1, 100., -2., None, 1), ("B", "mean_reversion", 1, 100., -2., None, 15), ("C", "mean_reversion", 1, 100., -2., None, 1),
            ("D", "pairs_long", 1, 100., -2., "E", 1), ("E", "pairs_short", -1, 100., 2., "D", 40), ("F", "residual_momentum", 1, 100., 2., None, 5),
            ("G", "residual_momentum", 1, 100., 2., None, 30), ("H", "mean_reversion", 1, 100., 1., None, 1)]
    book = spark.createDataFrame(rows, cols)
    px = spark.createDataFrame([(t, p) for t, p in zip("ABCDEFG", [100., 100., 96., 100., 100., 50., 94.])], "ticker string, price double")
    z = spark.createDataFrame([("A", 0.5), ("B", -1.0), ("C", -1.0), ("F", -1.0), ("G", 1.0)], "ticker string, z_now double")
    sp = spark.createDataFrame([("E", "D", 0.2)], "leg1 string, leg2 string, z double")
    got = {r.ticker: r.exit_reason for r in PO.exit_reasons(book, px, z, sp).collect()}
    assert got == {"A": "z_reversal", "B": "time_stop", "C": "loss_stop", "D": "spread_close", "E": "spread_close",
                   "F": None, "G": "loss_stop", "H": "delisted_or_missing"}


def test_cooldown_counts_from_the_last_kept(spark):
    e = spark.createDataFrame([("T", day(i)) for i in (0, 3, 5, 6, 12)], "ticker string, date date")
    assert column(PO.cooldown(e, 5), "date") == [day(0), day(6), day(12)]


def test_sector_cap_equals_greedy(spark):
    import random
    rnd = random.Random(1)
    rows = [(day(d), f"t{i:02d}", rnd.choice(["s1", "s2", "General"]), float(rnd.randint(0, 6))) for d in range(10) for i in range(25)]
    df = spark.createDataFrame(rows, "date date, ticker string, sector string, score double")
    got = {}
    for r in K.sector_capped_top_n(df, "score", 6, 2).collect():
        got.setdefault(r.date, set()).add(r.ticker)
    for d in {r[0] for r in rows}:
        taken, used = [], {}
        for _, t, s, _ in sorted((r for r in rows if r[0] == d), key=lambda r: (-r[3], r[1])):
            if len(taken) < 6 and (s == "General" or used.get(s, 0) < 2):
                taken.append(t)
                used[s] = used.get(s, 0) + 1
        assert got[d] == set(taken)


def test_keep_last_wins(spark):
    a, b = bars(spark, [1, 2]), bars(spark, [5])
    assert column(C.merge_bars(a, b), "close") == [5.0, 2.0]
    assert C.added_rows(a, b).first().added == 0


def test_quarter_start(spark):
    from barloom.functions.columns import is_quarter_start
    df = spark.createDataFrame([(dt.date(2024, 4, 7),), (dt.date(2024, 4, 8),), (dt.date(2024, 5, 1),)], "date date")
    assert [r[0] for r in df.select(is_quarter_start("date")).collect()] == [True, False, False]


def test_gate_reports_the_first_rule(spark):
    base = dict(ticker="A", is_finance=False, net_profit_negative=False, ebitda_negative=None, roe=None, roce=5.0, revenue_decline_2yr=False,
                promoter_holding=50.0, promoter_pledge=0.0, pledge_increasing_3q=False, market_cap_cr=1000.0, auditor_flag=False,
                promoter_selling=False, debt_equity=9.0, icr=9.0, gross_npa_pct=9.0, car_pct=1.0)
    rows = [base, {**base, "ticker": "B", "roce": 20.0}, {**base, "ticker": "C", "roce": 20.0, "is_finance": True}, {**base, "ticker": "D", "roce": 20.0, "debt_equity": 1.0}]
    schema = ("ticker string, is_finance boolean, net_profit_negative boolean, ebitda_negative boolean, roe double, roce double, revenue_decline_2yr boolean,"
              "promoter_holding double, promoter_pledge double, pledge_increasing_3q boolean, market_cap_cr double, auditor_flag boolean,"
              "promoter_selling boolean, debt_equity double, icr double, gross_npa_pct double, car_pct double")
    names = [c.strip().split()[0] for c in schema.split(",")]
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)
    got = {r.ticker: r.reason for r in G.fundamental_gate(df).collect()}
    assert got == {"A": "roce_low", "B": "debt_high", "C": "npa_high", "D": None}


def test_order_validation_agrees_with_a_plain_walk(spark):
    import random
    rnd = random.Random(9)
    rows, want, clock = [], {}, dt.datetime(2024, 1, 1)
    for acc, budget in (("rich", 1e9), ("poor", 300.0), ("mid", 5000.0)):
        cash, held = 5000.0 if acc != "rich" else 5000.0, {}
        for i in range(400):
            clock += dt.timedelta(seconds=rnd.randint(1, 900))
            sym, price = rnd.choice("XY"), float(rnd.randint(1, 5))
            q = float(rnd.randint(0, 3 if acc == "rich" else 60))
            side = "sell" if (acc == "rich" and held.get(sym, 0) >= q and i % 2) or (acc != "rich" and rnd.random() < 0.4) else "buy"
            if not q > 0:
                s = "bad_qty"
            elif side == "buy":
                s = "ok" if cash >= q * price else "no_cash"
                if s == "ok":
                    cash, held[sym] = cash - q * price, held.get(sym, 0.0) + q
            else:
                s = "ok" if held.get(sym, 0.0) >= q else "no_shares"
                if s == "ok":
                    cash, held[sym] = cash + q * price, held[sym] - q
            oid = f"{acc}{i:04d}"
            want[oid] = (s, round(cash, 6))
            rows.append((acc, sym, side, q, price, clock, oid))
    o = spark.createDataFrame(rows, "account string, symbol string, side string, qty double, price double, ts timestamp_ntz, order_id string")
    got = {r.order_id: (r.status, round(r.cash_after, 6)) for r in L.validate_orders(o, 5000.0).collect()}
    assert got == want
    assert {s for s, _ in want.values()} == {"ok", "bad_qty", "no_cash", "no_shares"}


def test_only_the_rest_behind_a_short_order_is_walked(spark):
    """One short sale at the end of an account of 3000 orders; the walk starts from its cash and holdings."""
    ts = lambda i: dt.datetime(2020, 1, 1) + dt.timedelta(minutes=7 * i)
    rows = [("big", f"S{i % 3}", "buy" if i % 4 else "sell", 0.0 if i % 50 == 0 else 2.0, 1.0 + i % 5, ts(i), f"{i:05d}") for i in range(12, 3012)]
    rows = [r if r[2] == "buy" or r[3] == 0 else (*r[:3], 1.0, *r[4:]) for r in rows if r[2] == "buy" or r[6] > "00100"]
    rows += [("big", "S1", "sell", 1e6, 2.0, ts(3020), "90000"), ("big", "S2", "sell", 5.0, 2.0, ts(3021), "90001"), ("big", "S0", "buy", 1.0, 3.0, ts(3022), "90002"),
             ("none", "X", "sell", 1.0, 1.0, ts(0), "90003"), ("none", "X", "buy", 1.0, 1.0, ts(1), "90004")]
    o = spark.createDataFrame(rows, "account string, symbol string, side string, qty double, price double, ts timestamp_ntz, order_id string").repartition(5)
    settled, rest = L.settled_orders(o, 1e5)
    assert settled.count() == len(rows) - 5 and rest.count() < len(rows) // 100
    cash, held, want = {"big": 1e5, "none": 1e5}, {}, {}
    for account, symbol, side, qty, price, _, oid in rows:
        have = held.get((account, symbol), 0.0)
        status = "bad_qty" if qty <= 0 else "ok" if (cash[account] >= qty * price if side == "buy" else have >= qty) else "no_cash" if side == "buy" else "no_shares"
        if status == "ok":
            sign = 1 if side == "buy" else -1
            cash[account] -= sign * qty * price
            held[account, symbol] = have + sign * qty
        want[oid] = (status, round(cash[account], 6))
    assert {r.order_id: (r.status, round(r.cash_after, 6)) for r in L.validate_orders(o, 1e5).collect()} == want
    assert want["90000"][0] == want["90003"][0] == "no_shares" and want["90001"][0] == want["90004"][0] == "ok"


def test_trailing_stop_beyond_the_first_quarter(spark):
    b = bars(spark, [100.0] * 80 + [120.0, 110.0, 107.0, 100.0])
    e = spark.createDataFrame([("T", day(0), 100.0), ("T", day(81), 110.0)], "ticker string, entry_date date, entry_price double")
    out = {r.entry_date: (r.exit_date, r.fill) for r in PO.trailing_stop(e, b, 0.10).collect()}
    assert out[day(0)] == (day(82), pytest.approx(120.0 * 0.9 * 0.998))
    assert out[day(81)] == (None, None)


def test_first_passage_reads_few_blocks():
    import numpy as np

    rng = np.random.default_rng(7)
    for n in (1, 2, 3, 64, 100, 5000):
        low = np.exp(np.cumsum(rng.normal(size=n) * 0.02))
        high = low * (1 + rng.random(n) * 0.02)
        low[rng.random(n) < 0.05] = np.nan
        found = PO.FirstPassage(high, low, 0.9)
        first, price = rng.integers(0, n + 1, 200), np.exp(rng.normal(size=200) * 0.3)
        at, peak, rounds = found.search(first, price)
        assert rounds <= 2 * (n.bit_length() + 1) + 1
        for f, p, a, q in zip(first, price, at, peak):
            while f < n and not low[f] <= p * 0.9:
                p, f = max(p, high[f]), f + 1
            assert (min(a, n), q if a < n else 0) == (f, p if f < n else 0)


def test_trailing_stop_of_unknown_tickers_dates_and_repeated_entries(spark):
    b = spark.createDataFrame([("A", 1, 10.0, 10.0), ("A", 2, 11.0, 10.5), ("A", 3, 10.0, 9.0)], "ticker string, date int, high double, low double")
    e = spark.createDataFrame([("A", 1, 10.0, "x"), ("A", 1, 10.0, "x"), ("A", 1, 20.0, "y"), ("A", 9, 10.0, "z"), ("B", 1, 10.0, "w"), ("A", 3, 1.0, "v")],
                              "ticker string, entry_date int, entry_price double, note string")
    got = sorted((r.note, r.exit_date, r.fill and round(r.fill, 9)) for r in PO.trailing_stop(e, b, 0.10, 0.0).collect())
    assert got == [("v", None, None), ("w", None, None), ("x", 3, 9.9), ("x", 3, 9.9), ("y", 2, 18.0), ("z", None, None)]
    assert {r.exit_date for r in PO.trailing_stop(e, b, 0.10, 0.0, max_rows=1).collect()} == {None, 2}
