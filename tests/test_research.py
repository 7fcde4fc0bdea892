"""Searches, filter chains, long-term regimes, exact index chains, table functions."""

from __future__ import annotations

import datetime as dt
import math
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelake.functions import tables
from tidelake.operators import backtest, regimes, search, universe

DAY = dt.timedelta(days=1)
START = dt.date(2022, 1, 1)


def test_drawn_sets_are_spread_evenly(spark):
    x = np.array([tuple(r)[1:] for r in search.drawn_sets(spark, 1000, {"a": (0.0, 1.0), "b": (-2.0, 0.0)}).orderBy("set_id").collect()])
    for col, lo in ((x[:, 0], 0.0), (x[:, 1] / 2 + 1, 0.0)):
        assert all(90 <= n <= 110 for n in np.histogram(col, 10, (lo, 1))[0])
    w = search.drawn_sets(spark, 50, {"a": (-1.0, 1.0), "b": (-1.0, 1.0)}, ["a", "b"]).where("set_id > 0").collect()
    assert all(math.isclose(abs(r["a"]) + abs(r["b"]), 1) for r in w)


def test_search_trains_on_earlier_rows_without_the_purged_ones(spark):
    r = random.Random(1)
    rows = [("s", START + i * DAY, i // 40, r.gauss(0, 1), r.gauss(0, 0.01)) for i in range(160)]
    df = spark.createDataFrame(rows, "series string, date date, window long, x double, r double")
    sets = [(k, r.uniform(-1, 1), r.uniform(-1, 0), r.uniform(0, 1)) for k in range(20)]
    got = {g["window"]: g for g in search.purged_search(df, spark.createDataFrame(sets, "set_id long, w double, low double, high double"), ["x"], ["w"], purge=3).collect()}

    def gains(window, s, skip=0):
        own = [x for x in rows if x[2] == window]
        return [0.0 + (b[4] if s[1] * a[3] > s[3] else -b[4] if s[1] * a[3] < s[2] else 0) for a, b in list(zip(own, own[1:], strict=False))[: 39 - max(0, skip - 0)]]

    def sharpe(p):
        return np.mean(p) / np.std(p, ddof=1) * math.sqrt(252)

    assert set(got) == {1, 2, 3}
    for window in (1, 2, 3):
        best = max((round(sharpe([g for w in range(window) for g in gains(w, s, 3 if w == window - 1 else 0)]), 6), -s[0]) for s in sets)
        assert got[window]["set_id"] == -best[1] and math.isclose(got[window]["train"], best[0], abs_tol=1e-5) and got[window]["n"] == 39
        assert math.isclose(got[window]["test"], sharpe(gains(window, sets[-best[1]])), rel_tol=1e-6)


def test_filter_chain_names_the_first_reason(spark):
    r = random.Random(2)
    base = [r.gauss(0, 0.01) for _ in range(80)]

    def series(key, returns, n=80):
        p, out = 100.0, []
        for i, x in enumerate(returns[:n]):
            p *= 1 + x
            out.append((key, START + i * DAY, p))
        return out

    rows = series("BTC", base) + series("ETH", [x * 1.1 for x in base]) + series("ok", [x + r.gauss(0, 0.002) for x in base])
    rows += series("wild", [r.gauss(0, 0.2) for _ in base]) + series("alone", [r.gauss(0, 0.01) for _ in base]) + series("jump", [*base[:-7], *(x + 0.04 for x in base[-7:])]) + series("new", base, 40)
    got = {x["asset_id"]: x for x in universe.filter_chain(spark.createDataFrame(rows, "asset_id string, date date, close double"), "2022-12-31", ("BTC", "ETH"), max_vol=3.0, min_corr=0.35, max_momentum=0.2).collect()}
    assert {k: v["reason"] for k, v in got.items()} == {"BTC": None, "ETH": None, "ok": None, "wild": "volatility", "alone": "correlation", "jump": "momentum", "new": "too_few_rows"}
    last = [p for k, _, p in rows if k == "ok"]
    back = [a / b - 1 for a, b in zip(last[-20:], last[-19:], strict=False)]
    assert math.isclose(got["ok"]["vol"], np.std(back, ddof=1) * math.sqrt(252)) and math.isclose(got["ok"]["momentum"], last[-1] / last[-8] - 1)


def test_longterm_regime_looks_back_only(spark):
    r = random.Random(3)
    v = [None if i % 50 == 9 else math.sin(i / 40) + r.gauss(0, 0.1) for i in range(500)]
    df = spark.createDataFrame([("s", START + i * DAY, x) for i, x in enumerate(v)], "series string, date date, f double")
    got = {x["date"]: x for x in regimes.longterm_regime(df, "f").collect()}
    days = [i for i, x in enumerate(v) if x is not None]
    assert len(got) == len(days) - 59
    for k in (59, 200, len(days) - 1):
        past = [v[i] for i in days[: k + 1]]
        level, time, x = past[-360:], past[-180:], got[START + days[k] * DAY]
        q1, q3 = np.percentile(level, [25, 75])
        p, hot, cold = (sum(y <= past[-1] for y in level) - 1) / (len(level) - 1), np.mean(np.array(time) >= q3), np.mean(np.array(time) <= q1)
        raw = 0.6 * (p + hot) / 2 - 0.3 * cold - 0.3 * max(0, p - hot)
        assert np.allclose([x["p_level"], x["frac_hot"], x["frac_cold"], x["score"]], [p, hot, cold, 1 - min(1, max(0, (raw + 0.6) / 1.2))])
    shares = [sum(x["bucket"] == b for x in got.values()) / len(got) for b in ("GREEN", "AMBER", "RED")]
    assert all(0.3 < s < 0.37 for s in shares)
    short = regimes.longterm_regime(df.where("date <= '2022-08-01'"), "f").drop("bucket").orderBy("date").collect()
    assert short == [x.__class__(**{k: x[k] for k in short[0].asDict()}) for _, x in sorted(got.items())][: len(short)]  # later rows change nothing but the thirds


def test_index_chain_is_exact_over_many_segments(spark):
    """400 segments: the level equals a product in whole numbers, digit by digit."""
    r = random.Random(4)
    prices = [(a, START + i * DAY, round(r.uniform(80, 120), 2)) for i in range(1201) for a in ("x", "y")]
    weights = [(START + i * DAY, a, 1.0 + (a == "y")) for i in range(0, 1201, 3) for a in ("x", "y")]
    df = backtest.chained_index(spark.createDataFrame(prices, "asset_id string, date date, close double"), spark.createDataFrame(weights, "rebalance_date date, asset_id string, weight double"))
    got = {x["date"]: x["level"] for x in df.collect()}
    one, at = 10**12, {(a, d): int(round(p * 10**6)) for a, d, p in prices}
    w = {"x": 10**14 // 300, "y": 2 * 10**14 // 300}
    base = one
    for i in range(0, 1200, 3):
        for k in range(4):
            rel = sum(w[a] * max(one * 7 // 10, min(one * 13 // 10, at[a, START + (i + k) * DAY] * one // at[a, START + i * DAY])) for a in "xy") // one
            if k < 3:
                assert got[START + (i + k) * DAY] == Decimal(1000 * (base * rel // one)) / one
        base = base * rel // one
    assert isinstance(got[START], Decimal) and len(got) == 1201


@pytest.mark.parametrize("batch", [3, 10_000])
def test_run_lengths_from_sql_equal_the_frame_form(spark, batch):
    from tidelake.operators import windows as W

    r = random.Random(5)
    rows = [(k, START + i * DAY, r.choice(["a", "a", "b", None])) for k in range(6) for i in range(60)]
    df = spark.createDataFrame(rows, "asset_id int, date date, state string").repartition(3)
    df.createOrReplaceTempView("states")
    tables.register(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = sorted(map(tuple, spark.sql("SELECT * FROM run_lengths(TABLE(SELECT asset_id, date, state FROM states) PARTITION BY asset_id ORDER BY date)").collect()), key=repr)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    runs = W.runs(df, F.col("state")).groupBy(F.col("asset_id").cast("string").alias("key"), "run").agg(F.first("_state").alias("state"), F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("n"))
    assert got == sorted(map(tuple, runs.select("key", "state", "first", "last", "n").collect()), key=repr)
    assert spark.sql("SELECT * FROM run_lengths(TABLE(SELECT asset_id, date, state FROM states WHERE false) PARTITION BY asset_id ORDER BY date)").count() == 0


def test_ranked_sides_and_their_fallback(spark):
    from tidelake.operators import statistics as T

    r = random.Random(7)
    rows = [(g, k, START + i * DAY, r.gauss(k / 1000 * (-1) ** g, 0.001 * (k + 1))) for g in (1, 2) for k in range(12) for i in range(40)]
    rows += [(3, k, START + i * DAY, r.gauss(0, 0.01)) for k in range(12) for i in range(6)] + [(4, k, START, 0.1) for k in range(12)]
    got = {}
    for x in T.rank_sides(spark.createDataFrame(rows, "g int, k int, date date, r double"), "g", "k", "date", "r", n=3).collect():
        got.setdefault((x["g"], x["method"]), {})[x["k"]] = x["weight"]
    for g in (1, 2):
        own = {k: [x for a, b, _, x in rows if (a, b) == (g, k)] for k in range(12)}
        for method, value in (("minvar_rank", lambda v: np.std(v, ddof=1)), ("momentum_rank", lambda v: np.mean(v[-30:]))):
            order = sorted(own, key=lambda k: value(own[k]))
            assert got[g, method] == {k: 0.5 / 3 for k in order[:3]} | {k: -0.5 / 3 for k in order[-3:]}
        assert len(got[g, "random"]) == 6 and sum(got[g, "random"].values()) == 0
    assert got[3, "random"] == got[3, "minvar_rank"]  # too few returns to draw from
    assert [m for g, m in got if g == 4] == ["momentum_rank"]  # no variance at all: only the means rank, all equal, by key
    assert got[4, "momentum_rank"] == {k: 0.5 / 3 for k in range(3)} | {k: -0.5 / 3 for k in range(9, 12)}


def test_label_summary_and_the_day_against_its_history(spark):
    from tidelake.operators import evaluation, stats

    x = stats.label_summary(spark.createDataFrame([("a", 0.1), ("a", -0.5), ("a", None), (None, 1.0), ("b", 0.2)], "l string, y double"), "l", "y")
    assert {r["label"]: (r["n"], round(r["mean"], 6), round(r["median"], 6), r["hit_rate"], round(r["compounded"], 6)) for r in x.collect()} == {"a": (2, -0.2, -0.2, 0.5, -0.45), "b": (1, 0.2, 0.2, 0.0, 0.2)}
    history = spark.createDataFrame([(START + i * DAY, float(i % 3), 5.0) for i in range(60)], "date date, v double, c double")
    day = spark.createDataFrame([(START + 50 * DAY, 9.0, 5.0)], "date date, v double, c double")  # later history doesn't count
    past = [float(i % 3) for i in range(50)]
    got = evaluation.z_of_day(day, history, ["v", "c"]).first()
    assert math.isclose(got["z_v"], (9 - np.mean(past)) / np.std(past)) and got["z_c"] is None
    assert evaluation.z_of_day(day, history.limit(5), ["v"]).first()["z_v"] is None
