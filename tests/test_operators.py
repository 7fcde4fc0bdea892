"""Operators on small hand-made frames: gaps, ties, nulls, caps, merges, gates."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidelake.functions import scores as C
from tidelake.operators import asof, backtest, mapping, portfolio, quality, regimes, stats, universe
from tidelake.operators import statistics as T
from tidelake.operators import windows as W
from tidelake.sources import catalog, panel

D = [dt.date(2024, 1, 1) + dt.timedelta(days=i) for i in range(60)]


def frame(spark, values, column="close", key="a"):
    return spark.createDataFrame([(key, D[i], v) for i, v in enumerate(values) if v != "gap"], f"asset_id string, date date, {column} double")


def column(df, name, order="date"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_returns_over_gaps(spark):
    d = frame(spark, [1.0, "gap", 3.0, 0.0, 2.0])
    r = lambda mode: column(d.withColumn("r", W.simple_return("close", W.by(), gap=mode)), "r")
    assert r("bridge") == [None, 2.0, -1.0, None]
    assert r("break") == [None, None, -1.0, None]
    dense = panel.densify(d)
    assert column(dense.withColumn("r", W.simple_return("close", W.by(), gap="pad")), "r") == [None, 0.0, 2.0, -1.0, None]


def test_windows_equal_pandas(spark):
    rng = np.random.default_rng(1)
    v = [None if i % 7 == 3 else round(float(x), 3) for i, x in enumerate(rng.normal(10, 3, 60))]
    d, s = frame(spark, v), pd.Series([math.nan if x is None else x for x in v])
    w = W.by()
    d = d.select("date", W.rolling("close", w, 10, F.avg, 5).alias("m"), W.rolling("close", w, 7, W.median, 4).alias("md"), W.zscore("close", w, 10, 5).alias("z"), W.rolling_pct_rank("close", w, 12, 6).alias("p"))
    r = s.rolling(10, min_periods=5)
    want = {"m": r.mean(), "md": s.rolling(7, min_periods=4).median(), "z": (s - r.mean()) / r.std(), "p": s.rolling(12, min_periods=6).apply(lambda x: pd.Series(x).rank(pct=True).iloc[-1])}
    for k, x in want.items():
        np.testing.assert_allclose([math.nan if y is None else y for y in column(d, k)], x.to_numpy(), rtol=1e-9, atol=1e-9)


def test_fills(spark):
    v = [None, 1.0, None, None, 2.0, None, None, None, None, 3.0, None, 4.0]
    d = frame(spark, v)
    assert column(d.withColumn("x", W.ffill("close", W.by(), 3)), "x") == [None, 1, 1, 1, 2, 2, 2, 2, None, 3, 3, 4]
    assert column(W.fill_whole_gaps(d, "close", 2), "filled") == [None, 1, 1, 1, 2, None, None, None, None, 3, 3, 4]
    assert column(d.withColumn("x", W.fill_single_gaps("close", W.by())), "x") == [None, 1, None, None, 2, None, None, None, None, 3, 3, 4]
    assert W.longest_run(d, F.col("close").isNull()).first()["longest"] == 4


def test_equity_survives_total_loss_and_worse(spark):
    d = frame(spark, [0.1, None, -1.5, 0.2, -1.0, 0.5], "r")
    assert column(d.withColumn("e", W.equity("r", W.by())), "e") == pytest.approx([1.1, 1.1, -0.55, -0.66, 0.0, 0.0])


def test_forward_return_needs_every_day(spark):
    d = frame(spark, [0.1, 0.2, None, 0.1, 0.1, 0.1], "r")
    assert column(d.withColumn("f", W.forward_compound("r", W.by(), 2)), "f") == [None, None, pytest.approx(0.21), pytest.approx(0.21), None, None]


def test_slingshot_marks(spark):
    d = frame(spark, [1.0, 3.0, 3.0, 1.0, 1.0, 3.0, 1.0]).withColumn("r", W.simple_return("close", W.by()))
    assert column(W.mark_slingshots(d, "r"), "anomaly") == [False, True, True, False, False, True, False]
    assert column(W.mark_slingshots(d, "r", through_fall=True, exclusive=True), "anomaly") == [False, True, True, True, False, True, True]


def test_ranks_and_buckets(spark):
    d = spark.createDataFrame([("g", 1.0), ("g", 2.0), ("g", 2.0), ("g", 4.0), ("g", None), ("h", 1.0)], "g string, x double")
    r = {(x["g"], x["x"]): x["k"] for x in d.withColumn("k", W.cross_rank("x", "g")).collect()}
    assert r[("g", 1.0)] == 0 and r[("g", 2.0)] == 0.5 and r[("g", 4.0)] == 1 and r[("g", None)] is None and r[("h", 1.0)] is None
    same = spark.createDataFrame([(1.0,)] * 5 + [(2.0,)], "x double")
    assert {x["bucket"] for x in W.quantile_buckets(same, "x", 4).collect()} <= {1, 2, 3, 4}
    c = spark.createDataFrame([(0.0,), (0.25,), (0.26,), (1.0,), (1.1,), (None,)], "x double").select("x", W.cut(F.col("x"), [0, 0.25, 0.5, 1]).alias("b"))
    assert {x["x"]: x["b"] for x in c.collect()} == {0.0: 0, 0.25: 0, 0.26: 1, 1.0: 2, 1.1: None, None: None}


def test_asof(spark):
    left = spark.createDataFrame([("a", 1), ("a", 5), ("b", 3)], "k string, t int")
    right = spark.createDataFrame([("a", 2, 20.0), ("a", 5, 50.0), ("a", 9, 90.0)], "k string, u int, v double")
    rows = {(r["k"], r["t"]): r["v"] for r in asof.backward(left, right, "t", "u", ["k"], ["v"]).collect()}
    assert rows == {("a", 1): None, ("a", 5): 50.0, ("b", 3): None}
    assert {(r["k"], r["t"]): r["v"] for r in asof.backward(left, right, "t", "u", ["k"], ["v"], strict=True).collect()}[("a", 5)] == 20.0
    assert asof.latest_per_key(right, ["k"], "u", F.lit(8)).first()["v"] == 50.0


def test_turnover(spark):
    s = spark.createDataFrame([(D[0], "a", 0.5), (D[0], "b", 0.5), (D[5], "b", 0.5), (D[5], "c", 0.5)], "rebalance_date date, asset_id string, weight double")
    r = W.turnover(s).orderBy("rebalance_date").collect()
    assert [(x["turnover"], x["entered"], x["exited"]) for x in r] == [(1.0, 2, 0), (0.5, 1, 1)]


def capped(w, cap):
    w = np.array(w) / sum(w)
    for _ in range(100):
        over = w >= cap
        excess = (w[over] - cap).sum()
        if excess <= 1e-12 or over.all():
            break
        w = np.where(over, cap, w * (1 + excess / w[~over].sum()))
    return w


def test_weights_cap(spark):
    sizes = [50.0, 20.0, 10.0, 8.0, 7.0, 5.0]
    d = spark.createDataFrame([(D[0], f"a{i}", s) for i, s in enumerate(sizes)], "rebalance_date date, asset_id string, m double")
    got = [r["weight"] for r in universe.weights(d, "rebalance_date", "m", "cap", 0.25).orderBy("asset_id").collect()]
    np.testing.assert_allclose(got, capped(sizes, 0.25))
    all_over = [r["weight"] for r in universe.weights(d, "rebalance_date", "m", "cap", 0.1).orderBy("asset_id").collect()]
    np.testing.assert_allclose(all_over, np.array(sizes) / 100)  # the cap cannot hold: uncapped


def test_eligibility_reasons(spark):
    d = spark.createDataFrame([(1, 1), (0, 1), (1, 0), (0, 0), (None, 1)], "a int, b int")
    rules = [("no_a", F.col("a") == 1), ("no_b", F.col("b") == 1)]
    assert [r["exclusion_reason"] for r in universe.eligibility(d, rules).collect()] == [None, "no_a", "no_b", "no_a", "no_a"]
    legacy = universe.eligibility(d, rules, ["no_a"]).collect()
    assert [(r["eligible"], r["exclusion_reason"]) for r in legacy][2] == (False, None)


def test_calendars(spark):
    assert [r[0] for r in universe.rebalance_dates(spark, "2024-01-10", "2024-08-01", 1, 3).collect()] == [dt.date(2024, 4, 1), dt.date(2024, 7, 1)]
    assert [r[0] for r in universe.weekly_dates(spark, "2024-01-04", "2024-01-18").collect()] == [dt.date(2024, 1, 4), dt.date(2024, 1, 11), dt.date(2024, 1, 18)]


def test_gate_and_machine(spark):
    d = spark.createDataFrame([("s", D[i], float(x)) for i, x in enumerate([0, 2, 4.5, 5.5, 3, -1, 2])], "series string, date date, x double")
    x = F.col("x")
    assert column(regimes.sticky_gate(d, x.between(1, 4), (x < 0) | (x > 5)), "active") == [False, True, True, False, True, False, True]
    m = regimes._machine([1.0, 1.0, 1.0, 1.0, None, -1, -1, -1, -1, -1, 0], [-0.3, 0.3], 0.05, 3)
    assert m == [1, 1, 2, 2, 2, 2, 2, 2, 2, 0, 0]


def test_scores(spark):
    d = spark.createDataFrame([(x,) for x in (None, 1.0, 3.5, 10.0, 25.0, 40.0)], "x double")
    assert [r[0] for r in d.select(C.risk_weight(F.col("x"))).collect()] == [None, 0.0, 0.5, 1.0, 0.5, 0.0]
    assert [r[0] for r in d.select(C.clamp(F.col("x"), 2, 20)).collect()] == [None, 2.0, 3.5, 10.0, 20.0, 20.0]
    assert [r[0] for r in spark.createDataFrame([("green",), ("odd",), (None,)], "x string").select(C.bucket_to_1_5(F.col("x"))).collect()] == [5, 3, 3]


def test_robust_means(spark):
    d = spark.createDataFrame([("g", float(x)) for x in (1, 2, 3, 4, 100)] + [("h", 5.0)], "g string, x double")
    assert {r["g"]: r["mean"] for r in stats.interquartile_mean(d, ["g"], "x").collect()} == {"g": 3.0, "h": 5.0}
    assert {r["g"]: r["spread"] for r in stats.floor_spread(d, ["g"], "x").collect()} == {"g": 2.0, "h": None}


def test_symbols(spark):
    d = spark.createDataFrame([("1000abcUSDT",), ("btcUSD",), ("XYZ",)], "s string").select(mapping.parse_instrument(F.upper("s")).alias("i")).select("i.*")
    assert [tuple(r) for r in d.collect()] == [(1000.0, "ABC", "USDT"), (1.0, "BTC", "USD"), (1.0, "XYZ", None)]
    n = spark.createDataFrame([(" btc-perp ",), ("a/b:c",)], "s string").select(mapping.normalize_symbol(F.col("s")))
    assert [r[0] for r in n.collect()] == ["BTC", "ABC"]
    payload = spark.createDataFrame([('{"symbols":[{"symbol":"AUSDT","baseAsset":"A","quoteAsset":"USDT","contractType":"PERPETUAL","onboardDate":1704153600000},{"symbol":"B","quoteAsset":"X","contractType":"PERPETUAL"}]}',)], "payload string")
    assert [tuple(r) for r in mapping.perp_listings(payload).collect()] == [("AUSDT", "A", dt.date(2024, 1, 2))]


def test_merges_and_sinks(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    new = spark.createDataFrame([(2, "b"), (3, "c")], "k int, v string")
    rows = lambda d: sorted(tuple(r) for r in d.collect())
    assert rows(catalog.upsert(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(catalog.combine_first(old, new, ["k"])) == [(1, "a"), (2, "b"), (3, "c")]
    p = str(tmp_path / "t.parquet")
    catalog.overwrite(old, p)
    catalog.replace_atomically(catalog.upsert(spark.read.parquet(p), new, ["k"]), p)
    assert spark.read.parquet(p).count() == 3
    day = spark.createDataFrame([(D[0], 1)], "date date, x int")
    q = str(tmp_path / "s.parquet")
    catalog.append_new_dates(day, q)
    catalog.append_new_dates(day, q)
    assert spark.read.parquet(q).count() == 1
    (tmp_path / "w.csv").write_text("date,aa,bb\n2024-01-01,1,\n2024-01-02,2,3\n")
    assert catalog.load_prices(spark, str(tmp_path / "w.csv"), ["aa", "bb"]).count() == 3
    assert catalog.create_views(spark, str(tmp_path), ["t", "missing"], {"u": "t"}) == ["t", "u"]
    assert catalog.run_sql(spark, "SELECT 1; SELECT ';' AS x FROM u")[1].count() == 3
    assert catalog.deep_merge({"a": {"b": 1, "c": 2}, "l": [1]}, {"a": {"b": 3}, "l": [2]}) == {"a": {"b": 3, "c": 2}, "l": [2]}


def test_require_unique(spark):
    d = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    with pytest.raises(ValueError):
        panel.require_unique(d, ["k"])
    assert panel.require_unique(d.distinct(), ["k"]).count() == 2


def test_clean_panel_logs_every_edit(spark):
    d = spark.createDataFrame([("a", D[0], 1.0, 1.0, 1.0), ("a", D[1], -2.0, -1.0, 1.0), ("a", D[2], 2.0, 1.0, 500.0)], "asset_id string, date date, close double, marketcap double, volume double")
    clean, log = quality.clean_panel(d)
    assert [tuple(r[2:]) for r in clean.orderBy("date").collect()] == [(1.0, 1.0, 1.0), (None, None, 1.0), (2.0, 1.0, None)]
    assert sorted((r["dataset"], r["rule"], r["old_value"]) for r in log.collect()) == [("close", "not_positive", -2.0), ("marketcap", "negative", -1.0), ("volume", "spike", 500.0)]


def test_gates(spark):
    d = spark.createDataFrame([(D[0], 0.5), (D[7], None), (D[15], 9.0)], "decision_date date, v double")
    assert tuple(quality.weekly_gate(d, "v", 0.1, 1.0).first()) == (1, 1, 1, 1)
    with pytest.raises(ValueError):
        quality.require_clean(quality.weekly_gate(d, "v", 0.1, 1.0))
    with pytest.raises(ValueError):
        quality.silver_funding(spark.createDataFrame([], "asset_id int, instrument_id int, exchange string, date date, rate double"), "2024-01-01")
    assert quality.schema_problems(d, "decision_date date, v string, x int") == ["missing x", "type of v"]
    assert quality.overall_status({"a": "warn"}, "smoke") == "ok"


def test_backtest_policies(spark):
    r = spark.createDataFrame([("a", D[1], 0.1), ("b", D[1], None), ("a", D[2], 0.1), ("b", D[2], 0.3)], "asset_id string, date date, r double")
    s = spark.createDataFrame([(D[0], "a", 0.5), (D[0], "b", 0.5)], "rebalance_date date, asset_id string, weight double")
    get = lambda p: column(backtest.basket_returns(r, s, p), "r_basket")
    assert get("nan") == [None, pytest.approx(0.2)] and get("renormalize") == [pytest.approx(0.1), pytest.approx(0.2)] and get("conservative_zero") == [pytest.approx(0.05), pytest.approx(0.2)]
    major = spark.createDataFrame([(D[1], 0.0), (D[2], 0.0)], "date date, r_major double")
    assert column(backtest.long_short(r, s, major, "conservative_zero"), "cost") == [pytest.approx(0.001), 0.0]


def test_chained_index_has_no_jump(spark):
    p = spark.createDataFrame([(k, D[i], v) for k, vs in {"a": [10.0, 11.0, 12.0, 12.0], "b": [20.0, 20.0, 20.0, 22.0]}.items() for i, v in enumerate(vs)], "asset_id string, date date, close double")
    w = spark.createDataFrame([(D[0], "a", 1.0), (D[0], "b", 1.0), (D[2], "b", 1.0)], "rebalance_date date, asset_id string, weight double")
    assert column(backtest.chained_index(p, w, 100.0), "level") == pytest.approx([100, 105, 110, 121])


def test_statistics():
    assert T.p_value(2.0, 10) == pytest.approx(0.07338803, abs=1e-6) and T.p_value(0.0, 5) == pytest.approx(1.0)
    x = np.random.default_rng(0).normal(size=(80, 6)) * [1, 1, 1, 2, 2, 3]
    cov, shrink = T.shrunk_covariance(x)
    assert 0 <= shrink <= 1
    w = T.min_variance(cov, 0.4)
    assert w.sum() == pytest.approx(1) and w.max() <= 0.4 + 1e-6 and w @ cov @ w <= np.full(6, 1 / 6) @ cov @ np.full(6, 1 / 6)
    d = np.abs(np.subtract.outer([0, 0.1, 5, 5.1, 9.0], [0, 0.1, 5, 5.1, 9.0]))
    assert T.average_linkage(d, 3).tolist() == [0, 0, 1, 1, 2]
    t = np.linspace(0, 1, 30)
    np.testing.assert_allclose(T.lowess(t, 2 * t + 1), 2 * t + 1, atol=1e-9)


def _least_pair(cov, longs, shorts, left):
    def variance(w):
        return w @ cov @ w

    best = None
    for a in left:
        for b in left:
            if a != b:
                w = np.zeros(len(cov))
                w[longs + [a]] = 1 / (len(longs) + 1)
                w[shorts + [b]] = -1 / (len(shorts) + 1)
                if best is None or variance(w) < best[0]:
                    best = variance(w), a, b
    return best[1:]


def test_long_short_baskets(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(40, 9)) + rng.normal(size=(40, 1)) * rng.uniform(0, 2, 9)
    cov = T.shrunk_covariance(x)[0]
    longs, shorts, left = [], [], list(range(9))
    for _ in range(3):
        a, b = _least_pair(cov, longs, shorts, left)
        longs, shorts, left = longs + [a], shorts + [b], [i for i in left if i not in (a, b)]
    assert T.greedy_sides(cov, 3) == (longs, shorts)
    at = longs + shorts
    w = T.long_short_variance(cov[np.ix_(at, at)], 3, 0.3)
    assert w[:3].sum() == pytest.approx(0.5) and w[3:].sum() == pytest.approx(-0.5) and np.abs(w).max() <= 0.3 + 1e-6
    sub, equal = cov[np.ix_(at, at)], np.array([1 / 6] * 3 + [-1 / 6] * 3)
    assert w @ sub @ w <= equal @ sub @ equal
    load = T.first_component(cov)[1]
    low, high = T.factor_neutral_sides(cov, 3)
    assert load[low].max() <= load[[i for i in range(9) if i not in low]].min() and load[high].min() >= load[[i for i in range(9) if i not in high]].max()
    rows = [("g", i, D[0] + dt.timedelta(days=t), float(x[t, i])) for t in range(40) for i in range(9)] + [("few", 1, D[0], 0.1)]
    df = spark.createDataFrame(rows, "g string, asset_id long, date date, r double")
    got = T.long_short_baskets(df, "g", "asset_id", "date", "r", n=3).collect()
    assert len(got) == 4 * 6 and {r["g"] for r in got} == {"g"}
    assert [r["asset_id"] for r in got if r["method"] == "greedy" and r["weighting"] == "equal"] == at
    assert T.long_short_baskets(df.limit(0), "g", "asset_id", "date", "r").count() == 0


def test_bucket_curves_trim_and_leave_out_assets_without_a_start(spark):
    rows = [(i, D[0], 10.0) for i in range(9)] + [(i, D[1], 10.0 + i) for i in range(9)] + [(99, D[1], 1e6), (3, D[0] + dt.timedelta(days=40), 1.0)]
    p = spark.createDataFrame(rows, "asset_id long, date date, close double")
    got = stats.bucket_curves(p, p.select("asset_id", F.lit(1).alias("bucket")).distinct(), F.lit(D[0]), 20).orderBy("date").collect()
    assert [(r["date"], r["n"]) for r in got] == [(D[0], 9), (D[1], 9)] and got[1]["mean"] == pytest.approx(0.4)


def test_portfolio(spark):
    o = spark.createDataFrame([("x", "SHORT", 10.0, 100.0, D[0])], "ticker string, side string, entry_price_usd double, notional_usd double, entry_date_utc date")
    t = portfolio.trade_rows(o, 0.5, 30).first()
    assert (t["quantity"], t["stop_price_usd"], t["exit_date_target_utc"]) == (10.0, 15.0, dt.date(2024, 1, 31))
    assert portfolio.close_trade(o, 8.0).first()["pnl_usd"] == pytest.approx(20.0)
    with pytest.raises(ValueError):
        portfolio.pick_single_open(portfolio.trade_rows(o.union(o), 0.5, 30), "x")


def test_replacing_survives_a_crash_between_renames(spark, tmp_path):
    import os

    from tidelake.sources import catalog

    path = str(tmp_path / "t")
    catalog.replace_atomically(spark.range(3), path)
    catalog.replace_atomically(spark.read.parquet(path).selectExpr("id + 1 as id"), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    os.rename(path, f"{path}.replaced")  # as a crash leaves it
    catalog.restore(spark, path)
    assert spark.read.parquet(path).count() == 3 and not os.path.exists(f"{path}.replaced")
    os.rename(path, f"{path}.replaced")
    catalog.replace_atomically(spark.range(1), path)
    assert spark.read.parquet(path).count() == 1 and not os.path.exists(f"{path}.replaced")


def test_market_methods_equal_those_of_one_matrix_without_holding_it(spark, monkeypatch):
    """More members than days, missing returns, copies; members meet in blocks of 16, so that clusters take rounds over pairs of blocks."""
    from tidelake.operators import market as M

    rng = np.random.default_rng(11)
    t, p = 12, 60
    x = rng.normal(size=(t, p)) + rng.normal(size=(t, 1)) * rng.uniform(0, 2, p)
    rows = [("g", i, D[0] + dt.timedelta(days=d), float(x[d, i])) for d in range(t) for i in range(p) if rng.random() < 0.9]
    rows += [("h", i, D[0] + dt.timedelta(days=d), float(d * i % 5)) for d in range(6) for i in range(7)]
    df = spark.createDataFrame(rows, "g string, asset_id long, date date, r double").repartition(5).cache()
    monkeypatch.setattr(M, "BLOCK", 16)
    for method in ("cov", "pca", "minvar", "cluster"):
        want = {(r["g"], r["asset_id"]): r["value"] for r in T.basket_matrix(df, "g", "asset_id", "date", "r", method).collect()}
        got = {(r["g"], r["asset_id"]): r["value"] for r in M.matrix(df, "g", "asset_id", "date", "r", method).collect()}
        own = [k for k in want if k[0] == "g" or method in ("cov", "minvar")]
        assert set(got) == set(want) and [got[k] for k in own] == pytest.approx([want[k] for k in own], abs=1e-6)
    assert M.matrix(df.limit(0), "g", "asset_id", "date", "r", "pca").count() == 0


def test_market_clusters_of_copies_and_matrix_never_formed(spark, monkeypatch):
    from tidelake.operators import market as M

    base = np.random.default_rng(4).normal(size=(5, 10))
    rows = [("g", 5 * c + i, D[0] + dt.timedelta(days=d), float(base[i, d])) for c in range(40) for i in range(5) for d in range(10)]
    df = spark.createDataFrame(rows, "g string, asset_id long, date date, r double")
    monkeypatch.setattr(M, "BLOCK", 64)
    monkeypatch.setattr(T, "shrunk_covariance", None)  # fails if a matrix of all members is asked for
    got = {r["asset_id"]: int(r["value"]) for r in M.matrix(df, "g", "asset_id", "date", "r", "cluster", k=5).collect()}
    assert got == {i: i % 5 for i in range(200)}
    assert T.long_short_baskets(df, "g", "asset_id", "date", "r", n=3, least=5).count() == 24


def test_market_clusters_of_a_star_take_few_rounds(spark, monkeypatch):
    """All members are nearest to one that varies far more than they do, so that they join it one after the other."""
    from tidelake.operators import market as M

    rng = np.random.default_rng(5)
    x = rng.normal(size=(8, 120)) * 0.3 + np.arange(8)[:, None] % 3
    x[:, 0] = 40.0 * (np.arange(8) % 3)
    rows = [("g", i, D[0] + dt.timedelta(days=d), float(x[d, i])) for d in range(8) for i in range(120)]
    df = spark.createDataFrame(rows, "g string, asset_id long, date date, r double").repartition(3).cache()
    rounds, nearest = [], M._nearest

    def counted(c, n):
        rounds.append(n)
        assert len(rounds) <= 8
        return nearest(c, n)

    monkeypatch.setattr(M, "_nearest", counted)
    monkeypatch.setattr(M, "BLOCK", 32)
    monkeypatch.setattr(M, "TILE", 7, raising=False)
    monkeypatch.setattr(M, "HOT", 60, raising=False)
    got = {r["asset_id"]: r["value"] for r in M.matrix(df, "g", "asset_id", "date", "r", "cluster", k=6).collect()}
    want = {r["asset_id"]: r["value"] for r in T.basket_matrix(df, "g", "asset_id", "date", "r", "cluster", k=6).collect()}
    assert got == want and len(rounds) >= 2


def test_market_covariance_has_all_pairs(spark, monkeypatch):
    from tidelake.operators import market as M

    rng = np.random.default_rng(3)
    x = rng.normal(size=(9, 40)) @ np.diag(rng.uniform(0.1, 3, 40))
    rows = [("g", 7 * i - 100, D[0] + dt.timedelta(days=d), float(x[d, i])) for d in range(9) for i in range(40)] + [("h", 5, D[0], 1.0), ("h", 5, D[1], 2.0)]
    df = spark.createDataFrame(rows, "g string, asset_id long, date date, r double").repartition(5)
    monkeypatch.setattr(M, "BLOCK", 16)
    monkeypatch.setattr(M, "STEP", 5)
    got = np.zeros((40, 40))
    found = M.covariance(df, "g", "asset_id", "date", "r").collect()
    for r in found:
        if r["g"] == "g":
            assert r["asset_id"] == 7 * r["place"] - 100
            at = r["first"] + np.arange(len(r["value"]))
            got[r["place"], at] = got[at, r["place"]] = r["value"]
    assert got == pytest.approx(T.shrunk_covariance(x)[0], abs=1e-9) and sum(len(r["value"]) for r in found if r["g"] == "g") == 40 * 41 // 2
    assert [(r["asset_id"], r["place"], r["first"], r["value"]) for r in found if r["g"] == "h"] == [(5, 0, 0, [0.25])]
    assert M.covariance(df.limit(0), "g", "asset_id", "date", "r").count() == 0


def test_cov_shrink_has_all_pairs_of_assets(spark, tmp_path):
    from tidelake.plans import registry

    events = [(i, dt.datetime(2024, 1, 1 + i // 4), i % 4, float(1 + (i * i + 3 * i) % 11)) for i in range(40)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    rows = registry.QUERIES["cov_shrink"](spark, str(tmp_path)).collect()
    assert sorted((r["asset_id"], len(r["value"])) for r in rows) == [(0, 1), (1, 2), (2, 3), (3, 4)]
