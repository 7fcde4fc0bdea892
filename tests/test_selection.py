"""Quantiles and ranks of whole tables, dense calendars in one shuffle, sweeps."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelake.operators import selection as S


def values(kind, n=30_000, seed=1):
    r = random.Random(seed)
    return {
        "spread": lambda: [r.uniform(-1, 1) * 10 ** r.uniform(-200, 200) for _ in range(n)],
        "ties": lambda: [float(r.choice([1, 1, 1, 2, 3, 7])) for _ in range(n)],
        "hot": lambda: [5.0] * (n // 2) + [r.gauss(5, 1) for _ in range(n - n // 2)],
        "one": lambda: [3.25] * n,
        "few": lambda: [r.random() for _ in range(7)],
    }[kind]()


@pytest.mark.parametrize("kind", ["spread", "ties", "hot", "one", "few"])
def test_order_statistics_are_exact(spark, kind):
    v = values(kind)
    df = spark.createDataFrame([(x,) for x in v] + [(None,)] * 5, "x double").repartition(4)
    want, n = sorted(v), len(v)
    ranks = sorted({0, 1, n // 3, n // 2, n // 2 + 1, n - 2, n - 1})
    got = S.order_statistics(df, "x", ranks, few=50)
    assert got == {r: want[r] for r in ranks}
    shares = [0.0, 0.01, 0.25, 0.5, 0.999, 1.0]
    exact = df.agg(F.percentile("x", F.array(*map(F.lit, shares))).alias("q")).first()["q"]
    assert S.quantiles(df, "x", shares, few=50) == exact
    assert S.quantiles(df.limit(0), "x", [0.5]) == [None] and S.order_statistics(df.limit(0), "x", [0]) == {}


def test_ranks_of_a_whole_table(spark):
    v = values("hot", 4000) + [float("inf"), -0.0]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)] + [(-1, None)], "id long, x double").repartition(7)
    a = np.array(v)
    order = np.sort(a)
    low = {i: int(np.searchsorted(order, x)) + 1 for i, x in enumerate(v)} | {-1: None}
    high = {i: len(v) - int(np.searchsorted(order, x, side="right")) + 1 for i, x in enumerate(v)} | {-1: None}
    mean = {i: (int(np.searchsorted(order, x)) + 1 + int(np.searchsorted(order, x, side="right"))) / 2 for i, x in enumerate(v)} | {-1: None}
    for options, want in (({}, low), ({"descending": True}, high), ({"average": True}, mean)):
        assert {r["id"]: r["rank"] for r in S.ranked(df, "x", **options).collect()} == want
    assert S.ranked(df.limit(0), "x").columns == ["id", "x", "rank"]


def test_dense_calendars_take_one_shuffle_of_sparse_rows(spark):
    from tidelake.operators import windows as W
    from tidelake.sources import panel

    rows = [(1, "2024-01-01", 1.0), (1, "2024-01-04", 4.0), (2, "2024-01-03", 3.0), (2, "2024-01-03", 3.5), (3, None, 9.0), (None, "2024-01-02", 0.5)]
    df = spark.createDataFrame(rows, "asset_id int, date string, close double").withColumn("date", F.to_date("date"))
    got = [(r["asset_id"], r["date"].day, r["close"]) for r in panel.densify(df).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1, 1.0), (1, 2, None), (1, 3, None), (1, 4, 4.0), (2, 3, 3.0), (2, 3, 3.5), (None, 2, 0.5)], key=repr)
    got = [(r["asset_id"], r["date"].day, r["close"]) for r in panel.align(df.where("asset_id < 3")).collect()]
    assert sorted(got, key=repr) == sorted([(1, 1, 1.0), (1, 2, None), (1, 3, None), (1, 4, 4.0), (2, 1, None), (2, 2, None), (2, 3, 3.0), (2, 3, 3.5), (2, 4, None)], key=repr)
    assert panel.densify(df.limit(0)).count() == panel.align(df.limit(0)).count() == 0
    filled = panel.densify(df).withColumn("v", W.ffill("close", W.by(), 3))
    plan = filled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_sweep_counts_each_row_once_between_thresholds(spark):
    import math

    from tidelake.operators import statistics as T

    r = random.Random(3)
    rows = [(r.choice([None, r.gauss(0, 1), 0.25]), r.choice([None, r.gauss(0, 0.01)])) for _ in range(500)]
    got = {x["i"]: x for x in T.threshold_sweep(spark.createDataFrame(rows, "s double, r double"), "s", "r", 10).collect()}
    s = np.array([a for a, _ in rows if a is not None])
    for i, th in enumerate(np.quantile(s, np.arange(11) / 10)):
        up = [b for a, b in rows if a is not None and a >= got[i]["threshold"]]
        down = [b for a, b in rows if a is not None and a < got[i]["threshold"]]
        assert math.isclose(got[i]["threshold"], th) and got[i]["n_above"] == len(up)
        for name, part in (("above", up), ("below", down)):
            known = [math.log1p(b) for b in part if b is not None]
            assert (got[i][name] is None) == (not known) and (not known or math.isclose(got[i][name], math.expm1(sum(known)), abs_tol=1e-9))
    assert T.threshold_sweep(spark.createDataFrame([], "s double, r double"), "s", "r", 10).count() == 0


def test_gaps_are_filled_on_sparse_rows_alone(spark, tmp_path, monkeypatch):
    """The registered gap queries against dense windows, with assets that begin, end or consist without a value; no window may run over added days."""
    import datetime as dt

    from tidelake.operators import windows as W
    from tidelake.plans import registry, rolling
    from tidelake.sources import panel

    r = random.Random(5)
    day = dt.date(2024, 1, 1)
    rows = [(a, day + dt.timedelta(days=i), None if a == 9 or r.random() < 0.3 else float(r.randint(0, 3))) for a in range(10) for i in range(40) if r.random() < 0.4]
    df = spark.createDataFrame(rows, "asset_id int, date date, close double").cache()
    monkeypatch.setattr(rolling, "p3", lambda spark, sf: df)
    w = W.by()
    d = panel.densify(df)
    falling = W.Window.partitionBy("asset_id").orderBy(F.desc("date"))
    f = d.withColumn("f", W.ffill("close", w)).withColumn("v", F.coalesce("f", W.bfill("f", falling)))
    prev = F.last("close", ignorenulls=True).over(w.rowsBetween(W.Window.unboundedPreceding, -1))
    back = F.when((F.col("close") != 0) & (F.col("p") != 0), (F.col("close") / F.col("p") - 1) * 100)
    dense = {
        "fill_both": f.select("asset_id", "date", registry.rnd("v", 4).alias("v")),
        "ffill3": d.withColumn("v", W.ffill("close", w, 3)).select("asset_id", "date", registry.rnd("v", 4).alias("v"), (F.col("close").isNull() & F.col("v").isNotNull()).alias("is_ffilled")),
        "gap_fill_whole": W.fill_whole_gaps(d, "close", 2).select("asset_id", "date", registry.rnd("filled", 4).alias("v")),
        "gap_fill_1d": d.select("asset_id", "date", registry.rnd(W.fill_single_gaps("close", w), 4).alias("v")),
        "ret_1d_pad": d.select("asset_id", "date", registry.rnd(W.simple_return("close", w, gap="pad")).alias("ret")),
        "ret_vs_last_nonnull": d.withColumn("p", prev).select("asset_id", "date", registry.rnd(back, 4).alias("ret")),
        "longest_null_run": W.longest_run(d, F.col("close").isNull()),
    }
    for name, want in dense.items():
        got = registry.QUERIES[name](spark, "")
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())), name
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        top = min((plan.find(x) for x in ("Generate", "Aggregate") if x in plan), default=-1)
        assert "Window" not in plan[:top], name
    assert rows and d.count() > len(rows)


def test_silver_prices_mark_added_days_of_a_slingshot(spark):
    import datetime as dt

    from tidelake.operators import quality, windows as W
    from tidelake.sources import panel

    r = random.Random(6)
    day = dt.date(2024, 1, 1)
    rows = [(a, day + dt.timedelta(days=i), None if r.random() < 0.05 else r.choice([1.0, 1.1, 5.0, 20.0, 0.2])) for a in range(30) for i in range(60) if r.random() < 0.8]
    df = spark.createDataFrame(rows, "asset_id int, date date, close double").cache()
    d = panel.densify(df).withColumn("_r", W.simple_return("close", W.by()))
    d = W.mark_slingshots(d, "_r", out="x")
    want = {(q["asset_id"], q["date"]): (q["x"], None if q["x"] else q["close"]) for q in d.collect()}
    s = quality.silver_prices(df)
    assert {(q["asset_id"], q["date"]): (q["is_winsorized"], q["close"]) for q in s.collect()} == want
    assert sum(q["close"] is None and q["x"] for q in d.collect()) and "Window" not in s._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]


def test_a_table_is_computed_once_for_edges_and_rows(spark, monkeypatch):
    """Values whose last bits change from one computation to the next, as sums of doubles do, keep their bucket and their rank."""
    from tidelake.operators import statistics as T, windows as W

    df = spark.range(4001).select("id", F.col("id").cast("double").alias("x"))
    noisy = df.withColumn("x", F.col("x") + F.udf(lambda: random.random() * 1e-3, "double").asNondeterministic()())
    b = {r["id"]: r["bucket"] for r in W.quantile_buckets(noisy, "x", 4).collect()}
    assert [sum(v == k for v in b.values()) for k in (1, 2, 3, 4)] == [1001, 1000, 1000, 1000]
    assert sorted(r["rank"] for r in S.ranked(noisy, "x").collect()) == list(range(1, 4002))
    w = T.wilcoxon(noisy.withColumn("x", F.col("x") + 1), "x").first()
    assert w["w"] == 4001 * 4002 / 2 and w["n"] == 4001
    assert sum(r["n_above"] == 0 for r in T.threshold_sweep(noisy, "x", "x", 4).collect()) == 0
