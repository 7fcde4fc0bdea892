"""Monitors, reports, category names, stable samples."""

from __future__ import annotations

import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tidelake.operators import mapping, monitors
from tidelake.sources import catalog


def test_monitors_share_one_result(spark):
    rows = [("s", dt.date(2024, 1, 1) + dt.timedelta(days=i), 1.0 if i % 4 else -1.0, float(i), 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "series string, date date, f double, a double, b double")
    mine = [monitors.Persistence("t_persistence", "f", 8, 4), monitors.RelativeValue("t_relative", "a", "b", 5)]
    for m in mine:
        monitors.register(m)
        monitors.register(m)
    got = {(r["monitor"], r["date"]): (r["score_raw"], r["regime_1_5"]) for r in monitors.run(df, ["t_persistence", "t_relative"]).collect()}
    last, first = rows[-1][1], rows[0][1]
    assert len(got) == 100 and got["t_persistence", last] == (0.75, 4) and got["t_persistence", first] == (None, None)
    assert got["t_relative", last] == (1.0, 5) and got["t_relative", rows[4][1]] == (None, None) and got["t_relative", first] == (None, None)
    with pytest.raises(ValueError, match="there is a monitor"):
        monitors.register(monitors.Persistence("t_relative", "f"))
    with pytest.raises(KeyError, match="no monitor"):
        monitors.run(df, ["absent"])
    with pytest.raises(ValueError, match="needs"):
        monitors.run(df.drop("a"), ["t_relative"])


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a|b"), (2, None), (3, "x\ny")], "n int, t string").orderBy("n")
    assert catalog.markdown(df) == "| n | t |\n|---|---|\n| 1 | a\\|b |\n| 2 |  |\n| 3 | x y |\n"
    assert catalog.markdown(df, 1).splitlines()[2:] == ["| 1 | a\\|b |", "| ... 2 more rows |  |"] and len(catalog.markdown(df.limit(0)).splitlines()) == 2
    catalog.write_json(df, f"{tmp_path}/j")
    assert sorted(r["value"] for r in spark.read.text(f"{tmp_path}/j").collect())[1] == '{"n":2,"t":null}'
    for _ in range(2):
        catalog.write_text(spark, catalog.receipt({"df": df}, {"b": 1, "a": dt.date(2024, 1, 1)}, {"load": "ok"}), f"{tmp_path}/r.json")
    got = json.load(open(f"{tmp_path}/r.json"))
    assert got["rows"] == {"df": 3} and got["steps"] == {"load": "ok"} and got["config"] == {"a": "2024-01-01", "b": 1} and len(got["config_hash"]) == 16


@pytest.mark.parametrize("seed", range(3))
def test_category_matches_equal_brute_force(spark, seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abAB -.") for _ in range(r.randint(0, 6)))
    names, cats = [word() for _ in range(60)] + ["", "!!", "ab", None], [(i, word()) for i in range(40)] + [(99, None), (100, "AB"), (101, "")]
    plain = lambda t: re.sub(r"[^a-z0-9]", "", t.lower())
    want = {}
    for n in names:
        hits = [(0 if n.lower() == c.lower() else 1 if plain(n) == plain(c) else 2, i) for i, c in cats if n is not None and c is not None and (n.lower() == c.lower() or plain(c) in plain(n) or plain(n) in plain(c))]
        want[n] = min(hits)[1] if hits else None
    got = mapping.match_category(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(cats, "category_id int, category_name string"))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert {x["name"]: x["category_id"] for x in got.collect()} == want


def test_samples_do_not_depend_on_partitions(spark):
    left = spark.range(500).withColumnRenamed("id", "k")
    got = [sorted(r["k"] for r in mapping.join_sanity(x, {"even": left.where("k % 2 = 0")}, "k").collect()) for x in (left.repartition(1), left.orderBy(F.rand(3)).repartition(7))]
    assert got[0] == got[1] and len(got[0]) == 20
