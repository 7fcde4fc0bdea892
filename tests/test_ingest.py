"""Versioned tables, catching up, event-time notices, landed payloads, state files."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidelake.sources.versioned import Conflict, VersionedTable, merge_stream


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_merges_touch_only_their_buckets(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t", ["k"], buckets=16)
    first = spark.createDataFrame([(k, 1, f"v{k}") for k in range(200)], "k long, at int, v string")
    assert t.merge(first, ["at"], "a") == 1
    before = t._entry(1)["buckets"]
    assert t.merge(spark.createDataFrame([(7, 2, "new"), (7, 0, "old"), (500, 1, "x")], "k long, at int, v string"), ["at"], "b") == 2
    after = t._entry(2)["buckets"]
    assert sum(before.get(b) != f for b, f in after.items()) <= 2
    assert rows_of(t.read()) == sorted([(k, 1, f"v{k}") for k in range(200) if k != 7] + [(7, 2, "new"), (500, 1, "x")], key=repr)
    assert rows_of(t.read(1)) == rows_of(first)  # as of a version
    assert t.history() == [(1, "a", len(before)), (2, "b", len(after))]


def test_a_batch_counts_once(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t", ["k"], buckets=4)
    rows = spark.createDataFrame([(1, 5, "a"), (2, 5, None)], "k long, at int, v string")
    assert [t.merge(rows, ["at"], "x"), t.merge(rows.withColumn("at", F.lit(9)), ["at"], "x")] == [1, 1]
    assert rows_of(t.read()) == rows_of(rows) and t.committed("x") == 1 and t.committed("y") is None


def test_merges_in_any_order_give_the_newest_rows(spark, tmp_path):
    r = random.Random(1)
    rows = [(r.randint(0, 40), at, r.choice(["p", None]), r.random()) for at in range(300)]
    newest = {}
    for row in rows:
        newest[row[0]] = row
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        t = VersionedTable(spark, f"{tmp_path}/t{seed}", ["k"], buckets=8)
        for i in range(0, 300, 100):
            t.merge(spark.createDataFrame(rows[i : i + 100], "k long, at int, s string, x double"), ["at"], i)
        assert rows_of(t.read()) == sorted(newest.values(), key=repr)


def test_new_columns_and_null_keys(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t", ["k"], buckets=4)
    t.merge(spark.createDataFrame([(1, 1), (None, 1)], "k long, at int"), ["at"], 1)
    t.merge(spark.createDataFrame([(None, 2, "x"), (3, 1, "y")], "k long, at int, v string"), ["at"], 2)
    assert rows_of(t.read()) == [(1, 1, None), (3, 1, "y"), (None, 2, "x")]
    t.merge(spark.createDataFrame([], "k long, at int"), ["at"], 3)
    assert t.version() == 3 and t.read().count() == 3


def test_a_writer_that_dies_and_a_second_writer(spark, tmp_path, monkeypatch):
    t = VersionedTable(spark, f"{tmp_path}/t", ["k"])
    t.replace(spark.createDataFrame([(1, 1)], "k long, v int"))
    monkeypatch.setattr(VersionedTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("killed")))
    with pytest.raises(OSError):
        t.replace(spark.createDataFrame([(2, 2)], "k long, v int"))
    monkeypatch.undo()
    assert rows_of(t.read()) == [(1, 1)] and t.version() == 1
    with pytest.raises(Conflict):
        t._commit(1, "other", t.read().schema, {})
    t.replace(t.read().withColumn("v", F.col("v") + 1))  # reads what it replaces
    assert rows_of(t.read()) == [(1, 2)] and len(t.vacuum()) == 2 and rows_of(t.read()) == [(1, 2)] and t.versions() == [2]


def test_keys_stay_unique_and_appends_add_columns(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/t", ["run"])
    t.append(spark.createDataFrame([("a", 0.5)], "run string, sharpe double"))
    t.append(spark.createDataFrame([("b", 0.7, 3)], "run string, sharpe double, trades int"))
    assert rows_of(t.read()) == [("a", 0.5, None), ("b", 0.7, 3)]
    with pytest.raises(ValueError, match="not unique"):
        t.append(spark.createDataFrame([("a", 1.0)], "run string, sharpe double"))
    assert len(t._entry(2)["buckets"]) == 2 and all(f in [*t._entry(2)["buckets"].values()] for f in t._entry(1)["buckets"].values())  # the old files stay
    again = VersionedTable(spark, t.path, ["other"], buckets=3)  # the ledger's keys hold
    assert again.keys == ("run",) and again.version() == 2


def test_a_stream_that_runs_twice_merges_once(spark, tmp_path):
    src = spark.createDataFrame([(k % 9, k, float(k)) for k in range(90)], "k long, at long, v double")
    for i in range(3):
        src.where(F.col("at") % 3 == i).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    t = VersionedTable(spark, f"{tmp_path}/t", ["k"], buckets=4)
    stream = lambda: spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    merge_stream(stream(), t, f"{tmp_path}/ck", ["at"])
    made = t.versions()
    merge_stream(stream(), t, f"{tmp_path}/ck", ["at"])
    assert t.versions() == made == [1, 2, 3] and rows_of(t.read()) == [(k, 81 + k, float(81 + k)) for k in range(9)]


# Event-time notices


def test_notices_do_not_depend_on_arrival(spark, tmp_path):
    """Micro-batches shuffled within the watermark's delay: what is settled and what waits is what a batch over all events in order gives."""
    from pyspark.sql import Window

    from tidelake.streaming import events as E
    from tidelake.streaming import notices as N

    all_ = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    place = F.floor((F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("ts")) - 1) / 250)
    parts = all_.withColumn("b", place).cache()
    for b in range(4):
        out = parts.where(F.col("b") == b).drop("b").orderBy(F.rand(b)).coalesce(1)
        out.write.parquet(f"{tmp_path}/p{b}")
    import glob
    import os
    import shutil
    import time

    os.makedirs(f"{tmp_path}/in")
    for b in range(4):
        shutil.copy(glob.glob(f"{tmp_path}/p{b}/*.parquet")[0], f"{tmp_path}/in/{b}.parquet")
        os.utime(f"{tmp_path}/in/{b}.parquet", (time.time() - 100 + b, time.time() - 100 + b))
    late = all_.orderBy("ts").limit(1).withColumn("event_id", F.lit(10**9).cast("long"))  # far too late: dropped
    late.coalesce(1).write.parquet(f"{tmp_path}/late")
    shutil.copy(glob.glob(f"{tmp_path}/late/*.parquet")[0], f"{tmp_path}/in/9.parquet")
    settled = E.run_available(N.notices(E.read(spark, f"{tmp_path}/in"), late="1 day", idle_days=2), "t", f"{tmp_path}/ck", "append")
    waiting = N.unsettled(spark, f"{tmp_path}/ck", idle_days=2)
    want = N.in_order(N.prepared(all_, 100.0), idle_days=2)
    got = rows_of(settled.unionByName(waiting))
    assert settled.count() > 0 and waiting.count() > 0
    assert got == rows_of(want) and {r[1] for r in got} == {"daily", "change"}


def test_a_key_that_was_idle_starts_anew(spark):
    from tidelake.streaming import notices as N

    day = 86_400_000_000
    x = spark.createDataFrame([(1, 0, 1, "LOW"), (1, day, 2, "HIGH"), (1, 40 * day, 3, "LOW"), (1, 40 * day + 5, 4, "LOW")], "key long, us long, event_id long, state string")
    assert [(r["kind"], r["event_id"], r["before"]) for r in N.in_order(x).orderBy("at", "kind").collect()] == [("daily", 1, None), ("change", 2, "LOW"), ("daily", 2, "LOW"), ("daily", 3, None)]


def test_notices_keep_state_in_few_rows(spark, tmp_path):
    """The rows of the state follow the shards, not the events; keys and ids may be null, an event may lie beyond what pandas takes for a time."""
    from tidelake.streaming import events as E
    from tidelake.streaming import notices as N

    n = F.col("id")
    made = spark.range(4000).select(
        n.alias("event_id"), F.timestamp_micros(F.lit(1_704_067_200_000_000) + n * 60_000_000 * F.when(n < 100, 1).otherwise(40)).cast("timestamp_ntz").alias("ts"), F.when(n % 5 > 0, n % 5).alias("user_id"),
        F.lit("view").alias("event_type"), ((n * 37) % 201).cast("double").alias("value"), F.lit("").alias("props"),
    )
    waits = spark.range(200).select((n + 5000).alias("event_id"), F.expr("timestamp_ntz '2024-06-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id)").alias("ts"), (n % 2 + 3).alias("user_id"), F.lit("view").alias("event_type"), (n % 3 * 90).cast("double").alias("value"), F.lit("").alias("props"))
    far = spark.sql("select bigint(null) event_id, timestamp_ntz '3000-01-01 00:00:00.000007' ts, 3L user_id, 'view' event_type, 500d value, '' props")
    for name, rows, shards in (("near", made.unionByName(waits), 2), ("far", made.unionByName(far), 1)):
        rows.coalesce(1).write.parquet(f"{tmp_path}/{name}")
        settled = E.run_available(N.notices(E.read(spark, f"{tmp_path}/{name}"), idle_days=2), name, f"{tmp_path}/{name}-ck", "append")
        waiting = N.unsettled(spark, f"{tmp_path}/{name}-ck", idle_days=2)
        want = N.in_order(N.prepared(spark.read.parquet(f"{tmp_path}/{name}").withColumn("ts", F.col("ts").cast("timestamp")), 100.0), idle_days=2)
        assert sorted(map(repr, settled.unionByName(waiting).collect())) == sorted(map(repr, want.collect()))
        assert settled.where("key is null").count() > 0 and waiting.count() > 0
        pending = spark.read.format("statestore").option("path", f"{tmp_path}/{name}-ck").option("stateVarName", "pending").load()
        assert 0 < pending.count() <= shards


# Catching up


def test_a_killed_run_resumes_without_double_rows(spark, tmp_path):
    import datetime as dt

    from tidelake.sources import catchup

    t, asked = VersionedTable(spark, f"{tmp_path}/t", ["day"], buckets=2), []

    def compute(a, b):
        asked.append((a.day, b.day))
        if a.day == 7 and asked.count((7, 9)) == 1:
            raise OSError("killed")
        return spark.createDataFrame([(a + dt.timedelta(days=k), k) for k in range((b - a).days + 1) if (a + dt.timedelta(days=k)).day != 2], "day date, v long")

    first, last = dt.date(2024, 1, 1), dt.date(2024, 1, 10)
    with pytest.raises(OSError):
        catchup.catch_up(t, compute, first, last, step=3)
    assert catchup.catch_up(t, compute, first, last, step=3) == 2 and catchup.catch_up(t, compute, first, last, step=3) == 0
    assert asked == [(1, 3), (4, 6), (7, 9), (7, 9), (10, 10)] and t.read().count() == 9  # the day without rows is done, too
    assert catchup.missing_runs(t, dt.date(2023, 12, 30), dt.date(2024, 1, 12), 30) == [(dt.date(2023, 12, 30), dt.date(2023, 12, 31)), (dt.date(2024, 1, 11), dt.date(2024, 1, 12))]


# Payloads


def landed(spark, rows):
    import datetime as dt

    from tidelake.sources import payloads

    return spark.createDataFrame([(k, key, dt.datetime(2024, 3, day), line) for k, key, day, line in rows], payloads.LANDED)


def test_payload_shapes(spark):
    import datetime as dt

    from tidelake.sources import payloads

    d1, d2, day = 1709251200000, 1709337600000, dt.date  # 1 and 2 March 2024
    x = landed(spark, [
        ("chart", "btc", 1, f'{{"prices": [[{d1}, 1], [{d1 + 5}, 2.5], [{d2}, null]], "total_volumes": [[{d2}, 7]]}}'),
        ("chart", "btc", 2, f'{{"prices": [[{d1}, 9]]}}'),
        ("ohlc", "eth", 1, f"[[{d1 + 9}, 5, 6, 1, 2], [{d1}, 3, 9, 2, 5], [{d2}, 1, 1, 1, null]]"),
        ("breadth", "24h", 2, '{"gainers": [{"symbol": "a", "change": 3.5}, {"symbol": "b"}], "losers": [{"symbol": "c", "change": -1}]}'),
        ("listings", "", 1, '[{"id": "x1", "symbol": "x", "name": "X"}, {"symbol": "none"}]'),
        ("listings", "", 3, '[{"id": "x1", "symbol": "y", "name": "renamed"}, {"id": "x2", "symbol": "z", "name": null}]'),
        ("exchange_volume", "ex", 1, f'[[{d1}, "12.5"], [{d1 + 1}, "13.5"]]'),
        ("trending", "", 1, '{"coins": [{"item": {"id": "t", "symbol": "t", "name": "T"}}]}'),
        ("categories", "", 1, '[{"category_id": "defi", "name": "DeFi"}]'),
        ("funding", "btc", 1, f'{{"code": "0", "data": [{{"time": {d1}, "close": "0.01"}}, {{"time": {d1 + 1}, "close": 0.03}}, {{"time": {d2}}}]}}'),
        ("open_interest", "btc", 1, f'{{"code": "0", "data": [{{"time": {d1 + 9}, "close": 5}}, {{"time": {d1}, "close": 6}}]}}'),
        ("liquidations", "btc", 1, f'{{"code": "0", "data": [{{"time": {d1}, "longLiquidationUsd": 0, "short_liquidation_usd": 0}}, {{"time": {d2}, "long_liquidation_usd": 4}}, {{"time": {d2 + 1}, "aggregated_short_liquidation_usd": "2"}}]}}'),
    ])
    got = {k: rows_of(payloads.facts(x, k)) for k in payloads.SHAPES}
    assert got["chart"] == [("btc", day(2024, 3, 1), "close", 9.0), ("btc", day(2024, 3, 2), "volume", 7.0)]
    assert got["ohlc"] == [("eth", day(2024, 3, 1), 3.0, 9.0, 1.0, 2.0)]
    assert got["breadth"] == [(day(2024, 3, 2), "24h", "gainer", 1, "A", 3.5), (day(2024, 3, 2), "24h", "gainer", 2, "B", None), (day(2024, 3, 2), "24h", "loser", 1, "C", -1.0)]
    assert got["listings"] == [("x1", "X", "X", day(2024, 3, 1)), ("x2", "Z", None, day(2024, 3, 3))]
    assert got["exchange_volume"] == [("ex", day(2024, 3, 1), 13.5)]
    assert got["trending"] == [(day(2024, 3, 1), 1, "t", "T", "T")] and got["categories"] == [("defi", "DeFi")]
    assert got["funding"] == [("btc", day(2024, 3, 1), 0.02)] and got["open_interest"] == [("btc", day(2024, 3, 1), 6.0)]
    assert got["liquidations"] == [("btc", day(2024, 3, 2), 4.0, 2.0)]
    assert payloads.rejected(x).count() == 0


def test_bad_payloads_are_kept_apart(spark):
    from tidelake.sources import payloads

    x = landed(spark, [
        ("funding", "a", 1, "<html>502"), ("funding", "b", 1, '{"code": "50001", "msg": "Rate limit"}'), ("funding", "c", 1, '{"code": "1", "msg": "Pair NOT FOUND"}'), ("funding", "d", 1, '{"code": "0", "data": []}'),
        ("ohlc", "e", 1, '{"error": 1}'), ("ohlc", "f", 1, "[[1, 2]]"), ("other", "g", 1, "[]"), (None, "h", 1, "[]"), ("funding", "i", 1, None), ("chart", "j", 1, '{"prices": "text"}'),
    ])
    assert rows_of(payloads.rejected(x).select("key", "reason", "retry")) == [
        ("a", "not json", False), ("b", "error: rate limit", True), ("c", "error: pair not found", False), ("d", "no data", False), ("e", "no data", False), ("f", "no data", False), ("g", "unknown kind", False), ("h", "unknown kind", False), ("i", "not json", False), ("j", "no data", False),
    ]
    assert all(payloads.facts(x, k).count() == 0 for k in payloads.SHAPES)


# State files


def state_db(path, n=1000):
    from tidelake.sources import state_files as S

    rows = [(f"2024-{1 + i // 28 % 12:02d}-{1 + i % 28:02d}-{i}", i, i / 2 if i % 7 else None, ("a", "b")[i % 2], i % 3 == 0) for i in range(n)]
    S.upsert_rows(path, "macro", ["decision_date", "n", "apr", "regime", "gate"], rows, "decision_date")
    return rows


def test_state_files_are_split_and_filtered_in_the_file(spark, tmp_path):
    from tidelake.sources import state_files as S

    path = f"{tmp_path}/s.db"
    rows = state_db(path)
    df = S.read(spark, path, "macro", rows=100)
    assert df.dtypes == [("decision_date", "string"), ("n", "bigint"), ("apr", "double"), ("regime", "string"), ("gate", "boolean")]
    assert df.rdd.getNumPartitions() == 10 and rows_of(df) == sorted(rows, key=repr)
    want = sorted((r for r in rows if r[1] > 900 and r[3] == "a" and r[2] is not None and r[4]), key=repr)
    conditions = [("n", ">", 900), ("regime", "=", "a"), ("apr", "not null")]
    assert rows_of(S.read(spark, path, "macro", where=conditions).where("gate")) == want
    assert rows_of(df.where("n > 900 and regime = 'a' and apr is not null and gate")) == want and df.count() == 1000  # a filtered read leaves the next one alone
    reader = S.SqliteReader(df.schema, {"path": path, "table": "macro", "rows": "100", "where": '[["n", "in", [1, 250, 251]], ["regime", "=", "a"]]'})
    assert [len(list(reader.read(p))) for p in reader.partitions()] == [0, 0, 1, 0, 0, 0, 0, 0, 0, 0]  # only one row leaves the file
    top = S.SqliteReader(df.schema, {"path": path, "table": "macro", "rows": "100", "newest": '["n", 2]'})
    assert [sum(b.num_rows for b in top.read(p)) for p in top.partitions()] == [2] * 10
    assert S.latest(spark, path, "macro", "n", 100).first()["n"] == 999 and [r["n"] for r in S.last_rows(spark, path, "macro", "n", 3, 100).collect()] == [997, 998, 999]
    assert [r["n"] for r in S.series(spark, path, "macro", "n", "apr", 980).collect()] == [i for i in range(980, 1000) if i % 7]
    for bad in ([("absent", "=", 1)], [("n", "like", 1)]):
        with pytest.raises(ValueError, match="no column|no operator"):
            S.clauses(df.schema, bad)


def test_state_files_upsert_by_key_and_grow(spark, tmp_path):
    import sqlite3

    from tidelake.sources import state_files as S

    path = f"{tmp_path}/s.db"
    S.upsert_rows(path, "t", ["d", "x"], [("2024-01-01", 1), ("2024-01-02", 2)], "d")
    S.upsert_rows(path, "t", ["d", "x", "y"], [("2024-01-02", 5, 0.5), ("2024-01-03", 6, None)], "d")
    assert rows_of(S.read(spark, path, "t")) == [("2024-01-01", 1, None), ("2024-01-02", 5, 0.5), ("2024-01-03", 6, None)]
    with sqlite3.connect(path) as con, pytest.raises(sqlite3.IntegrityError):
        con.execute("INSERT INTO t (d) VALUES ('2024-01-01')")
    assert [S.declared(map(S.parsed_value, c)) for c in (["1", "", "3"], ["1", "2.5"], ["true", "False"], ["x", "1"], ["", None])] == ["INTEGER", "REAL", "BOOLEAN", "TEXT", "TEXT"]
    S.upsert_rows(path, "none", ["d", "x"], [], "d")
    assert S.read(spark, path, "none").count() == 0 and S.latest(spark, path, "none", "d").count() == 0
    with pytest.raises(Exception, match="no table"):
        S.read(spark, path, "absent").count()


def test_several_state_files_are_one_source(spark, tmp_path):
    from tidelake.sources import state_files as S

    for k in range(3):
        S.upsert_rows(f"{tmp_path}/{k}.db", "t", ["d", "x"], [(f"{k}-{i}", i) for i in range(5)], "d")
    df = S.read(spark, f"{tmp_path}/*.db", "t", rows=2)
    assert df.count() == 15 and df.rdd.getNumPartitions() == 9


# Sketches


def test_sketches_of_any_range_keep_their_bounds(spark):
    from tidelake.operators import sketches as K

    n = 200_000
    facts = spark.range(n).select((F.col("id") % 30).alias("date"), (F.xxhash64("id") % 90_000).alias("who"), F.pow(F.col("id") / n, 3).alias("v"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("g"))
    daily = K.daily_sketches(facts, ["g"], "date", "who", "v").cache()
    assert daily.count() == 30
    for a, b in ((0, 29), (3, 3), (10, 19)):
        inside = facts.where(F.col("date").between(a, b))
        x = K.united(daily.where(F.col("date").between(a, b)), []).first()
        exact = inside.agg(F.count_distinct("who").alias("d"), F.avg((F.col("v") <= x["median"]).cast("double")).alias("m"), F.avg((F.col("v") <= x["p90"]).cast("double")).alias("p")).first()
        assert abs(x["hll"] - exact["d"]) <= K.HLL_BOUND * exact["d"] and abs(x["customers"] - exact["d"]) <= 2 / 2 ** (K.THETA / 2) * exact["d"]
        assert abs(exact["m"] - 0.5) <= K.KLL_BOUND and abs(exact["p"] - 0.9) <= K.KLL_BOUND
    o = K.overlap(daily.where("date < 3"), F.col("g") == "a", F.col("g") == "b").first()
    a, b = ({r["who"] for r in facts.where(f"date < 3 and g = '{g}'").select("who").distinct().collect()} for g in "ab")
    assert (o["a"], o["b"], o["both_"], o["only_a"]) == (len(a), len(b), len(a & b), len(a - b))  # exact below 2^16


def test_theta_sketches_beyond_their_entries(spark):
    from tidelake.operators import sketches as K

    x = K.united(K.daily_sketches(spark.range(300_000).select(F.lit(1).alias("date"), "id", F.rand(1).alias("v")), [], "date", "id", "v"), []).first()
    assert abs(x["customers"] - 300_000) <= 300_000 * 2 / 2 ** (K.THETA / 2) and abs(x["hll"] - 300_000) <= K.HLL_BOUND * 300_000


def test_sharded_sketches_are_exact_beyond_their_entries(spark):
    from tidelake.operators import sketches as K

    facts = spark.range(300_000).select((F.col("id") % 3).alias("date"), "id", F.rand(1).alias("v"), F.explode(F.array(F.lit("a"), F.when(F.col("id") % 5 == 0, F.lit("b")))).alias("g")).where("g is not null")
    n = K.shards_for(facts, "id")
    daily = K.daily_sketches(facts, ["g"], "date", "id", "v", n)
    x = K.united(daily, []).first()
    assert n > 8 and x["customers"] == 300_000 and x["n"] == 360_000 and abs(x["hll"] - 300_000) <= K.HLL_BOUND * 300_000 and abs(x["median"] - 0.5) <= 2 * K.KLL_BOUND
    assert tuple(K.overlap(daily, F.col("g") == "a", F.col("g") == "b").first()) == (300_000, 60_000, 60_000, 240_000)
    assert tuple(K.overlap(daily.where("false"), F.col("g") == "a", F.col("g") == "b").first()) == (0, 0, 0, 0)


def test_history_keeps_the_last_row_of_a_date_without_one_task(spark):
    from tidelake.operators import evaluation

    rows = [("2024-01-01", 3, "c"), ("2024-01-01 10:00:00", 7, None), ("2024-01-02", 1, "a"), (None, 9, "z"), ("no date", 9, "z"), ("2024-01-01", 5, "d")]
    df = spark.createDataFrame(rows, "decision_date string, v long, t string").repartition(4)
    h = evaluation.normalize_history(df.where("decision_date is null or decision_date not like 'no%'"), order="v")
    assert sorted(map(tuple, h.collect())) == [("2024-01-01", 7, None), ("2024-01-02", 1, "a")]
    plan = h._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Sort" not in plan


def test_panel_of_events_adds_up_in_their_order(spark, tmp_path):
    import datetime as dt

    from tidelake.plans import registry
    from tidelake.sources import panel

    r = random.Random(7)
    at = [dt.datetime(2024, 1, 1 + i % 2, 3) for i in range(12)]
    value = [None if i == 5 else round(r.random() * 1000, 2) for i in range(12)]
    rows = [(100 * u + i, at[i], u, value[i]) for u in range(50) for i in range(12)] + [(9999, at[0], 77, None)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, value double")
    df.orderBy(F.rand(3)).repartition(9).write.parquet(f"{tmp_path}/events.parquet")
    got = {(p["asset_id"], p["date"].day): (p["close"], p["volume"], p["marketcap"]) for p in panel.events_panel(spark, str(tmp_path)).collect()}
    assert got.pop((77, 1)) == (None, None, None)
    for d in (0, 1):
        total = 0.0
        for v in value[d::2]:
            total += v or 0.0
        n = sum(v is not None for v in value[d::2])
        assert {v for k, v in got.items() if k[1] == d + 1} == {(total / n, total, total / n * 6)}
    # of equally near days, and of equally high ones, the first
    days = [(i, dt.datetime(2024, 1, 1 + i), 1, v) for i, v in enumerate([60.0, 40.0, 90.0, 60.0, 90.0])]
    spark.createDataFrame(days, "event_id long, ts timestamp_ntz, user_id long, value double").write.parquet(f"{tmp_path}/b/events.parquet")
    n = registry.QUERIES["nearest_level"](spark, f"{tmp_path}/b").first()
    assert (n["nearest"], n["highest"]) == (dt.date(2024, 1, 1), dt.date(2024, 1, 3))
