"""Backtests. Weights hold from one rebalance to the next, so a day's weights are an as-of lookup, a day's return a grouped
sum, a rebalance's cost its turnover, and the equity a running product: joins and windows, no loop over days. Only the
engine whose stops depend on its own equity runs in grouped pandas, one group a parameter set."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows as W
from .windows import ratio


def holding_days(days: DataFrame, dates: DataFrame) -> DataFrame:
    """date, rebalance_date: the last rebalance before each day. Days and dates are one series, a row each, read in order; facts come in by their day."""
    both = days.select("date", F.lit(0).alias("_o"), F.lit(None).cast("date").alias("_r")).unionByName(dates.select(F.col("rebalance_date").alias("date"), F.lit(1).alias("_o"), F.col("rebalance_date").cast("date").alias("_r")))
    last = F.last("_r", ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("date", "_o").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("rebalance_date", last).where("_o = 0 and rebalance_date is not null").select("date", "rebalance_date")


def basket_returns(returns: DataFrame, snapshots: DataFrame, policy: str = "nan", coverage: float = 0.9) -> DataFrame:
    """date, rebalance_date, r_basket, covered, n: the held basket's return on each day after its rebalance.

    covered is the weight of members with a return. Below `coverage`: policy "nan" gives null (and else divides by the whole
    weight), "renormalize" divides by the covered weight on every day, "conservative_zero" lets missing members count as 0.
    returns: asset_id, date, r. snapshots: rebalance_date, asset_id, weight.
    """
    held = holding_days(returns.select("date").distinct(), snapshots.select("rebalance_date").distinct())
    x = held.join(snapshots, "rebalance_date").join(returns, ["date", "asset_id"], "left")
    has = F.col("r").isNotNull()
    g = x.groupBy("date", "rebalance_date").agg(F.sum("weight").alias("_w"), F.coalesce(F.sum(F.when(has, F.col("weight"))), F.lit(0.0)).alias("covered"), F.sum(F.col("weight") * F.col("r")).alias("_s"), F.count(F.lit(1)).alias("n"))
    whole = F.coalesce(F.col("_s"), F.lit(0.0)) / F.col("_w")
    r = {
        "nan": F.when(F.col("covered") >= coverage * F.col("_w"), whole),
        "renormalize": ratio(F.col("_s"), F.col("covered")),
        "conservative_zero": whole,
    }[policy]
    return g.select("date", "rebalance_date", r.alias("r_basket"), "covered", "n")


def long_short(returns: DataFrame, snapshots: DataFrame, major: DataFrame, policy: str = "nan", cost_rate: float = 0.001) -> DataFrame:
    """Long the major series, short the basket, with the cost of each rebalance's turnover on its first day held; equity.
    major: date, r_major."""
    b = basket_returns(returns, snapshots, policy)
    cost = W.turnover(snapshots).select("rebalance_date", (F.col("turnover") * cost_rate).alias("_c"))
    first = F.row_number().over(Window.partitionBy("rebalance_date").orderBy("date")) == 1
    x = b.withColumn("_first", first).join(cost, "rebalance_date").join(major, "date", "left")
    x = x.withColumns({"cost": F.when(F.col("_first"), F.col("_c")).otherwise(0.0), "r_ls": F.col("r_major") - F.col("r_basket")})
    x = x.withColumn("r_net", F.col("r_ls") - F.col("cost")).withColumn("series", F.lit("all"))
    return x.withColumn("equity", W.equity("r_net", W.by("series"))).select("date", "rebalance_date", "r_major", "r_basket", "r_ls", "cost", "r_net", "equity")


def basket_pnl(returns: DataFrame, snapshots: DataFrame, cost_rate: float = 0.0005) -> DataFrame:
    """Signed weights: pnl of the long and of the short side, gross exposure, and cost (the whole of the changes, not half)."""
    cost = W.turnover(snapshots, halve=False).select("rebalance_date", (F.col("turnover") * cost_rate).alias("cost"))
    held = returns.join(holding_days(returns.select("date").distinct(), snapshots.select("rebalance_date").distinct()), "date")
    x = held.join(snapshots, ["rebalance_date", "asset_id"])
    p = F.col("weight") * F.col("r")
    g = x.groupBy("date", "rebalance_date").agg(F.coalesce(F.sum(F.when(F.col("weight") > 0, p)), F.lit(0.0)).alias("long_pnl"), F.coalesce(F.sum(F.when(F.col("weight") < 0, p)), F.lit(0.0)).alias("short_pnl"), F.sum(F.abs("weight")).alias("gross"))
    first = F.row_number().over(Window.partitionBy("rebalance_date").orderBy("date")) == 1
    return g.withColumn("_f", first).join(cost, "rebalance_date").select("date", "rebalance_date", "long_pnl", "short_pnl", "gross", F.when(F.col("_f"), F.col("cost")).otherwise(0.0).alias("cost"))


def winner_takes_all(ranks: DataFrame, returns: DataFrame, gate: DataFrame) -> DataFrame:
    """Each day all weight on the best eligible rank, if the gate is open, from the next day on. ranks: asset_id, date, rank."""
    k = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("rank"), "asset_id"))
    best = ranks.where("rank is not null").withColumn("_k", k).where("_k = 1").join(gate, "date").where("open").select("date", "asset_id")
    days = returns.select("date").distinct().withColumn("_prev", F.lag("date").over(Window.partitionBy(F.lit("all")).orderBy("date")))
    pick = days.join(best.withColumnRenamed("date", "_prev"), "_prev")
    return pick.join(returns, ["date", "asset_id"], "left").select("date", "asset_id", F.coalesce("r", F.lit(0.0)).alias("r"))


def fixed_weight_index(prices: DataFrame, weights: DataFrame, base: str, least: float = 0.9) -> DataFrame:
    """Sum over assets of weight x base price / price, scaled to the weight that has a price; null below `least` of it."""
    b = prices.where(F.col("asset_id") == base).select("date", F.col("close").alias("_b"))
    x = b.join(prices.where(F.col("asset_id") != base), "date").join(weights, "asset_id")
    total = weights.where(F.col("asset_id") != base).agg(F.sum("weight").alias("_t"))
    g = x.groupBy("date").agg(F.sum(F.col("weight") * ratio(F.col("_b"), F.col("close"))).alias("_s"), F.sum("weight").alias("_w")).crossJoin(F.broadcast(total))
    return g.select("date", F.when(F.col("_w") >= least * F.col("_t"), F.col("_s") / F.col("_w")).alias("level"))


#: Digits after the point of an index; products and quotients are cut there.
DIGITS = 12
_ONE = 10**DIGITS


def _whole(v: Column) -> Column:
    return v.cast("decimal(19,0)")


def chained_index(prices: DataFrame, weights: DataFrame, start: int = 1000, bound: int = 300, digits: int = 6) -> DataFrame:
    """Index rebuilt at each rebalance date: sum of weight x price relative since then (held within +-bound per mille), chained so that
    the level doesn't jump. prices: asset_id, date, close (taken to so many digits); weights: rebalance_date, asset_id, weight (to two). The level
    before a segment is the running product of the segments' last relatives, over the ordered segments: one row each.

    All of it is exact: decimals without a fraction, in units of 10^-DIGITS, cut there after each product and quotient, so neither the order of sums
    nor the number of segments can change a level. date, rebalance_date, level (decimal)."""
    half = 0.501  # so that a value between two digits doesn't hang on its last bit
    p = prices.select("asset_id", "date", _whole(F.floor(F.col("close") * 10**digits + half)).alias("_p"))
    dates = weights.select("rebalance_date").distinct().withColumn("_next", F.lead("rebalance_date").over(Window.orderBy("rebalance_date")))
    p0 = p.select(F.col("date").alias("rebalance_date"), "asset_id", F.col("_p").alias("_p0"))
    w = weights.select("rebalance_date", "asset_id", _whole(F.floor(F.col("weight") * 100 + half)).alias("_w")).join(p0, ["rebalance_date", "asset_id"]).where("_p0 > 0")
    w = w.withColumn("_w", F.expr(f"cast((_w * {_ONE}) div sum(_w) over (partition by rebalance_date) as decimal(19,0))"))
    days = p.select("date").distinct().join(dates, (F.col("date") >= F.col("rebalance_date")) & (F.col("date") <= F.coalesce("_next", F.lit("9999-12-31").cast("date"))))
    seg = p.join(days.select("date", "rebalance_date"), "date")
    clamp = f"cast(greatest({_ONE // 1000 * (1000 - bound)}, least({_ONE // 1000 * (1000 + bound)}, (_p * {_ONE}) div _p0)) as decimal(19,0))"
    rel = seg.join(w, ["rebalance_date", "asset_id"]).withColumn("_r", F.expr(clamp))
    # a member without a price on a day keeps its last relative of the segment
    grid = rel.select("rebalance_date", "date").distinct().join(w.select("rebalance_date", "asset_id", "_w"), "rebalance_date")
    full = grid.join(rel.select("rebalance_date", "asset_id", "date", "_r"), ["rebalance_date", "asset_id", "date"], "left")
    last = F.last("_r", ignorenulls=True).over(Window.partitionBy("rebalance_date", "asset_id").orderBy("date"))
    day = full.withColumn("_r", F.coalesce(last, F.lit(_ONE).cast("decimal(19,0)"))).groupBy("rebalance_date", "date").agg(F.sum(F.col("_w") * F.col("_r")).alias("_s"))
    day = day.select("rebalance_date", "date", F.expr(f"_s div {_ONE}").alias("rel"))
    ends = day.groupBy("rebalance_date").agg(F.max_by("rel", "date").alias("_end"))
    ended = F.collect_list("_end").over(Window.partitionBy(F.lit("all")).orderBy("rebalance_date").rowsBetween(Window.unboundedPreceding, -1))
    product = f"aggregate(_ends, cast({_ONE} as bigint), (a, x) -> (cast(a as decimal(19,0)) * cast(x as decimal(19,0))) div {_ONE})"
    base = ends.withColumn("_ends", ended).select("rebalance_date", F.expr(product).alias("_base"))
    out = day.join(base, "rebalance_date").withColumn("level", F.expr(f"cast(({start} * ((cast(_base as decimal(19,0)) * cast(rel as decimal(19,0))) div {_ONE})) as decimal(38,{DIGITS})) / {_ONE}").cast(f"decimal(28,{DIGITS})"))
    w2 = Window.partitionBy("date").orderBy(F.desc("rebalance_date"))
    return out.withColumn("_k", F.row_number().over(w2)).where("_k = 1").select("date", "rebalance_date", "level")


def risk_engine(daily: DataFrame, params: DataFrame) -> DataFrame:
    """Path-dependent engine for each parameter set: a stop on the loss since entry, a take-profit, a trailing stop, volatility
    targeting and score scaling. daily: date, r, score (one row a day, for all sets). params: set_id, stop, take, trail, target.
    One task runs one set over the days; sets run in parallel."""
    schema = "set_id long, date date, exposure double, r_net double, equity double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("date")
        p = pdf.iloc[0]
        equity = peak = entry = 1.0
        on, wait, out, recent = False, 0, [], []
        for d, r, s in zip(pdf["date"], pdf["r"], pdf["score"], strict=True):
            r = 0.0 if pd.isna(r) else float(r)
            s = 0.0 if pd.isna(s) else float(s)
            vol = math.sqrt(sum(x * x for x in recent[-20:]) / len(recent[-20:])) if recent else 0.0
            size = (max(0.0, min(1.0, (s + 1) / 2)) * (min(2.0, p["target"] / vol) if vol > 0 else 1.0)) if on else 0.0
            net = size * r
            equity *= 1 + net
            peak = max(peak, equity)
            out.append((int(p["set_id"]), d, size, net, equity))
            recent.append(r)
            wait = max(0, wait - 1)
            if on and (equity / entry - 1 <= -p["stop"] or equity / entry - 1 >= p["take"] or equity / peak - 1 <= -p["trail"]):
                on, wait = False, 5
            elif not on and s > 0 and not wait:
                on, entry, peak = True, equity, equity
        return pd.DataFrame(out, columns=["set_id", "date", "exposure", "r_net", "equity"])

    return daily.crossJoin(F.broadcast(params)).groupBy("set_id").applyInPandas(run, schema)
