"""Positions: exposures, neutrality, daily profit with costs, alert states and trade rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import clamp
from .windows import by


def snapshot(positions: DataFrame) -> DataFrame:
    """One row for all positions (notional signed, beta): exposures, concentration, and the hedge that cancels the beta."""
    v, b = F.col("notional"), F.col("beta")
    return positions.agg(
        F.sum(b * v).alias("beta_exposure"), F.sum(F.abs(v)).alias("gross"), F.sum(v).alias("net"), F.sum(F.when(v > 0, v)).alias("long_total"), F.sum(F.when(v < 0, v)).alias("short_total"),
        (F.max(F.abs(v)) / F.sum(F.abs(v))).alias("concentration"), (-F.sum(b * v)).alias("hedge"),
    )


def neutral_weight(alt: Column, beta: Column, mode: str = "dollar", most: float = 1.0) -> Column:
    """The major leg's weight that cancels the other leg's dollars or its beta, within +-most."""
    return clamp(-alt if mode == "dollar" else -alt * beta, -most, most)


def daily_pnl(df: DataFrame, weight: str, ret: str, rate: Column, fee: float, slippage: float, key: str = "series", date: str = "date", halve: bool = False) -> DataFrame:
    """gross, cost of the change of weight (the first counts from nothing), funding of three payments a day, net."""
    w = F.col(weight)
    change = F.abs(w - F.coalesce(F.lag(weight).over(by(key, date)), F.lit(0.0))) * (0.5 if halve else 1.0)
    x = df.withColumns({"gross": w * F.col(ret), "cost": change * (fee + slippage), "funding": -w * rate * 3})
    return x.withColumn("net", F.col("gross") - F.col("cost") + F.col("funding"))


def open_by_cohort(ledger: DataFrame) -> DataFrame:
    """Open trades and their notional by cohort and side."""
    return ledger.where("status = 'OPEN'").groupBy("cohort", "side").agg(F.count(F.lit(1)).alias("n_open"), F.sum("notional_usd").alias("notional"), F.max("entry_date_utc").alias("last_entry"))


def has_open(ledger: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (cohort, ticker, side) rows that are open already."""
    return wanted.join(ledger.where("status = 'OPEN'"), ["cohort", "ticker", "side"], "left_semi")


def trade_rows(orders: DataFrame, stop_pct: float, hold_days: int) -> DataFrame:
    """Quantity, stop and target date of new trades (side, entry_price_usd, notional_usd, entry_date_utc)."""
    up = F.when(F.col("side") == "SHORT", 1 + stop_pct).otherwise(1 - stop_pct)
    return orders.withColumns({"quantity": F.col("notional_usd") / F.when(F.col("entry_price_usd") > 0, F.col("entry_price_usd")), "stop_price_usd": F.col("entry_price_usd") * up, "exit_date_target_utc": F.date_add("entry_date_utc", hold_days), "status": F.lit("OPEN")})


def pick_single_open(ledger: DataFrame, ticker: str) -> DataFrame:
    """The ticker's open row; raises if there is none or more than one."""
    x = ledger.where((F.col("ticker") == ticker) & (F.col("status") == "OPEN"))
    n = len(x.limit(2).collect())
    if n != 1:
        raise ValueError(f"{ticker}: {'no' if n == 0 else 'more than one'} open trade")
    return x


def new_alerts(alerts: DataFrame, log: DataFrame) -> DataFrame:
    """Alerts (trade_id, tier) that the log doesn't have yet: each is sent once."""
    return alerts.join(log, ["trade_id", "tier"], "left_anti")


def due_reminders(ledger: DataFrame, today: Column, days: tuple[int, ...] = (7, 3, 1)) -> DataFrame:
    """Open trades whose target date is exactly so many days off, and reminders by age of the cohort."""
    left = F.datediff("exit_date_target_utc", today)
    return ledger.where("status = 'OPEN'").withColumn("days_left", left).where(F.col("days_left").isin(*days)).withColumn("tier", F.concat(F.lit("T-"), F.col("days_left").cast("string")))


def cohort_age(ledger: DataFrame, today: Column, ages: tuple[int, ...] = (40, 43, 45)) -> DataFrame:
    x = ledger.groupBy("cohort").agg(F.min("entry_date_utc").alias("started"))
    return x.withColumn("age", F.datediff(today, "started")).where(F.col("age").isin(*ages))


def nearest(ledger: DataFrame, price: str) -> DataFrame:
    """The open trade with the nearest expiry, and the one whose price is nearest to its stop."""
    o = ledger.where("status = 'OPEN'")
    return o.agg(F.min_by("trade_id", "exit_date_target_utc").alias("next_expiry"), F.max_by("trade_id", F.col(price) / F.col("stop_price_usd")).alias("nearest_stop"))


def close_trade(row: DataFrame, exit_price: float) -> DataFrame:
    """Profit in money and percent."""
    sign = F.when(F.col("side") == "SHORT", -1.0).otherwise(1.0)
    pct = sign * (F.lit(exit_price) / F.when(F.col("entry_price_usd") > 0, F.col("entry_price_usd")) - 1)
    return row.withColumns({"exit_price_usd": F.lit(exit_price), "pnl_pct": pct * 100, "pnl_usd": pct * F.col("notional_usd"), "status": F.lit("CLOSED")})


def latest_rank(df: DataFrame, key: str, date: str) -> Column:
    return F.row_number().over(Window.partitionBy(key).orderBy(F.desc(date)))
