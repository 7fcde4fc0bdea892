"""Monitors: named computations of a daily regime, all with one result: series, date, score_raw, regime_1_5 (1 best, 5 worst).

A monitor is any object with a name and `compute`; `register` makes it known, `run` unites the results of several. Input is a daily table with
the columns that the monitor names in `needs`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Monitor(Protocol):
    name: str
    needs: tuple[str, ...]

    def compute(self, daily: DataFrame) -> DataFrame: ...


MONITORS: dict[str, Monitor] = {}


def register(monitor: Monitor) -> Monitor:
    if monitor.name in MONITORS and MONITORS[monitor.name] is not monitor:
        raise ValueError(f"there is a monitor {monitor.name}")
    MONITORS[monitor.name] = monitor
    return monitor


def run(daily: DataFrame, names: Sequence[str]) -> DataFrame:
    """monitor, series, date, score_raw, regime_1_5 of each named monitor."""
    out = None
    for name in names:
        if name not in MONITORS:
            raise KeyError(f"no monitor {name}; there are {sorted(MONITORS)}")
        m = MONITORS[name]
        if lacking := [c for c in ("series", "date", *m.needs) if c not in daily.columns]:
            raise ValueError(f"monitor {name} needs {lacking}")
        part = m.compute(daily).select(F.lit(name).alias("monitor"), "series", "date", F.col("score_raw").cast("double").alias("score_raw"), F.col("regime_1_5").cast("int").alias("regime_1_5"))
        out = part if out is None else out.unionByName(part)
    return out


def fifths(score: Column) -> Column:
    """1 to 5 of a score between 0 and 1; higher scores are worse."""
    return F.when(score.isNotNull(), F.least(F.lit(5), F.floor(score * 5) + 1))


@dataclass
class Persistence:
    """How lasting a sign is: the share of the last `rows` rows with a value above zero."""

    name: str
    column: str
    rows: int = 30
    least: int = 10

    @property
    def needs(self) -> tuple[str, ...]:
        return (self.column,)

    def compute(self, daily: DataFrame) -> DataFrame:
        w = Window.partitionBy("series").orderBy("date").rowsBetween(1 - self.rows, 0)
        share = F.when(F.count(self.column).over(w) >= self.least, F.avg((F.col(self.column) > 0).cast("double")).over(w))
        return daily.select("series", "date", share.alias("score_raw")).withColumn("regime_1_5", fifths(F.col("score_raw")))


@dataclass
class RelativeValue:
    """Where the ratio of two columns' sums over the last `rows` rows stands between its lowest and highest so far."""

    name: str
    above: str
    below: str
    rows: int = 30

    @property
    def needs(self) -> tuple[str, ...]:
        return (self.above, self.below)

    def compute(self, daily: DataFrame) -> DataFrame:
        w = Window.partitionBy("series").orderBy("date")
        last = w.rowsBetween(1 - self.rows, 0)
        total = F.sum(self.below).over(last)
        x = daily.select("series", "date", F.when((F.count(F.lit(1)).over(last) == self.rows) & (total != 0), F.sum(self.above).over(last) / total).alias("_v"))
        so_far = w.rowsBetween(Window.unboundedPreceding, 0)
        lo, hi = F.min("_v").over(so_far), F.max("_v").over(so_far)
        return x.select("series", "date", F.when(hi > lo, (F.col("_v") - lo) / (hi - lo)).alias("score_raw")).withColumn("regime_1_5", fifths(F.col("score_raw")))
