"""Regimes: gates by running state in SQL, and machines whose next state depends on how long one waited, by grouped pandas."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .windows import sorted_quantiles


def sticky_gate(df: DataFrame, enter: Column, leave: Column, key: str = "series", date: str = "date", out: str = "active") -> DataFrame:
    """On from a row that enters to a row that leaves (the two never hold together); off before the first."""
    signal = F.when(enter, 1).when(leave, 0)
    w = Window.partitionBy(key).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_s", signal).withColumn(out, F.coalesce(F.last("_s", ignorenulls=True).over(w), F.lit(0)) == 1).drop("_s")


def _machine(scores: Sequence[float | None], enter: Sequence[float], band: float, persist: int) -> list[int]:
    """States are zones between the thresholds. A new zone must lie `band` past its threshold, and hold for `persist` rows; a
    move against the last one needs half as many more."""
    state, out, waiting, waited, direction = 0, [], None, 0, 0
    middle = len(enter) // 2
    state = middle
    for s in scores:
        if s is not None and s == s:
            zone = state
            while zone < len(enter) and s > enter[zone] + band:
                zone += 1
            while zone > 0 and s < enter[zone - 1] - band:
                zone -= 1
            if zone == state:
                waiting, waited = None, 0
            else:
                waited = waited + 1 if zone == waiting else 1
                waiting = zone
                step = 1 if zone > state else -1
                need = persist if direction in (0, step) else -(-persist * 3 // 2)
                if waited >= need:
                    state, direction, waiting, waited = zone, step, None, 0
        out.append(state)
    return out


def classify(df: DataFrame, score: str, thresholds: Sequence[float], names: Sequence[str], key: str = "series", date: str = "date", band: float = 0.05, persist: int = 3) -> DataFrame:
    """key, date, score and regime of each row. One key's rows meet in one task: a key is one daily series (or one
    parameter set of a search), never the whole data."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date)
        states = _machine([None if pd.isna(x) else float(x) for x in pdf[score]], thresholds, band, persist)
        return pdf.assign(regime=[names[s] for s in states])

    x = df.select(key, date, score)
    return x.groupBy(key).applyInPandas(run, x.withColumn("regime", F.lit("")).schema)


def walk_forward(df: DataFrame, lookback: int, test: int, key: str = "series", date: str = "date") -> DataFrame:
    """Numbers the test windows after a first lookback; rows before it have none."""
    k = F.row_number().over(Window.partitionBy(key).orderBy(date)) - 1
    return df.withColumn("_k", k).withColumn("window", F.when(F.col("_k") >= lookback, F.floor((F.col("_k") - lookback) / test))).drop("_k")


def longterm_regime(df: DataFrame, value: str, key: str = "series", date: str = "date", level: int = 360, time: int = 180, least: int = 60) -> DataFrame:
    """Long-term regime of a level (such as funding) from the rows up to each day: where it stands among the last `level` rows, how much of the last
    `time` rows lay in that window's upper and lower quarter, a risk score of these in 0..1, and GREEN, AMBER or RED by the thirds of all scores.
    key, date, p_level, frac_hot, frac_cold, score, bucket; rows without a value, and the first least - 1, have none. A key is a daily series."""
    w = Window.partitionBy(key).orderBy(date)
    last = lambda n: F.collect_list(value).over(w.rowsBetween(1 - n, 0))
    x = df.where(F.col(value).isNotNull()).select(key, date, F.col(value).alias("_v"), F.row_number().over(w).alias("_k"), last(level).alias("_l"), last(time).alias("_t"))
    x = x.where(F.col("_k") >= least).withColumn("_q", sorted_quantiles(F.col("_l"), 4))
    share = lambda test: F.size(F.filter("_t", test)) / F.size("_t")
    p = (F.size(F.filter("_l", lambda v: v <= F.col("_v"))) - 1) / (F.size("_l") - 1)
    x = x.select(key, date, p.alias("p_level"), share(lambda v: v >= F.get("_q", 3)).alias("frac_hot"), share(lambda v: v <= F.get("_q", 1)).alias("frac_cold"))
    hot, cold, p = F.col("frac_hot"), F.col("frac_cold"), F.col("p_level")
    raw = 0.6 * (0.5 * p + 0.5 * hot) - 0.3 * cold - 0.3 * F.greatest(F.lit(0.0), p - hot)
    x = x.withColumn("score", F.round(1.0 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), (raw + 0.6) / 1.2)), 9))
    thirds = x.groupBy(key).agg(F.percentile("score", F.array(F.lit(0.3333), F.lit(0.6667))).alias("_e"))
    bucket = F.when(F.col("score") < F.get("_e", 0), "GREEN").when(F.col("score") < F.get("_e", 1), "AMBER").otherwise("RED")
    return x.join(thirds, key).withColumn("bucket", bucket).drop("_e")
