"""Curation with a log of every edit, and gates that list violations. A rule is one query; rules are united, so the plan stays
one job however many there are."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import windows as W


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def clean_panel(df: DataFrame, key: str = "asset_id", date: str = "date", jump: float = 5.0, cap_factor: float = 20.0, volume_factor: float = 50.0) -> tuple[DataFrame, DataFrame]:
    """The panel (close, marketcap, volume) with impossible and outlying values null, and one log row for each edit.

    Rules in order: a close that isn't positive; a negative marketcap or volume; two returns beyond +-jump of opposite sign on
    neighbouring rows (the first one's close); marketcap or volume above its factor times the 30-row median, itself included.
    """
    w = W.by(key, date)
    d = df.withColumns({"_c0": F.col("close"), "_m0": F.col("marketcap"), "_v0": F.col("volume")})
    d = d.withColumns({"close": F.when(F.col("close") > 0, F.col("close")), "marketcap": F.when(F.col("marketcap") >= 0, F.col("marketcap")), "volume": F.when(F.col("volume") >= 0, F.col("volume"))})
    d = d.withColumns({"_c1": F.col("close"), "_m1": F.col("marketcap"), "_v1": F.col("volume")})
    d = d.withColumn("_r", W.ratio(F.col("close"), F.lag("close").over(w)) - 1)
    spike = F.coalesce(F.abs("_r") > jump, F.lit(False))
    d = d.withColumn("_spike", spike).withColumn("_opposite", F.coalesce(F.lead("_spike").over(w) & (F.signum("_r") != F.signum(F.lead("_r").over(w))), F.lit(False)))
    d = d.withColumn("close", F.when(F.col("_spike") & F.col("_opposite"), None).otherwise(F.col("close")))
    for c, factor in (("marketcap", cap_factor), ("volume", volume_factor)):
        d = d.withColumn(c, F.when(F.col(c) > factor * W.rolling(c, w, 30, W.median, 1), None).otherwise(F.col(c)))
    steps = [("close", "_c0", "_c1", "not_positive"), ("marketcap", "_m0", "_m1", "negative"), ("volume", "_v0", "_v1", "negative"), ("close", "_c1", "close", "jump_revert"), ("marketcap", "_m1", "marketcap", "spike"), ("volume", "_v1", "volume", "spike")]
    entries = F.filter(F.array(*(F.when(F.col(a).isNotNull() & F.col(b).isNull(), F.struct(F.lit(c).alias("dataset"), F.lit(rule).alias("rule"), F.col(a).alias("old_value"), F.lit("set_null").alias("action"))) for c, a, b, rule in steps)), lambda x: x.isNotNull())
    log = d.select(key, date, F.explode(entries).alias("e")).select(key, date, "e.*", F.lit(None).cast("double").alias("new_value"))
    return d.select(*df.columns), log


def silver_prices(df: DataFrame, blacklist: DataFrame | None = None, key: str = "asset_id", date: str = "date") -> DataFrame:
    """Dense per asset; closes of slingshots null and flagged; nothing is filled; blacklisted assets go."""
    from ..sources.panel import densify

    if blacklist is not None:
        df = df.join(blacklist.select(key).distinct(), key, "left_anti")
    w, r = W.by(key, date), F.col("_r")
    d = df.where(F.col(date).isNotNull()).select(key, date, "close").withColumn("_r", W.simple_return("close", w, gap="break", date=date))
    # a jump marks the days up to the one before its fall, added ones too: the last marked day is carried onto them
    falls = (F.when((F.lead("_r", i).over(w) < -0.5) & (F.datediff(F.lead(date, i).over(w), date) == k), F.date_add(date, k - 1)) for k in (1, 2, 3) for i in range(1, k + 1))
    d = d.withColumn("_until", F.when(r > 1, F.greatest(F.lit(None).cast("date"), *falls))).withColumn("_until", F.max("_until").over(W.upto(w)))
    d = densify(d, key, date, carry=["_until"]).withColumn("is_winsorized", F.coalesce(F.col(date) <= F.col("_until"), F.lit(False))).withColumn("is_ffilled", F.lit(False))
    return d.withColumn("close", F.when(~F.col("is_winsorized"), F.col("close"))).drop("_r", "_until")


def silver_funding(df: DataFrame, cutover: str, least_assets: int = 25, limit: int = 3, bound: float = 1.0) -> DataFrame:
    """One unit on both sides of the cutover, mean of a key's rows a day, capped, filled at most `limit` days; raises with too
    few assets. Rows without an instrument go. Keys: asset_id, instrument_id, exchange, date; value: rate."""
    from ..sources.panel import unit_cutover

    n = df.agg(F.count_distinct("asset_id").alias("n")).first()["n"]
    if n < least_assets:
        raise ValueError(f"{n} assets, fewer than {least_assets}")
    keys = ["asset_id", "instrument_id", "exchange"]
    d = unit_cutover(df.where("instrument_id is not null"), "rate", cutover).groupBy(*keys, "date").agg(F.avg("rate").alias("rate"))
    d = d.withColumn("is_capped", F.abs("rate") > bound).withColumn("rate", F.greatest(F.lit(-bound), F.least(F.lit(bound), F.col("rate"))))
    # on the sparse rows: each value reaches to the next one, to `limit` days later, or to the key's last day
    own = Window.partitionBy(*keys)
    x = d.withColumn("_end", F.max("date").over(own)).where("rate is not null").withColumn("_next", F.lead("date").over(own.orderBy("date")))
    until = F.least(F.date_add("date", limit), F.date_sub("_next", 1), F.col("_end"))  # a null _next doesn't count
    x = x.select(*keys, F.explode(F.sequence(F.col("date"), until)).alias("_day"), "date", "rate", "is_capped")
    return x.select(*keys, F.col("_day").alias("date"), "rate", (F.col("_day") > F.col("date")).alias("is_ffilled"), (F.col("is_capped") & (F.col("_day") == F.col("date"))).alias("is_capped"))


def rules(df: DataFrame, checks: Mapping[str, Column]) -> DataFrame:
    """Violations of each check, counted in one pass: rule, n."""
    g = df.agg(*(F.count_if(~F.coalesce(c, F.lit(False))).alias(k) for k, c in checks.items()))
    return g.unpivot([], list(checks), "rule", "n")


def basket_invariants(baskets: DataFrame, eligible: DataFrame, forbidden: DataFrame, size: int, tolerance: float = 1e-3, date: str = "rebalance_date", key: str = "asset_id") -> DataFrame:
    """rule, rebalance_date, detail: weights that don't add up to one, wrong size, forbidden or ineligible members."""
    g = baskets.groupBy(date).agg(F.sum("weight").alias("_w"), F.count(F.lit(1)).alias("_n"))
    row = lambda d, rule, detail: d.select(F.lit(rule).alias("rule"), date, F.col(detail).cast("string").alias("detail") if isinstance(detail, str) else detail.alias("detail"))
    return union_all([
        row(g.where(F.abs(F.col("_w") - 1) > tolerance), "weights", F.format_number("_w", 4)),
        row(g.where(F.col("_n") != size), "size", "_n"),
        row(baskets.join(forbidden.select(key).distinct(), key, "left_semi"), "forbidden", key),
        row(baskets.join(eligible.select(date, key).distinct(), [date, key], "left_anti"), "ineligible", key),
    ])


def listing_invariants(eligible: DataFrame, listings: DataFrame, date: str = "rebalance_date", key: str = "asset_id") -> DataFrame:
    """Eligible before the listing began."""
    return eligible.join(listings.select(key, "onboard_date"), key).where(F.col(date) < F.col("onboard_date")).select(key, date, "onboard_date")


def result_invariants(df: DataFrame, ret: str, turnover: str, date: str = "date") -> DataFrame:
    """Share of empty returns from the first one on, returns beyond 50 %, turnovers above 95 %."""
    first = F.min(F.when(F.col(ret).isNotNull(), F.col(date))).over(Window.partitionBy(F.lit(0)))
    x = df.withColumn("_f", first).where(F.col(date) >= F.col("_f"))
    return x.agg((1 - F.count(ret) / F.count(F.lit(1))).alias("nan_share"), F.count_if(F.abs(ret) > 0.5).alias("extreme"), F.count_if(F.col(turnover) > 0.95).alias("high_turnover"))


def orphans(facts: Mapping[str, tuple[DataFrame, str]], dim: DataFrame, key: str, warn: Sequence[str] = ()) -> DataFrame:
    """Keys of each fact table that the dimension lacks, counted, with a severity."""
    parts = []
    for name, (df, column) in facts.items():
        o = df.select(F.col(column).alias(key)).distinct().join(dim.select(key), key, "left_anti")
        parts.append(o.agg(F.count(F.lit(1)).alias("orphans")).select(F.lit(name).alias("table"), "orphans", F.lit("warning" if name in warn else "error").alias("severity")))
    return union_all(parts)


def validate_table(df: DataFrame, keys: Sequence[str], positive: Sequence[str] = (), required: Sequence[str] = ()) -> DataFrame:
    """rule, n: duplicate keys, nulls in keys and required columns, values that aren't positive."""
    checks = {f"null:{c}": F.col(c).isNotNull() for c in [*keys, *required]} | {f"positive:{c}": F.col(c).isNull() | (F.col(c) > 0) for c in positive}
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("n"))
    return rules(df, checks).unionByName(dup.select(F.lit("duplicate_keys").alias("rule"), "n"))


def weekly_gate(df: DataFrame, value: str, lo: float, hi: float, date: str = "decision_date") -> DataFrame:
    """Counts of: empty values, values out of range, steps other than seven days, weekdays other than the most frequent."""
    step = F.datediff(date, F.lag(date).over(Window.partitionBy(F.lit(0)).orderBy(date)))
    x = df.withColumns({"_step": step, "_day": F.weekday(date)})
    day = x.groupBy("_day").agg(F.count(F.lit(1)).alias("_n")).agg(F.max_by("_day", F.struct("_n", -F.col("_day"))).alias("_mode"))
    return x.crossJoin(F.broadcast(day)).agg(F.count_if(F.col(value).isNull()).alias("empty"), F.count_if(~F.col(value).between(lo, hi)).alias("out_of_range"), F.count_if(F.col("_step") != 7).alias("bad_step"), F.count_if(F.col("_day") != F.col("_mode")).alias("bad_weekday"))


def require_clean(report: DataFrame) -> None:
    """Raises if a one-row report of counts has any."""
    bad = {k: v for k, v in report.first().asDict().items() if v}
    if bad:
        raise ValueError(f"gate: {bad}")


def staleness(df: DataFrame, today: Column, date: str = "date", most: int = 3) -> DataFrame:
    """Days since the newest row, and whether that is too many."""
    x = df.agg(F.max(date).alias("last")).withColumn("days", F.datediff(today, "last"))
    return x.withColumn("stale", F.col("days") > most)


def ohlc_violations(df: DataFrame) -> DataFrame:
    """Rows where high or low contradict open, close or each other, or a price isn't positive."""
    o, h, l, c = (F.col(x) for x in ("open", "high", "low", "close"))
    bad = (h < F.greatest(o, c)) | (l > F.least(o, c)) | (h < l) | (F.least(o, h, l, c) <= 0)
    return df.where(F.coalesce(bad, F.lit(True)))


def temporal_violations(df: DataFrame, key: str = "asset_id", date: str = "date") -> DataFrame:
    """For each key: rows with the date of the row before, and the steps longer than a day."""
    step = F.datediff(date, F.lag(date).over(W.by(key, date)))
    return df.withColumn("_s", step).groupBy(key).agg(F.count_if(F.col("_s") == 0).alias("repeated"), F.count_if(F.col("_s") > 1).alias("gaps"), F.max("_s").alias("longest"))


def change_bands(before: DataFrame, after: DataFrame, key: str, value: str, warn: float = 0.15, fail: float = 0.25) -> DataFrame:
    """Relative change by key: ok, warn or fail."""
    x = before.select(key, F.col(value).alias("before")).join(after.select(key, F.col(value).alias("after")), key)
    d = F.abs(W.ratio(F.col("after"), F.col("before")) - 1)
    return x.withColumn("status", F.when(d > fail, "fail").when(d > warn, "warn").otherwise("ok"))


def overall_status(steps: Mapping[str, str], mode: str = "research") -> str:
    """Of step statuses: any failure fails; in smoke mode warnings pass."""
    if any(s == "fail" for s in steps.values()):
        return "fail"
    return "warn" if mode != "smoke" and any(s == "warn" for s in steps.values()) else "ok"


def schema_problems(df: DataFrame, expected: str) -> list[str]:
    """Missing, extra and differently typed columns against a DDL string."""
    from pyspark.sql import types as T

    want = {f.name: f.dataType for f in T.StructType.fromDDL(expected).fields}
    have = {f.name: f.dataType for f in df.schema.fields}
    return [f"missing {c}" for c in want if c not in have] + [f"extra {c}" for c in have if c not in want] + [f"type of {c}" for c in want if c in have and have[c] != want[c]]


def burn_in(rows: int, key: str = "series", date: str = "date") -> Column:
    return F.row_number().over(W.by(key, date)) > rows
