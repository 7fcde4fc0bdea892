"""Rolling, ranking, cumulative and gap-aware operators over one row a key and date.

All are columns over windows partitioned by the key, so Spark shuffles once for any number of them on one key; series of a
whole market are aggregated to one row a day first.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from . import selection


def by(key: str | Sequence[str] = "asset_id", date: str = "date") -> WindowSpec:
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(date)


def ratio(a: Column, b: Column) -> Column:
    """a / b; null where b is zero."""
    return a / F.when(b != 0, b)


def simple_return(value: str, w: WindowSpec, k: int = 1, gap: str = "bridge", date: str = "date") -> Column:
    """value / value k rows ago - 1. gap: "bridge" takes the row before whatever its date; "break" gives null unless it lies
    exactly k days back; "pad" compares with the last value that isn't null."""
    v = F.col(value)
    if gap == "pad":
        filled = F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -k))
        return ratio(F.last(v, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), filled) - 1
    r = ratio(v, F.lag(v, k).over(w)) - 1
    return F.when(F.datediff(date, F.lag(date, k).over(w)) == k, r) if gap == "break" else r


def log_return(value: str, w: WindowSpec, k: int = 1) -> Column:
    """ln(value / value k rows ago); null where either is not positive."""
    pos = lambda c: F.when(c > 0, c)
    return F.ln(pos(F.col(value)) / pos(F.lag(value, k).over(w)))


def delta(value: str, w: WindowSpec, k: int = 1) -> Column:
    return F.col(value) - F.lag(value, k).over(w)


def rolling(value: Column | str, w: WindowSpec, rows: int, fn, least: int | None = None, skip: int = 0) -> Column:
    """fn over the last `rows` rows (ending `skip` rows back), null with fewer than `least` values (default: rows)."""
    v = F.col(value) if isinstance(value, str) else value
    frame = w.rowsBetween(-(rows - 1) - skip, -skip)
    return F.when(F.count(v).over(frame) >= (rows if least is None else least), fn(v).over(frame))


def zscore(value: str, w: WindowSpec, rows: int, least: int | None = None) -> Column:
    return ratio(F.col(value) - rolling(value, w, rows, F.avg, least), rolling(value, w, rows, F.stddev_samp, least))


def median(v: Column) -> Column:
    return F.percentile(v, 0.5)


def at_rolling_max(value: str, w: WindowSpec, rows: int) -> Column:
    """The row's value is the largest of the window; null while the window isn't full."""
    return F.col(value) == rolling(value, w, rows, F.max)


def values_of_window(value: str, w: WindowSpec, first: int, last: int) -> Column:
    """Array of the values in the frame; nulls are left out."""
    return F.collect_list(value).over(w.rowsBetween(first, last))


def rolling_pct_rank(value: str, w: WindowSpec, rows: int, least: int) -> Column:
    """Average-tie rank of the row's value in its window, as a share of the window's values."""
    a, v = values_of_window(value, w, -(rows - 1), 0), F.col(value)
    less, equal = F.size(F.filter(a, lambda x: x < v)), F.size(F.filter(a, lambda x: x == v))
    return F.when((F.size(a) >= least) & v.isNotNull(), (less + (equal + 1) / 2.0) / F.size(a))


def cross_rank(value: str, group: str) -> Column:
    """Average-tie rank within a group, scaled to 0..1; null alone or without a value."""
    v = F.col(value)
    w = Window.partitionBy(group)
    n = F.count(v).over(w)
    rank = F.rank().over(w.orderBy(v.asc_nulls_last())) + (F.count(F.lit(1)).over(Window.partitionBy(group, value)) - 1) / 2.0
    return F.when(v.isNotNull() & (n > 1), (rank - 1) / (n - 1))


def rank_desc(value: str, group: str) -> Column:
    """Rank by falling value within a group, ties share the smallest; null has none. (Of a whole table: `selection.ranked`.)"""
    w = Window.partitionBy(group).orderBy(F.col(value).desc_nulls_last())
    return F.when(F.col(value).isNotNull(), F.rank().over(w))


def bucket_by_edges(v: Column, edges: Column) -> Column:
    """1-based bucket: right-closed, the lowest edge belongs to the first. Equal edges merge their buckets."""
    e = F.array_distinct(edges)
    k = F.size(F.filter(F.slice(e, 2, F.size(e)), lambda x: x < v)) + 1
    return F.when(v.isNotNull(), F.least(k, F.greatest(F.size(e) - 1, F.lit(1))))


def quantile_buckets(df: DataFrame, value: str, n: int, out: str = "bucket", group: Sequence[str] = ()) -> DataFrame:
    """Equal-frequency buckets with interpolated edges, by group (the edges are one row a group) or over all rows (the edges are selected by passes over the table)."""
    shares = [i / n for i in range(n + 1)]
    if not group:
        df = selection.kept(df)
        edges = selection.quantiles(df, value, shares)
        return df.withColumn(out, bucket_by_edges(F.col(value), F.array(*(F.lit(e).cast("double") for e in edges))))
    edges = df.groupBy(*group).agg(F.percentile(value, F.array(*map(F.lit, shares))).alias("_edges"))
    return df.join(edges, list(group)).withColumn(out, bucket_by_edges(F.col(value), F.col("_edges"))).drop("_edges")


def cut(v: Column, edges: Sequence[float]) -> Column:
    """Right-closed bins between fixed edges, the lowest edge included; 0-based, null outside."""
    out = F.when(v.isNull() | (v < edges[0]) | (v > edges[-1]), None)
    for i, e in enumerate(edges[1:]):
        out = out.when(v <= e, i)
    return out


def label_by_edges(v: Column, edges: Column, labels: Sequence[str]) -> Column:
    """Half-open bins, the last closed; values outside get the first or last label."""
    out = F.when(v.isNull() | edges.isNull(), None)
    for i, name in enumerate(labels[:-1]):
        out = out.when(v < F.get(edges, i + 1), name)
    return out.otherwise(labels[-1])


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value computed once a row, however often use names it."""
    return F.get(F.transform(F.array(value), use), 0)


def sorted_quantiles(a: Column, n: int) -> Column:
    """Interpolated quantiles 0, 1/n .. 1 of an array."""
    def all_of(s: Column) -> Column:
        def q(i: int) -> Column:
            x = (F.size(s) - 1) * (i / n)
            lo = F.floor(x).cast("int")
            hi = F.least(lo + 1, F.size(s) - 1)
            return F.get(s, lo) + (x - lo) * (F.get(s, hi) - F.get(s, lo))

        return F.array(*(q(i) for i in range(n + 1)))

    return once(F.array_sort(a), all_of)


def prior_labels(value: str, w: WindowSpec, rows: int, labels: Sequence[str]) -> Column:
    """Label of the value among the quantiles of the `rows` rows before it; null with fewer."""
    a = values_of_window(value, w, -rows, -1)
    return F.when(F.size(a) >= rows, once(sorted_quantiles(a, len(labels)), lambda e: label_by_edges(F.col(value), e, labels)))


def pct_rank_le(value: str, w: WindowSpec, rows: int) -> Column:
    """Share (in percent) of the `rows` rows before that are at most the value."""
    a = values_of_window(value, w, -rows, -1)
    return F.when(F.size(a) > 0, F.size(F.filter(a, lambda x: x <= F.col(value))) / F.size(a) * 100)


def upto(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def equity(r: Column | str, w: WindowSpec) -> Column:
    """Product of 1 + r so far; null counts as 0. Exact for r <= -1 too: size and sign go apart."""
    v = F.coalesce(F.col(r) if isinstance(r, str) else r, F.lit(0.0))
    size = F.exp(F.sum(F.ln(F.when(v != -1, F.abs(1 + v)))).over(upto(w)))
    sign = 1 - 2 * (F.sum(F.when(v < -1, 1).otherwise(0)).over(upto(w)) % 2)
    return F.when(F.max(F.when(v == -1, 1).otherwise(0)).over(upto(w)) == 1, 0.0).otherwise(sign * F.coalesce(size, F.lit(1.0)))


def drawdown(level: Column | str, w: WindowSpec) -> Column:
    v = F.col(level) if isinstance(level, str) else level
    return ratio(v, F.max(v).over(upto(w))) - 1


def forward_compound(r: str, w: WindowSpec, h: int) -> Column:
    """Compounded return of the next h rows; null if one is missing."""
    frame = w.rowsBetween(1, h)
    return F.when(F.count(r).over(frame) == h, F.expm1(F.sum(F.log1p(r)).over(frame)))


def spread_back(flag: str, w: WindowSpec, rows: int) -> Column:
    """The flag holds on this row or one of the rows before it."""
    return F.max(F.col(flag).cast("int")).over(w.rowsBetween(-rows, 0)) == 1


def mark_slingshots(df: DataFrame, ret: str, key: str = "asset_id", date: str = "date", up: float = 1.0, down: float = -0.5, through_fall: bool = False, exclusive: bool = False, out: str = "anomaly") -> DataFrame:
    """Flags jumps that fall back. For a fall k rows later the jump and the k-1 rows after it are marked, and the row of the
    fall as well if through_fall. exclusive: a jump counts for its first fall only."""
    w = by(key, date)
    r = F.col(ret)
    names = ["_s1", "_s2", "_s3"]
    taken = F.lit(False)
    for k, n in enumerate(names, 1):
        hit = F.coalesce((r > up) & (F.lead(r, k).over(w) < down), F.lit(False))
        df = df.withColumn(n, hit & ~taken if exclusive else hit)
        taken = taken | F.col(n)
    marks = [spread_back(n, w, k if through_fall else k - 1) for k, n in enumerate(names, 1)]
    return df.withColumn(out, marks[0] | marks[1] | marks[2]).drop(*names)


def ffill(value: str, w: WindowSpec, limit: int | None = None) -> Column:
    """The last value so far, at most limit rows back (on a dense grid: days)."""
    return F.last(value, ignorenulls=True).over(w.rowsBetween(-limit if limit is not None else Window.unboundedPreceding, 0))


def bfill(value: str, falling: WindowSpec) -> Column:
    """The next value, by a window in falling order: a frame up to the end would be gone through again for every row."""
    return ffill(value, falling)


def fill_whole_gaps(df: DataFrame, value: str, limit: int, key: str = "asset_id", date: str = "date", out: str = "filled") -> DataFrame:
    """Fills a run of nulls with the value before it if the run has at most limit rows and such a value exists; else none of it."""
    w = by(key, date)
    v = F.col(value)
    df = df.withColumn("_gap", F.count(v).over(upto(w)))
    size = F.sum(F.when(v.isNull(), 1).otherwise(0)).over(Window.partitionBy(key, "_gap"))
    before = F.last(v, ignorenulls=True).over(upto(w))
    return df.withColumn(out, F.when(v.isNotNull(), v).when((size <= limit) & (F.col("_gap") > 0), before)).drop("_gap")


def fill_single_gaps(value: str, w: WindowSpec) -> Column:
    """A null between two values takes the one before."""
    v = F.col(value)
    return F.when(v.isNull() & F.lag(v).over(w).isNotNull() & F.lead(v).over(w).isNotNull(), F.lag(v).over(w)).otherwise(v)


def runs(df: DataFrame, state: Column, key: str = "asset_id", date: str = "date", out: str = "run") -> DataFrame:
    """Numbers the runs of equal state of each key."""
    w = by(key, date)
    df = df.withColumn("_state", state)
    change = F.when(F.col("_state").eqNullSafe(F.lag("_state").over(w)) & F.lag(F.lit(1)).over(w).isNotNull(), 0).otherwise(1)
    return df.withColumn("_change", change).withColumn(out, F.sum("_change").over(upto(w))).drop("_change")


def longest_run(df: DataFrame, flag: Column, key: str = "asset_id", date: str = "date") -> DataFrame:
    """Length of the longest run of rows where the flag holds, for each key (0 if none)."""
    r = runs(df, F.coalesce(flag, F.lit(False)), key, date)
    n = r.groupBy(key, "run").agg(F.sum(F.col("_state").cast("int")).alias("n"))
    return n.groupBy(key).agg(F.max("n").cast("long").alias("longest"))


def run_stats(df: DataFrame, state: str, key: str, date: str = "date", per_year: float = 365.25) -> DataFrame:
    """Rows, switches, switches a year (of rows) and mean run length of the states of each key."""
    r = runs(df, F.col(state), key, date).groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("run").alias("n_runs"))
    return r.select(key, "n", (F.col("n_runs") - 1).alias("switches"), ((F.col("n_runs") - 1) / (F.col("n") / per_year)).alias("per_year"), (F.col("n") / F.col("n_runs")).alias("mean_run"))


def rolling_corr(x: str, y: str, w: WindowSpec, rows: int) -> Column:
    frame = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).over(frame) >= rows, F.corr(x, y).over(frame))


def rolling_beta(y: str, x: str, w: WindowSpec, rows: int = 60, least: int = 30) -> Column:
    """Least-squares slope over the rows before this one."""
    frame = w.rowsBetween(-rows, -1)
    return F.when(F.regr_count(y, x).over(frame) >= least, F.regr_slope(y, x).over(frame))


def array_median(a: Column) -> Column:
    s, n = F.array_sort(a), F.size(a)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def mad_zscore(df: DataFrame, value: str, rows: int, least: int, key: str = "asset_id", date: str = "date", out: str = "mad_z") -> DataFrame:
    """Distance from the window's median in units of 1.4826 median absolute deviations."""
    df = df.withColumn("_a", values_of_window(value, by(key, date), -(rows - 1), 0)).withColumn("_m", array_median(F.col("_a")))
    mad = array_median(F.transform("_a", lambda x: F.abs(x - F.col("_m"))))
    z = (F.col(value) - F.col("_m")) / (1.4826 * F.greatest(mad, F.lit(1e-12)))
    return df.withColumn(out, F.when(F.size("_a") >= least, z)).drop("_a", "_m")


def turnover(snapshots: DataFrame, date: str = "rebalance_date", key: str = "asset_id", weight: str = "weight", halve: bool = True) -> DataFrame:
    """Between each snapshot and the one before: (half) the sum of weight changes, assets entered and exited. The first counts
    as 1.0. Dates are indexed by rank, so the join is on (index, asset) and shuffles like any equi-join."""
    dates = snapshots.select(date).distinct().withColumn("_i", F.row_number().over(Window.orderBy(date)))
    s = snapshots.join(dates, date).select("_i", key, weight)
    prev = s.select((F.col("_i") + 1).alias("_i"), key, F.col(weight).alias("_w0"))
    both = s.join(prev, ["_i", key], "full")
    change = F.sum(F.abs(F.coalesce(F.col(weight), F.lit(0.0)) - F.coalesce(F.col("_w0"), F.lit(0.0))))
    per = both.groupBy("_i").agg(change.alias("_t"), F.count_if(F.col("_w0").isNull()).alias("entered"), F.count_if(F.col(weight).isNull()).alias("exited"), F.count(weight).alias("n"))
    return dates.join(per, "_i").select(date, F.when(F.col("_i") == 1, 1.0).otherwise(F.col("_t") * (0.5 if halve else 1.0)).alias("turnover"), "entered", "exited", "n")
