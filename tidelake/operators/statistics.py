"""Statistics of daily series and small cross-sections: regressions, correlations of ranks, tests, resampling, and the few
matrix methods, which run in grouped pandas over one bounded group (the members of one basket or universe)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import selection
from .windows import ratio


def average_rank(value: str, group: Sequence[str]) -> Column:
    """Within a group. (Of a whole table: `selection.ranked`.)"""
    w = Window.partitionBy(*group)
    same = Window.partitionBy(*group, value)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(same) - 1) / 2.0


def spearman(df: DataFrame, group: Sequence[str], x: str, y: str) -> DataFrame:
    """Pearson correlation of average ranks, by group."""
    d = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = d.withColumns({"_x": average_rank(x, group), "_y": average_rank(y, group)})
    return d.groupBy(*group).agg(F.corr("_x", "_y").alias("spearman"), F.corr(x, y).alias("pearson"), F.count(F.lit(1)).alias("n"))


def linear_fit(df: DataFrame, group: Sequence[str], y: str, x: str) -> DataFrame:
    """Slope, intercept, r2, n, and the slope's t-value."""
    g = df.groupBy(*group).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"), F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"))
    se = F.sqrt(ratio((1 - F.col("r2")) * F.col("_syy"), (F.col("n") - 2).cast("double") * F.col("_sxx")))
    return g.withColumn("t", ratio(F.col("slope"), se)).drop("_sxx", "_syy")


def beta(df: DataFrame, key: str, y: str, x: str, least: int = 20) -> DataFrame:
    """Least-squares slope by key, for keys with enough pairs."""
    return df.groupBy(key).agg(F.regr_slope(y, x).alias("beta"), F.regr_count(y, x).alias("n")).where(F.col("n") >= least)


def winsorized(df: DataFrame, group: Sequence[str], values: Sequence[str], lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    q = df.groupBy(*group).agg(*(F.percentile(v, F.array(F.lit(lo), F.lit(hi))).alias(f"_q_{v}") for v in values))
    x = df.join(q, list(group))
    for v in values:
        x = x.withColumn(v, F.when(F.col(v).isNotNull(), F.greatest(F.get(f"_q_{v}", 0), F.least(F.get(f"_q_{v}", 1), F.col(v)))))
    return x.drop(*(f"_q_{v}" for v in values))


def ridge_betas(df: DataFrame, key: str, y: str, x1: str, x2: str, alpha: float = 0.1, most: float = 3.0, least: int = 30) -> DataFrame:
    """Two-factor ridge with an intercept, in closed form from the centred sums; clamped to 0..most; 1 with too few rows."""
    d = df.where(F.col(y).isNotNull() & F.col(x1).isNotNull() & F.col(x2).isNotNull())
    n = F.count(F.lit(1))
    c = lambda a, b: F.covar_pop(a, b) * n
    g = d.groupBy(key).agg(n.alias("n"), (c(x1, x1) + alpha).alias("_a"), c(x1, x2).alias("_b"), (c(x2, x2) + alpha).alias("_d"), c(x1, y).alias("_e"), c(x2, y).alias("_f"))
    det = F.col("_a") * F.col("_d") - F.col("_b") * F.col("_b")
    b1 = ratio(F.col("_d") * F.col("_e") - F.col("_b") * F.col("_f"), det)
    b2 = ratio(F.col("_a") * F.col("_f") - F.col("_b") * F.col("_e"), det)
    bound = lambda b: F.when(F.col("n") < least, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(most), b)))
    return g.select(key, "n", bound(b1).alias("beta1"), bound(b2).alias("beta2"))


def market_model(df: DataFrame, key: str, date: str, y: str, x: str, event: str, first: int = -180, last: int = -60, least: int = 30) -> DataFrame:
    """Abnormal and cumulated abnormal return after the event, against a line fitted between first and last days before it
    (slope 1 through 0 with too few days)."""
    day = F.datediff(date, F.lit(event).cast("date"))
    d = df.withColumn("_day", day)
    m = d.where(F.col("_day").between(first, last)).groupBy(key).agg(F.regr_intercept(y, x).alias("_a"), F.regr_slope(y, x).alias("_b"), F.regr_count(y, x).alias("_n"))
    z = d.where(F.col("_day") > last).join(m, key, "left")
    few = F.coalesce(F.col("_n") < least, F.lit(True))
    z = z.withColumn("ar", F.col(y) - (F.when(few, 0.0).otherwise(F.col("_a")) + F.when(few, 1.0).otherwise(F.col("_b")) * F.col(x)))
    return z.withColumn("car", F.sum("ar").over(Window.partitionBy(key).orderBy(date))).drop("_a", "_b", "_n", "_day")


def group_test(df: DataFrame, group: str, value: str) -> DataFrame:
    """n, mean, deviation, t-value of the mean, and share above zero."""
    g = df.groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.avg((F.col(value) > 0).cast("double")).alias("hit"))
    return g.withColumn("t", ratio(F.col("mean"), F.col("std") / F.sqrt(F.col("n").cast("double"))))


def p_value(t: float | None, dof: int) -> float | None:
    """Two-sided p of Student's t, by the continued fraction of the incomplete beta function."""
    if t is None or dof < 1 or t != t:
        return None
    x, a, b = dof / (dof + t * t), dof / 2.0, 0.5
    if x in (0.0, 1.0):
        return x
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))

    def fraction(p: float, q: float, z: float) -> float:
        c, d = 1.0, 1.0 - (p + q) * z / (p + 1)
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        h = d
        for m in range(1, 300):
            for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + num * d
                c = 1 + num / c
                d = 1 / (d if abs(d) > 1e-300 else 1e-300)
                h *= d * c
            if abs(d * c - 1) < 1e-12:
                break
        return h

    return front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * fraction(b, a, 1 - x) / b


def with_p(df: DataFrame, t: str = "t", n: str = "n", fewer: int = 1, out: str = "p") -> DataFrame:
    def run(tt: pd.Series, nn: pd.Series) -> pd.Series:
        return pd.Series([p_value(None if pd.isna(x) else float(x), int(k) - fewer) for x, k in zip(tt, nn, strict=True)], dtype="float64")

    return df.withColumn(out, F.pandas_udf(run, "double")(t, n))


def edges(df: DataFrame, group: str, value: str, best: str, worst: str) -> DataFrame:
    """Mean of the best and worst group against the mean of all, and their spread."""
    a = df.agg(F.avg(F.when(F.col(group) == best, F.col(value))).alias("_b"), F.avg(F.when(F.col(group) == worst, F.col(value))).alias("_w"), F.avg(value).alias("_m"), F.count(value).alias("n"))
    return a.select((F.col("_b") - F.col("_m")).alias("edge_best"), (F.col("_w") - F.col("_m")).alias("edge_worst"), (F.col("_b") - F.col("_w")).alias("spread"), "n")


def wilcoxon(df: DataFrame, value: str) -> DataFrame:
    """Sum of the signed ranks of |x| (zeros left out), and its normal score."""
    d = df.where(F.col(value) != 0).select(F.abs(value).alias("_x"), F.signum(value).alias("_s"))
    d = selection.ranked(d, "_x", "_r", average=True)
    g = d.agg(F.sum(F.col("_r") * F.col("_s")).alias("w"), F.sum(F.col("_r") ** 2).alias("_v"), F.count(F.lit(1)).alias("n"))
    return g.select("w", (F.col("w") / F.sqrt("_v")).alias("z"), "n")


def block_bootstrap(df: DataFrame, date: str, value: str, blocks: int = 10, draws: int = 300, seed: int = 42) -> DataFrame:
    """Means of series put together from blocks of neighbouring rows drawn with replacement: draw, mean. Blocks are drawn in
    Spark (seeded hashes), then joined with the rows by position."""
    rows = df.where(F.col(value).isNotNull()).withColumn("_i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(date)) - 1).select("_i", value)
    n = rows.count()
    if not n:
        return df.sparkSession.createDataFrame([], "draw long, mean double")
    need = -(-n // blocks)
    picks = df.sparkSession.range(draws).select(F.col("id").alias("draw"), F.explode(F.sequence(F.lit(0), F.lit(need - 1))).alias("_b"))
    start = F.pmod(F.xxhash64("draw", "_b", F.lit(seed)), F.lit(max(1, n - blocks + 1)))
    picks = picks.withColumn("_s", start).select("draw", F.explode(F.sequence(F.col("_s"), F.col("_s") + blocks - 1)).alias("_i"))
    return picks.join(rows, "_i").groupBy("draw").agg(F.avg(value).alias("mean"))


def bootstrap_interval(means: DataFrame, observed: float) -> DataFrame:
    return means.agg(F.percentile("mean", 0.025).alias("lo"), F.percentile("mean", 0.975).alias("hi"), F.avg((F.abs("mean") >= abs(observed)).cast("double")).alias("p"))


def threshold_sweep(df: DataFrame, signal: str, ret: str, thresholds: int = 50) -> DataFrame:
    """For each quantile of the signal: compounded log return of the rows above it, below it, and their counts. Rows are added up between
    neighbouring thresholds; only those sums are put together for each threshold."""
    df = selection.kept(df)
    edges = selection.quantiles(df, signal, [i / thresholds for i in range(thresholds + 1)])
    if edges[0] is None:
        edges = []
    reached = F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= F.col(signal))) if edges else F.lit(0)
    parts = df.where(F.col(signal).isNotNull()).groupBy(reached.alias("_k")).agg(F.sum(F.log1p(ret)).alias("_s"), F.count(F.lit(1)).alias("_n"))
    q = df.sparkSession.createDataFrame(list(enumerate(edges)), "i int, threshold double")
    up = F.col("_k") > F.col("i")
    x = q.join(parts, F.col("_k") >= 0)  # at most thresholds + 1 rows on either side
    return x.groupBy("i", "threshold").agg(F.expm1(F.sum(F.when(up, F.col("_s")))).alias("above"), F.expm1(F.sum(F.when(~up, F.col("_s")))).alias("below"), F.coalesce(F.sum(F.when(up, F.col("_n"))), F.lit(0)).alias("n_above"))


def series_error(a: DataFrame, b: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Errors between two series on their common keys."""
    d = a.join(b, key)
    e = F.abs(F.col(x) - F.col(y))
    return d.agg(F.count(F.lit(1)).alias("n"), F.avg(e).alias("mae"), F.avg(ratio(e, F.abs(F.col(y)))).alias("mape"), F.max(e).alias("worst"), F.corr(x, y).alias("corr"))


def inversions(df: DataFrame, order: str, value: str) -> DataFrame:
    """How often the value falls from one bucket to the next."""
    n = F.lead(value).over(Window.partitionBy(F.lit(0)).orderBy(order))
    return df.withColumn("_n", n).agg(F.count_if(F.col("_n") < F.col(value)).alias("inversions"), F.count("_n").alias("pairs"))


# Matrix methods over the members of one group


def shrunk_covariance(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Covariance shrunk towards a multiple of the identity, with the weight of least expected error."""
    n, p = x.shape
    x = x - x.mean(axis=0)
    s = x.T @ x / n
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum() / p
    b2 = min(d2, sum(((np.outer(r, r) - s) ** 2).sum() for r in x) / n**2 / p)
    w = b2 / d2 if d2 > 0 else 0.0
    return w * mu * np.eye(p) + (1 - w) * s, w


def first_component(cov: np.ndarray) -> tuple[float, np.ndarray]:
    """Share of the variance and loadings (sign: the largest is positive) of the first principal component."""
    values, vectors = np.linalg.eigh(cov)
    v = vectors[:, -1]
    return float(values[-1] / values.sum()), v * np.sign(v[np.argmax(np.abs(v))])


def onto_simplex(v: np.ndarray, total: float, cap: float) -> np.ndarray:
    """The nearest weights from 0 to cap that add up to total."""
    cap = max(cap, total / len(v))
    lo, hi = v.min() - cap, v.max()
    for _ in range(60):  # the shift that makes the clipped weights add up
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if np.clip(v - mid, 0, cap).sum() > total else (lo, mid)
    w = np.clip(v - hi, 0, cap)
    return w * (total / w.sum())


def min_variance(cov: np.ndarray, cap: float = 0.2, rounds: int = 500) -> np.ndarray:
    """Long-only weights that add up to one, each at most cap, of least variance, by projected gradient."""
    w, step = np.full(len(cov), 1.0 / len(cov)), 1.0 / (2 * np.linalg.eigvalsh(cov)[-1] + 1e-12)
    for _ in range(rounds):
        w = onto_simplex(w - step * 2 * cov @ w, 1.0, cap)
    return w


def long_short_variance(cov: np.ndarray, longs: int, cap: float = 0.1, rounds: int = 500) -> np.ndarray:
    """Weights of least variance of a dollar-neutral basket with gross one: the first `longs` members add up to one half, the
    others to minus one half, none is beyond cap. (Without fixed sides the least variance is that of no position at all.)"""
    sign = np.where(np.arange(len(cov)) < longs, 1.0, -1.0)
    signed = cov * np.outer(sign, sign)
    w = np.where(sign > 0, 0.5 / longs, 0.5 / (len(cov) - longs))
    step = 1.0 / (2 * np.linalg.eigvalsh(cov)[-1] + 1e-12)
    for _ in range(rounds):
        v = w - step * 2 * signed @ w
        w = np.concatenate([onto_simplex(v[:longs], 0.5, cap), onto_simplex(v[longs:], 0.5, cap)])
    return w * sign


def greedy_sides(cov: np.ndarray, n: int, pool: int = 60) -> tuple[list[int], list[int]]:
    """n longs and n shorts, taken in pairs: each time the pair (the first in order, of the first `pool` members left) after which the
    equal-weighted basket varies least. All pairs of a step are one matrix."""
    longs: list[int] = []
    shorts: list[int] = []
    left = np.arange(len(cov))
    own = np.diag(cov)
    for k in range(1, n + 1):
        c = left[:pool]
        side = lambda held: cov[np.ix_(held, held)].sum() + 2 * cov[np.ix_(c, held)].sum(axis=1) + own[c]
        across = cov[np.ix_(longs, shorts)].sum() + cov[np.ix_(c, shorts)].sum(axis=1)[:, None] + cov[np.ix_(c, longs)].sum(axis=1)[None, :] + cov[np.ix_(c, c)]
        variance = (side(longs)[:, None] + side(shorts)[None, :] - 2 * across) / k**2
        np.fill_diagonal(variance, np.inf)
        a, b = divmod(int(np.argmin(variance)), len(c))
        longs.append(int(c[a]))
        shorts.append(int(c[b]))
        left = left[(left != c[a]) & (left != c[b])]
    return longs, shorts


def factor_neutral_sides(cov: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """The n members with the lowest loadings on the first principal component long, the n with the highest short."""
    order = np.argsort(first_component(cov)[1], kind="stable").tolist()
    return order[:n], order[-n:]


def average_linkage(distance: np.ndarray, k: int) -> np.ndarray:
    """Cluster numbers (from 0, by smallest member) of agglomerative clustering with average linkage."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, owner = np.ones(n), np.arange(n)
    for _ in range(n - max(1, k)):
        a, b = sorted(divmod(int(np.argmin(d)), n))
        joined = (size[a] * d[a] + size[b] * d[b]) / (size[a] + size[b])
        d[a], d[:, a] = joined, joined
        d[b], d[:, b], d[a, a] = np.inf, np.inf, np.inf
        size[a] += size[b]
        owner[owner == b] = a
    return np.unique(owner, return_inverse=True)[1]


def lowess(x: np.ndarray, y: np.ndarray, frac: float = 0.3) -> np.ndarray:
    """Locally weighted lines with tricube weights."""
    n = len(x)
    k = max(2, int(math.ceil(frac * n)))
    out = np.empty(n)
    for i in range(n):
        d = np.abs(x - x[i])
        h = np.partition(d, k - 1)[k - 1] or 1e-12
        w = np.clip(1 - (d / h) ** 3, 0, 1) ** 3
        m = (w * x).sum() / w.sum()
        sxx = (w * (x - m) ** 2).sum()
        my = (w * y).sum() / w.sum()
        out[i] = my + ((w * (x - m) * (y - my)).sum() / sxx * (x[i] - m) if sxx > 0 else 0.0)
    return out


def basket_matrix(df: DataFrame, group: str, key: str, date: str, ret: str, method: str, k: int = 4, cap: float = 0.2) -> DataFrame:
    """group, key, value for each member of each group: "minvar" weights, "pca" loadings, "cluster" numbers, or "cov" (the
    shrunk variance). One group is one basket: a few hundred members at most, over one lookback."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index=date, columns=key, values=ret).fillna(0.0).sort_index()
        x, names = wide.to_numpy(), list(wide.columns)
        cov, _ = shrunk_covariance(x)
        if method == "minvar":
            v = min_variance(cov, cap)
        elif method == "pca":
            v = first_component(cov)[1]
        elif method == "cluster":
            sd = np.sqrt(np.diag(cov))
            v = average_linkage(1 - cov / np.outer(sd, sd), k).astype(float)
        else:
            v = np.diag(cov)
        return pd.DataFrame({group: [pdf[group].iloc[0]] * len(names), key: names, "value": v})

    schema = f"`{group}` {df.schema[group].dataType.simpleString()}, `{key}` {df.schema[key].dataType.simpleString()}, value double"
    return df.select(group, key, date, ret).groupBy(group).applyInPandas(run, schema)


def long_short_baskets(df: DataFrame, group: str, key: str, date: str, ret: str, n: int = 15, least: int = 30, pool: int = 60, cap: float = 0.1) -> DataFrame:
    """group, method, weighting, key, weight: for each group (a rebalance date with the returns of its lookback), the baskets of
    the methods "greedy" and "factor_neutral", each with weighting "equal" and "optimised" (gross one, dollar-neutral).

    Members are ordered by key; a missing return counts as 0. Groups of fewer than `least` days or 2 n members give no rows. No
    task holds a group (see `market`). Runs jobs.
    """
    from . import market

    return market.long_short_baskets(df, group, key, date, ret, n, least, pool, cap)


def rank_sides(df: DataFrame, group: str, key: str, date: str, ret: str, methods: Sequence[str] = ("minvar_rank", "momentum_rank", "random"), n: int = 15, recent: int = 30, least: int = 20) -> DataFrame:
    """group, method, key, weight: dollar-neutral equal-weighted baskets by rank, for each group (a rebalance date with the returns of its lookback), without bringing a group's
    matrix into one task: members are aggregated first, and only those numbers are ranked.

    minvar_rank: the n members that vary least long, the n that vary most short; momentum_rank: the lowest mean of the group's last `recent` days long (they revert), the highest
    short; random: drawn by a hash of date and member from those with `least` returns. A method with fewer than 2 n members falls back to minvar_rank; a group with fewer
    even there has no rows. Ties go to the smaller key."""
    day = F.dense_rank().over(Window.partitionBy(group).orderBy(F.desc(date)))
    x = df.select(group, key, date, ret).withColumn("_d", day)
    m = x.groupBy(group, key).agg(F.stddev_samp(ret).alias("_vol"), F.avg(F.when(F.col("_d") <= recent, F.col(ret))).alias("_mu"), F.count(ret).alias("_n"))
    drawn = F.md5(F.concat_ws(":", F.col(group).cast("string"), F.col(key).cast("string")))
    value = {"minvar_rank": F.when(F.col("_vol") > 0, F.col("_vol")), "momentum_rank": F.col("_mu"), "random": F.when(F.col("_n") >= least, F.conv(F.substring(drawn, 1, 12), 16, 10).cast("double"))}
    names = F.explode(F.array(*(F.struct(F.lit(a).alias("method"), value[a].alias("_v"), value["minvar_rank"].alias("_o")) for a in methods)))
    m = m.select(group, key, names.alias("_s")).select(group, key, "_s.method", "_s._v", "_s._o")
    both = Window.partitionBy(group, "method")
    m = m.withColumn("_x", F.when(F.count("_v").over(both) >= 2 * n, F.col("_v")).otherwise(F.col("_o"))).where("_x is not null")
    m = m.withColumns({"_k": F.row_number().over(both.orderBy("_x", key)), "_c": F.count(F.lit(1)).over(both)}).where(F.col("_c") >= 2 * n)
    weight = F.when(F.col("_k") <= n, 0.5 / n).when(F.col("_k") > F.col("_c") - n, -0.5 / n)
    return m.select(group, "method", key, weight.alias("weight")).where("weight is not null")


def select_basket(df: DataFrame, group: str, key: str, method: str, n: int = 15) -> DataFrame:
    """n members of each group: "minvar" (lowest vol), "momentum" (highest), "random" (seeded hash), "diverse" (lowest corr)."""
    order = {"minvar": F.col("vol").asc(), "momentum": F.col("momentum").desc(), "random": F.xxhash64(key, F.lit(42)).asc(), "diverse": F.col("corr").asc()}[method]
    k = F.row_number().over(Window.partitionBy(group).orderBy(order, key))
    return df.withColumn("_k", k).where(F.col("_k") <= n).select(group, key, F.lit(method).alias("method"), F.col("_k").alias("rank"), F.lit(1.0 / n).alias("weight"))
