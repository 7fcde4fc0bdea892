"""Scalar scores, labels and clamps, all as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, lo: float, hi: float) -> Column:
    """x within [lo, hi]; null stays null (greatest and least skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def risk_weight(apr: Column) -> Column:
    """0 up to 2, rising to 1 at 5, 1 up to 15, falling to 0 at 35 (percentage points)."""
    return F.when(apr <= 2, 0.0).when(apr < 5, (apr - 2) / 3).when(apr <= 15, 1.0).when(apr < 35, (35 - apr) / 20).when(apr.isNotNull(), 0.0)


def zone(apr: Column, edges: Sequence[float] = (2.0, 5.0, 15.0), names: Sequence[str] = ("FROZEN", "THAW", "NORMAL", "HOT")) -> Column:
    out = F.when(apr.isNull(), None)
    for e, n in zip(edges, names, strict=False):
        out = out.when(apr < e, n)
    return out.otherwise(names[-1])


def gate_state(weight: Column) -> Column:
    return F.when(weight.isNull(), None).when(weight <= 0, "CLOSED").when(weight >= 1, "OPEN").otherwise("PARTIAL")


def gate_conflict(weight: Column, label: Column) -> Column:
    """A closed gate in a normal zone, or an open one in a frozen or hot zone."""
    return (gate_state(weight) == "CLOSED") & (label == "NORMAL") | (gate_state(weight) == "OPEN") & label.isin("FROZEN", "HOT")


BUCKETS = {"RED": 1, "ORANGE": 2, "YELLOW": 3, "YELLOWGREEN": 4, "GREEN": 5}


def bucket_to_1_5(name: Column) -> Column:
    """Any case; unknown or null is 3."""
    out = F.when(F.lit(False), F.lit(0))
    for k, v in BUCKETS.items():
        out = out.when(F.upper(name) == k, v)
    return out.otherwise(3)


def score_to_1_5(score: Column, edges: Sequence[float] = (30, 45, 55, 70)) -> Column:
    out = F.when(score.isNull(), None)
    for i, e in enumerate(edges, 1):
        out = out.when(score < e, i)
    return out.otherwise(len(edges) + 1)


def log_modulus(x: Column) -> Column:
    return F.signum(x) * F.log1p(F.abs(x))


def composite(weights: Mapping[str, float], columns: Sequence[str]) -> Column:
    """Sum of weight x value; a missing value counts as 0. A name without its column takes the first that contains it."""
    out = F.lit(0.0)
    for name, w in weights.items():
        c = name if name in columns else next((x for x in columns if name in x), None)
        if c is not None:
            out = out + w * F.coalesce(F.col(c), F.lit(0.0))
    return out


def heating_risk(short: Column, long: Column, lo: float = 0.0, hi: float = 0.0002) -> Column:
    """How far the short mean lies above the long one, mapped to 0..1."""
    return clamp((short - long - lo) / (hi - lo), 0.0, 1.0)


def oi_risk(change: Column, quality: Column, scale: float = 50.0) -> Column:
    """min(change / scale, 1) x quality for rising interest, else 0."""
    return F.when(change > 0, F.least(change / scale, F.lit(1.0)) * quality).when(change.isNotNull(), 0.0)


def legacy_score(trend: Column, funding: Column, oi: Column, high_vol: Column) -> Column:
    """50 + trend - penalties, within 0..100, and at most 60 in high volatility."""
    s = clamp(50 + trend - 20 * F.coalesce(funding, F.lit(0.0)) - 15 * F.coalesce(oi, F.lit(0.0)), 0.0, 100.0)
    return F.when(high_vol, F.least(s, F.lit(60.0))).otherwise(s)


def size_multiplier(score: Column) -> Column:
    return clamp(0.5 + score / 100, 0.5, 1.5)


def position_scale(score: Column, lo: float, hi: float) -> Column:
    """0 at lo, 1 at hi, linear between."""
    return clamp((score - lo) / (hi - lo), 0.0, 1.0)


def vol_scale(vol: Column, target: float, most: float = 2.0) -> Column:
    return F.when(vol > 0, F.least(target / vol, F.lit(most)))


def short_adverse_move(entry: Column, price: Column) -> Column:
    return F.when(entry > 0, price / entry - 1)


def unrealized(side: Column, entry: Column, price: Column) -> Column:
    """Gain as a share of the entry."""
    return F.when(entry > 0, F.when(side == "SHORT", (entry - price) / entry).otherwise((price - entry) / entry))


def daily_funding_pnl(side: Column, notional: Column, rate_8h: Column) -> Column:
    """Three payments a day; shorts receive positive rates."""
    return F.when(side == "SHORT", 1.0).otherwise(-1.0) * notional * rate_8h * 3


def short_tier(entry: Column, price: Column, stop: Column) -> Column:
    """How near a short's stop is: STOP_HIT, CRITICAL (90 % of the way), WARNING (70 %), NONE."""
    way = (price - entry) / F.when(stop != entry, stop - entry)
    return F.when(price >= stop, "STOP_HIT").when(way >= 0.9, "CRITICAL").when(way >= 0.7, "WARNING").otherwise("NONE")


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
