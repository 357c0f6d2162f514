"""Risk scores and levels as column expressions; every time-dependent term takes ``as_of``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recency(last_at: Column, as_of: Column, none: float = 0.0) -> Column:
    return F.when(last_at.isNull(), none).when(last_at > as_of - F.expr("INTERVAL 90 DAYS"), 2.0).when(last_at > as_of - F.expr("INTERVAL 180 DAYS"), 1.0).otherwise(0.5)


def composite_risk(blocks: DataFrame, as_of: Column, by: list[str] | None = None) -> DataFrame:
    """``blocks`` with risk_score from 0 to 100, the greatest raw score of the group being 100.

    Reads incidents, last_at, staleness_days, complexity, couplings, avg_rate. Without ``by`` the maximum comes from an
    aggregate of one row, with it from a null-safe join, so units without a group are one group and a large group is split.
    """
    temporal = F.col("incidents") * recency(F.col("last_at"), as_of)
    owner = F.coalesce("staleness_days", F.lit(0)) / F.lit(365.0) * F.coalesce("complexity", F.lit(1))
    coupling = F.coalesce("couplings", F.lit(0)) * F.coalesce("avg_rate", F.lit(0.0))
    raw = blocks.withColumn("raw", temporal * 0.4 + owner * 0.3 + coupling * 0.3)
    top = raw.groupBy(*(by or [])).agg(F.max("raw").alias("top"))
    if by:
        t = top.select(*(F.col(b).alias(f"_{b}") for b in by), "top")
        on = F.lit(True)
        for b in by:
            on = on & F.col(b).eqNullSafe(F.col(f"_{b}"))
        out = raw.join(t, on).drop(*(f"_{b}" for b in by))
    else:
        out = raw.crossJoin(F.broadcast(top))  # top is one row
    return out.withColumn("risk_score", F.when(F.col("top") > 0, F.col("raw") / F.col("top") * 100.0).otherwise(0.0)).drop("raw", "top")


def ranked_risk(incidents: Column, rate_sum: Column, staleness: Column, is_class: Column, recent: bool = False) -> Column:
    score = incidents * 10.0 + rate_sum * 2.0 + F.least(staleness / 30.0, F.lit(3.0)) + F.when(is_class, 2.0).otherwise(0.0)
    return score + F.when(staleness < 30, (30.0 - staleness) / 30.0 * 5.0).otherwise(0.0) if recent else score


def diff_points(incidents: Column, stale: Column, single_owner: Column, coupling: Column) -> Column:
    inc = F.when(incidents >= 5, 40).when(incidents >= 3, 30).when(incidents >= 1, 15).otherwise(0)
    cpl = F.when(coupling > 10, 30).when(coupling > 5, 20).when(coupling > 0, 10).otherwise(0)
    return inc + F.when(stale, 20).otherwise(0) + F.when(single_owner, 10).otherwise(0) + cpl


def diff_level(points: Column) -> Column:
    return F.when(points >= 70, "CRITICAL").when(points >= 50, "HIGH").when(points >= 30, "MEDIUM").otherwise("LOW")


def adaptive_level(value: Column, threshold: Column) -> Column:
    """Counts: LOW up to half the threshold (whole part), MEDIUM up to it."""
    return F.when(value <= F.floor(threshold / 2), "LOW").when(value <= threshold, "MEDIUM").otherwise("HIGH")


def ratio_level(ratio: Column, threshold: Column) -> Column:
    return F.when(ratio < threshold, "HIGH").when(ratio < threshold + 0.3, "MEDIUM").otherwise("LOW")


def escalate(coupling: Column, co_change: Column, test_ratio: Column, t_coupling: float, t_co_change: float, t_ratio: float) -> Column:
    none = (coupling == 0) & (co_change == 0) & (test_ratio == 0)
    return (coupling > t_coupling) | (co_change > t_co_change) | (test_ratio < t_ratio) | none | (coupling > 5) | (co_change > 0.4)
