"""Pairing records with the nearest record in time of the same entity.

Each right-side timestamp owns the interval of instants that are nearer to it than to its neighbours, bounded by the
midpoints and the tolerance. The intervals of an entity are disjoint, so a left-side instant lies in one at most and
the match is a range join. Entities are cut into time bands longer than twice the tolerance: neighbours are looked up
within a band (with the records near its edges copied to the next), and the join is on (entity, band), so one entity
with a third of all rows spreads over its bands.

Defined results: null entities or times never match; of several right records at one instant the lowest number
stands; an instant midway between two records belongs to the lower number; a distance equal to the tolerance is no match.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_US = 86_400_000_000


def intervals(right: DataFrame, tolerance_us: int = DAY_US, band_us: int = 8 * DAY_US) -> DataFrame:
    """(entity, number, at, lo, hi, band): the instants, both ends included, nearest to each right record, by time band.

    ``right``: (entity, number, at bigint). Ends are whole microseconds.
    """
    if band_us < 2 * tolerance_us:
        raise ValueError("a band must hold twice the tolerance")
    reach = 2 * tolerance_us
    at, home = F.col("at"), F.floor(F.col("at") / F.lit(band_us)).cast("bigint")
    one = right.where("entity IS NOT NULL AND at IS NOT NULL").groupBy("entity", "at").agg(F.min("number").alias("number"))
    offset = F.col("at") - home * band_us
    bands = F.array_compact(
        F.array(home, F.when(offset < reach, home - 1), F.when(offset >= band_us - reach, home + 1))
    )
    spread = one.select("entity", "at", "number", home.alias("home"), F.explode(bands).alias("band"))
    w = Window.partitionBy("entity", "band").orderBy("at")
    near = spread.select(
        "entity", "at", "number", "home", "band",
        F.lag("at").over(w).alias("before"), F.lag("number").over(w).alias("before_number"),
        F.lead("at").over(w).alias("after"), F.lead("number").over(w).alias("after_number"),
    ).where("home = band")
    # twice the instant is compared with the sum of two neighbours: the lower number takes a tie
    low_sum, high_sum = F.col("before") + at, F.col("after") + at
    lo = F.when(F.pmod(low_sum, F.lit(2)) == 1, F.expr("(before + at - 1) div 2") + 1).otherwise(
        F.expr("(before + at) div 2") + F.when(F.col("before_number") < F.col("number"), 1).otherwise(0)
    )
    hi = F.when(F.pmod(high_sum, F.lit(2)) == 1, F.expr("(after + at - 1) div 2")).otherwise(
        F.expr("(after + at) div 2") - F.when(F.col("after_number") < F.col("number"), 1).otherwise(0)
    )
    edge = tolerance_us - 1
    cut = near.select(
        "entity", "number", "at",
        F.greatest(at - edge, F.coalesce(lo, at - edge)).alias("lo"),
        F.least(at + edge, F.coalesce(hi, at + edge)).alias("hi"),
    )
    first, last = (F.floor(F.col(c) / F.lit(band_us)).cast("bigint") for c in ("lo", "hi"))
    return cut.withColumn("band", F.explode(F.sequence(first, last)))


def nearest(left: DataFrame, right: DataFrame, tolerance_us: int = DAY_US, band_us: int = 8 * DAY_US) -> DataFrame:
    """Each ``left`` row (entity, id, at) with the nearest ``right`` row (entity, number, at): (entity, id, number, distance)."""
    owned = intervals(right, tolerance_us, band_us).withColumnRenamed("at", "right_at")
    probe = left.where("entity IS NOT NULL AND at IS NOT NULL").select(
        "entity", "id", "at", F.floor(F.col("at") / F.lit(band_us)).cast("bigint").alias("band")
    )
    return (
        probe.join(owned, ["entity", "band"])
        .where("at BETWEEN lo AND hi")
        .select("entity", "id", "number", (F.col("at") - F.col("right_at")).alias("distance"))
    )


def latest_copy(df: DataFrame, *columns: str) -> DataFrame:
    """Of the copies of one (repo_id, number) the ``columns`` of that with the greatest fetched_at, then id."""
    newest = F.max_by(F.struct(*columns), F.struct("fetched_at", "id")).alias("newest")
    return df.groupBy("repo_id", "number").agg(newest).select("repo_id", "number", "newest.*")


def issues_to_merges(issues: DataFrame, pulls: DataFrame) -> DataFrame:
    """(repo_id, issue_number, pr_number, merge_commit_sha, distance_us): the merge nearest to each closed issue within a day."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    closed = latest_copy(issues.select("repo_id", "number", "id", "fetched_at", us("closed_at").alias("at")), "at")
    usable = F.col("merged") & F.col("merge_commit_sha").rlike(r"\S")
    merged = latest_copy(
        pulls.select("repo_id", "number", "id", "fetched_at", F.when(usable, us("merged_at")).alias("at"), F.when(usable, F.col("merge_commit_sha")).alias("sha")),
        "at", "sha",
    ).where("at IS NOT NULL")
    pairs = nearest(
        closed.select(F.col("repo_id").alias("entity"), F.col("number").alias("id"), "at"),
        merged.select(F.col("repo_id").alias("entity"), F.struct("number", "sha").alias("number"), "at"),
    )
    return pairs.select(
        F.col("entity").alias("repo_id"), F.col("id").alias("issue_number"), F.col("number.number").alias("pr_number"),
        F.col("number.sha").alias("merge_commit_sha"), F.col("distance").alias("distance_us"),
    )
