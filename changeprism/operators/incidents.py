"""Incidents: linking to code units, counts, types, repair times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def link_incidents(events: DataFrame, changes: DataFrame) -> DataFrame:
    """(block, issue, sha, at): units changed by the commit that closed an issue; of several events the oldest stands.

    ``events``: (issue, sha, at); ``changes``: (block, sha).
    """
    hits = events.join(changes.select("block", "sha").distinct(), "sha")
    return hits.groupBy("block", "issue").agg(F.min(F.struct("at", "sha")).alias("o")).select("block", "issue", "o.sha", "o.at")


def incident_counts(blocks: DataFrame, links: DataFrame) -> DataFrame:
    """(block, incidents, last_at); units without incidents keep a row with 0."""
    n = links.groupBy("block").agg(F.count("*").alias("n"), F.max("at").alias("last_at"))
    return blocks.select("block").distinct().join(n, "block", "left").select("block", F.coalesce("n", F.lit(0)).alias("incidents"), "last_at")


def incident_statistics(links: DataFrame) -> DataFrame:
    """Units, issues, links, and the mean and greatest count of a unit, weighted by links."""
    n = links.groupBy("block").agg(F.count("*").alias("n"))
    return links.join(n, "block").agg(
        F.countDistinct("block").alias("blocks"), F.countDistinct("issue").alias("issues"), F.count("*").alias("links"), F.avg("n").alias("avg_incidents"), F.max("n").alias("max_incidents")
    )


def incident_type(labels: Column) -> Column:
    """The first label that speaks of a bug, security or critical state, else the first label as it is written, else unknown."""
    hit = F.filter(labels, lambda x: F.lower(x).rlike("bug|security|critical"))
    found = F.lower(F.get(hit, F.lit(0)))
    kind = F.when(found.contains("bug"), "bug").when(found.contains("security"), "security").when(found.contains("critical"), "critical")
    return F.coalesce(kind, F.get(labels, F.lit(0)), F.lit("unknown"))


def repair_hours(issues: DataFrame, by: str) -> DataFrame:
    """(by, closed, mean_hours) from creation to closing."""
    h = (F.unix_micros(F.col("closed_at").cast("timestamp")) - F.unix_micros(F.col("created_at").cast("timestamp"))) / F.lit(3.6e9)
    return issues.where("closed_at IS NOT NULL").groupBy(by).agg(F.count("*").alias("closed"), F.avg(h).alias("mean_hours"))


def coverage(parts: dict[str, tuple[DataFrame, DataFrame]]) -> DataFrame:
    """(metric, percent): distinct keys k of each first table by the rows of the second."""
    out = None
    for name, (hits, all_rows) in parts.items():
        row = hits.agg(F.countDistinct("k").alias("n")).crossJoin(all_rows.agg(F.count("*").alias("total")))  # one row each
        row = row.select(F.lit(name).alias("metric"), F.coalesce(F.try_divide(F.col("n") * 100.0, "total"), F.lit(0.0)).alias("percent"))
        out = row if out is None else out.unionByName(row)
    return out
