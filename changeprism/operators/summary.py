"""Reports that compose the other operators: filtered risk summary, unit history, partners, matching by tiers, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changeprism.operators.risk import ranked_risk


def risk_summary(blocks: DataFrame, kinds: list[str] | None = None, min_incidents: int = 0, min_staleness: int = 0, min_score: float = 0.0, recent: bool = False, max_blocks: int = 10) -> DataFrame:
    """Units by risk. ``blocks``: (block, kind, incidents, rate_sum, staleness_days). Kinds, incidents and staleness
    filter before scoring, the score after it; ``max_blocks`` 0 gives all."""
    b = blocks.where((F.col("incidents") >= min_incidents) & (F.col("staleness_days") >= min_staleness))
    if kinds:
        b = b.where(F.col("kind").isin(*kinds))
    score = ranked_risk(F.col("incidents"), F.coalesce("rate_sum", F.lit(0.0)), F.col("staleness_days"), F.col("kind") == "class", recent)
    out = b.withColumn("risk_score", F.round(score, 6)).where(F.col("risk_score") >= min_score).orderBy(F.desc("risk_score"), "block")
    return out.limit(max_blocks) if max_blocks else out


def unit_history(changes: DataFrame, incidents: DataFrame, days: int = 7) -> DataFrame:
    """``changes`` (block, sha, at) with the incidents (block, issue, at) of the unit within ``days`` before or after; changes
    without one stay. Bands of that width make it an equi join, so a unit with many rows spreads over its bands."""
    width = days * 86_400_000_000
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    band = lambda c: F.floor(us(c) / F.lit(width)).cast("bigint")
    c = changes.withColumn("band", band("at"))
    i = incidents.select("block", "issue", us("at").alias("i_us"), F.explode(F.array(band("at") - 1, band("at"), band("at") + 1)).alias("band"))
    near = c.join(i, ["block", "band"], "left").withColumn("hit", F.abs(us("at") - F.col("i_us")) <= width)
    kept = near.groupBy("block", "sha", "at").agg(F.array_sort(F.collect_set(F.when(F.col("hit"), F.col("issue")))).alias("issues"))
    return kept


def partners(changes: DataFrame, units: list, min_count: int = 3, min_frequency: float = 0.3, k: int = 10, samples: int = 0) -> DataFrame:
    """(other, n, frequency): units that changed in the commits of ``units``, often in number or in share; the k most, with the
    first ``samples`` of those commits (sample)."""
    mine = changes.where(F.col("block").isin(*units)).select("sha").distinct()
    total = mine.agg(F.count("*").alias("total"))
    n = changes.where(~F.col("block").isin(*units)).join(mine, "sha", "left_semi").groupBy(F.col("block").alias("other")).agg(F.countDistinct("sha").alias("n"))
    out = n.crossJoin(F.broadcast(total)).withColumn("frequency", F.try_divide(F.col("n"), F.col("total")))  # total is one row
    best = out.where((F.col("n") >= min_count) | (F.col("frequency") >= min_frequency)).orderBy(F.desc("n"), "other").limit(k).select("other", "n", "frequency")
    if not samples:
        return best
    w = Window.partitionBy("block").orderBy("sha")
    first = changes.join(mine, "sha", "left_semi").join(best.select(F.col("other").alias("block")), "block", "left_semi").select("block", "sha").distinct().withColumn("at", F.row_number().over(w)).where(F.col("at") <= samples)
    return best.join(first.groupBy(F.col("block").alias("other")).agg(F.array_sort(F.collect_list("sha")).alias("sample")), "other").orderBy(F.desc("n"), "other")


def file_statistics(incidents: DataFrame, by: str, as_of: Column) -> DataFrame:
    """(by, total, last_30, last_90, critical, high, last_at, mean_seconds) of (by, severity, at, resolved_at)."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    age = (us(as_of) - us(F.col("at"))) / F.lit(86_400_000_000)
    return incidents.groupBy(by).agg(
        F.count("*").alias("total"), F.count_if(age <= 30).alias("last_30"), F.count_if(age <= 90).alias("last_90"),
        F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "high").alias("high"),
        F.max("at").alias("last_at"), F.avg((us(F.col("resolved_at")) - us(F.col("at"))) / F.lit(1e6)).alias("mean_seconds"),
    )


def match_by_tiers(wanted: DataFrame, known: DataFrame, tiers: list[list[str]], value: str, otherwise: str) -> DataFrame:
    """``wanted`` with ``value`` of the first tier of equal columns that ``known`` answers, the least value on a tie."""
    w = wanted.withColumn("_id", F.to_json(F.struct(*wanted.columns)))  # nulls are left out under their names, so rows that differ have texts that differ
    hits = None
    for t, columns in enumerate(tiers):
        best = known.where(" AND ".join(f"{c} IS NOT NULL" for c in columns)).groupBy(*columns).agg(F.min(value).alias(value))
        h = w.join(best, columns).select("_id", F.lit(t).alias("tier"), value)
        hits = h if hits is None else hits.unionByName(h)
    one = hits.groupBy("_id").agg(F.min(F.struct("tier", value)).alias("h"))
    return w.join(one, "_id", "left").select(*wanted.columns, F.coalesce(F.col(f"h.{value}").cast("string"), F.lit(otherwise)).alias(value), F.col("h.tier").alias("tier"))


def rank_candidates(pairs: DataFrame) -> DataFrame:
    """score of (temporal, comment, body, title, file) similarities of an issue and its candidate."""
    w = {"temporal": 0.30, "comment": 0.30, "body": 0.20, "title": 0.15, "file": 0.05}
    return pairs.withColumn("score", sum((F.coalesce(F.col(c), F.lit(0.0)) * x for c, x in w.items()), F.lit(0.0)))


def select_links(scored: DataFrame, least: float = 0.65, spread: float = 0.10, k: int = 3) -> DataFrame:
    """Of the candidates (repo_id, issue, candidate, score) those near the best: rank, confidence and quality of each link.

    An issue has no link when its class is uncertain (unsure) and its best score is under 0.70, or when the brake holds for its
    best candidate: far in time (delta_seconds of window_seconds) and title, body and comment scores under 0.50. Columns that
    are absent or null do not count. The best link is low when the second that is kept is nearer than 0.03 to it.
    """
    c = scored
    for name, kind in (("unsure", "boolean"), ("delta_seconds", "double"), ("window_seconds", "double"), ("title_score", "double"), ("body_score", "double"), ("comment_score", "double")):
        if name not in c.columns:
            c = c.withColumn(name, F.lit(None).cast(kind))
    issue = ["repo_id", "issue"]
    w = Window.partitionBy(*issue).orderBy(F.desc("score"), "candidate")
    # the k best are all that can be kept, and the first of them tells whether there are links at all
    top = c.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    brake = (1.0 - F.col("delta_seconds") / F.col("window_seconds") < 0.20) & (F.greatest(*(F.coalesce(f"{n}_score", F.lit(0.0)) for n in ("title", "body", "comment"))) < 0.50)
    none = (F.coalesce("unsure", F.lit(False)) & (F.col("score") < 0.70)) | F.coalesce(brake, F.lit(False))
    r = top.withColumn("best", F.first("score").over(w)).withColumn("none", F.first(none).over(w)).withColumn("gap", F.col("best") - F.lead("score").over(w))
    edge = F.greatest(F.lit(least), F.col("best") - spread)
    kept = r.withColumn("second", F.lead("score").over(w)).where((F.col("score") >= edge) & ~F.col("none"))
    low = (F.col("rank") > 1) | F.coalesce((F.col("second") >= edge) & (F.col("gap") < 0.03), F.lit(False))
    return kept.select(*issue, "candidate", "rank", F.least(F.lit(0.85), 0.5 + 0.35 * F.col("score")).alias("confidence"), F.when(low, "low").otherwise("medium").alias("quality"))


def smoothed_test_ratio(test_lines: Column, source_lines: Column) -> Column:
    return (test_lines + 1) / (source_lines + 1)
