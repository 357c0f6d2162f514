"""Co-change coupling of code units over a rolling window.

``changes`` is (sha, block, at), with the columns of ``by`` (a repository, say) before them if there are any: one row for
each change of a unit in a commit. Pairs come from the distinct (sha, block) rows joined on the commit, so the work is the
sum of squared commit sizes. The units of a commit with more than ``SPLIT`` of them are dealt into groups, and the pairs
of each two groups are a key of their own, so that no task makes all pairs of one commit; the result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units of a commit from which on its pairs are spread over tasks.
SPLIT = 500


def commit_pairs(once: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, sha, a, b, at) of the units a < b of each commit of distinct (by, sha, block, at), best partitioned by (by, sha)."""
    key = [*by, "sha"]
    large = once.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > SPLIT)

    def pairs(df: DataFrame, on: list[str], left: list, right: list) -> DataFrame:
        a, b = df.select(*key, F.col("block").alias("a"), "at", *left), df.select(*key, F.col("block").alias("b"), *right)
        return a.join(b, on).where("a < b").select(*key, "a", "b", "at")

    k = F.ceil(F.col("n") / SPLIT).cast("int")
    rows = once.join(large, key).withColumn("g", F.pmod(F.xxhash64("block"), k).cast("int")).withColumn("every", F.sequence(F.lit(0), k - 1))
    own, each = F.col("g"), F.explode("every")
    # as a rule there is no large commit, and then the second part is empty
    return pairs(once.join(large, key, "left_anti"), key, [], []).unionByName(pairs(rows, [*key, "i", "j"], [own.alias("i"), each.alias("j")], [each.alias("i"), own.alias("j")]))


def in_window(at: str, as_of: Column, days: int) -> Column:
    return F.col(at) >= as_of - F.expr(f"INTERVAL {days} DAYS")


def cochange_pairs(changes: DataFrame, as_of: Column, days: int = 365, min_count: int = 10, min_rate: float = 0.95, incidents: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, a, b, n, total_a, rate, last_at, last_sha) of units that change together, a < b.

    The rate is distinct shared commits over all change rows of a. ``incidents`` (by, block) keeps pairs of which both
    had an incident.
    """
    seen = changes.where(in_window("at", as_of, days)).select(*by, "sha", "block", "at")
    # one shuffle by commit serves the distinct rows, their count and both sides of the pairs
    once = seen.repartition(*by, "sha").groupBy(*by, "sha", "block").agg(F.max("at").alias("at"))
    pairs = commit_pairs(once, by).groupBy(*by, "a", "b").agg(F.count("*").alias("n"), F.max("at").alias("last_at"), F.max("sha").alias("last_sha")).where(F.col("n") >= min_count)
    totals = seen.groupBy(*by, F.col("block").alias("a")).agg(F.count("*").alias("total_a"))
    out = pairs.join(totals, [*by, "a"]).withColumn("rate", F.col("n") / F.col("total_a")).where(F.col("rate") >= min_rate)
    if incidents is not None:
        for side in ("a", "b"):
            out = out.join(incidents.select(*by, F.col("block").alias(side)).distinct(), [*by, side], "left_semi")
    return out.select(*by, "a", "b", "n", "total_a", "rate", "last_at", "last_sha")


def both_directions(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("block"), F.col("b").alias("other"), "n", "rate").unionByName(pairs.select(F.col("b").alias("block"), F.col("a").alias("other"), "n", "rate"))


def coupling_aggregates(pairs: DataFrame) -> DataFrame:
    """(block, couplings, avg_rate): both directions; the average of the two directions' averages."""
    one = pairs.groupBy(F.col("a").alias("block")).agg(F.count("*").alias("c"), F.avg("rate").alias("r"))
    two = pairs.groupBy(F.col("b").alias("block")).agg(F.count("*").alias("c"), F.avg("rate").alias("r"))
    return one.unionByName(two).groupBy("block").agg(F.sum("c").alias("couplings"), F.avg("r").alias("avg_rate"))


def coupling_statistics(pairs: DataFrame) -> DataFrame:
    return pairs.agg(
        F.count("*").alias("total"), F.min("rate").alias("min_rate"), F.max("rate").alias("max_rate"), F.avg("rate").alias("avg_rate"),
        F.count_if(F.col("rate") >= 0.75).alias("high"), F.count_if((F.col("rate") >= 0.5) & (F.col("rate") < 0.75)).alias("medium"),
    )


def coupled_with(pairs: DataFrame, min_rate: float, k: int) -> DataFrame:
    """The k units most coupled to each unit."""
    w = Window.partitionBy("block").orderBy(F.desc("rate"), "other")
    return both_directions(pairs).where(F.col("rate") >= min_rate).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def file_cochange(changes: DataFrame, min_frequency: float) -> DataFrame:
    """(a, b, co_changes, frequency) over commits of two files or more; frequency by the greater of the two counts."""
    once = changes.select("sha", "block").distinct()
    multi = once.join(once.groupBy("sha").count().where("count >= 2").select("sha"), "sha", "left_semi")
    n = multi.groupBy("block").agg(F.count("*").alias("n"))
    pairs = commit_pairs(once.withColumn("at", F.lit(None).cast("timestamp"))).groupBy("a", "b").agg(F.count("*").alias("co_changes"))
    out = pairs.join(n.select(F.col("block").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("block").alias("b"), F.col("n").alias("nb")), "b")
    return out.withColumn("frequency", F.col("co_changes") / F.greatest("na", "nb")).where(F.col("frequency") >= min_frequency).select("a", "b", "co_changes", "frequency")


def partner_shares(changes: DataFrame, as_of: Column, days: int = 90, min_share: float = 0.5, k: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, block, other, n, share, rank): of the commits of each unit in the window the share in which another unit changed too,
    the ``k`` greatest shares above ``min_share``."""
    once = changes.where(in_window("at", as_of, days)).select(*by, "sha", "block", "at").repartition(*by, "sha").groupBy(*by, "sha", "block").agg(F.max("at").alias("at"))
    n = commit_pairs(once, by).groupBy(*by, "a", "b").agg(F.count("*").alias("n"))
    both = n.select(*by, F.col("a").alias("block"), F.col("b").alias("other"), "n").unionByName(n.select(*by, F.col("b").alias("block"), F.col("a").alias("other"), "n"))
    total = once.groupBy(*by, "block").agg(F.count("*").alias("total"))
    w = Window.partitionBy(*by, "block").orderBy(F.desc("share"), "other")
    s = both.join(total, [*by, "block"]).withColumn("share", F.col("n") / F.col("total")).where(F.col("share") > min_share)
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*by, "block", "other", "n", "share", "rank")


def partner_counts(changes: DataFrame, as_of: Column, days: int = 90, min_share: float = 0.3, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, block, partners): how many units changed in more than ``min_share`` of a unit's commits."""
    return partner_shares(changes, as_of, days, min_share, 2**31 - 1, by).groupBy(*by, "block").agg(F.count("*").alias("partners"))
