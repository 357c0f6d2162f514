"""Authors, ownership and familiarity of code units. ``changes`` is (by, block, sha, author, at); ``by`` are the columns that, with
block, name a unit (a repository, say)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def days_since(at: Column, as_of: Column) -> Column:
    """Whole days of 24 hours between a time and ``as_of``."""
    us = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.floor((us(as_of) - us(at)) / F.lit(86_400_000_000)).cast("bigint")


def first_and_last_author(changes: DataFrame, as_of: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """(block, original_author, last_modifier, last_at, staleness_days); ties by sha."""
    key = F.struct("at", "sha", "author")
    g = changes.groupBy(*by, "block").agg(F.min(key).alias("f"), F.max(key).alias("l"))
    return g.select(*by, "block", F.col("f.author").alias("original_author"), F.col("l.author").alias("last_modifier"), F.col("l.at").alias("last_at"), days_since(F.col("l.at"), as_of).alias("staleness_days"))


def familiarity(changes: DataFrame, k: int = 10, by: tuple[str, ...] = ()) -> DataFrame:
    """(block, author, edits, rank): the k authors with most distinct commits of each unit, ties by author."""
    edits = changes.groupBy(*by, "block", "author").agg(F.countDistinct("sha").alias("edits"))
    w = Window.partitionBy(*by, "block").orderBy(F.desc("edits"), "author")
    return edits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ownership_share(changes: DataFrame, k: int = 3) -> DataFrame:
    """(block, author, commits, share): the top authors with their part of all commits of the unit."""
    n = changes.groupBy("block", "author").agg(F.countDistinct("sha").alias("commits"))
    total = Window.partitionBy("block")
    w = Window.partitionBy("block").orderBy(F.desc("commits"), "author")
    return n.withColumn("share", F.col("commits") / F.sum("commits").over(total)).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")


def bus_factor(changes: DataFrame) -> DataFrame:
    """(block, expert, concentration, level): the author with most commits and how much hangs on that person."""
    n = changes.groupBy("block", "author").agg(F.countDistinct("sha").alias("c"))
    g = n.groupBy("block").agg(F.max_by("author", F.struct("c", "author")).alias("expert"), (F.max("c") * 100.0 / F.sum("c")).alias("concentration"))
    level = F.when(F.col("concentration") >= 90, "CRITICAL").when(F.col("concentration") >= 70, "HIGH").when(F.col("concentration") >= 50, "MEDIUM").otherwise("LOW")
    return g.withColumn("level", level)


def churn(changes: DataFrame, as_of: Column) -> DataFrame:
    """(block, current_owner, previous_owner): most active author of the last 30 days, and of the 60 days before who is another."""
    age = days_since(F.col("at"), as_of)
    n = changes.withColumn("age", age).where("age BETWEEN 0 AND 90").groupBy("block", "author").agg(F.count_if(F.col("age") <= 30).alias("recent"), F.count_if(F.col("age") > 30).alias("older"))
    cur = n.where("recent > 0").groupBy("block").agg(F.max_by("author", F.struct("recent", "author")).alias("current_owner"))
    prev = n.where("older > 0").join(cur, "block", "left").where("current_owner IS NULL OR author != current_owner").groupBy("block").agg(F.max_by("author", F.struct("older", "author")).alias("previous_owner"))
    return cur.join(prev, "block", "full")


def transition(changes: DataFrame) -> DataFrame:
    """(block, first_author, second_author, transition_at): when the leading author's running count passed the second's.

    Only the two leading authors' changes are ordered, counted by (time, sha) first, so a unit's other changes are not kept.
    """
    n = changes.groupBy("block", "author").agg(F.count("*").alias("c"))
    w = Window.partitionBy("block").orderBy(F.desc("c"), "author")
    two = n.withColumn("r", F.row_number().over(w)).where("r <= 2").groupBy("block").agg(F.max(F.when(F.col("r") == 1, F.col("author"))).alias("first_author"), F.max(F.when(F.col("r") == 2, F.col("author"))).alias("second_author"))
    lead = F.col("author") == F.col("first_author")
    e = changes.join(two.where("second_author IS NOT NULL"), "block").where("author = first_author OR author = second_author")
    # at one time the leader's changes come first, so the lead is greatest after them
    day = e.groupBy("block", "at").agg(F.count_if(lead).alias("x"), F.count_if(~lead).alias("y"))
    before = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum(F.col("x") - F.col("y")).over(before), F.lit(0)) + F.col("x")
    at = day.withColumn("ahead", ahead).where((F.col("ahead") > 0) & (F.col("x") > 0)).groupBy("block").agg(F.min("at").alias("transition_at"))
    return two.join(at, "block", "left")


def roll_up(commits: DataFrame) -> DataFrame:
    """(repo_id, email, name, commits, first_at, last_at): one row for each address and name as they are written."""
    return commits.groupBy("repo_id", "email", "name").agg(F.count("*").alias("commits"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def developers(commits: DataFrame) -> DataFrame:
    """(email, name, commits, first_at, last_at) by lower-case address; the name first seen."""
    return commits.where("email IS NOT NULL").groupBy(F.lower("email").alias("email")).agg(
        F.min_by("name", F.struct("at", "sha")).alias("name"), F.count("*").alias("commits"), F.min("at").alias("first_at"), F.max("at").alias("last_at")
    )
