"""The risk report of a file, of a diff or of a whole repository, with all its arguments; thresholds by kind of project;
searches for incidents; files that incidents name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeprism.functions import text
from changeprism.operators.risk import ranked_risk

#: Kind of project, couplings, co-change and test ratio from which on a change is looked at (fixed values).
THRESHOLDS = (
    ("python_web", 15, 0.75, 0.4), ("python_backend", 12, 0.7, 0.5), ("go_backend", 8, 0.6, 0.5), ("go_web", 10, 0.65, 0.45), ("typescript_web", 18, 0.8, 0.35), ("typescript_frontend", 20, 0.8, 0.3),
    ("java_backend", 12, 0.65, 0.6), ("rust_backend", 7, 0.55, 0.55), ("ml_project", 10, 0.7, 0.25), ("cli_tool", 10, 0.6, 0.4), ("default", 10, 0.7, 0.3),
)


def thresholds(spark: SparkSession) -> DataFrame:
    """(config, coupling, co_change, test_ratio); a table of eleven rows."""
    return spark.createDataFrame(THRESHOLDS, "config string, coupling int, co_change double, test_ratio double")


def with_thresholds(rows: DataFrame, config: str = "config") -> DataFrame:
    """``rows`` with the thresholds of their kind of project; of an unknown or null one those of default."""
    own = F.coalesce(F.col(config), F.lit("default"))
    t = thresholds(rows.sparkSession)
    known = [c for c, *_ in THRESHOLDS]
    return rows.withColumn("_key", F.when(own.isin(*known), own).otherwise("default")).join(F.broadcast(t.withColumnRenamed("config", "_key")), "_key").drop("_key")


def risk_report(
    units: DataFrame, pairs: DataFrame, incidents: DataFrame, repo_id=None, paths: list[str] | None = None, names: list[str] | None = None, kinds: list[str] | None = None, max_coupled: int = 1, max_incidents: int = 1,
    max_blocks: int = 10, min_staleness: int = 0, min_incidents: int = 0, min_score: float = 0.0, include_score: bool = False, prioritize_recent: bool = False, counted_incidents: int = 10, min_rate: float = 0.5, max_rates: int = 20,
) -> DataFrame:
    """One row for each unit by risk, the greatest first: its columns, coupled array<struct<other, rate>> and incidents.

    ``units``: (repo_id, block, name, file, kind, staleness_days, …); ``pairs``: (repo_id, a, b, rate); ``incidents``:
    (repo_id, block, issue, at). ``paths`` are the file with its former paths, or the files of a diff, ``names`` the units of
    a diff; without them all units count. Kinds, incidents and staleness filter first, the score after it is made of at most
    ``counted_incidents`` incidents and the ``max_rates`` greatest rates of ``min_rate``. ``max_blocks`` 0 gives all units.
    """
    u = units
    for on, value in (("repo_id", [repo_id] if repo_id is not None else None), ("file", paths), ("name", names), ("kind", kinds)):
        if value is not None:
            u = u.where(F.col(on).isin(*value))
    key = ["repo_id", "block"]
    mine = u.select(*key).distinct()
    both = pairs.select("repo_id", F.col("a").alias("block"), F.col("b").alias("other"), "rate").unionByName(pairs.select("repo_id", F.col("b").alias("block"), F.col("a").alias("other"), "rate")).where(F.col("rate") >= min_rate)
    w = Window.partitionBy(*key).orderBy(F.desc("rate"), "other")
    c = both.join(mine, key, "left_semi").withColumn("k", F.row_number().over(w)).where(F.col("k") <= max_rates)
    coupled = F.array_sort(F.collect_list(F.when(F.col("k") <= max_coupled, F.struct("k", "other", "rate"))))
    c = c.groupBy(*key).agg(F.sum("rate").alias("rates"), F.transform(coupled, lambda x: F.struct(x["other"].alias("other"), x["rate"].alias("rate"))).alias("coupled"))
    v = Window.partitionBy(*key).orderBy(F.desc("at"), "issue")
    i = incidents.join(mine, key, "left_semi").withColumn("k", F.row_number().over(v)).where(F.col("k") <= max(counted_incidents, max_incidents))
    shown = F.array_sort(F.collect_list(F.when(F.col("k") <= max_incidents, F.struct("k", "issue", "at"))))
    i = i.groupBy(*key).agg(F.least(F.count("*"), F.lit(counted_incidents)).alias("incident_count"), F.transform(shown, lambda x: F.struct(x["issue"].alias("issue"), x["at"].alias("at"))).alias("incidents"))
    j = u.join(i, key, "left").join(c, key, "left").withColumn("incident_count", F.coalesce("incident_count", F.lit(0)))
    j = j.where((F.col("incident_count") >= min_incidents) & (F.coalesce("staleness_days", F.lit(0)) >= min_staleness))
    score = ranked_risk(F.col("incident_count"), F.coalesce("rates", F.lit(0.0)), F.coalesce("staleness_days", F.lit(0)), F.col("kind") == "class", prioritize_recent)
    out = j.withColumn("risk_score", F.round(score, 6)).drop("rates").where(F.col("risk_score") >= min_score).orderBy(F.desc("risk_score"), *key)
    out = out.limit(max_blocks) if max_blocks else out
    return out if include_score else out.drop("risk_score")


def report_summary(units: DataFrame, report: DataFrame) -> DataFrame:
    """(total_blocks, matching_blocks, block_kinds, total_incidents, max_staleness) of all units of the scope and of a report of all
    of them (max_blocks 0)."""
    a = units.agg(F.count("*").alias("total_blocks"))
    b = report.agg(F.count("*").alias("matching_blocks"), F.countDistinct("kind").alias("block_kinds"), F.coalesce(F.sum("incident_count"), F.lit(0)).alias("total_incidents"), F.coalesce(F.max("staleness_days"), F.lit(0)).alias("max_staleness"))
    return a.crossJoin(b)  # one row each


def similar(docs: DataFrame, key: str, texts: list[str], text_value: str, k: int = 10) -> DataFrame:
    """(key, score): the documents whose keywords have most in common with a text, by Jaccard similarity."""
    own = text.keywords(F.lit(text_value))
    whole = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in texts])
    return docs.select(key, F.round(text.jaccard(text.keywords(whole), own), 6).alias("score")).where("score > 0").orderBy(F.desc("score"), key).limit(k)


def naming_file(docs: DataFrame, texts: list[str], path: str) -> DataFrame:
    """Documents that hold the last part of a path."""
    base = path.rpartition("/")[2]
    return docs.where(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in texts]).contains(base))


def between(docs: DataFrame, at: str, start: Column, end: Column) -> DataFrame:
    return docs.where((F.col(at) >= start) & (F.col(at) <= end))


def checked_file_links(links: DataFrame, incidents: DataFrame) -> DataFrame:
    """(incident, path, confidence) links whose confidence lies in 0 to 1 and whose incident is there; of several of one file the
    most certain stands."""
    ok = links.where("confidence >= 0 AND confidence <= 1 AND path IS NOT NULL").join(incidents.select("incident").distinct(), "incident", "left_semi")
    return ok.groupBy("incident", "path").agg(F.max("confidence").alias("confidence"))


def resolved_paths(asked: DataFrame, current: DataFrame, former: DataFrame) -> DataFrame:
    """(path, found, confidence): a path that is there for certain, what a former path has become by 0.95, else itself by 0.3.

    ``current``: (path); ``former``: (path, canonical).
    """
    a = asked.select("path").distinct()
    c = a.join(current.select("path").distinct(), "path").select("path", F.col("path").alias("found"), F.lit(1.0).alias("confidence"))
    f = a.join(former.groupBy("path").agg(F.min("canonical").alias("found")), "path").select("path", "found", F.lit(0.95).alias("confidence"))
    best = c.unionByName(f).groupBy("path").agg(F.max_by("found", "confidence").alias("found"), F.max("confidence").alias("confidence"))
    return a.join(best, "path", "left").select("path", F.coalesce("found", "path").alias("found"), F.coalesce("confidence", F.lit(0.3)).alias("confidence"))


def repository_state(repositories: DataFrame, commits: DataFrame) -> DataFrame:
    """(repo_id, initialised, commits, last_at) of each repository."""
    n = commits.groupBy("repo_id").agg(F.count("*").alias("commits"), F.max("at").alias("last_at"))
    return repositories.select("repo_id").distinct().join(n, "repo_id", "left").select("repo_id", F.col("commits").isNotNull().alias("initialised"), F.coalesce("commits", F.lit(0)).alias("commits"), "last_at")


def invalidated(derived: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """``derived`` without the repositories whose hash (repo_id, hash) is no longer the one it was made with."""
    moved = old.join(new.withColumnRenamed("hash", "now"), "repo_id").where("hash != now").select("repo_id")
    return derived.join(moved, "repo_id", "left_anti")
