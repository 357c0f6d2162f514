"""Table maintenance without a mutable store: upserts, inserts if absent, missing rows, edges, closures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from changeprism.session import cut_lineage


def latest(rows: DataFrame, keys: list[str], version: tuple[str, ...] = ("fetched_at", "id")) -> DataFrame:
    """The copy of each record that is the last by ``version``."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(v) for v in version])
    return rows.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")


def upsert_last(old: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row for each key: the one of the greatest ``version``; on a tie the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(version), F.desc("_new"))
    return both.withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at", "_new")


def upsert_greatest(old: DataFrame, new: DataFrame, keys: list[str], measure: str, version: str) -> DataFrame:
    """As ``upsert_last``, but ``measure`` keeps its greatest value."""
    both = old.unionByName(new)
    w = Window.partitionBy(*keys)
    last = F.row_number().over(w.orderBy(F.desc_nulls_last(version), F.desc_nulls_last(measure)))
    return both.withColumn("_at", last).withColumn(measure, F.max(measure).over(w)).where("_at = 1").drop("_at")


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti"))


def missing(source: DataFrame, present: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``source`` whose key is not in ``present``."""
    return source.join(present.select(*keys), keys, "left_anti")


def present(source: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``source`` whose key is in ``there``, such as commits on a default branch."""
    return source.join(there.select(*keys).distinct(), keys, "left_semi")


def consistency(counts: dict[str, tuple[DataFrame, DataFrame]], least: float = 95.0) -> DataFrame:
    """(entity, source_rows, target_rows, percent, ok) of each pair of tables."""
    out = None
    for name, (a, b) in counts.items():
        row = a.agg(F.count("*").alias("source_rows")).crossJoin(b.agg(F.count("*").alias("target_rows")))  # one row each
        row = row.select(F.lit(name).alias("entity"), "source_rows", "target_rows", F.coalesce(F.try_divide(F.col("target_rows") * 100.0, F.col("source_rows")), F.lit(100.0)).alias("percent"))
        out = row if out is None else out.unionByName(row)
    return out.withColumn("ok", F.col("percent") >= least)


def reach(edges: DataFrame, hops: int | None = None, start: DataFrame | None = None) -> DataFrame:
    """(src, dst, hops): nodes within ``hops`` steps of (src, dst) ``edges`` (any number without), by the fewest steps; cycles
    are harmless. A null end is no edge."""
    e = edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct()
    front = e if start is None else e.join(start.select("src").distinct(), "src", "left_semi")
    found = front.withColumn("hops", F.lit(1))
    front, h = found, 1
    while hops is None or h < hops:
        h += 1
        step = front.select("src", F.col("dst").alias("mid")).join(e.select(F.col("src").alias("mid"), "dst"), "mid").select("src", "dst").distinct()
        front = cut_lineage(step.join(found, ["src", "dst"], "left_anti").withColumn("hops", F.lit(h)))
        if hops is None and front.isEmpty():
            break
        found = found.unionByName(front)
    return found


def identity_map(renames: DataFrame) -> DataFrame:
    """(repo_id, canonical, former) of (repo_id, former, path) renames: each path that nothing renames further, with all the
    paths it had before, sorted. Of several last paths of a file the least; a cycle of renames has none."""
    key = lambda c, n: F.struct(F.col("repo_id"), F.col(c).alias("path")).alias(n)
    steps = renames.where("former IS NOT NULL AND path IS NOT NULL AND former != path").distinct()
    far = reach(steps.select(key("former", "src"), key("path", "dst"))).select("src", "dst")
    last = far.join(steps.select(key("former", "dst")).distinct(), "dst", "left_anti").groupBy("src").agg(F.min("dst").alias("dst"))
    return last.groupBy(F.col("dst.repo_id").alias("repo_id"), F.col("dst.path").alias("canonical")).agg(F.array_sort(F.collect_set("src.path")).alias("former"))


def move_identities(identity: DataFrame, renames: DataFrame) -> DataFrame:
    """``identity`` (repo_id, canonical, former) after (repo_id, former, path) ``renames``: the file that has or had the old path
    gets the new one, and its last path joins the former ones; a file without an entry gets one."""
    paths = identity.select("repo_id", "canonical", F.explode(F.array_union(F.array("canonical"), "former")).alias("at"))
    hit = paths.join(renames.select("repo_id", F.col("former").alias("at"), "path"), ["repo_id", "at"]).groupBy("repo_id", "canonical").agg(F.max("path").alias("path"))
    moved = identity.join(hit, ["repo_id", "canonical"], "left").select("repo_id", F.coalesce("path", "canonical").alias("canonical"), F.when(F.col("path").isNotNull(), F.array_union("former", F.array("canonical"))).otherwise(F.col("former")).alias("former"))
    fresh = renames.join(paths.select("repo_id", F.col("at").alias("former")).distinct(), ["repo_id", "former"], "left_anti")
    return moved.unionByName(fresh.groupBy("repo_id", F.col("path").alias("canonical")).agg(F.array_sort(F.collect_set("former")).alias("former")))


def mark_processed(rows: DataFrame, done: DataFrame, at) -> DataFrame:
    """``rows`` with processed_at set for the ids in ``done`` (id)."""
    flag = done.select("id").distinct().withColumn("_done", F.lit(True))
    return rows.join(flag, "id", "left").withColumn("processed_at", F.when(F.col("_done"), at).otherwise(F.col("processed_at"))).drop("_done")


def enqueue_failures(queue: DataFrame, failures: DataFrame) -> DataFrame:
    """``queue`` (repo_id, commit_sha, error_message, retry_count, updated_at) after ``failures`` (repo_id, commit_sha,
    error_message, at): a known one counts one retry for each failure and takes the newest message, a new one starts at 0."""
    f = failures.groupBy("repo_id", "commit_sha").agg(F.count("*").alias("n"), F.max_by("error_message", "at").alias("new"), F.max("at").alias("at"))
    j = queue.select("repo_id", "commit_sha", "error_message", "retry_count", "updated_at").withColumn("old", F.lit(True)).join(f, ["repo_id", "commit_sha"], "full")
    return j.select("repo_id", "commit_sha", F.coalesce("new", "error_message").alias("error_message"), F.when(F.col("old"), F.col("retry_count") + F.coalesce("n", F.lit(0))).otherwise(F.col("n") - 1).cast("int").alias("retry_count"), F.coalesce("at", "updated_at").alias("updated_at"))


def retries(queue: DataFrame, most: int = 5) -> DataFrame:
    """Rows that may be tried again, the oldest first."""
    return queue.where(F.col("retry_count") < most)


def purge(queue: DataFrame, before) -> DataFrame:
    """``queue`` without rows last touched before a time."""
    return queue.where(~(F.col("updated_at") < before) | F.col("updated_at").isNull())


def feedback_rates(log: DataFrame, most: float = 0.03) -> DataFrame:
    """(metric, uses, false_positives, rate, enabled) of (metric, false_positive) feedback; a rate over ``most`` disables."""
    g = log.groupBy("metric").agg(F.count("*").alias("uses"), F.count_if("false_positive").alias("false_positives"))
    return g.withColumn("rate", F.try_divide("false_positives", "uses")).withColumn("enabled", F.col("rate") <= most)


def canonical_paths(identity: DataFrame, paths: DataFrame) -> DataFrame:
    """(path, canonical): a current path stands for itself, a former one for its file, any other for itself.

    ``identity``: (canonical, former array<string>); the OR of the two conditions is one exploded equi join.
    """
    at = identity.select("canonical", F.explode(F.array_union(F.array("canonical"), F.coalesce("former", F.array().cast("array<string>")))).alias("path"))
    best = at.groupBy("path").agg(F.min(F.struct((F.col("path") != F.col("canonical")).cast("int"), "canonical")).alias("b")).select("path", F.col("b.canonical").alias("canonical"))
    return paths.select("path").distinct().join(best, "path", "left").select("path", F.coalesce("canonical", "path").alias("canonical"))
