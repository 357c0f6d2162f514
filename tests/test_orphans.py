"""Orphan references against a plain double loop, hot keys and corner cases."""

import datetime as dt
import random

from pyspark.sql import functions as F

from changeprism.operators.orphans import number_key, orphans, project_orphans, sha_key

T = dt.datetime(2024, 1, 1)


def brute(issues, pulls, commits, links, queue):
    def numbered(rows, repo, number, when):
        own = [r for r in rows if r[1] == repo and r[2] == number and repo is not None]
        if not own:
            return "missing"
        if max(own, key=lambda r: (r[4], r[0]))[3] == "deleted":
            return "deleted"
        return "late" if when and min(r[4] for r in own) > when else None

    def sha(repo, key, when):
        key = key.strip().lower()
        own = [r for r in commits if r[1] == repo and repo is not None and r[2] and (r[2] == key or len(key) >= 4 and r[2].startswith(key))]
        return "missing" if not own else "late" if when and min(r[3] for r in own) > when else None

    out = []
    for i, repo, a, b, created in links:
        for column, rows, n in (("issue_number", issues, a), ("pr_number", pulls, b)):
            if n is not None and (c := numbered(rows, repo, n, created)):
                out.append(("github_issue_pr_links", column, i, c))
    for i, repo, _, _, fetched, key, _ in pulls:
        if key and key.strip() and (c := sha(repo, key, fetched)):
            out.append(("github_pull_requests", "merge_commit_sha", i, c))
    for i, repo, key, created in queue:
        if key and key.strip() and (c := sha(repo, key, created)):
            out.append(("dead_letter_queue", "commit_sha", i, c))
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(11)
    when = lambda: T + dt.timedelta(days=rng.randrange(60))
    repo = lambda: rng.choice([1, 1, 1, 2, 3])
    shas = ["".join(rng.choice("0a") for _ in range(40)) for _ in range(40)]
    typed = lambda: rng.choice([None, "", "  ", "zz", "0", rng.choice(shas), rng.choice(shas)[: rng.randrange(3, 30)], f" {rng.choice(shas).upper()}\n"])
    issues = [(i, repo(), rng.randrange(12), rng.choice(["open", "deleted", None]), when()) for i in range(40)]
    pulls = [(i, repo(), rng.randrange(12), rng.choice(["open", "deleted"]), when(), typed(), when()) for i in range(60)]
    commits = [(i, repo(), rng.choice(shas[:25]), when()) for i in range(40)]
    links = [(i, rng.choice([1, 1, 2, 9, None]), rng.choice([None, *range(15)]), rng.choice([7, 7, 7, None, *range(15)]), when()) for i in range(300)]
    queue = [(i, repo(), typed(), when()) for i in range(60)]
    f = spark.createDataFrame
    got = project_orphans(
        f(issues, "id long, repo_id long, number int, state string, fetched_at timestamp"),
        f(pulls, "id long, repo_id long, number int, state string, fetched_at timestamp, merge_commit_sha string, created_at timestamp"),
        f(commits, "id long, repo_id long, sha string, fetched_at timestamp"),
        f(links, "id long, repo_id long, issue_number int, pr_number int, created_at timestamp"),
        f(queue, "id long, repo_id long, commit_sha string, created_at timestamp"),
    ).collect()
    assert sorted((r.table_name, r.column_name, r.record_id, r.cause) for r in got) == brute(issues, pulls, commits, links, queue)
    assert {r.period for r in got} <= {"2024-01", "2024-02", "2024-03"}


def test_empty_tables(spark):
    f = lambda s: spark.createDataFrame([], s)
    i = f("id long, repo_id long, number int, state string, fetched_at timestamp")
    p = f("id long, repo_id long, number int, state string, fetched_at timestamp, merge_commit_sha string, created_at timestamp")
    c = f("id long, repo_id long, sha string, fetched_at timestamp")
    q = spark.createDataFrame([(1, 1, "abcd", None)], "id long, repo_id long, commit_sha string, created_at timestamp")
    got = project_orphans(i, p, c, f("id long, repo_id long, issue_number int, pr_number int, created_at timestamp"), q).collect()
    assert [(r.record_id, r.cause, r.period) for r in got] == [(1, "missing", None)]


def test_one_key_with_and_without_abbreviation(spark):
    p = spark.createDataFrame([("abcdef",)], "sha string").select(sha_key("c", F.lit(1), F.col("sha")).alias("key"), F.lit(1).cast("long").alias("at"), F.lit(1).cast("long").alias("tie"), F.lit(False).alias("gone"))
    r = spark.createDataFrame([("t", "c", 1, "abcd", True), ("t", "c", 2, "abcd", False), ("t", "c", 3, "abcdef", False), ("t", "c", 4, "abcdef", True)], "table_name string, column_name string, record_id long, sha string, short boolean")
    r = r.withColumns({"key": sha_key("c", F.lit(1), F.col("sha")), "at": F.lit(5).cast("long"), "created_at": F.lit(T)})
    assert [(x.record_id, x.cause) for x in orphans(p, r).collect()] == [(2, "missing")]


def test_numbers_of_one_repository_spread(spark):
    n = spark.range(20_000).select(number_key("i", F.lit(1), F.col("id")).alias("key"), F.lit(1).cast("long").alias("at"), F.col("id").alias("tie"), F.lit(False).alias("gone"))
    r = spark.range(19_990, 20_010).select(F.lit("t").alias("table_name"), F.lit("c").alias("column_name"), F.col("id").alias("record_id"), number_key("i", F.lit(1), F.col("id")).alias("key"), F.lit(False).alias("short"), F.lit(5).cast("long").alias("at"), F.lit(T).alias("created_at"))
    assert sorted(x.record_id for x in orphans(n, r).collect()) == list(range(20_000, 20_010))
    ranges = n.repartitionByRange(4, "key").select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert len(ranges) == 4 and max(x["count"] for x in ranges) < 10_000
