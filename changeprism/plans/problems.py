"""The queries of the general data problems (nested records, orphan references) with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeprism.operators.nested import flatten_objects
from changeprism.operators.orphans import project_orphans
from changeprism.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects in arrays of the four JSON columns, each with the object that holds it."""
    commits = table(spark, sf_dir, "github_commits", "id", "raw_data")
    pulls = table(spark, sf_dir, "github_pull_requests", "id", "raw_data")
    links = table(spark, sf_dir, "github_issue_pr_links", "id", "confidence_breakdown", "temporal_analysis")
    return flatten_objects(
        [
            ("github_commits", "raw_data", commits, "id"),
            ("github_pull_requests", "raw_data", pulls, "id"),
            ("github_issue_pr_links", "confidence_breakdown", links, "id"),
            ("github_issue_pr_links", "temporal_analysis", links, "id"),
        ]
    )


def p2_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and linked children by table, column and depth of nesting."""
    rows = p2_found(spark, sf_dir)
    depth = F.size(F.split("node_path", r"\[")) - 1
    return rows.groupBy("table_name", "column_name", depth.alias("depth")).agg(
        F.count("*").alias("objects"), F.count_if(F.col("parent_path") != "").alias("with_parent")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References whose record is not there, with cause and month."""
    t = lambda name, *c: table(spark, sf_dir, name, *c)
    return project_orphans(
        t("github_issues", "id", "repo_id", "number", "state", "fetched_at"),
        t("github_pull_requests", "id", "repo_id", "number", "state", "fetched_at", "merge_commit_sha", "created_at"),
        t("github_commits", "id", "repo_id", "sha", "fetched_at"),
        t("github_issue_pr_links", "id", "repo_id", "issue_number", "pr_number", "created_at"),
        t("dead_letter_queue", "id", "repo_id", "commit_sha", "created_at"),
    )


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table, column, cause and month."""
    return p5_found(spark, sf_dir).groupBy("table_name", "column_name", "cause", "period").agg(F.count("*").alias("orphans"))


_P5 = r"""
WITH i AS (SELECT repo_id, number, min(fetched_at) AS first_at, arg_max(state, (fetched_at, id)) AS state
           FROM github_issues GROUP BY repo_id, number),
p AS (SELECT repo_id, number, min(fetched_at) AS first_at, arg_max(state, (fetched_at, id)) AS state
      FROM github_pull_requests GROUP BY repo_id, number),
c AS (SELECT repo_id, lower(trim(sha, E' \t\r\n')) AS sha, min(fetched_at) AS first_at FROM github_commits GROUP BY 1, 2),
s AS (SELECT 'github_pull_requests' AS table_name, 'merge_commit_sha' AS column_name, id, repo_id,
             lower(trim(merge_commit_sha, E' \t\r\n')) AS sha, fetched_at AS ref_at, created_at FROM github_pull_requests
      UNION ALL
      SELECT 'dead_letter_queue', 'commit_sha', id, repo_id, lower(trim(commit_sha, E' \t\r\n')), created_at, created_at FROM dead_letter_queue),
sm AS (SELECT s.table_name, s.column_name, s.id, s.ref_at, s.created_at, count(c.sha) AS n, min(c.first_at) AS first_at
       FROM s LEFT JOIN c ON c.repo_id = s.repo_id AND left(c.sha, 4) = left(s.sha, 4) AND length(s.sha) >= 4 AND starts_with(c.sha, s.sha)
       WHERE s.sha <> '' GROUP BY ALL),
f AS (SELECT 'github_issue_pr_links' AS table_name, 'issue_number' AS column_name, l.id AS record_id,
             CASE WHEN i.number IS NULL THEN 'missing' WHEN i.state = 'deleted' THEN 'deleted' WHEN i.first_at > l.created_at THEN 'late' END AS cause,
             l.created_at
      FROM github_issue_pr_links l LEFT JOIN i ON i.repo_id = l.repo_id AND i.number = l.issue_number WHERE l.issue_number IS NOT NULL
      UNION ALL
      SELECT 'github_issue_pr_links', 'pr_number', l.id,
             CASE WHEN p.number IS NULL THEN 'missing' WHEN p.state = 'deleted' THEN 'deleted' WHEN p.first_at > l.created_at THEN 'late' END, l.created_at
      FROM github_issue_pr_links l LEFT JOIN p ON p.repo_id = l.repo_id AND p.number = l.pr_number WHERE l.pr_number IS NOT NULL
      UNION ALL
      SELECT table_name, column_name, id, CASE WHEN n = 0 THEN 'missing' WHEN first_at > ref_at THEN 'late' END, created_at FROM sm)
"""

SQL = {
    "p5_found": _P5 + "SELECT table_name, column_name, record_id, cause, strftime(created_at, '%Y-%m') AS period FROM f WHERE cause IS NOT NULL",
    "p5_report": _P5
    + "SELECT table_name, column_name, cause, strftime(created_at, '%Y-%m') AS period, count(*) AS orphans FROM f WHERE cause IS NOT NULL GROUP BY ALL",
}

QUERIES = {"p2_found": p2_found, "p2_children": p2_children, "p5_found": p5_found, "p5_report": p5_report}
