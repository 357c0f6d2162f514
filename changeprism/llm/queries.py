"""The queries of the training-data problems, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from changeprism.llm.leakage import leaked_items
from changeprism.llm.mojibake import garbled_texts
from changeprism.llm.names import linked, members
from changeprism.llm.nearest import issues_to_merges
from changeprism.llm.pii import occurrences, replaced
from changeprism.llm.secrets import credential_lines, redacted_texts
from changeprism.llm.tokenize import decode, encode
from changeprism.session import table


#: Key of the surrogates in p1_surrogates; a deployment passes its own secret.
SURROGATE_KEY = b"demonstration key"


def _free_text(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, str, str]]:
    names = (("github_issues", "body"), ("github_pull_requests", "body"), ("github_commits", "message"))
    return [(t, table(spark, sf_dir, t, "id", c), "id", c) for t, c in names]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of personal information in bodies and messages."""
    return occurrences(_free_text(spark, sf_dir))


def p1_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that hold personal information, with typed placeholders."""
    return replaced(_free_text(spark, sf_dir))


def p1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that hold personal information, with keyed replacements of the same type and form."""
    return replaced(_free_text(spark, sf_dir), SURROGATE_KEY)


def _merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues_to_merges(
        table(spark, sf_dir, "github_issues", "id", "repo_id", "number", "closed_at", "fetched_at"),
        table(spark, sf_dir, "github_pull_requests", "id", "repo_id", "number", "merged", "merged_at", "merge_commit_sha", "fetched_at"),
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged pull request nearest in time to each closed issue."""
    return _merges(spark, sf_dir).select("repo_id", "issue_number", "pr_number")


def p3_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p3_found, with the merge commit and the distance in microseconds (negative: closed before the merge)."""
    return _merges(spark, sf_dir)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of messages and patches in which a credential begins."""
    return credential_lines(table(spark, sf_dir, "github_commits", "id", "message", "raw_data"))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages and patches with a credential, only the secret values replaced."""
    return redacted_texts(table(spark, sf_dir, "github_commits", "id", "message", "raw_data"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of developers and commits that mean one person or organisation."""
    return linked(
        table(spark, sf_dir, "github_developers", "id", "repo_id", "name", "email", "github_login"),
        table(spark, sf_dir, "github_commits", "id", "repo_id", "author_name", "author_email"),
    )


def p6_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The person or organisation of each row, with the number of developers rows of it."""
    m = members(
        table(spark, sf_dir, "github_developers", "id", "repo_id", "name", "email", "github_login"),
        table(spark, sf_dir, "github_commits", "id", "repo_id", "author_name", "author_email"),
    )
    rows = m.groupBy("entity").agg(F.count_if(F.col("side") == "d").alias("developers"))
    return m.join(rows, "entity").select(F.when(F.col("side") == "d", "github_developers").otherwise("github_commits").alias("table_name"), F.col("id").alias("record_id"), "entity", "developers")


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token ids of every document."""
    return encode(table(spark, sf_dir, "documents", "doc_id", "text"))


def p7_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded and decoded again; null comes back as an empty text."""
    return decode(p7_ids(spark, sf_dir))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the evaluation item that leaked into them."""
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p8_found, with the number of the passage's words that the document holds."""
    return leaked_items(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "eval_items", "item_id", "passage"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with text that was decoded with a wrong encoding."""
    return garbled_texts(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id")


def p9_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled documents as far as they could be restored."""
    return garbled_texts(table(spark, sf_dir, "documents", "doc_id", "text"))


_P3 = """
WITH i AS (SELECT repo_id, number, arg_max({'at': closed_at}, (fetched_at, id)) AS n FROM github_issues GROUP BY repo_id, number),
p AS (SELECT repo_id, number, arg_max({'ok': merged AND regexp_matches(merge_commit_sha, '\\S'), 'at': merged_at, 'sha': merge_commit_sha}, (fetched_at, id)) AS n
      FROM github_pull_requests GROUP BY repo_id, number),
x AS (SELECT i.repo_id, i.number AS issue_number, p.number AS pr_number, p.n.sha AS merge_commit_sha,
             epoch_us(i.n.at) - epoch_us(p.n.at) AS distance_us
      FROM i JOIN p ON i.repo_id = p.repo_id AND p.n.ok AND abs(epoch_us(i.n.at) - epoch_us(p.n.at)) < 86400000000)
"""
_P3_BEST = "FROM x QUALIFY row_number() OVER (PARTITION BY repo_id, issue_number ORDER BY abs(distance_us), pr_number) = 1"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_redacted": p1_redacted,
    "p1_surrogates": p1_surrogates,
    "p3_found": p3_found,
    "p3_merges": p3_merges,
    "p4_found": p4_found,
    "p4_redacted": p4_redacted,
    "p6_found": p6_found,
    "p6_members": p6_members,
    "p7_ids": p7_ids,
    "p7_decoded": p7_decoded,
    "p8_found": p8_found,
    "p8_leaks": p8_leaks,
    "p9_found": p9_found,
    "p9_restored": p9_restored,
}
SQL: dict[str, str] = {
    "p3_found": _P3 + "SELECT repo_id, issue_number, pr_number " + _P3_BEST,
    "p7_decoded": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p3_merges": _P3 + "SELECT repo_id, issue_number, pr_number, merge_commit_sha, distance_us " + _P3_BEST,
}
