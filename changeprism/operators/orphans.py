"""References to records that are missing, deleted or arrive later.

Parents and the distinct references are range-partitioned together on (kind, repository, key), numbers by the whole key and
object names by the shortest abbreviation, so a repository with most of the rows spreads over many ranges. Each task stores the
parents of its range as one sorted array and probes Arrow batches of references by binary search; only the verdict of
each distinct key leaves the task and is joined back to the referring rows (a skewed join that AQE may split), so a
key that a third of all rows refer to costs one probe.

Defined results: a null or blank key is no reference. A null repository has no records, so its references are missing.
A null reference time, or a target without fetch times, is never late. Without fetched_at a copy counts as the oldest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_NEVER = np.iinfo(np.int64).min
#: Shortest abbreviation of an object name that git takes.
SHORTEST_SHA = 4


def _key(kind: str, repo: Column, key: Column) -> Column:
    return F.concat(F.lit(kind), F.coalesce(F.lpad(F.hex(repo.cast("bigint")), 16, "0"), F.lit("-" * 16)), key)


def number_key(kind: str, repo: Column, number: Column) -> Column:
    """Sortable key of a numbered record; null for a null number."""
    return _key(kind, repo, F.lpad(F.hex(number.cast("bigint")), 16, "0"))


def sha_key(kind: str, repo: Column, sha: Column) -> Column:
    """Sortable key of an object name in git's usual reading; null for null and blank."""
    clean = F.lower(F.regexp_replace(sha, r"^\s+|\s+$", ""))
    return _key(kind, repo, F.when(clean != "", clean))


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
    keys = None
    for batch in batches:
        role = batch.column("role").to_numpy(zero_copy_only=False)
        text = np.array([k.encode() for k in batch.column("key").to_pylist()], dtype=np.bytes_)
        parent = role == 0
        if parent.any():
            at = batch.column("at").fill_null(_NEVER).to_numpy(zero_copy_only=False)
            gone = batch.column("gone").fill_null(False).to_numpy(zero_copy_only=False)
            tie = batch.column("tie").fill_null(_NEVER).to_numpy(zero_copy_only=False)
            parts.append((text[parent], at[parent], tie[parent], gone[parent]))
        if parent.all():
            continue
        if keys is None:  # parents come first in a partition
            if parts:
                keys, at, tie, gone = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((tie, at, keys))
                keys, at, gone = keys[order], at[order], gone[order]
            else:
                keys, at, gone = np.zeros(0, "S1"), np.zeros(0, np.int64), np.zeros(0, bool)
            known = np.append(np.where(at == _NEVER, np.iinfo(np.int64).max, at), np.iinfo(np.int64).max)
        refs = text[~parent]
        short = batch.column("short").filter(pa.array(~parent))
        open_end = batch.column("open_end").to_numpy(zero_copy_only=False)[~parent].astype(bool)
        lo = np.searchsorted(keys, refs, "left")
        hi = np.searchsorted(keys, refs, "right")
        if open_end.any():
            hi[open_end] = np.searchsorted(keys, np.char.add(refs[open_end], b"\xff"), "left")
        found = hi > lo
        bounds = np.stack([lo, hi], 1).ravel()
        first = np.minimum.reduceat(known, np.minimum(bounds, len(known) - 1))[::2] if len(refs) else np.zeros(0, np.int64)
        deleted = found & np.append(gone, False)[np.maximum(hi - 1, 0)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k.decode() for k in refs.tolist()]),
                short,
                pa.array(found),
                pa.array(deleted),
                pa.array(first, mask=~found | (first == np.iinfo(np.int64).max)),
            ],
            ["key", "short", "found", "deleted", "first_at"],
        )


def orphans(parents: DataFrame, references: DataFrame, abbreviated: tuple[str, ...] = ("c",)) -> DataFrame:
    """References without their record, with cause and month.

    ``parents``: (key, at bigint, tie bigint, gone boolean), one row for each copy: fetch time in microseconds, a
    tie-breaker, and whether that copy says the record was removed. ``references``: (table_name, column_name,
    record_id, key, short boolean, at bigint, created_at); ``short`` marks keys that may be abbreviated, which only kinds in
    ``abbreviated`` may be.
    """
    references = references.where(F.col("key").isNotNull())
    asked = references.select("key", "short").distinct()
    head = F.length(F.lit("k" + "0" * 16)) + SHORTEST_SHA
    both = (
        parents.where(F.col("key").isNotNull())
        .select(F.lit(0).alias("role"), "key", "at", "tie", "gone", F.lit(False).alias("open_end"), F.lit(False).alias("short"))
        .unionByName(
            asked.select(
                F.lit(1).alias("role"), "key", F.lit(None).cast("bigint").alias("at"), F.lit(None).cast("bigint").alias("tie"),
                F.lit(None).cast("boolean").alias("gone"),
                (F.col("short") & F.col("key").rlike(rf"^.{{17}}[0-9a-f]{{{SHORTEST_SHA},}}$")).alias("open_end"), "short",
            )
        )
    )
    # an abbreviation shares its first characters with what it stands for, so both lie in one range; a key of a kind that
    # nothing abbreviates needs no such range
    place = F.when(F.substring("key", 1, 1).isin(*abbreviated), F.substring("key", 1, head)).otherwise(F.col("key"))
    verdicts = (
        both.repartitionByRange(place)
        .sortWithinPartitions("role")
        .mapInArrow(_probe, "key string, short boolean, found boolean, deleted boolean, first_at bigint")
    )
    cause = (
        F.when(~F.col("found"), "missing").when(F.col("deleted"), "deleted").when(F.col("first_at") > F.col("at"), "late")
    )
    return (
        references.join(verdicts, ["key", "short"])
        .withColumn("cause", cause)
        .where(F.col("cause").isNotNull())
        .select("table_name", "column_name", "record_id", "cause", F.date_format("created_at", "yyyy-MM").alias("period"))
    )


def micros(c: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp, with or without zone."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def project_orphans(issues: DataFrame, pulls: DataFrame, commits: DataFrame, links: DataFrame, queue: DataFrame) -> DataFrame:
    """Orphans among the references of links, pull requests and the dead letter queue."""
    gone = F.coalesce(F.col("state") == "deleted", F.lit(False)).alias("gone")
    numbered = [
        df.select(number_key(kind, F.col("repo_id"), F.col("number")).alias("key"), micros("fetched_at").alias("at"), F.col("id").alias("tie"), gone)
        for kind, df in (("i", issues), ("p", pulls))
    ]
    shas = commits.select(
        sha_key("c", F.col("repo_id"), F.col("sha")).alias("key"), micros("fetched_at").alias("at"), F.col("id").alias("tie"), F.lit(False).alias("gone")
    )

    def refs(df: DataFrame, table: str, column: str, key: Column, at: str, short: bool) -> DataFrame:
        return df.select(
            F.lit(table).alias("table_name"), F.lit(column).alias("column_name"), F.col("id").alias("record_id"), key.alias("key"),
            F.lit(short).alias("short"), micros(at).alias("at"), "created_at",
        )

    repo = F.col("repo_id")
    asked = (
        refs(links, "github_issue_pr_links", "issue_number", number_key("i", repo, F.col("issue_number")), "created_at", False)
        .unionByName(refs(links, "github_issue_pr_links", "pr_number", number_key("p", repo, F.col("pr_number")), "created_at", False))
        .unionByName(refs(pulls, "github_pull_requests", "merge_commit_sha", sha_key("c", repo, F.col("merge_commit_sha")), "fetched_at", True))
        .unionByName(refs(queue, "dead_letter_queue", "commit_sha", sha_key("c", repo, F.col("commit_sha")), "created_at", True))
    )
    return orphans(numbered[0].unionByName(numbered[1]).unionByName(shas), asked)
