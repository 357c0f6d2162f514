"""Readers of history text and JSON."""

from __future__ import annotations

from collections.abc import Iterator
from json import dumps, loads

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from changeprism.session import cut_lineage


def file_objects(value) -> Iterator[dict]:
    """Every object with a filename in a JSON value, under any key, in arrays or alone; strings of JSON are read through."""
    if isinstance(value, str):
        if value.lstrip()[:1] not in ("{", "[", '"'):
            return
        try:
            value = loads(value)
        except (ValueError, RecursionError):
            return
        yield from file_objects(value)
    elif isinstance(value, dict):
        if value.get("filename") is not None:
            yield value
        for k, x in value.items():
            if k != "patch":
                yield from file_objects(x)
    elif isinstance(value, list):
        for x in value:
            yield from file_objects(x)


def _text(x) -> str | None:
    return None if x is None else (x if isinstance(x, str) else dumps(x)).encode("utf-8", "replace").decode()


def _int(x) -> int | None:
    return x if type(x) is int and -(2**31) <= x < 2**31 else None


def commit_files(commits: DataFrame, json: str = "raw_data", texts: tuple[str, ...] = ("filename", "status", "patch")) -> DataFrame:
    """(repo_id, sha, ``texts``, additions, deletions) of each file object of each commit's JSON.

    The JSON may be a string of JSON, and its file objects may lie under any key. Incomplete JSON gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, files = [], []
            for i, raw in enumerate(batch.column("raw").to_pylist()):
                try:
                    own = list(file_objects(raw.lstrip("\ufeff")))
                except RecursionError:
                    continue
                at += [i] * len(own)
                files += own
            rows = pa.array(at, pa.int64())
            own = [pa.array([_text(f.get(k)) for f in files], pa.string()) for k in texts]
            counts = [pa.array([_int(f.get(k)) for f in files], pa.int32()) for k in ("additions", "deletions")]
            yield pa.RecordBatch.from_arrays([batch.column("repo_id").take(rows), batch.column("sha").take(rows), *own, *counts], ["repo_id", "sha", *texts, "additions", "deletions"])

    raw = F.col(json).cast("string")
    # a key may be written with escapes
    some = commits.select("repo_id", "sha", raw.alias("raw")).where(F.col("raw").contains("filename") | F.col("raw").contains("\\u"))
    kinds = {f.name: f.dataType.simpleString() for f in some.schema.fields}
    return some.mapInArrow(run, f"repo_id {kinds['repo_id']}, sha {kinds['sha']}, {', '.join(f'{t} string' for t in texts)}, additions int, deletions int")


def renames(commits: DataFrame, json: str = "raw_data") -> DataFrame:
    """(repo_id, former, path) of the files that commits renamed, distinct."""
    f = commit_files(commits, json, ("filename", "previous_filename"))
    return f.where("previous_filename IS NOT NULL AND previous_filename != filename").select("repo_id", F.col("previous_filename").alias("former"), F.col("filename").alias("path")).distinct()


#: A header line of the log: object name, name, address, date, subject.
_HEADER = r"^[0-9a-fA-F]{4,64}\|[^|]*\|[^|]*\|[^|]*\|"
_NUMBERS = r"^\d+\t\d+\t."


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Header and count lines with the number of headers seen so far in their split of the file."""
    now, seen = None, 0
    for batch in batches:
        lines = batch.column("value")
        head = pc.fill_null(pc.match_substring_regex(lines, _HEADER), False).to_numpy(zero_copy_only=False)
        counts = pc.fill_null(pc.match_substring_regex(lines, _NUMBERS), False).to_numpy(zero_copy_only=False)
        files, starts = batch.column("file").to_pylist(), batch.column("start").to_pylist()
        places = list(zip(files, starts, strict=True))
        edges = [0, *(i for i in range(1, len(places)) if places[i] != places[i - 1]), len(places)]
        number = np.zeros(len(places), np.int64)
        for a, z in zip(edges, edges[1:], strict=False):
            if a == z:
                continue
            if places[a] != now:
                now, seen = places[a], 0
            number[a:z] = seen + np.cumsum(head[a:z])
            seen = int(number[z - 1])
        keep = np.flatnonzero(head | counts)
        yield pa.RecordBatch.from_arrays([batch.column("file").take(pa.array(keep)), batch.column("start").take(pa.array(keep)), pa.array(number[keep]), pa.array(head[keep]), lines.take(pa.array(keep))], ["file", "start", "number", "head", "value"])


def git_log(spark: SparkSession, path: str) -> DataFrame:
    """(sha, author, email, date, subject, files array<struct<path, additions, deletions>>) of ``git log --numstat`` text with
    ``sha|name|email|date|subject`` headers.

    A commit begins at each header, with or without an empty line before or after it, so a merge without files keeps none.
    Files are read in splits; lines before the first header of a split belong to the last header of the splits before.
    Binary files and lines that are neither are left out; a date that cannot be read is null.
    """
    t = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    rows = t.mapInArrow(_numbered, "file string, start bigint, number bigint, head boolean, value string")
    heads = rows.where("head")
    # one row for each split that has a header
    last = heads.groupBy("file", "start").agg(F.max("number").alias("number")).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "number"))).alias("splits"))
    before = F.try_element_at(F.filter("splits", lambda x: x["start"] < F.col("start")), F.lit(-1))
    part = F.split("value", "\t", 3)
    files = (
        rows.where("NOT head").join(last, "file")
        .select("file", F.when(F.col("number") > 0, F.struct("start", "number")).otherwise(before).alias("at"), F.struct(part[2].alias("path"), part[0].cast("int").alias("additions"), part[1].cast("int").alias("deletions")).alias("f"))
        .groupBy("file", "at").agg(F.collect_list("f").alias("files"))
    )
    h = F.split("value", r"\|", 5)
    head = heads.select("file", F.struct("start", "number").alias("at"), h[0].alias("sha"), h[1].alias("author"), h[2].alias("email"), F.try_to_timestamp(h[3]).alias("date"), h[4].alias("subject"))
    empty = F.array().cast("array<struct<path:string,additions:int,deletions:int>>")
    return head.join(files, ["file", "at"], "left").select("sha", "author", "email", "date", "subject", F.coalesce("files", empty).alias("files"))


def timeline_events(timeline: DataFrame, events: str = "events") -> DataFrame:
    """(repo_id, issue_number, event, created_at, source_type, source_number, source_sha) of an issue's JSON timeline.

    A cross-reference names the issue or pull request it comes from, a reference or closing its commit.
    """
    schema = "array<struct<event string, created_at string, commit_id string, source struct<type string, issue struct<number int, pull_request struct<url string>>>>>"
    e = timeline.select("repo_id", "issue_number", F.explode(F.from_json(events, schema)).alias("e"))
    cross = F.col("e.event") == "cross-referenced"
    kind = F.when(cross, F.when(F.col("e.source.issue.pull_request").isNotNull(), "pr").otherwise("issue")).when(F.col("e.commit_id").isNotNull(), "commit")
    return e.select(
        "repo_id", "issue_number", F.col("e.event").alias("event"), F.try_to_timestamp("e.created_at").alias("created_at"), kind.alias("source_type"),
        F.when(cross, F.col("e.source.issue.number")).alias("source_number"), F.when(F.col("e.event").isin("referenced", "closed"), F.col("e.commit_id")).alias("source_sha"),
    )


def topological_order(parents: DataFrame) -> DataFrame:
    """(sha, depth, position) of (sha, parents array<string>, date): parents come before children, by longest path from a root,
    then date and sha; position counts from 0. A parent that is not in the table does not count.

    Depths are relaxed level by level along the edges, so the number of rounds is the length of the longest path.
    """
    own = parents.select("sha")
    e = parents.select("sha", F.explode("parents").alias("parent")).join(own.withColumnRenamed("sha", "parent"), "parent", "left_semi").distinct()
    depth = cut_lineage(own.distinct().withColumn("depth", F.lit(0)))
    while True:
        longer = e.join(depth.withColumnRenamed("sha", "parent"), "parent").groupBy("sha").agg((F.max("depth") + 1).alias("d"))
        new = cut_lineage(depth.join(longer, "sha", "left").select("sha", F.greatest("depth", F.coalesce("d", F.lit(0))).alias("depth"), (F.coalesce("d", F.lit(0)) > F.col("depth")).alias("moved")))
        depth = new.drop("moved")
        if new.where("moved").isEmpty():
            break
    counts = depth.groupBy("depth").agg(F.count("*").alias("n"))
    # one row for each level
    base = counts.select("depth", (F.sum("n").over(Window.orderBy("depth")) - F.col("n")).alias("base"))
    w = Window.partitionBy("depth").orderBy("date", "sha")
    placed = depth.join(parents.select("sha", "date"), "sha").withColumn("r", F.row_number().over(w)).join(base, "depth")
    return placed.select("sha", "depth", (F.col("base") + F.col("r") - 1).alias("position"))


def parent_graph_hash(parents: DataFrame, by: list[str]) -> DataFrame:
    """(by, commits, hash): SHA-256 over the sorted ``sha:parents`` lines of each group, made in two steps: of each of 256
    parts by the first characters of the sha, then of their digests in order, so no group is gathered in one row."""
    line = F.concat(F.col("sha"), F.lit(":"), F.concat_ws(" ", F.coalesce("parents", F.array().cast("array<string>"))))
    rows = parents.where("sha IS NOT NULL").select(*by, F.substring(F.sha2("sha", 256), 1, 2).alias("part"), line.alias("line"))
    part = rows.groupBy(*by, "part").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("line"))), 256).alias("h"), F.count("*").alias("n"))
    return part.groupBy(*by).agg(F.sum("n").alias("commits"), F.sha2(F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"])), 256).alias("hash"))


#: Folders and names that a walk over sources leaves out, extensions it keeps (fixed values).
SKIP_FOLDERS = r"(?:^|/)(?:\.git|node_modules|vendor|dist|build|target|__pycache__|\.venv|venv)/"
SOURCE_NAME = r"\.(?:go|py|js|jsx|ts|tsx|java|rb|rs|c|h|cpp|hpp|cs|php|swift|kt|scala)$"
GENERATED = r"(?:_generated\.|\.pb\.go$|\.min\.js$|\.bundle\.js$|(?:^|/)testdata/|(?:^|/)fixtures?/)"


def source_files(paths: DataFrame, path: str = "path") -> DataFrame:
    """Rows of ``paths`` that are source files of a known language, neither generated nor test data."""
    p = F.col(path)
    return paths.where(p.rlike(SOURCE_NAME) & ~p.rlike(SKIP_FOLDERS) & ~p.rlike(GENERATED))


def ground_truth(spark: SparkSession, path: str) -> DataFrame:
    schema = "issue_number int, title string, expected_links struct<fixed_by_commits array<string>, associated_prs array<int>, associated_issues array<int>>, linking_patterns array<string>, expected_confidence double, should_detect boolean, expected_miss boolean"
    return spark.read.schema(schema).json(path, multiLine=True)
