"""Tables written out: Parquet by repository, CSV, JSON, and one JSON document for a caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write(df: DataFrame, path: str, form: str = "parquet") -> None:
    """``df`` as parquet, json or csv (with a header); what was there is replaced."""
    w = df.write.mode("overwrite")
    (w.option("header", True) if form == "csv" else w).format(form).save(path)


def replace_repositories(df: DataFrame, path: str, by: str = "repo_id") -> None:
    """``df`` by ``by`` into a partitioned table: the partitions it has are replaced as a whole, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def append(df: DataFrame, path: str) -> None:
    """A snapshot more, such as a score with the time it was computed at."""
    df.write.mode("append").parquet(path)


def with_properties(nodes: DataFrame, properties: DataFrame, keys: list[str]) -> DataFrame:
    """``nodes`` with the columns of ``properties`` (one row for each key); nodes without keep theirs null."""
    fresh = [c for c in properties.columns if c not in keys]
    return nodes.drop(*fresh).join(properties, keys, "left")


def document(df: DataFrame, version: str, *columns: str) -> DataFrame:
    """``df`` with its columns as one versioned JSON text (doc) beside ``columns``; null fields are written."""
    body: Column = F.to_json(F.struct(F.lit(version).alias("version"), F.struct(*df.columns).alias("data")), {"ignoreNullFields": "false"})
    return df.select(*columns, body.alias("doc"))
