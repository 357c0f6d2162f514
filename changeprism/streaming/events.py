"""Event streams: windowed counts with late data, and the ordered fold of unit changes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_table(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """A Parquet folder, or a single file of one, as a stream of its files."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return stream.option("pathGlobFilter", at.getName()).parquet(str(at.getParent()))
    return stream.parquet(path)


def windowed_counts(events: DataFrame, size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) by event-time window; batch and stream alike."""
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    e = e.withWatermark("at", late) if e.isStreaming else e
    w = F.window("at", size, slide) if slide else F.window("at", size)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    e = events.withColumn("at", F.col("ts").cast("timestamp"))
    e = e.withWatermark("at", late) if e.isStreaming else e
    return e.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def throttle(events: DataFrame, limit: int, share: float = 0.9) -> DataFrame:
    """Minutes in which the count reached ``share`` of ``limit``."""
    return windowed_counts(events.withColumn("event_type", F.lit("all")), "1 minute").where(F.col("n") >= limit * share)


FOLD_OUT = "unit string, state string, changes long"
FOLD_STATE = "state string, changes long"


def fold_units(changes: DataFrame) -> DataFrame:
    """State and number of changes of each unit from (unit, seq, behavior), in seq order over all that a batch brings for it.

    A CREATE of a present unit is a change, a MODIFY of an absent one creates it, a RENAME of an absent one is a DELETE and a
    CREATE (two changes), a DELETE of an absent one changes nothing; other behaviors are left out.
    """

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, n = state.get if state.exists else ("absent", 0)
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")["behavior"]
        b = rows[rows.isin(["CREATE", "MODIFY", "RENAME", "DELETE"])].to_numpy()
        if len(b):
            gone = b == "DELETE"
            absent = np.concatenate([[now == "absent"], gone[:-1]])  # before each of them
            n += int((~(gone & absent)).sum() + ((b == "RENAME") & absent).sum())
            now = "absent" if gone[-1] else "present"
        state.update((now, n))
        yield pd.DataFrame({"unit": [key[0]], "state": [now], "changes": [n]})

    return changes.groupBy("unit").applyInPandasWithState(run, FOLD_OUT, FOLD_STATE, "update", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """All that is there now through ``stream`` into a Parquet table in ``folder``; a later call goes on where this one ended.

    Append writes what is final; update writes each batch's rows with its number (batch), the last of a key being valid.
    """
    out, state = f"{folder}/rows", f"{folder}/state"
    if mode == "append":
        w = stream.writeStream.format("parquet").option("path", out).outputMode("append")
    else:
        w = stream.writeStream.outputMode(mode).foreachBatch(lambda df, i: df.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{out}/part={i}"))
    w.option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(out)


def last_states(rows: DataFrame, key: str) -> DataFrame:
    """Of the rows of an update run the last of each key."""
    rest = [c for c in rows.columns if c not in (key, "batch", "part")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(key, "r.*")
