"""The labelling campaign as streams: first submission per assignment, and progress over time windows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.labelling import with_faults
from ..sources import views as V


def source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, a file or a folder of files, as a stream of files."""
    static = V.table(spark, sf_dir, "events")
    path = f"{sf_dir}/events.parquet"
    folder = any("/events.parquet/" in f for f in static.inputFiles())
    stream = spark.readStream.schema(static.schema)
    return stream.parquet(path) if folder else stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def arrive(events: DataFrame, number: Column, folder: str) -> None:
    """Write a table as it would have arrived: one file for each value of ``number``, in that order (the values are few)."""
    rows = events.withColumn("_portion", number)
    for p in sorted(r[0] for r in rows.select("_portion").distinct().limit(1000).collect()):
        rows.where(F.col("_portion") == p).drop("_portion").coalesce(1).write.mode("append").parquet(folder)


def arrivals(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """The files of a folder as a stream, one file a micro-batch, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def accepted_first(stream: DataFrame, predictions: DataFrame, delay: str = "1 day", hold: str = "7 days") -> DataFrame:
    """Status of each submission as it arrives, in append mode: accepted, conflict, or the rule that it breaks.

    The first good submission of an assignment in the first micro-batch that has one is accepted (within a batch by time, then id), later ones are
    conflicts. An assignment's state is one row; it ends when the watermark passes the winner's time by ``hold``, so state doesn't grow with the
    number of assignments ever seen, and a good submission after that is accepted anew. Rows behind the watermark are dropped.
    """
    keep = int(pd.Timedelta(hold).total_seconds() * 1000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now = state.getCurrentWatermarkMs()
        until = state.get[0] if state.exists else None
        if until is not None and until <= now:
            until = None
        rows = pd.concat(list(parts)).sort_values(["us", "event_id"])
        status = []
        for us, bad in zip(rows["us"], rows["bad"]):
            if isinstance(bad, str):
                status.append(bad)
            elif until is None:
                status.append("accepted")
                until = us // 1000 + keep
            else:
                status.append("conflict")
        if until is not None and until > now:
            state.update((until,))
            state.setTimeoutTimestamp(until)
        elif state.exists:
            state.remove()
        yield pd.DataFrame({"event_id": rows["event_id"], "assignment": key[0], "status": status})

    rows = with_faults(stream, predictions).withWatermark("ts", delay).select("assignment", "event_id", "ts", F.unix_micros("ts").alias("us"), "bad")
    return rows.groupBy("assignment").applyInPandasWithState(step, "event_id long, assignment long, status string", "until long", "append", GroupStateTimeout.EventTimeTimeout)


def standing(stream: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each assignment's status so far: its winner, the first good submission by time, and how many came, were good or came too late."""
    own = F.struct("ts", "event_id", "verdict", "labeler")
    good = F.col("bad").isNull()
    out = with_faults(stream, predictions).groupBy("assignment").agg(F.min(F.when(good, own)).alias("w"), F.count(F.lit(1)).alias("n"), F.count_if(good).alias("n_good"))
    status = F.when(F.col("w").isNull(), "pending").otherwise("complete")
    return out.select("assignment", F.col("w.event_id").alias("winner"), "w.verdict", "w.labeler", status.alias("status"), "n", "n_good")


def progress(stream: DataFrame, every: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Submissions per labeler and time window."""
    counted = stream.withWatermark("ts", delay).groupBy(F.window("ts", every).alias("w"), "labeler")
    return counted.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("verdict") == "accepted").alias("n_accepted"))


def run_available(stream: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is now and return what it wrote to ``path`` (complete results overwrite).

    Called again with the same path it goes on where it stopped, also after a failure: a batch that is tried again overwrites what it wrote.
    """
    spark = stream.sparkSession
    out, check = f"{path}/out", f"{path}/checkpoint"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch" if mode == "complete" else f"{out}/batch={number}")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").schema(stream.schema).parquet(out)
