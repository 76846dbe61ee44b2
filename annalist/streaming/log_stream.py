"""The event log as a stream: idempotent counts, event-time windows, and a keyed snapshot (ST-1, ST-20; windows are an extension)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.readers import scratch_path


def stream_of(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", name).option("recursiveFileLookup", "true").parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Run the stream over all that is there, into a table, and read that."""
    spark, name = stream.sparkSession, f"annalist_{uuid.uuid4().hex}"
    path = scratch_path(spark)

    def put(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{path}/out")

    query = stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def deduplicated_counts(spark: SparkSession, path: str) -> DataFrame:
    """history_id, n: events counted once each though every one is delivered twice."""
    events = stream_of(spark, path).select("event_id", "ts", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("history_id"))
    twice = events.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    once = twice.withWatermark("ts", "40 days").dropDuplicatesWithinWatermark(["event_id"])
    return drain(once.groupBy("history_id").agg(F.count("*").alias("n")), "complete")


def windowed_counts(spark: SparkSession, path: str) -> DataFrame:
    """day, event_type, n, total over tumbling event-time windows."""
    events = stream_of(spark, path).withWatermark("ts", "2 days")
    per = events.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return drain(per.select(F.col("window.start").alias("day"), "event_type", "n", "total"), "complete")


def sessions(spark: SparkSession, path: str, gap: str = "6 hours") -> DataFrame:
    """history_id, start, n of every session: events no further apart than the gap (extension)."""
    events = stream_of(spark, path).withWatermark("ts", "2 days")
    per = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return drain(per.select("user_id", F.col("session_window.start").alias("start"), "n"), "complete")


def live_snapshot(events: DataFrame, history: str = "history_id") -> DataFrame:
    """A stream of history_id, fact_id, object, alive: after each batch, the state of every fact the batch touched (ST-1). events: history_id, fact_id, pos, operation, object, retracts; late events find their place by position."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    moved = events.select(history, F.coalesce(F.when(F.col("operation") == "retract", F.col("retracts")), F.col("fact_id")).alias("fact_id"), "pos", "operation", "object")

    def step(key, batches, state: GroupState):
        gone, best, again, value = state.get if state.exists else (-1, -1, -1, None)
        log = []
        for pdf in batches:
            log += pdf[["pos", "operation", "object"]].itertuples(index=False)
        for pos, operation, obj in sorted(log):
            if operation == "retract":
                gone = max(gone, pos)
            elif operation == "duplicate_delivery" and best > gone:
                continue
            elif pos > max(best, gone):
                best, value = pos, obj
        state.update((int(gone), int(best), int(again), value))
        yield pd.DataFrame({"history_id": [key[0]], "fact_id": [key[1]], "object": [value], "alive": [best > gone]})

    return moved.groupBy(history, "fact_id").applyInPandasWithState(step, "history_id string, fact_id string, object string, alive boolean", "gone long, best long, again long, value string", "update", GroupStateTimeout.NoTimeout)
