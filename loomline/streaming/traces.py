"""Live traces: windowed counts, and sessions as keyed state with a time-out, over Structured Streaming.

Both read the trace files as a stream, take all that is there and end. Rows later than the watermark are dropped by
Spark; time is event time throughout. Results are written by batch to the shared folder, so they survive a lost
executor and a restart picks up at the last committed batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import IntegerType, StructField, StructType

from loomline.sources.messages import shared_path

EVENT = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
C = F.col


def events(spark: SparkSession, path: str) -> DataFrame:
    schema = spark.read.parquet(path).schema
    # a stream reads a folder or a pattern of names; a class of one character makes a pattern that fits this name alone
    stream = spark.readStream.schema(schema).parquet(path if "*" in path else f"{path[:-1]}[{path[-1]}]")
    return stream.withColumn("ts", C("ts").cast("timestamp"))


def _run(df: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a stream over what is there; each batch's rows go to a folder of their own, replaced if the batch runs again."""
    spark = df.sparkSession
    out, check = shared_path(spark, name), shared_path(spark, f"{name}-state")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", check).foreachBatch(keep).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(StructType([*df.schema.fields, StructField("batch", IntegerType())])).option("basePath", out).parquet(f"{out}/*")


def window_counts(spark: SparkSession, path: str) -> DataFrame:
    """Counts by hour and type; updates of a later batch replace those of an earlier one."""
    e = events(spark, path).withWatermark("ts", "2 hours")
    n = e.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    rows = _run(n.select(C("w.start").alias("hour"), "event_type", "n"), "update", "window-counts")
    return rows.groupBy("hour", "event_type").agg(F.max("n").alias("n"))


def expired_sessions(spark: SparkSession, path: str, idle_ms: int = 3_600_000) -> DataFrame:
    """user_id, events, total of sessions as they end: after an hour of silence in event time, or (open ones) at the end of input.

    A session's state is three numbers; a batch's rows of one user are one task's.
    """
    e = events(spark, path).withWatermark("ts", "1 minute").select("user_id", "ts", "value")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            n, total, _ = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "events": [n], "total": [total], "ended": [True]})
            return
        rows = pd.concat(list(batches)).sort_values("ts")
        n, total, last = state.get if state.exists else (0, 0.0, None)
        done = []
        for ts, value in zip(rows["ts"], rows["value"], strict=True):
            at = int(ts.timestamp() * 1000)
            if last is not None and at - last >= idle_ms:
                done.append((key[0], n, total, True))
                n, total = 0, 0.0
            n, total, last = n + 1, total + float(value), at
        state.update((n, total, last))
        state.setTimeoutTimestamp(max(last + idle_ms, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([*done, (key[0], n, total, False)], columns=["user_id", "events", "total", "ended"])

    out = e.groupBy("user_id").applyInPandasWithState(step, "user_id BIGINT, events BIGINT, total DOUBLE, ended BOOLEAN", "events BIGINT, total DOUBLE, last BIGINT", "update", GroupStateTimeout.EventTimeTimeout)
    # a session that stays open is told of with each batch; only what a user's last batch says of it stands
    rows = _run(out, "update", "sessions").withColumn("__last", F.max("batch").over(Window.partitionBy("user_id")))
    return rows.where(C("ended") | (C("batch") == C("__last"))).drop("batch", "__last")
