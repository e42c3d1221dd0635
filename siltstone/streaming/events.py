"""The log operators as Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import new_folder


def event_stream(spark: SparkSession, folder: str, schema, pattern: str = "events.parquet", files_per_trigger: int = 16) -> DataFrame:
    """Parquet files of a folder as they come; event time as a timestamp, for watermarks."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def rate_windows(events: DataFrame, client: str, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    counts = events.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds").alias("w"), client).agg(F.count("*").alias("n"))
    return counts.select(client, F.col("w.start").alias("window_start"), "n")


def once_within(events: DataFrame, keys: list[str], late: str = "1 hour") -> DataFrame:
    """The first of each key; state of keys older than the watermark goes."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def breaker_states(events: DataFrame, key: str, trip: int = 3, late: str = "1 hour") -> DataFrame:
    """Per key and micro-batch: failures in a row and whether the breaker is open; the state is two integers a key.

    Events of a batch are folded in order of time; late ones are folded when they come.
    """

    def fold(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        run, trips = state.get if state.exists else (0, 0)
        for frame in frames:
            for failed in frame.sort_values(["ts", "event_id"]).failed:
                run = run + 1 if failed else 0
                trips += int(run == trip)
        state.update((run, trips))
        yield pd.DataFrame({key: [k[0]], "failures_in_row": [run], "trips": [trips], "open": [run >= trip]})

    kind = events.schema[key].dataType.simpleString()
    return events.withWatermark("ts", late).groupBy(key).applyInPandasWithState(
        fold, f"{key} {kind}, failures_in_row long, trips long, open boolean", "run long, trips long", "update", "NoTimeout"
    )


def run_available(stream: DataFrame, mode: str = "append", keys: list[str] | None = None) -> DataFrame:
    """Run over what is there now and stop; the result as a table of files in the shared folder.

    Append goes straight to files. In update mode each batch adds the rows that it changed, and the
    table shows the newest of each of ``keys``; in complete mode it shows the last batch.
    """
    spark = stream.sparkSession
    base = new_folder(spark, "stream")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").start(f"{base}/rows").awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/rows")

    def put(rows: DataFrame, batch: int) -> None:
        rows.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{base}/rows/batch-{batch}")  # a batch that runs again replaces itself

    writer.foreachBatch(put).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{base}/rows/batch-*")
    if mode == "complete":
        return rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch").drop("batch")
    last = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return rows.withColumn("nth", F.row_number().over(last)).filter("nth = 1").drop("nth", "batch")
