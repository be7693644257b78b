"""Bars from ticks, in batch or as a stream with late ticks dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bars(ticks: DataFrame, width: str = "1 hour", lateness: str | None = None) -> DataFrame:
    """(asset, start, open, high, low, close, n) of ticks (asset, ts, seq, price); seq orders ticks of one time.

    With a lateness ticks is a stream: a bar is final, and its state dropped, once the latest time
    seen is that much past its end.
    """
    rows = ticks.withWatermark("ts", lateness) if lateness else ticks
    order = F.struct("ts", "seq")
    made = rows.groupBy(F.window("ts", width), "asset").agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count(F.lit(1)).alias("n")
    )
    return made.select("asset", F.col("window.start").cast("timestamp_ntz").alias("start"), "open", "high", "low", "close", "n")


def run_bars(spark: SparkSession, folder: str, name: str, schema, to_ticks, out: str, checkpoint: str, width: str, lateness: str) -> DataFrame:
    """Streams the files called name in folder through bars to Parquet at out, until all there is has been read."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    query = bars(to_ticks(stream), width, lateness).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()
    query.awaitTermination()
    return spark.read.parquet(out)
