"""Bars from a stream of ticks, with late ticks kept beside them instead of dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What an open bar holds: enough to merge it with later ticks.
OPEN = "asset string, start timestamp, first struct<ts: timestamp, seq: bigint, price: double>, high double, low double, last struct<ts: timestamp, seq: bigint, price: double>, n bigint"
MARK = "latest timestamp"


def partial_bars(ticks: DataFrame) -> DataFrame:
    """Open bars of ticks (asset, ts, seq, price, start)."""
    tick = F.struct("ts", "seq", "price")
    return ticks.groupBy("asset", "start").agg(F.min(tick).alias("first"), F.max("price").alias("high"), F.min("price").alias("low"), F.max(tick).alias("last"), F.count(F.lit(1)).alias("n"))


def merged_bars(bars: DataFrame) -> DataFrame:
    """One open bar for each (asset, start) of several."""
    return bars.groupBy("asset", "start").agg(F.min("first").alias("first"), F.max("high").alias("high"), F.min("low").alias("low"), F.max("last").alias("last"), F.sum("n").alias("n"))


class LateBars:
    """The step of a stream that makes bars, final ones and open ones, and a table of late ticks.

    A bar is final once the latest time of any batch so far is ``lateness`` past its end. A tick that
    comes in a later batch than that is late: it goes to the late table with the start of the bar it has
    missed. Nothing is lost: every tick is in one bar or in that table. Open bars and the latest time
    are the state, stored by batch in the checkpoint folder. A batch that runs again after a failure
    reads its predecessor's state and overwrites its own folders, so each tick counts once.
    """

    def __init__(self, spark: SparkSession, out: str, late: str, state: str, width: str, lateness: str):
        self.spark, self.out, self.late, self.state, self.width, self.lateness = spark, out, late, state, width, lateness

    def stored(self, name: str, batch: int, schema: str) -> DataFrame:
        path = f"{self.state}/{name}/{batch}"
        return self.spark.read.schema(schema).parquet(path) if batch >= 0 else self.spark.createDataFrame([], schema)

    def watermark(self, batch: int):
        """The latest time of all batches up to this one, less the lateness; None before the first tick."""
        passed = F.col("latest") - F.expr(f"interval {self.lateness}")
        return self.stored("mark", batch, MARK).agg(F.max(passed)).first()[0]

    def folders(self, name: str) -> dict[int, object]:
        """The batches whose state of that name is stored, with their folders."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.state}/{name}")
        files = hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [f.getPath() for f in files.listStatus(hadoop)] if files.exists(hadoop) else []
        return {int(f.getName()): f for f in found if f.getName().isdigit()}

    def forget(self, batch: int) -> None:
        """Removes the state of batches before this one, which no batch that may still run again reads."""
        for name in ("mark", "open"):
            for number, folder in self.folders(name).items():
                if number < batch:
                    folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)

    def closed(self, watermark) -> Column:
        end = F.col("start") + F.expr(f"interval {self.width}")
        return F.lit(False) if watermark is None else end <= F.lit(watermark)

    def __call__(self, ticks: DataFrame, batch: int) -> None:
        rows = ticks.withColumn("start", F.window("ts", self.width)["start"])
        rows.persist()
        before = self.closed(self.watermark(batch - 1))
        rows.where(before).write.mode("overwrite").parquet(f"{self.late}/batch={batch}")
        marks = rows.agg(F.max("ts").alias("latest")).unionByName(self.stored("mark", batch - 1, MARK))
        marks.agg(F.max("latest").alias("latest")).write.mode("overwrite").parquet(f"{self.state}/mark/{batch}")
        after = self.closed(self.watermark(batch))
        bars = merged_bars(partial_bars(rows.where(~before)).unionByName(self.stored("open", batch - 1, OPEN)))
        bars = bars.withColumn("final", after).persist()
        bars.where("final").drop("final").write.mode("overwrite").parquet(f"{self.out}/batch={batch}")
        bars.where("not final").drop("final").write.mode("overwrite").parquet(f"{self.state}/open/{batch}")
        self.forget(batch - 1)
        bars.unpersist()
        rows.unpersist()


def run_late_bars(spark: SparkSession, folder: str, name: str, schema, to_ticks, out: str, checkpoint: str, width: str, lateness: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Streams the files called name in folder until all there is has been read; final bars, open bars and late ticks so far.

    Bars have (asset, start, open, high, low, close, n); late ticks (asset, ts, seq, price, start). A
    NULL time belongs to no bar and is left out. Ticks of one time go by seq.
    """
    step = LateBars(spark, f"{out}/bars", f"{out}/late", f"{checkpoint}/bars", width, lateness)
    stream = to_ticks(spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)).where("ts is not null")
    query = stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()
    query.awaitTermination()
    last = max(step.folders("open"), default=-1)
    return shown(spark, f"{out}/bars"), latest_open(spark, step, last), late_ticks(spark, f"{out}/late")


def bar_columns(bars: DataFrame) -> DataFrame:
    return bars.select("asset", F.col("start").cast("timestamp_ntz").alias("start"), F.col("first.price").alias("open"), "high", "low", F.col("last.price").alias("close"), "n")


def shown(spark: SparkSession, path: str) -> DataFrame:
    return bar_columns(spark.read.schema(OPEN).parquet(path))


def latest_open(spark: SparkSession, step: LateBars, batch: int) -> DataFrame:
    return bar_columns(step.stored("open", batch, OPEN))


def late_ticks(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("asset string, ts timestamp, seq bigint, price double, start timestamp").parquet(path)
    return rows.select("asset", F.col("ts").cast("timestamp_ntz").alias("ts"), "seq", "price", F.col("start").cast("timestamp_ntz").alias("start"))
