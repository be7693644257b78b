"""Panels as long tables: schemas, reading, writing, revisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import checkpointed

PRICES = T.StructType([T.StructField("asset", T.StringType()), T.StructField("date", T.DateType()), T.StructField("price", T.DoubleType()), T.StructField("weight", T.DoubleType())])
RETURNS = T.StructType([T.StructField("asset", T.StringType()), T.StructField("date", T.DateType()), T.StructField("ret", T.DoubleType())])
FACTORS = T.StructType([T.StructField("date", T.DateType()), T.StructField("factor", T.StringType()), T.StructField("value", T.DoubleType())])


def read_panel(spark: SparkSession, path: str, schema: T.StructType = PRICES, form: str = "parquet") -> DataFrame:
    """A panel stored as Parquet or CSV, read with a declared schema."""
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if form == "csv" else reader.parquet(path)


def write_panel(df: DataFrame, path: str) -> None:
    """Writes a panel in one folder per year; rows of a year meet before writing, so that files are few."""
    df.withColumn("year", F.year("date")).repartition("year", F.pmod(F.xxhash64("asset"), F.lit(16))).write.mode("overwrite").partitionBy("year").parquet(path)


def upsert_panel(df: DataFrame, path: str, keys: list[str], version: str) -> None:
    """Merges rows into the panel at path: the newest version of each key wins, and only the years that df touches are written anew.

    The merged years are computed and stored apart first, then put in place by Spark's dynamic partition
    overwrite, which stages its files and moves them when all are there; a run that fails before leaves
    the old panel as it was. keys have to decide the year (they hold the date), as a key's old row is
    looked for in its new row's year. A panel that is not there yet is made. Columns are those of df.
    """
    spark = df.sparkSession
    new = df.withColumn("year", F.year("date"))
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        years = [r["year"] for r in new.select("year").distinct().collect()]  # one row a year
        touched = F.col("year").isin([y for y in years if y is not None]) | (F.col("year").isNull() & F.lit(None in years))
        old = spark.read.schema(new.schema).parquet(path).where(touched)
        new = old.unionByName(new)
    merged = checkpointed(latest_revision(new, keys, version))
    in_files = merged.repartition("year", F.pmod(F.xxhash64(*keys), F.lit(16)))
    in_files.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)


def latest_revision(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key, the newest version. Equal versions are settled by the other columns, the larger first."""
    rest = [F.col(c).desc() for c in df.columns if c not in keys and c != version]
    newest = Window.partitionBy(*keys).orderBy(F.col(version).desc(), *rest)
    return df.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n")
