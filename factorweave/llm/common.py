"""Helpers that several operators share: text rules and Arrow batches; storage as in sources.shared."""

from __future__ import annotations

import gc
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import checkpointed, shared_dir, written  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case, every other character as it is; lower() does that, and faster, where all characters are ASCII."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def whole_text(name: str = "text") -> Column:
    """The text, a null as the empty string."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def text_bytes(name: str = "text") -> Column:
    """The text's UTF-8 bytes for Arrow, which then need no decoding; a null stays null."""
    return F.col(name).cast("string").cast("binary")


def boxed(docs: DataFrame, **more: Column) -> DataFrame:
    """docs as one struct column ``row``, so that no name of its columns can clash, and more columns beside it."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in more.items()])


def unboxed(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns that boxed() put away, some of them changed or added."""
    kept = [changed.pop(c, F.col("row")[c]).alias(c) for c in columns]
    return rows.select(*kept, *[v.alias(k) for k, v in changed.items()])


def one_of_repeats(rows: DataFrame, repeats: DataFrame) -> DataFrame:
    """rows with one row of each key that repeats; only those rows are shuffled. repeats has their keys."""
    if repeats.isEmpty():
        return rows
    several = rows.join(repeats, "key", "left_semi").dropDuplicates(["key"])
    return rows.join(repeats, "key", "left_anti").unionByName(several)


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner remove the shuffle files of steps that are done: it learns of them when the driver collects its garbage."""
    gc.collect()
    spark._jvm.System.gc()


@contextmanager
def small_batches(spark: SparkSession, most: int = 8 << 20) -> Iterator[None]:
    """Arrow batches of at most so many bytes for the jobs that run inside: wide rows are held by JVM and Python worker several times over."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(most))
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def memory_kept() -> None:
    """Lets this Python worker keep up to 48 MB that numpy frees, in place of giving pages back and faulting them in again at each step: the C library keeps twice the largest block it has seen freed."""
    np.empty(24 << 20, np.uint8)


def groups_by_bytes(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose column holds about ``most`` bytes, or one row if that row alone is longer."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
        first = held = 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += n
        if first < len(sizes):
            yield batch.slice(first)
