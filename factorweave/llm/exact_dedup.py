"""Exact dedup by skew-safe combining.

Texts are equal when they are identical after lower-casing A-Z. Three combines, each with the
normalised text itself among its grouping keys, so that full content is compared every time and
the digest only decides where rows meet:

1. Spark's map-side partial aggregate removes copies inside each task (local dedup);
2. the exchange deals what is left by digest and salt, the salt being the task's number modulo
   ``salts``, so a digest that a third of all rows share is merged in ``salts`` places;
3. the at most ``salts`` winners of each text meet by digest and give the global winner.

Rows then learn their winner through a join on the digest alone, which is safe because step 3 also
counts how many different texts each digest has; rows of a digest with several texts are joined on
the text as well. The join is a plain equi-join, whose hot digests adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, boxed, checkpointed, one_of_repeats, unboxed, whole_text

SALTS = 16


def sha256(text: Column) -> Column:
    """The digest as 32 bytes."""
    return F.unhex(F.sha2(text, 256))


def winners_of(rows: DataFrame, salts: int) -> DataFrame:
    """Rows (_digest, _norm, _keep, _size) of rows (doc_id, _norm, _digest): each text's largest id and number of rows."""
    salted = (
        rows.withColumn("_salt", F.spark_partition_id() % salts)
        .groupBy("_digest", "_salt", "_norm")
        .agg(F.max("doc_id").alias("_keep"), F.count(F.lit(1)).alias("_size"))
    )
    return salted.repartition("_digest").groupBy("_digest", "_norm").agg(F.max("_keep").alias("_keep"), F.sum("_size").alias("_size"))


def normalised(docs: DataFrame, digest) -> DataFrame:
    rows = docs.select("doc_id", ascii_lower(whole_text()).alias("_norm"))
    return rows.withColumn("_digest", digest(F.col("_norm")))


def dedup_report(docs: DataFrame, salts: int = SALTS, digest=sha256) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the largest doc_id stays. A null text counts as empty. A null doc_id is smaller
    than any other; where all ids of a group are null, keep_id is null and its rows are kept. Rows
    that repeat both id and text all carry the same answer and count singly in group_size. Columns
    other than doc_id and text are not read. An empty table gives an empty result. digest may be
    any function from a text column to a column; a weak one costs time, not correctness.
    """
    keyed = normalised(docs, digest)
    winners = winners_of(keyed, salts)
    by_digest = checkpointed(
        winners.groupBy("_digest").agg(
            F.max("_keep").alias("_keep"), F.max("_size").alias("_size"), F.count(F.lit(1)).alias("_texts")
        )
    )
    single = by_digest.where("_texts = 1").drop("_texts")
    several = by_digest.where("_texts > 1").select("_digest")
    columns = [
        F.col("doc_id"),
        F.col("_keep").alias("keep_id"),
        F.col("_size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("_keep")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    ]
    named = keyed.withColumn("_sha", F.sha2("_norm", 256))
    found = named.select("doc_id", "_digest", "_sha").join(single, "_digest").select(columns)
    if several.isEmpty():
        return found
    clashing = named.join(several, "_digest", "left_semi")
    exact = winners.join(several, "_digest", "left_semi")
    return found.unionByName(clashing.join(exact, ["_digest", "_norm"]).select(columns))


def exact_dedup(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with all their columns: of equal texts the one with the largest doc_id.

    A null doc_id is smaller than any other. Of rows that repeat an id and text, one stays, and of
    equal texts without any id one too. Whole rows move once, to the narrow table of winners; rows
    with that key meet again only if the counts of ids say that some repeat.
    """
    keyed = normalised(docs, sha256)
    kept = checkpointed(winners_of(keyed, salts).select("_digest", "_keep", "_size"))
    key = lambda digest, doc_id: F.struct(digest.alias("text"), doc_id.cast("string").alias("id"))
    rows = boxed(docs, key=key(sha256(ascii_lower(whole_text())), F.col("doc_id")))
    stay = kept.select(key(F.col("_digest"), F.col("_keep")).alias("_key"), "_size")
    found = rows.join(stay.select("_key"), rows["key"].eqNullSafe(F.col("_key")), "left_semi")
    of_groups = keyed.select(key(F.col("_digest"), F.col("doc_id")).alias("key")).join(stay.where("_size > 1").select(F.col("_key").alias("key")), "key", "left_semi")
    return unboxed(one_of_repeats(found, checkpointed(of_groups.groupBy("key").count().where("count > 1").select("key"))), docs.columns)


SQL = """
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as h
  from documents)
select doc_id, max(doc_id) over (partition by h) as keep_id, count(*) over (partition by h) as group_size,
       doc_id = max(doc_id) over (partition by h) as kept, h as text_sha256
from d
"""
