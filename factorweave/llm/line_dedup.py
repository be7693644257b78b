"""Repeated runs of lines: suffix ranks by distributed prefix doubling, in built-in functions only.

A corpus is a set of sequences of line ids, one per document; lines without a word belong to the line
before them. Rank k of a place orders the blocks of 2**k lines that start there; only blocks found at
two places or more have one, so unique text leaves the tables at once. Doubling puts beside each rank
the one 2**k lines on and ranks the pairs, by a range sort. The ranks are a suffix array over the
repeated text: two places agree in their first m lines, 2**k <= m < 2**(k + 1), exactly if they have
equal ranks for the block at their start and for the block that ends after m lines. The places of one
key (m, first block, last block) are an LCP interval, and its first place is the original.

A maximal run of at least ``min_words`` words is the union of its least such parts: from each of its
lines the fewest lines onward that hold so many words, and the fewest back. So only intervals of those
lengths are looked up. They have at most min_words lines, which bounds the doublings, and every line
of every repeated run lies in one. The parts that are later copies are joined to maximal runs and go.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import boxed, checkpointed, unboxed, whole_text, written

MIN_WORDS = 50
PLACE = ["d", "h", "pos"]
#: Where a text is cut: before each line with a word, so that lines without one stay with the line before.
CUT = r"\n(?=[\x20\x09\x0B-\x0D]*[^\x20\x09-\x0D])"
WORD = r"[^\x20\x09-\x0D]+"


def document_id() -> Column:
    """The id as a join key; a null becomes the smallest long."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))


def text_hash() -> Column:
    return F.xxhash64(whole_text())


def lines_of(docs: DataFrame) -> DataFrame:
    """Rows (d, h, pos, line, words): each document's lines with words; d and h tell documents apart by id and text."""
    rows = docs.select(document_id().alias("d"), text_hash().alias("h"), F.posexplode(F.split(whole_text(), CUT, -1)).alias("pos", "unit"))
    line = F.substring_index("unit", "\n", 1)
    return rows.select(*PLACE, F.unhex(F.md5(line)).alias("line"), F.regexp_count(line, F.lit(WORD)).alias("words")).where("words > 0")


def repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """The keys that occur at two places or more, with their first place."""
    place = F.struct(*PLACE)
    return rows.groupBy(*key).agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select(*key, "low")


def ranked(rows: DataFrame, key: list[str], name: str) -> DataFrame:
    """The keys of rows that occur at two places or more, with their place in sorted order: after a range sort, the partition's number and the row's in it."""
    ordered = repeated(rows, key).select(key).repartitionByRange(*key).sortWithinPartitions(*key)
    return checkpointed(ordered.withColumn(name, F.monotonically_increasing_id()))


def lengths(ahead: Column, least: int) -> Column:
    """How many lines the parts have that begin at a place; ahead has the places (pos, words) from there on, least + 1 at most."""
    joined = F.filter(ahead, lambda x, i: x["pos"] == F.col("pos") + i)

    def add(s: Column, x: Column) -> Column:
        n, total = s["n"] + 1, s["total"] + x["words"]
        reached = lambda name, words: F.when((s[name] == 0) & (words >= least), n).otherwise(s[name]).alias(name)
        return F.struct(n.alias("n"), total.alias("total"), reached("own", total), reached("next", total - F.col("words")))

    zero = F.struct(*[F.lit(0).alias(x) for x in ("n", "total", "own", "next")])

    def parts(s: Column) -> Column:
        last = F.when(s["next"] > 0, s["next"] - 1).otherwise(s["n"])
        return F.when(s["own"] > 0, F.sequence(s["own"], F.greatest(s["own"], last)))

    return F.coalesce(F.aggregate(joined, zero, add, parts), F.array().cast("array<int>"))


def level_rows(places: DataFrame, k: int) -> DataFrame:
    """Rows (d, h, pos, rank, lens, next, parts) of rows (d, h, pos, rank, lens): next is the rank 2**k lines on, parts the lengths from 2**k lines to twice that with the rank of their last block."""
    size = 1 << k
    ahead = F.collect_list(F.struct("pos", "rank")).over(Window.partitionBy("d", "h").orderBy("pos").rowsBetween(0, size))
    rows = places.withColumn("ahead", ahead)
    at = lambda i: F.get(F.filter(F.slice("ahead", i + 1, 1), lambda x: x["pos"] == F.col("pos") + i), F.lit(0))["rank"]
    own = F.transform(F.filter("lens", lambda m: (m >= size) & (m < 2 * size)), lambda m: F.struct(m.alias("m"), at(m - size).alias("last")))
    return rows.select(*PLACE, "rank", F.filter("lens", lambda m: m >= 2 * size).alias("lens"), at(F.lit(size)).alias("next"), F.filter(own, lambda x: x["last"].isNotNull()).alias("parts"))


def doubling(docs: DataFrame, least: int) -> list[DataFrame]:
    """level_rows() of k = 0, 1, ... as long as parts are open; each is written."""
    lines = written(lines_of(docs), "lines")
    found = lines.join(ranked(lines, ["line"], "rank"), "line").select(*PLACE, "rank", "words")
    places = found.repartition("d", "h").dropDuplicates(PLACE)
    ahead = F.collect_list(F.struct("pos", "words")).over(Window.partitionBy("d", "h").orderBy("pos").rowsBetween(0, least))
    places = places.withColumn("ahead", ahead).select(*PLACE, "rank", lengths(F.col("ahead"), least).alias("lens"))
    levels = [written(level_rows(places, 0), "level")]
    while not levels[-1].where("size(lens) > 0").isEmpty():
        pairs = levels[-1].where("next is not null").select(*PLACE, F.col("rank").alias("first"), "next", "lens")
        places = pairs.join(ranked(pairs, ["first", "next"], "rank"), ["first", "next"]).select(*PLACE, "rank", "lens")
        levels.append(written(level_rows(places, len(levels)), "level"))
    return levels


def later_copies(levels: list[DataFrame]) -> DataFrame:
    """Rows (d, h, pos, m): parts that are found at an earlier place too, which they do not overlap."""
    rows = [x.select(*PLACE, F.col("rank").alias("first"), F.inline("parts")) for x in levels]
    parts = reduce(DataFrame.unionByName, rows)
    key = ["m", "first", "last"]
    met = parts.join(checkpointed(repeated(parts, key)), key)  # with both sides plain, Spark splits a hot key
    apart = (F.col("d") != F.col("low.d")) | (F.col("h") != F.col("low.h")) | (F.col("pos") >= F.col("low.pos") + F.col("m"))
    return met.where(apart).select(*PLACE, "m")


def deleted_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """Rows (d, h, runs): for each document with later copies, its maximal runs of lines to delete, as sorted (from, to)."""
    in_doc = Window.partitionBy("d", "h").orderBy("pos", "m")
    ends = later_copies(doubling(docs, min_words)).withColumn("end", F.col("pos") + F.col("m") - 1)
    before = F.max("end").over(in_doc.rowsBetween(Window.unboundedPreceding, -1))
    opened = ends.withColumn("new", (F.coalesce(before, F.lit(-2)) + 1 < F.col("pos")).cast("int")).withColumn("run", F.sum("new").over(in_doc))
    runs = opened.groupBy("d", "h", "run").agg(F.min("pos").alias("from"), F.max("end").alias("to"))
    return runs.groupBy("d", "h").agg(F.sort_array(F.collect_list(F.struct("from", "to"))).alias("runs"))


def between(runs: Column, units: Column) -> Column:
    """The units that no run holds: slices between runs, in order."""

    def part(j: Column) -> Column:
        begin = F.coalesce(F.get(runs, j - 1)["to"] + 1, F.lit(0))
        end = F.coalesce(F.get(runs, j)["from"], F.size(units))
        return F.slice(units, begin + 1, end - begin)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(runs)), part))


def line_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the later copies of repeated runs, and columns n_lines and n_deleted.

    A run is a stretch of lines with at least min_words words; lines are compared whole. The earliest
    place, by doc_id, then by a hash of the text, then by line, keeps its run; a later copy is one that
    does not overlap it. Lines without a word are not compared and go with the line before. A null
    text stays null with no lines; an empty one has one line. Rows that repeat id and text are one
    document and get the same answer. A null doc_id comes before all others. Other columns are carried
    along, except that n_lines and n_deleted are replaced. An empty table gives an empty result.
    """
    gone = checkpointed(deleted_runs(docs, min_words))
    rows = boxed(docs, _d=document_id(), _h=text_hash(), text=F.col("text"))
    rows = rows.join(gone, (rows["_d"] == gone["d"]) & (rows["_h"] == gone["h"]), "left")
    rows = rows.withColumn("left", F.when(F.col("runs").isNotNull(), between(F.col("runs"), F.split("text", CUT, -1))))
    count = lambda text: F.regexp_count(text, F.lit("\n")) + 1
    rows = rows.withColumn("joined", F.array_join("left", "\n")).withColumn("n", F.coalesce(count(F.col("text")), F.lit(0)))
    remain = F.when(F.size("left") == 0, 0).otherwise(count(F.col("joined")))
    deleted = F.when(F.col("runs").isNotNull(), F.col("n") - remain).otherwise(0)
    text = F.when(F.col("runs").isNotNull(), F.col("joined")).otherwise(F.col("text"))
    return unboxed(rows, docs.columns, text=text, n_lines=F.col("n"), n_deleted=deleted)
