"""SimHash near-dedup: vantage-point trees find all fingerprints within two bits.

1. *Fingerprints.* Each bit says whether more than half the 64-bit hashes of the text's 3-word
   shingles, repeats included, have it set. Equal fingerprints are one point from then on.
2. *Shards.* A vantage-point tree fitted to a bounded sample of the fingerprints cuts the space into
   shards. Every fingerprint has one home shard, and visits those shards whose region its radius
   overlaps by the triangle bound. Of two regions that a border parts, only the outer one's points
   visit, so each pair is found once.
3. *Search.* A task builds a tree of one shard's own points, searches it for these points and for the
   visitors, and hands on a forest: each point with one representative of its component in the shard.
   So a dense group of n points makes n links, not n * n.
4. *Components* of the forests of all shards.

The tree's borders do not decide which pairs are found, only where; so neither does the sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, groups_by_bytes, text_bytes
from .components import components
from .textkit import LOWERED
from .vantage import VantageTree, united

WIDTH, RADIUS, SEED = 3, 2, 42
#: Fingerprints the shards' tree is fitted to, at most; fingerprints of a shard that are aimed at; points of a leaf inside a shard.
SAMPLE, SHARD, LEAF = 1 << 16, 1 << 13, 128
#: A sampled leaf has so many points at least, which bounds the shards by SAMPLE / LEAST_SAMPLED.
LEAST_SAMPLED = 16


def shingle_hashes(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """XXH64 values of the text's shingles; of the whole sequence if it has fewer words; none without words."""
    import xxhash

    words = (text or b"").translate(LOWERED).split()
    if not words:
        return np.zeros(0, np.uint64)
    line, hashed = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = np.concatenate([[0], ends[:-1]])
    last = max(1, len(words) - width + 1)
    spans = zip(begins[:last].tolist(), (ends[-last:] - 1).tolist())
    return np.fromiter((hashed(line[b:e], SEED) for b, e in spans), np.uint64, last)


def majority(hashes: np.ndarray, block: int = 1 << 16) -> int:
    """The 64 bits that more than half the hashes have."""
    counts = np.zeros(64, np.int64)
    for first in range(0, len(hashes), block):
        bits = np.unpackbits(hashes[first : first + block].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, fp): fp has the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups_by_bytes(batches, "text"):
            found = np.array([majority(shingle_hashes(t)) for t in part.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, "doc_id long, fp long")


def values(batch: pa.RecordBatch, column: str = "fp") -> np.ndarray:
    return batch.column(column).to_numpy().view(np.uint64)


def routed(points: DataFrame, tree: VantageTree) -> DataFrame:
    """Rows (leaf, visitor, fp): each point at home, and as a visitor of other shards."""
    shared = points.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = values(batch)
            for leaf, visiting, at in shared.value.routed(own):
                columns = [pa.array(np.full(len(at), leaf, np.int32)), pa.array(np.full(len(at), visiting)), pa.array(own[at].view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["leaf", "visitor", "fp"])

    return points.select("fp").mapInArrow(run, "leaf int, visitor boolean, fp long")


def shard_links(rows: DataFrame, radius: int = RADIUS, leaf_size: int = LEAF) -> DataFrame:
    """Rows (a, b) that link each point of each shard, and each visitor, to the shard's components within the radius.

    A task reads a shard's own points first and keeps them; visitors stream past.
    """

    def linked(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, held, tree, label = None, [], None, None
        own = np.zeros(0, np.uint64)

        def settled() -> Iterator[pa.RecordBatch]:
            nonlocal own, tree, label, held
            own, held = np.concatenate(held) if held else np.zeros(0, np.uint64), []
            tree, label = VantageTree(own, leaf_size, radius), np.arange(len(own))
            for q, p in tree.pairs(own, own):
                united(label, q, p)
            moved = label != np.arange(len(own))
            yield linked(own[moved], own[label[moved]])

        for batch in batches:
            leaves, visiting, points = batch.column("leaf").to_numpy(), batch.column("visitor").to_numpy(zero_copy_only=False), values(batch)
            edges = np.flatnonzero(np.diff(leaves)) + 1
            for first, last in zip([0, *edges], [*edges, len(leaves)]):
                if leaf != leaves[first]:
                    if leaf is not None and tree is None:
                        yield from settled()
                    leaf, held, tree = leaves[first], [], None
                guests = visiting[first:last]
                held.append(points[first:last][~guests])
                if guests.any():
                    if tree is None:
                        yield from settled()
                    visitors = points[first:last][guests]
                    for q, p in tree.pairs(own, visitors):
                        both = np.unique(np.stack([q, label[p]]), axis=1)
                        yield linked(visitors[both[0]], own[both[1]])
        if leaf is not None and tree is None:
            yield from settled()

    return rows.repartition("leaf").sortWithinPartitions("leaf", "visitor").mapInArrow(run, "a long, b long")


def sampled(points: DataFrame, total: int, sample: int) -> DataFrame:
    """Rows (fp) of the fingerprints of least hash, ``sample`` at most. Hashes beyond what twice as many would need are left out before any are sorted."""
    hashed = points.select("fp", F.xxhash64("fp").alias("h"))
    if total > 2 * sample:
        hashed = hashed.where(F.col("h") < -(1 << 63) + (2 * sample << 64) // total)
    return hashed.orderBy("h", "fp").limit(sample).select("fp")


def near_links(points: DataFrame, sample: int = SAMPLE, shard: int = SHARD, radius: int = RADIUS, leaf_size: int = LEAF) -> DataFrame:
    """Rows (a, b) whose components are those of all pairs of distinct fingerprints within the radius."""
    total = points.count()
    taken = sampled(points, total, sample).toArrow().column("fp").to_numpy().view(np.uint64)
    leaf = max(LEAST_SAMPLED, shard * len(taken) // max(1, total))
    return shard_links(routed(points, VantageTree(taken, leaf, radius)), radius, leaf_size)


def simhash_components(docs: DataFrame, sample: int = SAMPLE, shard: int = SHARD) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    A null or empty text, or one of white space only, has the fingerprint zero, which links like any
    other. A null doc_id links too; component_id is the smallest id of the component, null if none of
    its documents has one. Repeated rows each get the same answer. Columns other than doc_id and text
    are not read. An empty table gives an empty result. The driver holds at most ``sample`` fingerprints.
    """
    rows = checkpointed(fingerprints(docs))
    points = checkpointed(rows.groupBy("fp").agg(F.min("doc_id").alias("id")))
    found = components(near_links(points, sample, shard))
    named = points.join(found.select(F.col("u").alias("fp"), "v"), "fp", "left").withColumn("c", F.coalesce("v", "fp"))
    smallest = named.groupBy("c").agg(F.min("id").alias("component_id"))
    by_point = named.select("fp", "c").join(smallest, "c").select("fp", "component_id")
    return rows.join(by_point, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
