"""Ranked lexical search over a clustered index in an order made by recursive graph bisection.

1. *Survey.* One pass counts documents and terms, and each task offers a few documents for a sample.
2. *Coarse order.* Bisection of the bounded sample gives a few regions; every document goes to the
   region in which its terms take the fewest bits, and from there to one of the region's shards,
   whose number follows the region's size.
3. *Fine order.* In each shard, recursive bisection of all its documents makes clusters. A cluster is
   a row of the index: its terms with their counts and highest impacts, its postings, its doc_ids.
4. *Search.* The impacts bound the score that a cluster can hold. Each query first visits the cluster
   of the highest bound, which gives a score to beat; then a task visits its clusters from the highest
   bound down and stops when the bound is below the score to beat, which rises as it goes. A bound
   that equals it is visited, as a tie may have a smaller doc_id. So the result is exact.

Queries go through in blocks of bounded size. Positions in the new order are only used inside a
cluster; results carry doc_ids.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bisection import bisected, spans
from .common import checkpointed, groups_by_bytes, small_batches, text_bytes, written
from .textkit import hashed_words

TOP = 20
#: Documents that a task offers for the sample, the terms that stand for such a document (those of least hash), and the sample's size.
OFFERED, OFFERED_TERMS, SAMPLE = 64, 256, 2048
REGIONS = 16
#: Terms of a shard that are aimed at; a task cuts one whose postings are more than that. Documents of a cluster at most.
SHARD_TERMS, CLUSTER = 500_000, 256
#: Bytes of query texts of a block, and clusters among which a task chooses the order of its visits.
BLOCK_BYTES, CHOICE = 4 << 20, 32
NO_ID = np.iinfo(np.int64).max

#: Bytes outside terms become blanks, A-Z lower case; bytes from 0x80 on are parts of characters of terms.
TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Index(NamedTuple):
    """The clusters, and the numbers of documents with a term and of terms with repeats."""

    clusters: DataFrame
    documents: int
    terms: int


def term_counts(texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct term hashes in order, and how often it has them."""
    hashes, bounds = hashed_words([t and t.translate(TERM_BYTES) for t in texts])
    return [np.unique(hashes[a:b], return_counts=True) for a, b in zip(bounds, bounds[1:])]


def surveyed(docs: DataFrame) -> DataFrame:
    """Rows (docs, terms, key, hashes): counts of a batch, or a document offered for the sample with its number of terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        names, kinds = ["docs", "terms", "key", "hashes"], [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        row = lambda *values: pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*values), kinds)], names)
        offered: dict[int, tuple[int, bytes]] = {}
        for part in groups_by_bytes(batches, "text"):
            found = term_counts(part.column("text").to_pylist())
            sizes = [int(n.sum()) for _, n in found]
            yield row((sum(s > 0 for s in sizes), sum(sizes), None, None))
            for (hashes, _), n in zip(found, sizes):
                if n:
                    offered[xxhash.xxh64_intdigest(hashes.tobytes()) >> 1] = (n, hashes[:OFFERED_TERMS].tobytes())
            if len(offered) > OFFERED:
                offered = {k: offered[k] for k in sorted(offered)[:OFFERED]}
        if offered:
            yield row(*[(None, n, k, h) for k, (n, h) in offered.items()])

    return docs.select(text_bytes().alias("text")).mapInArrow(run, "docs long, terms long, key long, hashes binary")


def chosen_offers(seen: DataFrame, sample: int) -> DataFrame:
    """Rows (terms, hashes) of the offered documents of least key, ``sample`` at most, copies once. Only keys are sorted; the rows of the least are looked up."""
    keys = seen.select("key").where("key is not null").distinct().orderBy("key").limit(sample)
    last = keys.agg(F.max("key")).first()[0]
    return seen.where(F.col("key") <= last).dropDuplicates(["key"]).orderBy("key").select("terms", "hashes")


class Regions(NamedTuple):
    """Sorted terms of the sample, and the bits that each takes in each region."""

    terms: np.ndarray
    costs: np.ndarray

    def of(self, hashes: np.ndarray) -> int:
        """The region where a document's terms take the fewest bits."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return int(self.costs[at[self.terms[at] == hashes]].sum(axis=0).argmin())


def regions_of(sample: list[tuple[int, bytes]], count: int = REGIONS) -> tuple[Regions, np.ndarray]:
    """Regions by bisection of sampled documents (number of terms, hashes of some), and the share of the sample's terms that goes to each."""
    held = [np.frombuffer(h, np.uint64) for _, h in sample]
    sizes = np.array([n for n, _ in sample], float)
    doc = np.repeat(np.arange(len(held)), [len(h) for h in held])
    terms, term, found = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
    order, cuts = bisected(doc, term, len(held), max(1, -(-len(held) // count)))
    region = np.zeros(len(held), np.int64)
    region[order] = np.repeat(np.arange(len(cuts) - 1), np.diff(cuts))
    n = np.diff(cuts)
    counts = np.bincount(term * len(n) + region[doc], minlength=len(terms) * len(n)).reshape(-1, len(n))
    several = found > 1 if (found > 1).any() else np.ones(len(found), bool)
    regions = Regions(terms[several], -np.log2((counts[several] + 0.1) / (n + 1)).astype(np.float32))
    return regions, np.bincount([regions.of(h) for h in held], weights=sizes, minlength=len(n)) / sizes.sum()


def dealt(docs: DataFrame, regions: Regions, shards: np.ndarray) -> DataFrame:
    """Rows (region, shard, doc_id, n, hashes, tfs): each document with a term; a region's documents are dealt to its shards in turn."""
    shared = docs.sparkSession.sparkContext.broadcast((regions, shards))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, limits = shared.value
        turn = np.arange(len(limits))
        for part in groups_by_bytes(batches, "text"):
            out = []
            for doc_id, (hashes, tf) in zip(part.column("doc_id").to_pylist(), term_counts(part.column("text").to_pylist())):
                if len(hashes):
                    region = where.of(hashes)
                    turn[region] += 1
                    out.append((region, int(turn[region] % limits[region]), doc_id, int(tf.sum()), hashes.tobytes(), packed(tf)))
            if out:
                kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["region", "shard", "doc_id", "n", "hashes", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(run, "region int, shard int, doc_id long, n long, hashes binary, tfs binary")


def packed(values: np.ndarray) -> bytes:
    """Counts as bytes if all are below 256, else as 32-bit numbers; the length tells which."""
    return values.astype(np.uint8 if values.max() < 256 else np.uint32).tobytes()


def unpacked(data: bytes, count: int) -> np.ndarray:
    return np.frombuffer(data, np.uint8 if len(data) == count else np.uint32).astype(np.int64)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term adds to a score for each unit of its weight."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


CLUSTER_ROW = "ids binary, m binary, terms binary, counts binary, best binary, places binary, tfs binary"


def clusters_of(rows: list[tuple], documents: int, all_terms: int, largest: int) -> pa.RecordBatch:
    """A shard's documents (doc_id, n, hashes, tfs) as clusters."""
    hashes = [np.frombuffer(r[2], np.uint64) for r in rows]
    sizes = [len(h) for h in hashes]
    doc = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    tf = np.concatenate([unpacked(r[3], n) for r, n in zip(rows, sizes)])
    names, term = np.unique(np.concatenate(hashes), return_inverse=True)
    term = term.astype(np.int32)
    order, cuts = bisected(doc, term, len(rows), largest)
    place = np.empty(len(rows), np.int64)
    place[order] = np.arange(len(rows))
    ids = np.array([NO_ID if r[0] is None else r[0] for r in rows], np.int64)[order]
    m = np.array([75 + 25 * r[1] * documents // all_terms for r in rows], np.int64)
    best = impacts(tf, m[doc])
    m = m[order]
    at = place[doc]
    cluster = np.searchsorted(cuts, at, "right") - 1
    by = np.lexsort((at, term, cluster))
    at, term, cluster, tf, best = at[by], term[by], cluster[by], tf[by], best[by]
    edges = np.searchsorted(cluster, np.arange(len(cuts)))
    out = []
    for k, (begin, end) in enumerate(zip(edges, edges[1:])):
        own = term[begin:end]
        first = np.concatenate([[0], np.flatnonzero(np.diff(own)) + 1])
        counts = np.diff(np.append(first, end - begin))
        a, b = cuts[k], cuts[k + 1]
        out.append((ids[a:b].tobytes(), m[a:b].tobytes(), names[own[first]].tobytes(), counts.astype(np.uint16).tobytes(), np.maximum.reduceat(best[begin:end], first).astype(np.int32).tobytes(), (at[begin:end] - a).astype(np.uint16).tobytes(), packed(tf[begin:end])))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], [c.split()[0] for c in CLUSTER_ROW.split(", ")])


def clustered(rows: DataFrame, documents: int, all_terms: int, shard_terms: int, cluster: int) -> DataFrame:
    """The clusters of rows sorted by region and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in groups_by_bytes(batches, "hashes"):
            for region, shard, *row in zip(*(batch.column(c).to_pylist() for c in ("region", "shard", "doc_id", "n", "hashes", "tfs"))):
                if held and ((region, shard) != last or size > shard_terms):
                    yield clusters_of(held, documents, all_terms, cluster)
                    held, size = [], 0
                held.append(tuple(row))
                size, last = size + len(row[2]) // 8, (region, shard)
        if held:
            yield clusters_of(held, documents, all_terms, cluster)

    return rows.mapInArrow(run, CLUSTER_ROW)


def build_index(docs: DataFrame, shard_terms: int = SHARD_TERMS, cluster: int = CLUSTER, sample: int = SAMPLE) -> Index:
    """The index of all documents with a term. The driver holds the sample; a task one shard, or a part of a shard that is larger than aimed at.

    A null text has no terms. A null doc_id stays null. Rows that repeat are documents of their own.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        seen = checkpointed(surveyed(docs))
        counted = seen.where("key is null").agg(F.sum("docs"), F.sum("terms")).first()
        documents, all_terms = counted[0] or 0, counted[1] or 0
        if not documents:
            return Index(spark.createDataFrame([], f"cluster long, {CLUSTER_ROW}"), 0, 0)
        offers = chosen_offers(seen, sample).toArrow()
        regions, shares = regions_of(list(zip(offers.column("terms").to_pylist(), offers.column("hashes").to_pylist())))
        shards = np.maximum(1, np.ceil(shares * all_terms / shard_terms)).astype(int)
        rows = dealt(docs, regions, shards).repartition("region", "shard").sortWithinPartitions("region", "shard")
        found = clustered(rows, documents, all_terms, shard_terms, cluster).withColumn("cluster", F.monotonically_increasing_id())
        return Index(written(found, "clusters"), documents, all_terms)


class Queries(NamedTuple):
    """A block of queries: entries (query, term, weight) sorted by query; floor is the score each has to reach."""

    terms: np.ndarray
    query: np.ndarray
    term: np.ndarray
    weight: np.ndarray
    floor: np.ndarray

    def present(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries whose term is among sorted terms, and its place there."""
        at = np.minimum(np.searchsorted(terms, self.terms), len(terms) - 1)
        entries = np.flatnonzero((terms[at] == self.terms)[self.term])
        return entries, at[self.term[entries]]

    def bounds(self, terms: np.ndarray, best: np.ndarray) -> np.ndarray:
        """The highest score that a cluster can hold for each query."""
        entries, at = self.present(terms)
        out = np.zeros(len(self.floor), np.int64)
        np.add.at(out, self.query[entries], self.weight[entries] * best[at])
        return out


class Cluster:
    """A row of the index, opened."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        take = lambda name, kind: np.frombuffer(batch.column(name)[i].as_buffer(), kind)
        self.terms, self.best = take("terms", np.uint64), take("best", np.int32).astype(np.int64)
        if "places" in batch.schema.names:
            self.ids, self.m, self.places = take("ids", np.int64), take("m", np.int64), take("places", np.uint16)
            self.tf, self.counts = unpacked(batch.column("tfs")[i].as_py(), len(self.places)), take("counts", np.uint16).astype(np.int64)
            self.starts = np.cumsum(self.counts) - self.counts

    def opened(self, queries: Queries) -> None:
        self.entries, self.at = queries.present(self.terms)

    def scores(self, queries: Queries, q: int) -> np.ndarray:
        """Every document's score for query q."""
        a, b = np.searchsorted(queries.query[self.entries], (q, q + 1))
        at = self.at[a:b]
        postings = spans(self.starts[at], self.counts[at])
        places = self.places[postings]
        added = np.repeat(queries.weight[self.entries[a:b]], self.counts[at]) * impacts(self.tf[postings], self.m[places])
        out = np.zeros(len(self.ids), np.int64)
        np.add.at(out, places, added)
        return out


class Best:
    """The best documents seen so far for one query: higher scores first, then smaller ids."""

    def __init__(self, floor: int, top: int):
        self.floor, self.top, self.scores, self.ids = max(1, floor), top, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        good = scores >= self.floor
        if good.any():
            scores, ids = np.concatenate([self.scores, scores[good]]), np.concatenate([self.ids, ids[good]])
            order = np.lexsort((ids, -scores))[: self.top]
            self.scores, self.ids = scores[order], ids[order]
            if len(order) == self.top:
                self.floor = max(self.floor, int(self.scores[-1]))


FOUND = "query int, doc_id long, score long"


def found_rows(best: dict[int, Best]) -> pa.RecordBatch:
    n = [len(b.ids) for b in best.values()]
    ids = np.concatenate([b.ids for b in best.values()])
    columns = [pa.array(np.repeat(list(best), n), pa.int32()), pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(np.concatenate([b.scores for b in best.values()]))]
    return pa.RecordBatch.from_arrays(columns, ["query", "doc_id", "score"])


def visited(clusters: DataFrame, queries: Queries, top: int, only: dict[int, list[int]] | None = None) -> DataFrame:
    """Rows (query, doc_id, score) of the best documents of each task's clusters; only: the queries that visit each cluster."""
    shared = clusters.sparkSession.sparkContext.broadcast((queries, only))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, chosen = shared.value
        best: dict[int, Best] = {}
        held: list[tuple[Cluster, np.ndarray]] = []

        def visit() -> None:
            bounds = np.stack([b for _, b in held])
            for q in np.flatnonzero((bounds.max(axis=0) >= np.maximum(1, block.floor))).tolist():
                own = best.setdefault(q, Best(int(block.floor[q]), top))
                for k in np.argsort(-bounds[:, q], kind="stable"):
                    if bounds[k, q] < own.floor:
                        break
                    own.add(held[k][0].scores(block, q), held[k][0].ids)
            held.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                cluster = Cluster(batch, i)
                cluster.opened(block)
                bound = block.bounds(cluster.terms, cluster.best)
                if chosen is not None:
                    bound[np.setdiff1d(np.arange(len(bound)), chosen.get(batch.column("cluster")[i].as_py(), []))] = 0
                held.append((cluster, bound))
                if len(held) == CHOICE:
                    visit()
        if held:
            visit()
        if any(len(b.ids) for b in best.values()):
            yield found_rows(best)

    return clusters.mapInArrow(run, FOUND)


def highest_bounds(clusters: DataFrame, queries: Queries) -> dict[int, list[int]]:
    """For each query the cluster of the highest bound, by cluster."""
    shared = clusters.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        most, where = np.zeros(len(block.floor), np.int64), np.zeros(len(block.floor), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                cluster = Cluster(batch, i)
                bound = block.bounds(cluster.terms, cluster.best)
                better = bound > most
                most[better], where[better] = bound[better], batch.column("cluster")[i].as_py()
        at = np.flatnonzero(most)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(most[at]), pa.array(where[at])], ["query", "bound", "cluster"])

    rows = clusters.select("cluster", "terms", "best").mapInArrow(run, "query int, bound long, cluster long")
    chosen: dict[int, list[int]] = {}
    for r in rows.groupBy("query").agg(F.max(F.struct("bound", "cluster")).alias("b")).select("query", "b.cluster").collect():
        chosen.setdefault(r["cluster"], []).append(r["query"])
    return chosen


def document_counts(clusters: DataFrame, terms: np.ndarray) -> dict[int, int]:
    """How many documents hold each of some sorted terms."""
    shared = clusters.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for own, counts in zip(batch.column("terms"), batch.column("counts")):
                own, counts = np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.uint16)
                at = np.minimum(np.searchsorted(own, shared.value), len(own) - 1)
                total += np.where(own[at] == shared.value, counts[at], 0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["term", "df"])

    rows = clusters.select("terms", "counts").mapInArrow(run, "term int, df long")
    return {r["term"]: r["df"] for r in rows.groupBy("term").agg(F.sum("df").alias("df")).collect()}


def weighed(index: Index, texts: list[bytes | None]) -> Queries:
    """A block of query texts with the weights of its terms; terms of no document are left out."""
    found = term_counts(texts)
    terms, term = np.unique(np.concatenate([h for h, _ in found]), return_inverse=True)
    df = document_counts(index.clusters, terms)
    weight = np.array([math.floor(1000 * math.log((2 * index.documents + 2) / (2 * df[i] + 1))) if i in df else 0 for i in range(len(terms))], np.int64)
    query, times = np.repeat(np.arange(len(texts)), [len(h) for h, _ in found]), np.concatenate([n for _, n in found])
    keep = weight[term] > 0
    return Queries(terms, query[keep], term[keep], (times * weight[term])[keep], np.zeros(len(texts), np.int64))


def search_block(index: Index, texts: list[bytes | None], top: int = TOP) -> DataFrame:
    """Rows (query, doc_id, score, rank): the best documents of each query of a block."""
    spark = index.clusters.sparkSession
    queries = weighed(index, texts)
    chosen = highest_bounds(index.clusters, queries)
    few = spark.createDataFrame([(c,) for c in chosen], "cluster long")
    first = visited(index.clusters.join(F.broadcast(few), "cluster"), queries, top, chosen)  # a cluster a query at most
    beaten = first.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("score")).collect()
    for r in beaten:
        if r["n"] == top:
            queries.floor[r["query"]] = r["score"]
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return visited(index.clusters, queries, top).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def search(index: Index, items: DataFrame, top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): the top documents with a score above 0 for each row of items (item_id, text).

    A null text, or one without a term that any document holds, finds nothing. Rows that repeat an
    item_id are queries of their own. Equal scores go by ascending doc_id, null last. Every query is
    held against all clusters whose bound it does not rule out.
    """
    spark = items.sparkSession
    rows = checkpointed(items.select("item_id", text_bytes().alias("text"), F.monotonically_increasing_id().alias("row")))
    total = rows.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    out = spark.createDataFrame([], rows.select("item_id").schema.add("rank", T.IntegerType()).add("doc_id", T.LongType()).add("score", T.LongType()))
    for b in range(blocks if index.documents else 0):
        own = rows.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).select("item_id", "text").toArrow()
        if not own.num_rows:
            continue
        names = spark.createDataFrame(pa.table({"query": pa.array(range(own.num_rows), pa.int32()), "item_id": own.column("item_id")}))
        with small_batches(spark):
            found = search_block(index, own.column("text").to_pylist(), top)
            out = out.unionByName(checkpointed(found.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")))  # a block's names
    return out


def ranked_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """All items against all documents: item_id, rank, doc_id, score.

    Columns other than doc_id and text, item_id and text are not read. Empty tables give an empty result.
    Terms are told apart by 64-bit hashes. A doc_id of 2**63 - 1 is returned as null.
    """
    return search(build_index(docs), items)


SQL = r"""
with d as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
i as (
  select item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
t as (select doc_id, term, count(*) as tf from d group by 1, 2),
s as (select doc_id, sum(tf)::bigint as n from t group by 1),
g as (select count(*) as docs, sum(n)::bigint as terms from s),
m as (select doc_id, 75 + ((25 * n * docs) // terms) as m from s, g),
w as (select term, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)))::bigint as w from t, g group by 1),
q as (select item_id, term, count(*) as times from i group by 1, 2),
f as (
  select item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::bigint as score
  from q join w using (term) join t using (term) join m using (doc_id) group by 1, 2),
o as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::integer as rank, doc_id, score from f where score > 0)
select item_id, rank, doc_id, score from o where rank <= 20
"""
