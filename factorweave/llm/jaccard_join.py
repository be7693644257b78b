"""N-gram Jaccard join by vertical partitioning.

Documents are sets of word shingles. The join finds, over the distinct sets (exact copies share a
class from the start), every component of pairs with Jaccard similarity of at least 0.8:

1. *Sets.* A task turns whole texts into sorted 64-bit shingle hashes; a document's class is a
   128-bit sum over its set.
2. *Pruning.* In any fixed order of shingles, two similar sets x and y share at least
   min(l_x, l_y) of the first |x| - ceil(0.8 |x|) + l_x and so on. In hash order, which needs no
   counting, only those first shingles are shuffled, and classes too few of whose shingles occur
   in another class are out. A second turn with longer prefixes, over the classes left, leaves few
   that have no similar set.
3. *Global order.* The shingles left are counted, and ordered by frequency and hash. Shingles of
   one class overlap with nothing and are cut away.
4. *Vertical partitioning.* Quantiles of that order cut it, and with it every set, into fragments.
   Candidates come from the prefix filter with length and position bounds; their partial overlaps
   are counted in each fragment separately and summed per pair, which gives the exact overlap.
5. *Two passes.* A group of near copies has a quadratic number of pairs, all needless once its
   members are known to belong together. So pass one pairs each class with at most ``PARTNERS``
   others, found through a few hubs of each of its prefix shingles. Hubs are the classes with the
   fewest shingles of their own: the middle of a group of near copies, similar to all that are
   similar to any. The links found give components. Pass two pairs classes that share a prefix
   shingle but not yet a component, all of them, so no component is missed; what is left for it are
   the classes that look like members of a group and are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, checkpointed, groups_by_bytes, one_of_repeats, released, text_bytes, unboxed, written
from .components import components
from .textkit import LOWERED, hashed_words, mixed, windows

WIDTH = 5
FRAGMENTS = 8
#: By which share of the set, in percent, the prefixes of step 2 are longer than the least needed: over all sets, then over those left.
EXTRA = (3, 30)
#: Classes left by step 2 (four longs each) up to which their table is broadcast to find their texts; beyond it both are shuffled.
BROADCAST_CLASSES = 2_000_000
#: Pass one: hubs of a shingle (half of them central, half by a hash), and partners of a class.
HUBS, PARTNERS = 4, 2
SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))


def need_of_size(n):
    """Shingles of a set of n that a similar set must share: ceil(0.8 n), in whole numbers."""
    return (4 * n + 4) // 5


def shingle_sets(texts: list[bytes | None], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts, one set after another, and the sets' bounds."""
    words, bounds = hashed_words([t and t.translate(LOWERED) for t in texts])
    hashes, owner = windows(words, bounds, width)
    at = np.searchsorted(owner, np.arange(len(texts) + 1))
    sets = []
    for i in range(len(texts)):
        own, n = hashes[at[i] : at[i + 1]], bounds[i + 1] - bounds[i]
        if 0 < n < width:  # the whole sequence is the one shingle
            own = windows(words[bounds[i] : bounds[i + 1]], np.array([0, n]), int(n))[0] ^ SEEDS[0]
        own = np.sort(own)
        sets.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own)
    ends = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(s) for s in sets], out=ends[1:])
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), ends


def signatures(hashes: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two sums over each set, together its class."""
    out = []
    for seed in SEEDS:
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(hashes ^ seed), dtype=np.uint64)])
        out.append((sums[ends[1:]] - sums[ends[:-1]]).view(np.int64))
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, key, text): key tells documents apart by id and text, through a 64-bit hash."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text_bytes()).alias("key"), text_bytes().alias("text"))


def set_rows(rows: DataFrame) -> DataFrame:
    """Rows (doc_id, key, n_shingles, a, b): size and class of each document's set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups_by_bytes(batches, "text"):
            hashes, ends = shingle_sets(part.column("text").to_pylist())
            a, b = signatures(hashes, ends)
            columns = [part.column("doc_id"), part.column("key"), pa.array(np.diff(ends)), pa.array(a), pa.array(b)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "n_shingles", "a", "b"])

    return rows.mapInArrow(run, "doc_id long, key long, n_shingles long, a long, b long")


def first_shingles(rows: DataFrame, extra: int) -> DataFrame:
    """Rows (shingle, a): the first shingles of each set in hash order, extra percent of the set more than needed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups_by_bytes(batches, "text"):
            hashes, ends = shingle_sets(part.column("text").to_pylist())
            n = np.diff(ends)
            first = np.minimum(n, n - need_of_size(n) + np.maximum(1, n * extra // 100))
            owner = np.repeat(np.arange(len(n)), n)
            inside = np.arange(len(hashes)) - ends[:-1][owner] < first[owner]
            owner = owner[inside]
            a = signatures(hashes, ends)[0]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[inside].view(np.int64)), pa.array(a[owner])], ["shingle", "a"])

    return rows.select("text").mapInArrow(run, "shingle long, a long")


def full_sets(rows: DataFrame) -> DataFrame:
    """Rows (rid, n, shingle) of rows (a, b, text); rid is a, and texts of another class than that are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in groups_by_bytes(batches, "text"):
            hashes, ends = shingle_sets(part.column("text").to_pylist())
            a, b = signatures(hashes, ends)
            same = (a == part.column("a").to_numpy()) & (b == part.column("b").to_numpy())
            n = np.diff(ends)
            owner = np.repeat(np.arange(len(n)), n)
            keep = same[owner]
            columns = [a[owner][keep], n[owner][keep], hashes[keep].view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["rid", "n", "shingle"])

    return rows.select("a", "b", "text").mapInArrow(run, "rid long, n long, shingle long")


def need(n: Column | str) -> Column:
    return F.floor((4 * F.col(n) + 4) / 5) if isinstance(n, str) else F.floor((4 * n + 4) / 5)


def need_of_pair(n: Column, other: Column) -> Column:
    """The overlap at which 100 * overlap >= 80 * union: ceil(4 (n + other) / 9)."""
    return F.floor((4 * (n + other) + 8) / 9)


def likely_classes(rows: DataFrame, classes: DataFrame, extra: int) -> DataFrame:
    """The rows of classes (a, b, key, n) that step 2 leaves in."""
    first = first_shingles(rows, extra)
    shared = first.groupBy("shingle").agg(F.min("a").alias("low"), F.max("a").alias("high")).where("low <> high").select("shingle")
    held = first.join(shared.hint("shuffle_hash"), "shingle", "left_semi").distinct().groupBy("a").agg(F.count(F.lit(1)).alias("held"))
    least = F.greatest(F.lit(1), F.floor(need("n") * extra / 100))
    return classes.join(held, "a").where(F.col("held") >= least).drop("held")


def texts_of_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (a, b, text): one document of each class, its table broadcast if counted as small enough."""
    near = F.broadcast(classes) if classes.count() <= BROADCAST_CLASSES else classes
    return rows.select("key", "text").join(near, "key").select("a", "b", "text")


def ordered_sets(sets: DataFrame) -> DataFrame:
    """Rows (rid, n, held): held has (df, shingle) of the shingles with df > 1 in the global order; sets with too few of them are left out."""
    frequent = sets.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    rows = sets.join(frequent.hint("shuffle_hash"), "shingle")
    held = rows.groupBy("rid", "n").agg(F.sort_array(F.collect_set(F.struct("df", "shingle"))).alias("held"))
    return held.where(F.size("held") >= need("n"))


def place(entry: Column) -> Column:
    """A shingle's place in the global order as a number: frequency, then hash."""
    return entry["df"] + (F.shiftrightunsigned(entry["shingle"], 11) / F.lit(float(1 << 53)))


def fragments(ordered: DataFrame, count: int = FRAGMENTS) -> DataFrame:
    """Rows (rid, fragment, shingles): each set cut where quantiles cut the global order."""
    shares = [i / count for i in range(1, count)]
    places = ordered.select(F.explode("held").alias("e")).select(place(F.col("e")).alias("at"))
    pivots = places.agg(F.percentile_approx("at", shares)).first()[0] or []
    edges = [float("-inf"), *pivots, float("inf")]

    def part(i: int, low: float, high: float) -> Column:
        inside = F.filter("held", lambda e: (place(e) >= low) & (place(e) < high))
        return F.struct(F.lit(i).alias("fragment"), F.transform(inside, lambda e: e["shingle"]).alias("shingles"))

    parts = [part(i, low, high) for i, (low, high) in enumerate(zip(edges, edges[1:]))]
    return ordered.select("rid", F.inline(F.array(*parts))).where(F.size("shingles") > 0)


def links_of(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """The pairs (p, q, n_p, n_q) that are similar: partial overlaps of each fragment, summed per pair."""
    left = pairs.join(cut.select(F.col("rid").alias("p"), "fragment", F.col("shingles").alias("own")), "p")
    both = left.join(cut.select(F.col("rid").alias("q"), "fragment", F.col("shingles").alias("other")), ["q", "fragment"])
    partial = both.select("p", "q", "n_p", "n_q", F.size(F.array_intersect("own", "other")).alias("part"))
    total = partial.groupBy("p", "q", "n_p", "n_q").agg(F.sum("part").alias("overlap"))
    return total.where("100 * overlap >= 80 * (n_p + n_q - overlap)").select(F.col("p").alias("a"), F.col("q").alias("b"))


def prefix_rows(ordered: DataFrame) -> DataFrame:
    """Rows (shingle, rid, n, rest, own): prefix shingles, rest being how many of the set stand from there on in the global order, own how many it has alone."""
    size = F.size("held").cast("long")
    prefix = F.slice("held", F.lit(1), (size - need("n") + 1).cast("int"))
    rows = ordered.select("rid", "n", size.alias("m"), F.posexplode(prefix).alias("k", "e"))
    return rows.select("e.shingle", "rid", "n", (F.col("m") - F.col("k")).alias("rest"), (F.col("n") - F.col("m")).alias("own"))


def bounded(x: str, y: str) -> Column:
    """Length and position bounds for two prefix rows of one shingle, if that is the first shingle they share."""
    c = lambda side, name: F.col(f"{side}.{name}")
    wanted = need_of_pair(c(x, "n"), c(y, "n"))
    return (c(x, "rest") >= wanted) & (c(y, "rest") >= wanted)


def pair_columns(x: str, y: str) -> list[Column]:
    return [F.col(f"{x}.rid").alias("p"), F.col(f"{y}.rid").alias("q"), F.col(f"{x}.n").alias("n_p"), F.col(f"{y}.n").alias("n_q")]


def hub_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (p, q, n_p, n_q) of each class p with at most PARTNERS hubs of its prefix shingles: those met most often and the most central ones."""
    orders = [F.struct(F.col("own") if i < HUBS // 2 else F.lit(0), F.xxhash64("rid", F.lit(i))) for i in range(HUBS)]
    hub = F.struct("rid", "n", "rest", "own")
    hubs = rows.groupBy("shingle").agg(*[F.min_by(hub, o).alias(f"hub{i}") for i, o in enumerate(orders)])
    hubs = hubs.select("shingle", F.explode(F.array_distinct(F.array(*[f"hub{i}" for i in range(HUBS)]))).alias("hub")).select("shingle", "hub.*")
    x, y = rows.alias("x"), hubs.alias("y")
    near = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.rid") != F.col("y.rid")) & bounded("x", "y"))
    met = near.select(*pair_columns("x", "y"), "y.own").groupBy("p", "q", "n_p", "n_q", "own").agg((-F.count(F.lit(1))).alias("met"))

    def first(*by: str) -> Column:  # of one class's hubs, of which its prefix bounds the number
        ordered = F.sort_array(F.collect_list(F.struct(*by, F.xxhash64("q", "p").alias("mixed"), "q", "n_q")))
        return F.transform(F.slice(ordered, 1, PARTNERS // 2), lambda e: F.struct(e["q"].alias("q"), e["n_q"].alias("n_q")))

    chosen = met.groupBy("p", "n_p").agg(F.array_union(first("met"), first("own", "met")).alias("partners"))
    return chosen.select("p", "n_p", F.inline("partners")).select("p", "q", "n_p", "n_q")


def class_links(ordered: DataFrame) -> DataFrame:
    """Rows (u, v) of components of the sets: two passes of links."""
    cut, rows = written(fragments(ordered), "fragments"), checkpointed(prefix_rows(ordered))
    first = checkpointed(links_of(hub_pairs(rows), cut))
    known = components(first)

    named = rows.join(known.select(F.col("u").alias("rid"), F.col("v").alias("c")), "rid", "left").withColumn("c", F.coalesce("c", "rid"))
    sizes = named.groupBy("shingle", "c").agg(F.count(F.lit(1)).alias("size"))
    mixed_ = sizes.groupBy("shingle").agg(F.max_by("c", F.struct("size", "c")).alias("main"), F.count(F.lit(1)).alias("parts")).where("parts > 1")
    open_ = checkpointed(named.join(mixed_.select("shingle", "main"), "shingle"))
    x, y = open_.where("c <> main").alias("x"), open_.alias("y")
    once = (F.col("y.c") == F.col("y.main")) | (F.col("x.rid") < F.col("y.rid"))
    rest = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.c") != F.col("y.c")) & once & bounded("x", "y"))
    second = checkpointed(links_of(rest.select(pair_columns("x", "y")).distinct(), cut))
    return known if second.isEmpty() else components(first.unionByName(second))


def classed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, key, n_shingles, a, b) of docs, and rows (a, b, c): each class with its component."""
    rows = keyed(docs)
    sets = checkpointed(set_rows(rows))
    classes = checkpointed(sets.where("n_shingles > 0").groupBy("a", "b").agg(F.min("key").alias("key"), F.max("n_shingles").alias("n")))
    likely, chosen = classes, rows
    for extra in EXTRA:
        likely = checkpointed(likely_classes(chosen, likely, extra))
        chosen = texts_of_classes(rows, likely)
        released(docs.sparkSession)
    ordered = written(ordered_sets(full_sets(chosen)), "sets")
    released(docs.sparkSession)
    found = class_links(ordered)
    return sets, classes.join(found.select(F.col("u").alias("a"), "v"), "a", "left").select("a", "b", F.coalesce("v", "a").alias("c"))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id.

    A null or empty text, or one of white space only, has no shingles and is its own component.
    Documents are told apart by id and text, so different texts that share a doc_id link on their
    own. A null doc_id links like any other; component_id is the smallest id of the component, null
    if none of its documents has one. Repeated rows each get the same answer. Columns other than
    doc_id and text are not read. An empty table gives an empty result. Shingles, and the classes
    that are compared, are told apart by 64-bit hashes, sets by 128-bit sums of them.
    """
    sets, found = classed(docs)
    own = sets.where("n_shingles > 0").groupBy("a", "b").agg(F.min("doc_id").alias("id"))
    named = own.join(found, ["a", "b"])
    smallest = named.groupBy("c").agg(F.min("id").alias("component_id"))
    merged = named.join(smallest, "c").select("a", "b", "component_id")
    linked = sets.where("n_shingles > 0").join(merged, ["a", "b"]).select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(sets.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def one_per_component(docs: DataFrame) -> DataFrame:
    """Of each component of similar documents the row with the smallest doc_id, with all its columns.

    Rows are told apart by id and text together, through a 64-bit hash: different texts that share a
    doc_id are different documents, rows that repeat both are one. A null doc_id is larger than any
    other, and its document links like any other: it stays if no document of its component has an id,
    one of several. Where texts of one component share the smallest id, the one with the least hash stays.
    """
    sets, found = classed(docs)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    best = sets.where("n_shingles > 0").groupBy("a", "b").agg(first).join(found, ["a", "b"])
    kept = best.groupBy("c").agg(F.min("first").alias("first")).select(F.col("first.key").alias("key"))
    kept = checkpointed(kept.unionByName(sets.where("n_shingles = 0").select("key").distinct()))
    rows = boxed(docs, key=F.xxhash64(F.col("doc_id").cast("long"), text_bytes())).join(kept, "key", "left_semi")
    repeats = sets.groupBy("key").count().where("count > 1").select("key")
    return unboxed(one_of_repeats(rows, checkpointed(repeats)), docs.columns)


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws
  from documents),
s as (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as sh
  from w),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p join n a on a.doc_id = x join n b on b.doc_id = y where 100 * i >= 80 * (a.n + b.n - i)),
e as (select x, y from l union all select y, x from l),
r as (select doc_id as v, doc_id as c from w union select e.y, r.c from r join e on e.x = r.v)
select w.doc_id, coalesce(any_value(n.n), 0) as n_shingles, min(r.c) as component_id
from w left join n using (doc_id) join r on r.v = w.doc_id group by w.doc_id
"""
