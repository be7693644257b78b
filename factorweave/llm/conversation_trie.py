"""Conversation prefix trie in succinct level-order shards.

1. *Rebuild.* Turns are numbered by ranges of (conversation, turn), so that a conversation of any
   length is many tasks; heads of other conversations, at most eight turns, replace first turns.
2. *Prefixes.* A prefix is known by its depth and two 64-bit polynomial sums over its turns' hashes.
   Sums run along the ranges; what a conversation had in earlier ranges is carried into the next.
3. *Cut.* A prefix with more than ``limit`` rows at and below it is heavy, and so are all above it.
   The first prefix of a path that is not heavy is the root of a shard of at most limit rows.
4. *Shards.* A task builds level-order tries of its shards in numpy: LOUDS bits and label arrays.
   Rollups run over the levels in reverse with add.at.
5. *Heavy levels.* Spark merges them: each heavy node takes the sums of the shards below it, then the
   sums climb the heavy nodes' own tree, the distance doubling every round.
6. *Ends.* The ids that end in a node are sorted by ranges, joined in chunks, and hashed chunk by chunk.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranges import numbered, ranged
from .common import checkpointed, whole_text
from .louds import Louds

#: Heads are c - c % BASE's first crc32(c) % HEADS turns.
BASE, HEADS = 5, 9
#: Rows of a shard at most, and ids of a chunk.
LIMIT, CHUNK = 1 << 14, 4096
STEPS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
KEY = ["pos", "p1", "p2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def turns_of(conversations: DataFrame) -> DataFrame:
    """Rows (c, turn, h1, h2, bytes): hashes of role and text, and the text's length in UTF-8."""
    role, text = whole_text("role"), whole_text("text")
    names = F.col("conv_id").cast("long").alias("c"), F.col("turn").cast("long").alias("turn")
    hashes = F.xxhash64(role, text).alias("h1"), F.xxhash64(F.lit(1), text, role).alias("h2")
    return conversations.where("conv_id is not null").select(*names, *hashes, F.octet_length(text).cast("long").alias("bytes"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (c, pos, length, h1, h2, bytes) of the rebuilt conversations, and rows (c, length) of all of them."""
    own = checkpointed(numbered(turns, ["c"], ["turn", "h1", "h2"]))
    sizes = own.groupBy("c").agg(F.max("_total").alias("n"))
    h = F.crc32(F.col("c").cast("string").cast("binary")) % HEADS
    convs = sizes.select("c", "n", h.alias("h"), (F.col("c") - F.col("c") % BASE).alias("base"))
    convs = convs.join(sizes.select(F.col("c").alias("base"), F.col("n").alias("there")), "base", "left")
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = checkpointed(convs.select("c", "base", "h", taken.alias("taken"), (taken + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("length")))
    values = ["length", "h1", "h2", "bytes"]
    tails = own.join(convs, "c").where("_n > h").select("c", (F.col("taken") + F.col("_n") - F.col("h")).alias("pos"), *values)
    first = own.where(F.col("_n") < HEADS).withColumnRenamed("c", "base")
    heads = first.join(convs, "base").where("_n <= taken").select("c", F.col("_n").alias("pos"), *values)
    return tails.unionByName(heads), convs.select("c", "length")


def powers(step: int, at: np.ndarray) -> np.ndarray:
    """step ** at modulo 2**64."""
    out, square, left = np.ones(len(at), np.uint64), step, at.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * np.uint64(square), out)
        left, square = left >> np.uint64(1), square * square & (1 << 64) - 1
    return out


def terms(batch: pa.RecordBatch) -> list[np.ndarray]:
    """What each row adds to the two polynomial sums of its conversation."""
    pos = batch.column("pos").to_numpy()
    return [batch.column(h).to_numpy().view(np.uint64) * powers(step, pos) for h, step in zip(("h1", "h2"), STEPS)]


def starts_of(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero(np.diff(values)) + 1])


def edge_sums(rows: DataFrame) -> DataFrame:
    """Rows (part, c, s1, s2): sums over the partition's rows of its first and its last conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, edges = None, {}
        for batch in batches:
            c = batch.column("c").to_numpy()
            if not len(c):
                continue
            part, starts = batch.column("_part")[0].as_py(), starts_of(c)
            sums = [np.add.reduceat(t, starts) for t in terms(batch)]
            for i in dict.fromkeys([0, len(starts) - 1]):
                before = edges.get(int(c[starts[i]]), (0, 0))
                edges[int(c[starts[i]])] = tuple((b + int(s[i])) & (1 << 64) - 1 for b, s in zip(before, sums))
            ids = list(edges)
            edges = {k: edges[k] for k in (ids[0], ids[-1])}
        if edges:
            signed = lambda x: x - (1 << 64) if x >> 63 else x
            found = [(part, c, signed(s), signed(t)) for c, (s, t) in edges.items()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found)], ["part", "c", "s1", "s2"])

    return rows.select("c", "pos", "h1", "h2", "_part").mapInArrow(run, "part long, c long, s1 long, s2 long")


def carries(edges: list) -> dict[int, tuple[int, int, int]]:
    """For each partition the conversation that its predecessor ended with, and that conversation's sums up to there."""
    out, c, sums = {}, None, (0, 0)
    for part in sorted({e["part"] for e in edges}):
        out[part] = (c, *sums)
        own = {e["c"]: (e["s1"], e["s2"]) for e in edges if e["part"] == part}
        last = max(own)
        sums = tuple((own[last][i] + (sums[i] if last == c else 0)) & (1 << 64) - 1 for i in (0, 1))
        c = last
    return out


def prefixes(rows: DataFrame) -> DataFrame:
    """Rows (c, pos, length, bytes, p1, p2, q1, q2): each turn's prefix, and the one before it (zeros: the root)."""
    ordered = ranged(rows, "c", "pos")
    by_part = {}
    for e in edge_sums(ordered).collect():  # two rows a partition at most
        by_part.setdefault(e["part"], []).append(e)
    shared = rows.sparkSession.sparkContext.broadcast(carries([e for part in by_part.values() for e in part]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            c = batch.column("c").to_numpy()
            if not len(c):
                continue
            if held is None:
                held = shared.value[batch.column("_part")[0].as_py()]
            starts, out = starts_of(c), []
            sizes = np.diff(np.append(starts, len(c)))
            for term, so_far in zip(terms(batch), held[1:]):
                sums = np.cumsum(term, dtype=np.uint64)
                base = np.concatenate([np.zeros(1, np.uint64), sums])[starts]
                base[:1] -= np.uint64(so_far if c[0] == held[0] else 0)
                sums -= np.repeat(base, sizes)
                out.append((sums, sums - term))
            held = (int(c[-1]), int(out[0][0][-1]), int(out[1][0][-1]))
            columns = [batch.column(n) for n in ("c", "pos", "length", "bytes")] + [pa.array(out[i][k].view(np.int64)) for k in (0, 1) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, ["c", "pos", "length", "bytes", "p1", "p2", "q1", "q2"])

    schema = "c long, pos long, length long, bytes long, p1 long, p2 long, q1 long, q2 long"
    return ordered.select("c", "pos", "length", "bytes", "h1", "h2", "_part").mapInArrow(run, schema)


NODE = "pos long, p1 long, p2 long, q1 long, q2 long, top boolean, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long"


def level_order(shard: np.ndarray, c: np.ndarray, level: np.ndarray, p1: np.ndarray, p2: np.ndarray) -> tuple[Louds, np.ndarray]:
    """The trie of rows (shard, conversation, level below the shard's root, prefix), and each row's node in it."""
    _, conv = np.unique(c, return_inverse=True)
    node, at_row = np.zeros(conv.max() + 1, np.int64), np.zeros(len(c), np.int64)
    order = np.argsort(level, kind="stable")
    cuts = np.append(starts_of(level[order]), len(order))
    first, degrees = 0, []
    for k, (begin, end) in enumerate(zip(cuts, cuts[1:])):
        rows = order[begin:end]
        parent = node[conv[rows]] if k else shard[rows]
        by = np.lexsort((p2[rows], p1[rows], parent))
        rows, parent = rows[by], parent[by]
        new = np.concatenate([[True], (np.diff(parent) != 0) | (np.diff(p1[rows]) != 0) | (np.diff(p2[rows]) != 0)])
        at_row[rows] = first + np.cumsum(new) - 1
        if k:
            degrees.append(np.bincount(parent[new] - before, minlength=first - before))
        else:
            degrees.append(np.array([new.sum()]))
        before, first = first, first + int(new.sum())
        node[conv[rows]] = at_row[rows]
    degrees.append(np.zeros(first - before, np.int64))
    return Louds(np.concatenate(degrees)), at_row


def shard_nodes(rows: pa.Table) -> pa.RecordBatch:
    """The nodes of whole shards with their rollups."""
    take = {n: rows.column(n).to_numpy() for n in rows.column_names}
    _, shard = np.unique(np.stack([take["top"], take["r1"], take["r2"]]), axis=1, return_inverse=True)
    trie, at_row = level_order(shard.ravel(), take["c"], take["pos"] - take["top"], take["p1"], take["p2"])
    n = np.bincount(at_row)
    least = np.full(len(n), np.iinfo(np.int64).max)
    np.minimum.at(least, at_row, take["c"])
    one = np.zeros(len(n), np.int64)
    one[at_row] = np.arange(len(at_row))
    labels = {k: take[k][one] for k in ("pos", "p1", "p2", "q1", "q2", "bytes")}
    parents, children = trie.parents(), trie.degrees()
    leaves, saved = trie.rolled_up((children == 0).astype(np.int64)), trie.rolled_up((n - 1) * labels["bytes"])
    top = parents < 0
    parent = pa.array(least[parents], mask=top)
    columns = [pa.array(labels[k]) for k in ("pos", "p1", "p2", "q1", "q2")] + [pa.array(top), pa.array(least), parent, *(pa.array(x.astype(np.int64)) for x in (n, children, leaves, saved))]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in NODE.split(", ")])


def light_nodes(light: DataFrame, limit: int) -> DataFrame:
    """Nodes of rows (top, r1, r2, c, pos, p1, p2, q1, q2, bytes) of all shards; a task builds whole shards of about limit rows together."""
    root = ["top", "r1", "r2"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, last = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch.column(n).to_numpy() for n in root])
            edges = np.flatnonzero((np.diff(names) != 0).any(axis=0)) + 1
            begin = 0
            for edge in ([0] if last is not None and tuple(names[:, 0]) != last else []) + [int(e) for e in edges]:
                if count + edge - begin >= limit:
                    held.append(batch.slice(begin, edge - begin))
                    yield shard_nodes(pa.Table.from_batches([b for b in held if b.num_rows]))
                    held, count, begin = [], 0, edge
            held.append(batch.slice(begin))
            count, last = count + batch.num_rows - begin, tuple(names[:, -1])
        if count:
            yield shard_nodes(pa.Table.from_batches([b for b in held if b.num_rows]))

    return light.repartition(*root).sortWithinPartitions(*root, "pos").mapInArrow(run, NODE)


def parent_key() -> Column:
    """The key of the node above, of columns pos, q1 and q2."""
    return F.struct((F.col("pos") - 1).alias("pos"), F.col("q1").alias("p1"), F.col("q2").alias("p2"))


def climbed(upper: DataFrame, deepest: int) -> DataFrame:
    """upper (pos, p1, p2, q1, q2, n_leaves, saved_tokens, ...) with both sums taken over its own tree.

    After round k a node has the sums of its descendants nearer than 2**k, and knows its ancestor at that distance.
    """
    now = checkpointed(upper.select(*KEY, F.when(F.col("pos") > 0, parent_key()).alias("up"), "n_leaves", "saved_tokens"))
    distance = 1
    while distance <= deepest:
        given = now.where("up is not null").groupBy(*[F.col("up")[k].alias(k) for k in KEY]).agg(F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved"))
        above = now.select(F.struct(*KEY).alias("up"), F.col("up").alias("further"))
        total = [(F.col(k) + F.coalesce(m, F.lit(0))).alias(k) for k, m in (("n_leaves", "more_leaves"), ("saved_tokens", "more_saved"))]
        now = checkpointed(now.join(given, KEY, "left").join(above, "up", "left").select(*KEY, F.col("further").alias("up"), *total))
        distance *= 2
    return now.drop("up")


def end_hashes(ends: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows (pos, p1, p2, sha) of rows (pos, p1, p2, c): the hash of each node's ids in ascending order.

    Ids are joined in chunks over ranges of (node, id). The chunks of a node, 1 / chunk of its rows, stream through one hash.
    """

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, c = np.stack([batch.column(k).to_numpy() for k in KEY]), batch.column("c").to_numpy()
            cuts = np.concatenate([[0], np.flatnonzero((np.diff(keys) != 0).any(axis=0)) + 1, [len(c)]])
            cuts = [(a, min(b, a + chunk)) for begin, b in zip(cuts, cuts[1:]) for a in range(begin, b, chunk)]
            first = np.array([a for a, _ in cuts])
            ids = pa.array([",".join(map(str, c[a:b].tolist())) for a, b in cuts])
            yield pa.RecordBatch.from_arrays([*(pa.array(k[first]) for k in keys), pa.array(c[first]), ids], [*KEY, "c", "ids"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, done = None, None, []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*done))
            return pa.RecordBatch.from_arrays([*(pa.array(columns[i], pa.int64()) for i in range(3)), pa.array(columns[3])], [*KEY, "sha"])

        for batch in batches:
            for *own, ids in zip(*(batch.column(k).to_pylist() for k in [*KEY, "ids"])):
                if own != key:
                    if key is not None:
                        done.append((*key, digest.hexdigest()))
                    key, digest = own, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if done:
                yield flushed()
                done = []
        if key is not None:
            done.append((*key, digest.hexdigest()))
            yield flushed()

    pieces = ranged(ends, *KEY, "c").select(*KEY, "c").mapInArrow(joined, "pos long, p1 long, p2 long, c long, ids string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "c").mapInArrow(hashed, "pos long, p1 long, p2 long, sha string")


def prefix_trie(conversations: DataFrame, limit: int = LIMIT) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A null turn comes first; turns of equal number are ordered by hashes of role and text. A null role
    or text is empty. Rows without conv_id belong to no conversation and are left out. c % 5 has the
    sign of c, as in SQL. Rows that repeat are turns of their own. Columns other than conv_id, turn,
    role and text are not read. An empty table gives an empty result. Turns and prefixes are told apart
    by 128 bits of hashes. The driver holds two rows for each partition.
    """
    found, convs = rebuilt(checkpointed(turns_of(conversations)))
    rows = checkpointed(prefixes(checkpointed(found)))
    sums = [F.sum(F.col("length") - F.col("pos") + 1).alias("rows"), F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id"), *[F.max(k).alias(k) for k in ("bytes", "q1", "q2")]]
    heavy = checkpointed(rows.groupBy(*KEY).agg(*sums).where(F.col("rows") > limit).drop("rows"))
    marked = rows.join(heavy.select(*KEY, F.lit(True).alias("heavy")), KEY, "left")
    cut = marked.where("heavy is null").groupBy("c").agg(F.min(F.struct("pos", "p1", "p2")).alias("r"))
    cut = checkpointed(cut.select("c", F.col("r.pos").alias("top"), F.col("r.p1").alias("r1"), F.col("r.p2").alias("r2")))
    light = checkpointed(light_nodes(rows.join(cut, "c").where("pos >= top").drop("length"), limit))

    zero = [F.lit(0).cast("long").alias(k) for k in ("bytes", "q1", "q2")]
    root = convs.agg(F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id")).where("n_convs > 0").select(*[F.lit(0).cast("long").alias(k) for k in KEY], "n_convs", "conv_id", *zero)
    heavy = checkpointed(heavy.unionByName(root))
    above = [(F.col("pos") - 1).alias("pos"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
    of_shards = light.where("top").groupBy(*above).agg(F.count(F.lit(1)).alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    of_heavy = heavy.where("pos > 0").groupBy(*above).agg(F.count(F.lit(1)).alias("heavy_kids"))
    none = F.lit(0).cast("long")
    upper = heavy.join(of_shards, KEY, "left").join(of_heavy, KEY, "left").withColumn("n_children", F.coalesce("kids", none) + F.coalesce("heavy_kids", none))
    upper = upper.withColumn("n_leaves", F.coalesce("leaves", none) + F.when(F.col("n_children") == 0, 1).otherwise(0))
    upper = checkpointed(upper.withColumn("saved_tokens", F.coalesce("saved", none) + (F.col("n_convs") - 1) * F.col("bytes")))
    deepest = upper.agg(F.max("pos")).first()[0] or 0
    whole = upper.drop("n_leaves", "saved_tokens").join(climbed(upper, deepest), KEY)

    names = heavy.select(F.struct(*KEY).alias("up"), F.col("conv_id").alias("above"))
    columns = [*KEY, "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    up = parent_key().alias("up")
    below = light.where("top").select(*columns, up).unionByName(whole.select(*columns, up)).join(names, "up", "left")
    nodes = below.select(*columns, F.col("above").alias("parent_conv_id")).unionByName(light.where("not top").select(*columns, "parent_conv_id"))

    ends = rows.where("pos = length").select(*KEY, "c").unionByName(convs.where("length = 0").select(*[F.lit(0).cast("long").alias(k) for k in KEY], "c"))
    hashes = end_hashes(checkpointed(ends))
    out = nodes.join(hashes, KEY, "left")
    return out.select("conv_id", F.col("pos").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"))


SQL = """
with t as (
  select conv_id as c, row_number() over (partition by conv_id order by turn nulls first) as i, sha256(concat(sha256(coalesce(role, '')), sha256(coalesce(text, '')))) as x, strlen(coalesce(text, '')) as b
  from conversations where conv_id is not null),
s as (select c, count(*) as n, c - c % 5 as base from t group by 1),
k as (
  select c, n, base, xor(4294967295, list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(c::varchar) + 1), lambda j: ascii(substr(c::varchar, j, 1))::bigint)),
    lambda v, y: list_reduce(list_prepend(xor(v, y), range(8)), lambda u, z: case when (u & 1) = 1 then xor(u >> 1, 3988292384) else u >> 1 end))) % 9 as h
  from s),
m as (select k.c, k.h, k.base, least(k.h, coalesce(o.n, 0)) as taken, least(k.h, coalesce(o.n, 0)) + greatest(0, k.n - k.h) as len from k left join s o on o.c = k.base),
r as (
  select m.c, taken + i - h as d, len, x, b from m join t on t.c = m.c where i > h
  union all select m.c, i as d, len, x, b from m join t on t.c = m.base where i <= taken),
p as (
  select c, d, len, b, sha256(string_agg(x, ',' order by d) over (partition by c order by d rows unbounded preceding)) as key from r
  union all select c, 0, len, 0, '' from m),
g as (select key, d, min(c) as conv_id, count(*) as n, any_value(b) as b, coalesce(string_agg(c::varchar, ',' order by c) filter (d = len), '') as ids from p group by 1, 2),
u as (select distinct x.key as kid, y.key as mum from p x join p y on x.c = y.c and x.d = y.d + 1),
f as (select key from g where key not in (select mum from u)),
a as (select distinct x.key as low, y.key as high from p x join p y on x.c = y.c and x.d >= y.d),
z as (select high, sum((n - 1) * b)::bigint as saved, count(f.key) as leaves from a join g on g.key = low left join f on f.key = low group by 1)
select g.conv_id, g.d as depth, o.conv_id as parent_conv_id, g.n as n_convs, (select count(*) from u q where q.mum = g.key) as n_children, leaves as n_leaves, saved as saved_tokens, sha256(g.ids) as ends_sha256
from g join z on z.high = g.key left join u on u.kid = g.key left join g o on o.key = u.mum
"""
