"""WARC files as Spark tables, and a Merkle fixity audit of two replicas.

An archive's records, ordered by slot, are leaves of a tree with ``FANOUT`` children a node. A leaf
hashes a record's offset, length and SHA-256; a node hashes its children in order, with the slots
they stand in, so it vouches for an ordered range of offsets. The audit compares the roots of the
two replicas, then only the children of nodes that differ, level by level, down to the records.
Levels are plain groupings by (archive, node), bounded by FANOUT rows a group; there are as many as the
highest slot needs for one root an archive.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, whole_text

FANOUT = 16
#: Levels above the leaves; more where an archive has more than FANOUT**LEAST_LEVELS slots.
LEAST_LEVELS = 3
#: Slots of an archive of documents.
SLOTS = 1000


#: Bytes of a gzip member that are unzipped at once.
PIECE = 1 << 16


def record_bytes(doc_id: Column, text: Column) -> Column:
    """A WARC resource record of a document."""
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:document:"), F.coalesce(doc_id.cast("string"), F.lit("none")),
        F.lit(">\r\nContent-Type: text/plain\r\nContent-Length: "), F.octet_length(text).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head, text, F.lit("\r\n\r\n"))


def archived(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """Rows (archive, slot, record): documents as WARC records in archives of one source and a block of ids.

    An archive has at most ``slots`` slots whatever a source's size. A null id goes by a hash of the
    text, a null source to archives named "none".
    """
    by_text = F.pmod(F.xxhash64(whole_text()), F.lit(1 << 40))
    block = F.coalesce(F.floor(F.col("doc_id") / slots), -1 - F.floor(by_text / slots))
    slot = F.coalesce(F.pmod("doc_id", F.lit(slots)), F.pmod(by_text, F.lit(slots)))
    name = F.concat_ws("-", F.coalesce(F.col("source").cast("string"), F.lit("none")), block.cast("string"))
    return docs.select(name.alias("archive"), slot.cast("long").alias("slot"), record_bytes(F.col("doc_id"), whole_text()).alias("record"))


def leaves(records: DataFrame) -> DataFrame:
    """Rows (archive, slot, length, hash): a slot's records; of rows that share a slot, the sum of lengths and a hash of all."""
    one = records.select("archive", "slot", F.octet_length("record").cast("long").alias("n"), F.sha2("record", 256).alias("own"))
    parts = [F.sum(F.conv(F.substring("own", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string") for i in range(4)]
    merged = one.groupBy("archive", "slot").agg(F.sum("n").alias("length"), F.count(F.lit(1)).alias("rows"), F.max("own").alias("own"), F.concat_ws("|", *parts).alias("sums"))
    several = F.sha2(F.concat_ws("|", F.col("rows").cast("string"), "sums"), 256)
    return merged.select("archive", "slot", "length", F.when(F.col("rows") == 1, F.col("own")).otherwise(several).alias("hash"))


def with_offsets(leaf_rows: DataFrame) -> DataFrame:
    """leaf rows with each record's offset in its archive file, as its index has it."""
    before = Window.partitionBy("archive").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    return leaf_rows.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))


def levels_of(*replicas: DataFrame) -> int:
    """How many levels give every archive of the replicas one root, node 0."""
    highest = max((r.agg(F.max("slot")).first()[0] or 0 for r in replicas), default=0)
    levels = LEAST_LEVELS
    while FANOUT**levels <= highest:
        levels += 1
    return levels


def tree(leaf_rows: DataFrame, levels_above: int) -> list[DataFrame]:
    """Levels from leaves to roots: rows (archive, node, hash)."""
    entry = F.sha2(F.concat_ws("|", F.col("offset").cast("string"), F.col("length").cast("string"), "hash"), 256)
    levels = [leaf_rows.select("archive", F.col("slot").alias("node"), entry.alias("hash"))]
    for _ in range(levels_above):
        child = F.concat_ws(":", F.col("node").cast("string"), "hash")
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("node", child.alias("child")))), lambda x: x["child"])
        parent = levels[-1].groupBy("archive", F.floor(F.col("node") / FANOUT).alias("node"))
        levels.append(parent.agg(F.sha2(F.array_join(ordered, ","), 256).alias("hash")))
    return [levels[0], *map(checkpointed, levels[1:])]


def differing(one: DataFrame, other: DataFrame) -> DataFrame:
    """Rows (archive, node, hash_a, hash_b) of the nodes that differ or are in one tree only."""
    a, b = one.withColumnRenamed("hash", "hash_a"), other.withColumnRenamed("hash", "hash_b")
    return a.join(b, ["archive", "node"], "full").where(~F.col("hash_a").eqNullSafe(F.col("hash_b")))


def audit(replica_a: DataFrame, replica_b: DataFrame) -> DataFrame:
    """One row per archive without a fault and one per faulty slot of the others.

    The replicas have columns archive, slot, offset, length, hash. Result: archive, root_a, root_b
    (null where a replica lacks the archive), slot, offset, length (of replica a, else of b; -1
    for intact archives), status (intact, altered, missing in b, extra in b). Rows with a null
    archive or a null or negative slot are left out; empty replicas give an empty result.
    """
    whole = [r.where("archive is not null and slot >= 0") for r in (replica_a, replica_b)]
    above = levels_of(*whole)
    trees = [tree(r, above) for r in whole]
    roots = [t[-1].select("archive", F.col("hash").alias(f"root_{x}")) for t, x in zip(trees, "ab")]
    both = checkpointed(roots[0].join(roots[1], "archive", "full"))
    bad = both.where(~F.col("root_a").eqNullSafe(F.col("root_b"))).select("archive", F.lit(0).cast("long").alias("parent"))
    for k in range(above - 1, -1, -1):
        below = [t[k].withColumn("parent", F.floor(F.col("node") / FANOUT)).join(bad, ["archive", "parent"], "left_semi").drop("parent") for t in trees]
        found = differing(*below)
        bad = checkpointed(found.select("archive", F.col("node").alias("parent")))
    slots = bad.withColumnRenamed("parent", "slot")
    at = [r.join(slots, ["archive", "slot"], "left_semi").select("archive", "slot", F.struct("offset", "length").alias(x)) for r, x in zip(whole, "ab")]
    place = at[0].join(at[1], ["archive", "slot"], "full")
    status = F.when(F.col("b").isNull(), "missing in b").when(F.col("a").isNull(), "extra in b").otherwise("altered")
    faults = place.select("archive", "slot", F.coalesce("a.offset", "b.offset").alias("offset"), F.coalesce("a.length", "b.length").alias("length"), status.alias("status"))
    out = both.join(faults, "archive", "left")
    numbers = [F.coalesce(F.col(c), F.lit(-1)).cast("long").alias(c) for c in ("slot", "offset", "length")]
    return out.select("archive", "root_a", "root_b", *numbers, F.coalesce("status", F.lit("intact")).alias("status"))


def damaged(records: DataFrame) -> DataFrame:
    """A replica with planted faults, for drills: by a digest of archive and slot, some records lose their last letter to a tilde, some are gone."""
    mark = F.substring(F.md5(F.concat_ws("/", "archive", F.col("slot").cast("string"))), 1, 2)
    record = F.when(mark == "0a", F.concat(F.substr("record", F.lit(1), F.length("record") - 5), F.lit("~\r\n\r\n"))).otherwise(F.col("record"))
    return records.where(mark != "b0").withColumn("record", record)


def drill(docs: DataFrame) -> DataFrame:
    """The audit of all documents' archives against a replica with planted faults; both keep the index of offsets."""
    records = archived(docs)
    good = checkpointed(with_offsets(leaves(records)))
    index = good.select("archive", "slot", "offset")
    return audit(good, leaves(damaged(records)).join(index, ["archive", "slot"]))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of WARC files, gzipped by record or plain: archive, slot, offset, length, hash, headers, payload.

    One task reads one file, as WARC files are written to about a gigabyte; Spark's reader of whole
    files takes up to 2 GB. Bytes after the last whole record come as one record with null headers,
    so that a cut file shows in an audit.
    """
    schema = "archive string, slot long, offset long, length long, hash string, headers map<string,string>, payload binary"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path_, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = [(path_, i, *r) for i, r in enumerate(split_records(data))]
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.map_(pa.string(), pa.string()), pa.binary()]
                names = ["archive", "slot", "offset", "length", "hash", "headers", "payload"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 7, kinds)], names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, schema)


def unzipped(data: memoryview, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at a place and its stored size; what is left of the data if it is cut or broken."""
    unzip, parts, begin = zlib.decompressobj(wbits=31), [], at
    try:
        while at < len(data) and not unzip.eof:
            parts.append(unzip.decompress(data[at : at + PIECE]))
            at += PIECE
    except zlib.error:
        return b"", len(data) - begin
    if not unzip.eof:
        return b"", len(data) - begin
    return b"".join(parts), min(at, len(data)) - len(unzip.unused_data) - begin


def split_records(data: bytes) -> Iterator[tuple[int, int, str, list[tuple[str, str]] | None, bytes]]:
    """(offset, length, SHA-256 of the stored bytes, headers, payload) of each record; each byte is read once."""
    view, at = memoryview(data), 0
    while at < len(data):
        if data.startswith(b"\x1f\x8b", at):
            plain, size = unzipped(view, at)
            begin = 0
        else:
            plain, size, begin = data, None, at
        end = plain.find(b"\r\n\r\n", begin)
        lines = plain[begin : max(end, begin)].decode("utf-8", "replace").split("\r\n")
        headers = [tuple(map(str.strip, x.split(":", 1))) for x in lines[1:] if ":" in x]
        length = next((int(v) for k, v in headers if k.lower() == "content-length" and v.isdigit()), None)
        if end < 0 or not lines[0].startswith("WARC/") or length is None or len(plain) < end + 4 + length:
            stored = data[at:]
            yield at, len(stored), hashlib.sha256(stored).hexdigest(), None, stored
            return
        size = end + 4 + length + 4 - begin if size is None else size
        stored = view[at : at + size]
        yield at, len(stored), hashlib.sha256(stored).hexdigest(), headers, plain[end + 4 : end + 4 + length]
        at += size


SQL = """
with r as (
  select coalesce(source, 'none') || '-' || cast(cast(floor(doc_id / 1000) as bigint) as varchar) as archive, doc_id % 1000 as slot,
    'WARC/1.0' || n || 'WARC-Type: resource' || n || 'WARC-Record-ID: <urn:document:' || doc_id || '>' || n || 'Content-Type: text/plain' || n
    || 'Content-Length: ' || strlen(coalesce(text, '')) || n || n || coalesce(text, '') || n || n as record
  from documents, (select chr(13) || chr(10) as n)),
m as (select *, substr(md5(archive || '/' || slot), 1, 2) as mark from r),
a as (
  select archive, slot, strlen(record) as length, sha256(record) as hash,
    coalesce(sum(strlen(record)) over (partition by archive order by slot rows between unbounded preceding and 1 preceding), 0)::bigint as "offset"
  from m),
b as (
  select d.archive, d.slot, strlen(kept) as length, sha256(kept) as hash, a."offset"
  from (select *, case when mark = '0a' then left(record, length(record) - 5) || '~' || chr(13) || chr(10) || chr(13) || chr(10) else record end as kept from m) d
    join a on a.archive = d.archive and a.slot = d.slot
  where mark <> 'b0'),
e as (
  select 'a' as t, archive, slot as node, sha256("offset" || '|' || length || '|' || hash) as hash from a
  union all select 'b', archive, slot, sha256("offset" || '|' || length || '|' || hash) from b),
l1 as (select t, archive, node // 16 as node, sha256(string_agg(node || ':' || hash, ',' order by node)) as hash from e group by all),
l2 as (select t, archive, node // 16 as node, sha256(string_agg(node || ':' || hash, ',' order by node)) as hash from l1 group by all),
l3 as (select t, archive, node // 16 as node, sha256(string_agg(node || ':' || hash, ',' order by node)) as hash from l2 group by all),
roots as (select archive, max(hash) filter (t = 'a') as root_a, max(hash) filter (t = 'b') as root_b from l3 group by all),
f as (
  select a.archive, a.slot, a."offset", a.length, case when b.slot is null then 'missing in b' else 'altered' end as status
  from a left join b on a.archive = b.archive and a.slot = b.slot where b.slot is null or a.hash <> b.hash)
select archive, root_a, root_b, coalesce(slot, -1) as slot, coalesce("offset", -1) as "offset", coalesce(length, -1) as length, coalesce(status, 'intact') as status from roots left join f using (archive)
"""
