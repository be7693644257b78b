"""The conversation prefix trie against brute force and SQL."""

import hashlib
import random
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

from factorweave.llm import conversation_trie as C
from factorweave.llm.louds import Louds

DIR = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string, pos long, p1 string, length int, up string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = defaultdict(list)
    for r in rows:
        if r[0] is not None:
            own[r[0]].append((r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    turns = {c: [t[2:] for t in sorted(v, key=lambda t: t[:2])] for c, v in own.items()}
    members = defaultdict(list)
    whole = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(np.fmod(c, 5))
        whole[c] = tuple(turns.get(base, [])[:h] + turns[c][h:])
        for d in range(len(whole[c]) + 1):
            members[whole[c][:d]].append(c)
    out = []
    for p, own in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(x) == len(q) + 1 and x[: len(q)] == q for x in below)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1].encode()) for q in below if q)
        ends = ",".join(str(c) for c in sorted(c for c in own if whole[c] == p))
        out.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made():
    rng = random.Random(4)
    rows = []
    for c in [*range(-7, 40), 1000, 10**12]:
        n = rng.choice([1, 2, 3, 5, 8, 12]) if c != 7 else 60
        rows += [(c, t, rng.choice(["user", "bot"]), rng.choice(["é", "yes", "no"]) if c % 3 else "same") for t in range(n)]
    rows += [(50, None, None, None), (50, 1, "user", "x"), (51, None, "", ""), (51, 1, "user", "x"), (None, 1, "user", "lost"), (53, 1, "user", "only"), (53, 1, "user", "only")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("limit", [4, 30, C.LIMIT])
def test_trie_equals_brute_force(spark, limit):
    rows = made()
    df = spark.createDataFrame([(*r, 5, "a", 1, "b") for r in rows], SCHEMA).repartition(4)
    got = C.prefix_trie(df, limit)
    assert got.columns == NAMES
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from read_parquet('{DIR}/conversations.parquet')")
    sql = con.sql(f"select {', '.join(NAMES)} from ({C.SQL})").fetchall()
    got = C.prefix_trie(spark.read.parquet(f"{DIR}/conversations.parquet")).select(NAMES).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, sql)) and len(got) == 34


def test_shards_are_cut_between_batches(spark):
    """Groups of copies and long conversations, with batches much smaller than a shard."""
    rows = [(c, t, "u", f"t{t}" if t < 30 else f"t{t}-{c % 2}") for c in range(0, 300, 5) for t in range(40)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        got = C.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 50).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_end_hashes_over_many_chunks(spark):
    rows = [(1, 2, 3, c) for c in range(1000)] + [(1, 2, 4, c) for c in (-5, 7)]
    got = {r["p2"]: r["sha"] for r in C.end_hashes(spark.createDataFrame(rows, "pos long, p1 long, p2 long, c long").repartition(3), chunk=16).collect()}
    assert got == {3: hashlib.sha256(",".join(map(str, range(1000))).encode()).hexdigest(), 4: hashlib.sha256(b"-5,7").hexdigest()}


def test_louds_gives_parents_levels_and_sums_back():
    rng = np.random.default_rng(2)
    parents = [-1, -1]
    while len(parents) < 200:
        parents += [parents[-1] + k for k in sorted(rng.integers(0 if parents[-1] >= 0 else 1, 3, 2)) if parents[-1] + k < len(parents)]
    parents = np.sort(np.array(parents))
    degrees = np.bincount(parents + 1, minlength=len(parents) + 1)
    trie = Louds(degrees)
    assert (trie.parents() == parents).all() and (trie.degrees() == degrees[1:]).all()
    values = rng.integers(0, 9, len(parents))
    want = values.copy()
    for i in range(len(parents) - 1, 1, -1):
        want[parents[i]] += want[i] if parents[i] >= 0 else 0
    assert (trie.rolled_up(values) == want).all() and trie.levels()[-1][1] == len(parents)


def test_empty_table(spark):
    assert C.prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
