"""Ranked search against brute force and SQL; bisection on documents of known groups."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from factorweave.llm import bisection
from factorweave.llm import ranked_search as R

DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, query int, cluster string, score int"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return Counter(TERM.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or "")))


def brute(docs, items, top=20):
    found = [terms(t) for _, t in docs]
    n_docs, n_terms = sum(1 for c in found if c), sum(sum(c.values()) for c in found)
    df = Counter(t for c in found for t in c)
    out = []
    for item, text in items:
        scored = []
        for (doc_id, _), c in zip(docs, found):
            score = 0
            for t, times in terms(text).items():
                if c[t]:
                    m = 100 - 25 + 25 * sum(c.values()) * n_docs // n_terms
                    score += times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item, k, s[3], -s[0]) for k, s in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def made():
    rng = random.Random(9)
    topics = [[f"{a}{i}" for i in range(40)] for a in ("x", "Ÿ", "z9", "Q")]
    docs = []
    for i in range(400):
        words = rng.choices(rng.choice(topics), k=rng.randint(1, 50)) + rng.choices(["the", "of", "and"], k=rng.randint(0, 9))
        docs.append((i * 7 % 1009, rng.choice([" ", "\n", "--", "\x7f"]).join(words)))
    docs += [(5000 + i, "same old copy x1 x2") for i in range(60)] + [(None, "same old copy x1 x2"), (None, None), (9, ""), (10, "?! .."), (11, "the " * 400 + "x3"), (11, "the " * 400 + "x3")]
    items = [(k, " ".join(rng.choices(rng.choice(topics) + ["the", "copy"], k=rng.randint(1, 12)))) for k in range(30)]
    return docs, items + [(100, None), (101, "nowhere"), (102, "Copy COPY x1"), (102, "x3 the"), (None, "z91")]


@pytest.mark.parametrize(("shard_terms", "cluster", "block"), [(300, 8, 500), (R.SHARD_TERMS, R.CLUSTER, R.BLOCK_BYTES)])
def test_search_equals_brute_force(spark, shard_terms, cluster, block):
    docs, items = made()
    df = spark.createDataFrame([(*d, 1, "c", 2) for d in docs], DOCS).repartition(5)
    asked = spark.createDataFrame([(*i, 3) for i in items], "item_id long, text string, rank int")
    index = R.build_index(df, shard_terms, cluster, sample=50 if cluster == 8 else R.SAMPLE)
    got = R.search(index, asked, block_bytes=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(docs, items)
    held = [r for c in index.clusters.collect() for r in np.frombuffer(c["ids"], np.int64)]
    assert len(held) == sum(1 for _, t in docs if terms(t))


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{DIR}/{t}.parquet')")
    sql = con.sql(f"select item_id, rank, doc_id, score from ({R.SQL})").fetchall()
    got = R.ranked_search(spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/benchmark.parquet")).collect()
    assert sorted(map(tuple, got)) == sorted(sql) and len(got) > 100


def test_visits_stop_at_the_bound(spark, monkeypatch):
    """Clusters of other topics are not scored, and those that could tie are."""
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices([f"{'abcd'[i % 4]}{k}" for k in range(30)], k=20))) for i in range(800)]
    index = R.build_index(spark.createDataFrame([(*d, 1, "c", 2) for d in docs], DOCS), 10**6, 16)
    texts = [b"a1 a2 a3 a4"]
    queries = R.weighed(index, texts)
    opened = []
    for row in index.clusters.toArrow().to_batches():
        for i in range(row.num_rows):
            c = R.Cluster(row, i)
            c.opened(queries)
            opened.append((int(queries.bounds(c.terms, c.best)[0]), int(c.scores(queries, 0).max())))
    assert all(bound >= score for bound, score in opened)
    twentieth = brute(docs, [(0, texts[0].decode())])
    floor = min(r[3] for r in twentieth)
    assert sum(bound >= floor for bound, _ in opened) < len(opened) / 2


def test_bisection_brings_groups_together():
    rng = np.random.default_rng(0)
    group = rng.permutation(np.repeat(np.arange(8), 40))
    doc = np.repeat(np.arange(320), 12)
    term = group[doc] * 50 + rng.integers(0, 50, len(doc))
    both = np.unique(np.stack([doc, term]), axis=1)
    order, cuts = bisection.bisected(both[0], both[1], 320, 40)
    assert sorted(order) == list(range(320)) and np.diff(cuts).max() <= 40
    assert np.mean([np.bincount(group[order[a:b]]).max() / (b - a) for a, b in zip(cuts, cuts[1:])]) > 0.8
    for count in (0, 1, 2, 3):
        order, cuts = bisection.bisected(np.zeros(0, int), np.zeros(0, int), count, 1)
        assert sorted(order) == list(range(count)) and cuts[-1] == count


def test_empty_tables_and_long_texts(spark):
    docs, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert R.ranked_search(docs, items).collect() == []
    many = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(100_000)) + " b" * 70_000, 0, "", 0), (2, "b", 0, "", 0)], DOCS)
    assert R.ranked_search(many, items.limit(0)).collect() == []
    asked = spark.createDataFrame([(1, "b w77")], "item_id long, text string")
    assert [tuple(r) for r in R.ranked_search(many, asked).orderBy("rank").collect()] == sorted(brute([(1, " ".join(f"w{i}" for i in range(100_000)) + " b" * 70_000), (2, "b")], [(1, "b w77")]), key=lambda r: r[1])
