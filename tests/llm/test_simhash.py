"""The SimHash join against brute force over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from factorweave.llm import simhash_join as S
from factorweave.llm.vantage import VantageTree, distance, united

SCHEMA = "doc_id long, text string, fp string, a int"


def fingerprint(text):
    words = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute(rows):
    points = [fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(points[i] ^ points[j]).count("1") <= 2:
                group[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(r[0], least.get(top(i), r[0]))
    return sorted((str(r[0]), f"{p:016x}", str(least.get(top(i)))) for i, (r, p) in enumerate(zip(rows, points)))


def made(n):
    rng = random.Random(7)
    vocabulary = ["Élan", "word", "Z z", "A-b", "x"] + [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(1, 60))) for _ in range(n)]
    texts += [t + rng.choice(["", " tail", "\n\tX"]) for t in texts for _ in range(2)]
    return [(i * 3 % 997, t) for i, t in enumerate(texts)] + [(5000, None), (5001, ""), (None, " \n"), (None, "alone"), (5002, "alone"), (5002, "alone"), (5003, "ALONE")]


@pytest.mark.parametrize("shard", [8, 1 << 13])
def test_components_equal_brute_force(spark, shard):
    rows = made(120)
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], SCHEMA)
    got = S.simhash_components(docs, sample=64 if shard == 8 else S.SAMPLE, shard=shard).collect()
    assert sorted((str(r[0]), r[1], str(r[2])) for r in got) == brute(rows)


def test_forests_of_shards_have_the_components_of_all_pairs(spark):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 40, np.uint64)
    flips = np.uint64(1) << rng.integers(0, 64, (40, 60, 3)).astype(np.uint64)
    points = np.unique(np.concatenate([centres, (centres[:, None] ^ flips[..., 0]).ravel(), (centres[:, None] ^ flips[..., 0] ^ flips[..., 1]).ravel(), (centres[:, None] ^ np.bitwise_xor.reduce(flips, axis=2)).ravel()]))
    near = distance(points[:, None], points[None, :]) <= 2
    label, other = np.arange(len(points)), np.arange(len(points))
    united(label, *np.nonzero(near))
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long").repartition(5)
    found = S.near_links(df, sample=300, shard=50, leaf_size=10).collect()
    place = {int(p): i for i, p in enumerate(points.view(np.int64))}
    united(other, np.array([place[r["a"]] for r in found]), np.array([place[r["b"]] for r in found]))
    assert (label == other).all() and len(np.unique(label)) < len(points) and len(found) < 6 * len(points)
    assert all(near[place[r["a"]], place[r["b"]]] or label[place[r["a"]]] == label[place[r["b"]]] for r in found)


def test_tree_finds_every_pair():
    rng = np.random.default_rng(5)
    points = rng.integers(0, 1 << 10, 400, np.uint64)
    points = np.unique(points | points << np.uint64(40))
    tree = VantageTree(points, 5)
    got = {(int(a), int(b)) for q, p in tree.pairs(points, points, block=64) for a, b in zip(q, p)}
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero(distance(points[:, None], points[None, :]) <= 2))}
    homes = np.concatenate([at for _, visiting, at in tree.routed(points) if not visiting])
    assert sorted(homes) == list(range(len(points)))


def test_equal_points_and_empty_tables(spark):
    assert VantageTree(np.zeros(50, np.uint64), 4).root == -1
    docs = spark.createDataFrame([], SCHEMA)
    out = S.simhash_components(docs)
    assert out.columns == ["doc_id", "fingerprint", "component_id"] and out.count() == 0
    same = spark.createDataFrame([(i, "one two three four", "", 0) for i in range(50)], SCHEMA)
    assert {r["component_id"] for r in S.simhash_components(same).collect()} == {0}


def test_a_very_long_text_and_ties():
    assert S.majority(np.array([1, 2], np.uint64)) == 0  # half is not over half
    long_text = " ".join(f"w{i % 977}" for i in range(200_000))
    assert S.majority(S.shingle_hashes(long_text.encode())) == S.majority(np.concatenate([S.shingle_hashes(long_text.encode())] * 2))
    assert len(S.shingle_hashes(long_text.encode())) == 199_998


def test_the_sample_is_bounded_and_the_least_hashes(spark):
    points = spark.range(0, 5000).selectExpr("id * 7919 as fp").repartition(6)
    want = [r["fp"] for r in points.orderBy(S.F.xxhash64("fp")).limit(100).collect()]
    assert [r["fp"] for r in S.sampled(points, 5000, 100).collect()] == want
    assert S.sampled(points, 5000, 4000).count() == 4000
