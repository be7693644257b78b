"""The perplexity bands and the verdict of the quality rules, taken again from the perplexities of all rows."""

import collections
import math

from factorweave.llm import ngram_quality

DIR = "/root/testdata/sf0.001"


def middle(values):
    return sorted(values)[math.ceil(len(values) / 2) - 1]


def test_bands_and_kept_equal_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    rows = ngram_quality.quality_report(docs).collect()
    sizes = collections.Counter(lang.values())
    pool = {i: x if x and sizes[x] >= ngram_quality.LEAST_DOCS else "" for i, x in lang.items()}
    passed = collections.defaultdict(list)
    for r in rows:
        if not r["base_failed"]:
            passed[pool[r["doc_id"]]].append(r["log10_perplexity"])
    bands = {}
    for p, values in passed.items():
        m = middle(values)
        low, high = ([abs(v - m) for v in values if (v - m) * sign >= 0] for sign in (-1, 1))
        scale = lambda apart: max(ngram_quality.LEAST_SCALE, 1.4826 * middle(apart))
        bands[p] = m - ngram_quality.WIDTH_LOW * scale(low), m + ngram_quality.WIDTH_HIGH * scale(high)
    assert len(rows) == len(lang) and len(bands) > 1
    for r in rows:
        lower, upper = bands[pool[r["doc_id"]]]
        assert math.isclose(r["log10_lower"], lower, rel_tol=1e-9) and math.isclose(r["log10_upper"], upper, rel_tol=1e-9)
        assert r["kept"] == (not r["base_failed"] and lower <= r["log10_perplexity"] <= upper)
    assert {r["kept"] for r in rows if not r["base_failed"]} == {True, False}
