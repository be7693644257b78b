"""The language model writes no text, rows without an id keep their own scores, and uneven class weights change nothing."""

import numpy as np
import public_tokenizers
import pytest

from factorweave.llm import attention, lm_scoring

WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_no_text_is_written(spark, monkeypatch):
    tables, write = {}, lm_scoring.written

    def kept(df, name):
        tables[name] = df.columns
        return write(df, name)

    monkeypatch.setattr(lm_scoring, "written", kept)
    rows = [(1, "the house of the house"), (None, "the house"), (None, "of unbelievably zzqqk"), (None, "the house"), (2, None), (3, "the"), (3, "the"), (3, "of of")]
    out = lm_scoring.score(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, subwords=True).collect()
    assert {"coded", "scored"} <= set(tables) and not any("text" in c for c in tables.values())
    assert sorted((r["doc_id"] or 0, r["n_tokens"]) for r in out) == [(0, 3), (0, 3), (0, 4), (1, 6), (2, 1), (3, 2), (3, 2), (3, 3)]
    scores = {}
    for r in out:
        scores.setdefault((r["doc_id"], r["n_tokens"]), set()).add(r["score"])
    assert all(len(x) == 1 and None not in x for x in scores.values()) and len({*map(tuple, scores.values())}) == len(scores)


@pytest.mark.parametrize("spread,size", [(1, 1), (20, 1), (60, 1), (20, 40), (60, 40)])
def test_uneven_classes(spread, size):
    rng = np.random.default_rng(5)
    text = rng.integers(0, attention.INPUTS, 60) | rng.integers(0, attention.INPUTS, 60) << 16 | rng.integers(0, attention.END, 60) << 32
    x, y, begins, _ = attention.blocked([text])
    p = attention.fresh(rng.random(attention.OUTPUTS))
    p["c"] = (-spread * rng.random(attention.OUTPUTS)).astype(np.float32)
    p["U"] *= size
    q = {k: v.astype(float) for k, v in p.items()}
    single, double = (attention.log_probabilities(o, x, y, begins) for o in (p, q))
    assert np.isfinite(single).all() and np.allclose(single, double, rtol=1e-3, atol=1e-3)
    assert np.allclose(sum(np.exp(attention.log_probabilities(q, x, np.full_like(y, i), begins)) for i in range(attention.OUTPUTS)), 1)
    (_, g), (_, h) = (attention.gradients(o, x, y, begins) for o in (p, q))
    for name in g:
        assert np.allclose(g[name], h[name], rtol=1e-2, atol=1e-3 * np.abs(h[name]).max()), name
    step = 1e-4 * rng.standard_normal(attention.OUTPUTS)
    two = [-attention.log_probabilities(q | {"c": q["c"] + s}, x, y, begins).sum() / (y >= 0).sum() for s in (-step, step)]
    assert abs((two[1] - two[0]) / 2 - h["c"] @ step) < 1e-4 * np.abs(h["c"] * step).sum()
