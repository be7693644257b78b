"""The score of whole texts against a plain loop over words."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers

from factorweave.llm import attention, lm_scoring

WORDS = public_tokenizers.path("word_bpe_49k.json")


def log10_of_text(p, codes):
    """log10 probability of the classes of a text and its end: one position after another, in doubles."""
    p = {k: v.astype(float) for k, v in p.items()}
    seen = [(attention.INPUTS, attention.INPUTS)] + [(c & 0xFFFF, c >> 16 & 0xFFFF) for c in codes]
    e = [p["E"][a] + p["L"][b] for a, b in seen]
    total = 0.0
    for t, wanted in enumerate([c >> 32 for c in codes] + [attention.END]):
        keys = range(max(0, (t // attention.STRIDE - 1) * attention.STRIDE), t + 1)
        weights = np.array([(e[t] @ p["Q"]) @ (e[j] @ p["K"]) / math.sqrt(attention.WIDTH) - 0.25 * (t - j) for j in keys])
        weights = np.exp(weights - weights.max())
        weights /= weights.sum()
        z = e[t] + sum(w * (e[j] @ p["V"]) for w, j in zip(weights, keys)) @ p["O"]
        z = z + np.maximum(z @ p["W1"] + p["b1"], 0) @ p["W2"]
        logits = z @ p["U"] + p["c"]
        total += (logits[wanted] - logits.max() - math.log(np.exp(logits - logits.max()).sum())) / math.log(10)
    return total


def test_score_equals_a_loop_over_words(spark, monkeypatch):
    rng = random.Random(3)
    some = ["the", "of", "house", "Haus", "unbelievably", "ha-ha", "x1", "straße", "and", "zzqqk"]
    texts = {i: " ".join(rng.choices(some, range(10, 0, -1), k=n)) for i, n in enumerate([50, 5, 0, 33, 16, 15, 32, 1, 90, 12, 40, 7])}
    texts[2] = None
    held = {}
    train = lm_scoring.trained

    def kept(rows, words, known, share):
        p = {k: v * 3 if k in "QKVOU" else v for k, v in train(rows, words, known, share).items()}
        held.update(p=p, known=known.value)
        return p

    monkeypatch.setattr(lm_scoring, "trained", kept)
    rows = lm_scoring.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), WORDS).collect()
    words = {i: (t or "").lower().split() for i, t in texts.items()}
    training = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    counts = collections.Counter(w for i in training for w in words[i])
    coder = lm_scoring.Coder(WORDS)
    code = {w: int(held["known"].codes(coder.encoded([w.encode()]).astype(np.int64))[0]) for w in {w for ws in words.values() for w in ws}}
    size, kinds = collections.Counter({attention.END: len(training)}), collections.Counter({attention.END: 1})
    for w, n in counts.items():
        size[code[w] >> 32] += n
        kinds[code[w] >> 32] += 1
    assert {r["doc_id"] for r in rows} == set(texts) and len(training) < len(texts)
    for r in rows:
        own = [code[w] for w in words[r["doc_id"]]]
        inside = [(counts[w] + 1, c >> 32) for w, c in zip(words[r["doc_id"]], own)] + [(len(training) + 1, attention.END)]
        wanted = log10_of_text(held["p"], own) + sum(math.log10(c / (size[k] + kinds[k] + 1)) for c, k in inside)
        assert math.isclose(r["score"], wanted, rel_tol=1e-4), (r, wanted)
