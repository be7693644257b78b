"""The quality rules tell all characters apart; the model over UTF-16 units against brute force."""

import collections
import math
import random

import numpy as np

from factorweave.llm import ngram_quality

SCHEMA = "doc_id long, text string, lang string"


def brute(texts, order):
    """log10 probability of each text's units and end under modified Kneser-Ney trained on texts."""
    split = lambda t: [t.encode("utf-16-le")[i : i + 2] for i in range(0, len(t.encode("utf-16-le")), 2)]
    edge = "\n".encode("utf-16-le")
    padded = [(*[edge] * (order - 1), *split(t), edge) for t in texts]
    counts = {order: collections.Counter(s[i : i + order] for s in padded for i in range(len(s) - order + 1))}
    for k in range(order - 1, 0, -1):
        counts[k] = collections.Counter(g[1:] for g in counts[k + 1])
    discount = {}
    for k, c in counts.items():
        t = collections.Counter(c.values())
        y = t[1] / (t[1] + 2 * t[2]) if t[1] + 2 * t[2] else 0.5
        discount[k] = [max(0.1, min(i - 0.1, i - (i + 1) * y * t[i + 1] / t[i] if t[i] else 0.5 * i)) for i in (1, 2, 3)]

    def prob(gram):
        k = len(gram)
        if not k:
            return 1 / 65536
        seen = {g: n for g, n in counts[k].items() if g[:-1] == gram[:-1]}
        if not seen:
            return prob(gram[1:])
        cut = lambda n: discount[k][min(n, 3) - 1]
        total = sum(seen.values())
        own = (seen[gram] - cut(seen[gram])) / total if gram in seen else 0
        return own + sum(map(cut, seen.values())) / total * prob(gram[1:])

    return [sum(math.log10(prob(s[i : i + order])) for i in range(len(s) - order + 1)) for s in padded]


def test_perplexity_over_characters_equals_brute_force(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices("abcA DÉé#|\n78;жЖ漢字𝒳\uffee豈", k=rng.randint(0, 60))) for _ in range(12)] + ["", "ab ab ab"]
    rows = ngram_quality.quality_report(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], SCHEMA)).collect()
    for r, t, wanted in zip(sorted(rows, key=lambda r: r["doc_id"]), texts, brute(texts, 4)):
        kinds = [ngram_quality.UNITS.kinds[ngram_quality.units(w)] for w in t.split()]
        lettered = sum(any((k >= 3) & (k < 30)) for k in kinds)
        assert math.isclose(r["log10_perplexity"], -wanted / max(1, lettered), rel_tol=1e-9), t


def test_no_two_characters_are_one():
    """Of 64 classes, these texts were the same to the model: letters 26 code points apart, all capitals, all digits."""
    for a, b in (("о", "ш"), ("A", "Q"), ("3", "8"), ("e", "é"), ("漢", chr(ord("漢") + 26)), ("—", "…"), ("𝒳", "😀")):
        one, other = (ngram_quality.gram_keys([x.encode()], 4, ngram_quality.UNITS)[0] for x in (a, b))
        assert not np.array_equal(one, other), (a, b)


def test_letters_of_other_scripts_in_a_wrong_order_are_rejected(spark):
    """Letters of three texts are swapped with those 26 code points away, which the classes could not see."""
    rng = random.Random(6)
    words = ["".join(chr(0x4E00 + rng.randrange(52)) for _ in range(rng.randint(2, 5))) for _ in range(60)]
    texts = [" ".join(rng.choices(words, k=120)) for _ in range(80)]
    swapped = ["".join(c if c == " " or rng.random() < 0.5 else chr((ord(c) - 0x4E00 + 26) % 52 + 0x4E00) for c in t) for t in texts[:3]]
    assert all(np.array_equal(ngram_quality.classes(a), ngram_quality.classes(b)) for a, b in zip(texts, swapped))
    rows = ngram_quality.quality_report(spark.createDataFrame([(i, t, "zh") for i, t in enumerate(texts[3:] + swapped)], SCHEMA)).collect()
    kept = {r["doc_id"]: r["kept"] for r in rows if not r["base_failed"]}
    assert len(kept) == 80 and sum(kept[i] for i in range(77)) >= 75 and not any(kept[i] for i in range(77, 80))
