"""The language model on subword ids: every id of every word is a position, and scores equal a plain loop over them."""

import collections
import math
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from factorweave.llm import lm_scoring

from test_lm_score import WORDS, log10_of_text


def positions(tokenizer, text):
    """(id, whether it ends its word) of each subword id of a text."""
    out = []
    for w in text.lower().split():
        ids = tokenizer.encode(w, add_special_tokens=False).ids
        out += [(i, k == len(ids) - 1) for k, i in enumerate(ids)]
    return out


def test_packed_positions_come_back():
    rng = np.random.default_rng(1)
    for n in range(40):
        ids, final = rng.integers(0, 1 << 16, n), rng.random(n) < 0.5
        assert lm_scoring.unpacked(lm_scoring.packed(ids, final)).tolist() == (ids + final * lm_scoring.FINAL).tolist()


def test_score_equals_a_loop_over_subword_ids(spark, monkeypatch):
    rng = random.Random(3)
    some = ["the", "of", "house", "unbelievably", "unbestably", "ha-ha", "x1", "straße", "and", "zzqqk"]
    texts = {i: " ".join(rng.choices(some, range(10, 0, -1), k=n)) for i, n in enumerate([50, 5, 0, 33, 16, 15, 32, 1, 90, 12, 40, 7])}
    texts |= {2: None, 20: "the zzqqk of", 21: "the zzxqk of"}
    held, train = {}, lm_scoring.trained

    def kept_model(rows, words, known, share):
        p = {k: v * 3 if k in "QKVOU" else v for k, v in train(rows, words, known, share).items()}
        held.update(p=p, known=known.value, words=words)
        return p

    monkeypatch.setattr(lm_scoring, "trained", kept_model)
    rows = {r["doc_id"]: r for r in lm_scoring.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), WORDS, subwords=True).collect()}
    tokenizer = Tokenizer.from_file(WORDS)
    own = {i: positions(tokenizer, t or "") for i, t in texts.items()}
    counts = collections.Counter(x for i in texts if zlib.crc32(str(i).encode()) % 7 != 2 for x in own[i])
    assert held["words"] == sum(counts.values())
    code = lambda i, final: int(held["known"].of[i + final * lm_scoring.FINAL])
    size, kinds = collections.Counter(), collections.Counter()
    for i in [*range(tokenizer.get_vocab_size()), lm_scoring.SAME]:
        for final in (False, True):
            size[code(i, final) >> 32] += counts[i, final]
            kinds[code(i, final) >> 32] += 1
    for i in texts:
        codes = [code(*x) for x in own[i]]
        wanted = log10_of_text(held["p"], codes) + sum(math.log10((counts[x] + 1) / (size[c >> 32] + kinds[c >> 32])) for x, c in zip(own[i], codes))
        assert math.isclose(rows[i]["score"], wanted, rel_tol=1e-4), (i, rows[i], wanted)
    for c in kinds:
        assert math.isclose(sum((counts[i, f] + 1) / (size[c] + kinds[c]) for i in [*range(tokenizer.get_vocab_size()), lm_scoring.SAME] for f in (False, True) if code(i, f) >> 32 == c), 1)


def test_a_store_that_starts_anew_spells_the_same():
    rng, speller, tokenizer = random.Random(4), lm_scoring.Speller(WORDS, 6), Tokenizer.from_file(WORDS)
    for _ in range(20):
        words = sorted({rng.choice(["the", "unbelievably", "ha-ha", "x1", "straße", "zzqqk", "of", "1-1"]) for _ in range(4)})
        data, ends = "".join(words).encode(), np.cumsum([len(w.encode()) for w in words])
        hashes = np.array([int.from_bytes((w.encode() + bytes(3))[:3], "big") for w in words], np.uint64)
        ids, _ = speller.spelt(*speller.places(hashes, np.concatenate([[0], ends[:-1]]), ends, data))
        assert ids.tolist() == [i for w in words for i in tokenizer.encode(w, add_special_tokens=False).ids] and len(speller.hashes) <= 6


def test_ids_inside_words_count():
    """Words with equal ends were one to the model whatever stood between."""
    speller, coder = lm_scoring.Speller(WORDS), lm_scoring.Coder(WORDS)
    by_ends = collections.defaultdict(set)
    for w in [f"zz{a}{b}qqk".encode() for a in "abcdefgh" for b in "xyzw"]:
        by_ends[int(coder.encoded([w])[0])].add(w)
    one, other = next(sorted(x)[:2] for x in by_ends.values() if len(x) > 1)
    data = one + other
    starts, sizes = speller.places(np.array([1, 2], np.uint64), np.array([0, len(one)]), np.array([len(one), len(data)]), data)
    ids, final = speller.spelt(starts, sizes)
    assert ids[: sizes[0]].tolist() != ids[sizes[0] :].tolist() and np.flatnonzero(final).tolist() == [sizes[0] - 1, sizes.sum() - 1]
    assert ids.tolist() == [i for w in (one, other) for i in Tokenizer.from_file(WORDS).encode(w.decode(), add_special_tokens=False).ids]
