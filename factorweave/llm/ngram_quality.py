"""Quality rules with an n-gram perplexity band.

A modified Kneser-Ney model over characters, one per language, is counted by Spark over all
documents. Languages are the values of ``lang``; rows without one, and languages of fewer than
LEAST_DOCS rows, share a model and a band, as so few rows give neither. Every character counts as
itself: the symbols of a text are its UTF-16 units, one for a character and two beyond U+FFFF, and the
hash of an n-gram of order 4 is its units side by side, 64 bits, so no two n-grams share one. A model
holds every n-gram of its language's texts and grows with them. It is broadcast as sorted hash arrays
with their probabilities and searched by bisection. The same code also takes the alphabet CLASSED of 64
classes of characters, which is small enough to try every n-gram.

Perplexity is taken per word that holds a letter: minus the log10 probability of the whole text, over
those words. Whatever stands between words or hangs on them is so paid for by the words, and a text of
symbols does not look predictable because its symbols repeat. A document is kept if the base rules
pass and its log10 perplexity lies inside its language's band, ``median +- width * scale``, where the
scale is the larger of a floor and 1.4826 times the median absolute deviation on that side, over that
language's documents that pass the base rules. The upper limit rejects gibberish, tables and symbol
soup, the lower one text that strings a few forms together.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, checkpointed, groups_by_bytes, text_bytes, unboxed
from .textkit import hashed_words, windows

ORDER = 4
BOUNDARY, SPACE, DIGIT, CAPITAL, LETTER_A, SYMBOLS_FROM, OTHER = 0, 1, 2, 3, 4, 30, 62
ASCII_SYMBOLS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())
#: Languages of so many rows have a model and a band of their own; all other rows share the pool REST.
LEAST_DOCS, REST = 10, ""
#: n-grams of a pool that a task holds before it adds them up, and before it hands them on.
HELD, HANDED = 1 << 22, 1 << 22
#: Band: so many robust deviations below and above the median, and the least deviation counted.
WIDTH_LOW, WIDTH_HIGH, LEAST_SCALE = 6.0, 8.0, 0.01
MIN_WORDS = 50
SYMBOLS = b"#*$%&|<>"
WHITE_OR_CONTINUATION = bytes([9, 10, 11, 12, 13, 32, *range(0x80, 0xC0)])


def class_table(size: int = 0x3000) -> np.ndarray:
    """The class of each code point below size, made from the Unicode database."""
    table = np.full(size, OTHER, np.int32)
    for cp in range(size):
        c = chr(cp)
        kind, base = unicodedata.category(c), unicodedata.normalize("NFD", c)[0].lower()
        if c == "\n":
            table[cp] = BOUNDARY
        elif c.isspace():
            table[cp] = SPACE
        elif kind[0] == "N":
            table[cp] = DIGIT
        elif kind in ("Lu", "Lt"):
            table[cp] = CAPITAL
        elif kind[0] in "LM":
            table[cp] = LETTER_A + (ord(base) - 97 if "a" <= base <= "z" else cp % 26)
        elif c in ASCII_SYMBOLS:
            table[cp] = SYMBOLS_FROM + ASCII_SYMBOLS.index(c)
    return table


TABLE = class_table()


def classes(text: str) -> np.ndarray:
    """The classes of a text's characters; beyond the table, letters by code point modulo 26."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    if len(points) and points.max() >= len(TABLE):
        return np.where(points < len(TABLE), TABLE[np.minimum(points, len(TABLE) - 1)], LETTER_A + points % 26).astype(np.int32)
    return TABLE[points]


def units(text: str) -> np.ndarray:
    """A text's UTF-16 units."""
    return np.frombuffer(text.encode("utf-16-le", "replace"), "<u2")


class Alphabet(NamedTuple):
    """The symbols of an n-gram model: how many bits one takes, those of a text, and the class of each by its number."""

    bits: int
    symbols: Callable[[str], np.ndarray]
    kinds: np.ndarray


CLASSED = Alphabet(6, classes, np.arange(64, dtype=np.int32))
#: Beyond the table all units are letters, as in classes().
UNITS = Alphabet(16, units, np.concatenate([TABLE, np.full((1 << 16) - len(TABLE), LETTER_A, np.int32)]))


def key_type(bits: int) -> type:
    return np.int32 if bits < 31 else np.int64


def gram_keys(texts: list[bytes | None], order: int = ORDER, alphabet: Alphabet = CLASSED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts: the hash of the n-gram that ends at each symbol and at one boundary after the text; each text's first hash (one more at the end); its words with a letter.

    Boundaries stand before each text.
    """
    if order * alphabet.bits > 64:
        raise ValueError(f"{order} symbols of {alphabet.bits} bits do not fit into 64 bits")
    whole = [(t or b"").decode("utf-8", "replace") for t in texts]
    gap = "\n" * (order - 1)
    symbols = alphabet.symbols(gap + gap.join(whole) + gap) if order > 1 else alphabet.symbols("\n".join(whole) + "\n")
    key = np.zeros(len(symbols) - max(order - 1, 0), key_type(order * alphabet.bits))
    for k in range(order):
        key <<= alphabet.bits
        key |= symbols[k : k + len(key)]
    sizes = np.array([len(alphabet.symbols(t)) + 1 for t in whole], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes + max(order - 2, 0))[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    first = np.concatenate([[0], np.cumsum(sizes)])
    at = np.repeat(begins - first[:-1], sizes) + np.arange(first[-1])
    own = alphabet.kinds.take(symbols[max(order - 1, 0) :][at])  # of each text's symbols and its end
    letter, word = (own >= CAPITAL) & (own < SYMBOLS_FROM), np.cumsum(own <= SPACE)
    seen = word[letter]
    new = np.concatenate([seen[:1] >= 0, seen[1:] != seen[:-1]])  # the first letter of each word: ends part texts
    counts = np.diff(np.searchsorted(np.flatnonzero(letter)[new], first))
    return key[at], first, counts


def languages(docs: DataFrame) -> frozenset[str]:
    """The languages with a pool of their own."""
    seen = docs.select(F.col("lang").cast("string").alias("lang")).where("lang <> ''").groupBy("lang").count()
    return frozenset(r["lang"] for r in seen.where(F.col("count") >= LEAST_DOCS).collect())


def rows_of(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *more, F.col("lang").cast("string").alias("lang"), text_bytes().alias("text"))


def by_pool(part: pa.RecordBatch, own: frozenset[str]) -> dict[str, list[int]]:
    """The places of a batch's rows by their pool."""
    out: dict[str, list[int]] = {}
    for i, lang in enumerate(part.column("lang").to_pylist()):
        out.setdefault(lang if lang in own else REST, []).append(i)
    return out


def summed(keys: list[np.ndarray], times: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, at = np.unique(np.concatenate(keys), return_inverse=True)
    return found, np.bincount(at, np.concatenate(times)).astype(np.int64)


def count_grams(docs: DataFrame, order: int = ORDER, own: frozenset[str] | None = None, alphabet: Alphabet = CLASSED) -> DataFrame:
    """Rows (pool, gram, n): how often each n-gram of the highest order occurs, over all documents."""
    own = languages(docs) if own is None else own

    def counted(p: str, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([p] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["pool", "gram", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[list, list]] = {}
        size = 0
        for part in groups_by_bytes(batches, "text"):
            texts = part.column("text").to_pylist()
            for p, at in by_pool(part, own).items():
                keys, n = np.unique(gram_keys([texts[i] for i in at], order, alphabet)[0], return_counts=True)
                lists = held.setdefault(p, ([], []))
                lists[0].append(keys)
                lists[1].append(n)
                size += len(keys)
            if size > HELD:
                held = {p: tuple([x] for x in summed(*lists)) for p, lists in held.items()}
                size = sum(len(lists[0][0]) for lists in held.values())
                if size > HANDED:
                    yield from (counted(p, *summed(*lists)) for p, lists in held.items())
                    held, size = {}, 0
        yield from (counted(p, *summed(*lists)) for p, lists in held.items())

    return rows_of(docs).mapInArrow(count, "pool string, gram long, n long").groupBy("pool", "gram").agg(F.sum("n").alias("n"))


def counts_by_order(grams: DataFrame, order: int = ORDER, bits: int = CLASSED.bits) -> DataFrame:
    """Rows (pool, k, gram, n): counts of order k; below the highest, in how many contexts an n-gram continues."""
    found, level = [grams.withColumn("k", F.lit(order))], grams
    for k in range(order - 1, 0, -1):
        level = level.groupBy("pool", F.col("gram").bitwiseAND(F.lit((1 << bits * k) - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n"))
        found.append(level.withColumn("k", F.lit(k)))
    columns = ["pool", "k", "gram", "n"]
    out = found[0].select(columns)
    for x in found[1:]:
        out = out.unionByName(x.select(columns))
    return out


def model_table(counts: DataFrame, bits: int = CLASSED.bits) -> DataFrame:
    """Rows (pool, k, gram, share, backoff): a discounted share for each n-gram and, for each context, the weight of the lower order.

    Modified Kneser-Ney: discounts D1, D2, D3+ from the counts of counts of each order, with the
    usual fallback where a count of counts is zero.
    """
    times = [F.sum((F.col("n") == i).cast("long")).alias(f"t{i}") for i in (1, 2, 3, 4)]
    discounts = counts.groupBy("pool", "k").agg(*times)
    y = F.coalesce(F.try_divide(F.col("t1"), F.col("t1") + 2 * F.col("t2")), F.lit(0.5))

    def discount(i: int):
        d = F.coalesce(i - (i + 1) * y * F.try_divide(F.col(f"t{i + 1}"), F.col(f"t{i}")), F.lit(0.5 * i))
        return F.greatest(F.lit(0.1), F.least(d, F.lit(i - 0.1))).alias(f"d{i}")

    discounts = F.broadcast(discounts.select("pool", "k", *map(discount, (1, 2, 3))))
    rows = counts.join(discounts, ["pool", "k"]).withColumn("context", F.shiftrightunsigned("gram", bits))
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    totals = rows.groupBy("pool", "k", "context").agg(F.sum("n").alias("total"), F.sum(cut).alias("freed"))
    return rows.join(totals, ["pool", "k", "context"]).select(
        "pool", "k", "gram", ((F.col("n") - cut) / F.col("total")).alias("share"), (F.col("freed") / F.col("total")).alias("backoff")
    )


class Model:
    """Per pool and order, sorted arrays of n-gram hashes and of contexts, with probabilities and back-off weights as log10."""

    def __init__(self, table: pa.Table, order: int = ORDER, bits: int = CLASSED.bits):
        self.order, self.bits, self.pools = order, bits, {}
        pools = table.column("pool").combine_chunks().dictionary_encode()
        names, of, ks = pools.dictionary.to_pylist(), pools.indices.to_numpy(), table.column("k").to_numpy()
        grams, shares, backoffs = (table.column(c).to_numpy() for c in ("gram", "share", "backoff"))
        for number, p in sorted(enumerate(names), key=lambda x: x[1]):
            lower_keys, lower, levels = np.zeros(1, np.int64), np.array([0.5**bits]), []
            for k in range(1, order + 1):
                own = np.flatnonzero((of == number) & (ks == k))
                own = own[np.argsort(grams[own])]
                keys, share, backoff = grams[own], shares[own], backoffs[own]
                below = lower[np.searchsorted(lower_keys, self.shorter(keys, k))] if k > 1 else lower[0]
                contexts, at = np.unique(self.context(keys), return_index=True)
                lower_keys, lower = keys, share + backoff * below
                levels.append((keys.astype(key_type(bits * k)), np.log10(lower), contexts.astype(key_type(bits * k)), np.log10(backoff[at])))
            self.pools[p] = levels

    def context(self, keys: np.ndarray) -> np.ndarray:
        """The hashes of n-grams without their last symbols."""
        return keys >> self.bits & (1 << 64 - self.bits) - 1 if keys.dtype == np.int64 else keys >> self.bits

    def shorter(self, keys: np.ndarray, k: int) -> np.ndarray:
        """The hashes of n-grams of order k without their first symbols."""
        return keys & (1 << self.bits * (k - 1)) - 1

    def log10(self, p: str, keys: np.ndarray) -> np.ndarray:
        """log10 probability of the last symbol of each n-gram given those before it; unseen n-grams back off."""
        value, left, part = np.zeros(len(keys)), np.arange(len(keys)), keys
        for k in range(self.order if p in self.pools else 0, 0, -1):
            grams, prob, contexts, backoff = self.pools[p][k - 1]
            at = np.minimum(np.searchsorted(grams, part), len(grams) - 1)
            known = grams[at] == part
            value[left[known]] += prob[at[known]]
            left, part = left[~known], part[~known]
            if not len(left):
                return value
            context = self.context(part)
            c = np.minimum(np.searchsorted(contexts, context), len(contexts) - 1)
            value[left] += np.where(contexts[c] == context, backoff[c], 0.0)
            part = self.shorter(part, k)
        value[left] -= self.bits * np.log10(2)
        return value


def repeated(texts: list[bytes | None], width: int = 3) -> np.ndarray:
    """For each text, the words that lie in windows of ``width`` words found twice or more in that text."""
    words, bounds = hashed_words(texts)
    hashes, owner = windows(words, bounds, width)
    out = np.zeros(len(texts), np.int64)
    if not len(hashes):
        return out
    order = np.lexsort((hashes, owner))
    same = (hashes[order][1:] == hashes[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(hashes), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    inside = bounds[owner] + np.arange(len(hashes)) - np.searchsorted(owner, owner)  # each window's first word
    steps = np.zeros(len(words) + width + 1, np.int64)
    np.add.at(steps, inside[twice], 1)
    np.add.at(steps, inside[twice] + width, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(steps)[: len(words)] > 0)])
    return covered[bounds[1:]] - covered[bounds[:-1]]


BASE = "doc_id long, key long, band string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_lettered long, log10_prob double"


def score(docs: DataFrame, model: Model, own: frozenset[str], alphabet: Alphabet = CLASSED) -> DataFrame:
    """One row per row of docs with its key, its pool as band, the base figures and the log10 probability of its whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in groups_by_bytes(batches, "text", 1 << 21):
            texts = [t or b"" for t in part.column("text").to_pylist()]
            again, out = repeated(texts), []
            bands, lettered, logs = [REST] * len(texts), np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for p, at in by_pool(part, own).items():
                keys, first, n = gram_keys([texts[i] for i in at], model.order, alphabet)
                sums = np.concatenate([[0.0], np.cumsum(model.log10(p, keys))])
                lettered[at], logs[at] = n, sums[first[1:]] - sums[first[:-1]]
                for i in at:
                    bands[i] = p
            for text, n_repeat in zip(texts, again.tolist()):
                lines = [x for x in text.split(b"\n") if x.strip()]
                n_words = len(text.split())
                out.append((
                    n_words, len(text.translate(None, WHITE_OR_CONTINUATION)), len(text) - len(text.translate(None, SYMBOLS)),
                    len(lines) - len(set(lines)), n_repeat, n_words < MIN_WORDS or 100 * n_repeat > 50 * n_words,
                ))
            kinds = [pa.int64()] * 5 + [pa.bool_()]
            arrays = [pa.array(c, t) for c, t in zip(zip(*out), kinds)]
            names = [x.split()[0] for x in BASE.split(", ")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(bands, pa.string()), *arrays, pa.array(lettered), pa.array(logs)], names)

    return rows_of(docs.withColumn("key", own_key()), "key").mapInArrow(run, BASE)


def own_key():
    """What the verdict on a row depends on, and its id, as a 64-bit hash."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.col("lang").cast("string"), text_bytes())


def judged(docs: DataFrame, order: int, width_low: float, width_high: float, alphabet: Alphabet = CLASSED) -> DataFrame:
    """The rows of score() with log10_ppl, its band's lower and upper, and kept."""
    own = languages(docs)
    counts = checkpointed(counts_by_order(checkpointed(count_grams(docs, order, own, alphabet)), order, alphabet.bits))
    model = Model(model_table(counts, alphabet.bits).toArrow(), order, alphabet.bits)
    figure = -F.col("log10_prob") / F.greatest("n_lettered", F.lit(1))
    scored = checkpointed(score(docs, model, own, alphabet).withColumn("log10_ppl", figure))
    passed = scored.where(~F.col("base_failed"))
    middle = passed.groupBy("band").agg(F.percentile_approx("log10_ppl", 0.5).alias("middle"))
    apart = passed.join(F.broadcast(middle), "band").withColumn("apart", F.col("log10_ppl") - F.col("middle"))
    side = lambda sign: F.greatest(F.lit(LEAST_SCALE), 1.4826 * F.percentile_approx(F.when(sign * F.col("apart") >= 0, F.abs("apart")), 0.5))
    bands = apart.groupBy("band", "middle").agg(side(-1).alias("below"), side(1).alias("above"))
    bands = bands.select("band", (F.col("middle") - width_low * F.col("below")).alias("lower"), (F.col("middle") + width_high * F.col("above")).alias("upper"))
    inside = F.col("log10_ppl").between(F.col("lower"), F.col("upper"))
    return scored.join(F.broadcast(bands), "band", "left").withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True)))


def quality_report(docs: DataFrame, order: int = ORDER, width_low: float = WIDTH_LOW, width_high: float = WIDTH_HIGH) -> DataFrame:
    """One row per row of docs: doc_id, the base figures, base_failed, kept, and log10 perplexity with its band.

    A null or empty text has no words, so it fails the base rules; its perplexity is that of one
    boundary. A null or empty language, or one of fewer than LEAST_DOCS rows, belongs to the pool REST.
    Repeated rows are judged one by one. Columns other than doc_id, lang and text are not read. An empty
    table gives an empty result. Counting covers every document; the driver holds the models, which have a
    row for every n-gram of any order. The order is 4 at most.
    """
    return judged(docs, order, width_low, width_high, UNITS).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.col("log10_ppl").alias("log10_perplexity"), F.col("lower").alias("log10_lower"), F.col("upper").alias("log10_upper"),
    )


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns.

    Rows are told apart by id, language and text, through a 64-bit hash; a null id is an id like any
    other, and all of the rows that repeat all three stay or go together.
    """
    kept = judged(docs, ORDER, WIDTH_LOW, WIDTH_HIGH, UNITS).where("kept").select(F.col("key").alias("own")).distinct()
    rows = boxed(docs, key=own_key())
    return unboxed(rows.join(kept, rows["key"] == kept["own"], "left_semi"), docs.columns)
