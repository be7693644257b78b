"""Best-fit packing by minimum bin slack.

Documents become token ids, long ones are cut, and the pieces are packed into sequences of at most
``size`` tokens. Only lengths decide a packing, so the search works on the histogram of lengths,
which has at most ``size`` entries however many documents there are, and that is all the driver
sees. For each bin the longest length left is placed, then a bitset subset-sum program over the
lengths left (bit s of the set: some combination has sum s) finds the fullest combination for the
rest. The same combination is taken as often as the histogram allows, so one search serves many
equal bins. Spark then ranks the pieces of each length and looks up their bin and place.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, groups_by_bytes, text_bytes
from .textkit import LOWERED

SIZE = 4096
END_ID = 1
#: Words whose ids a Python worker keeps; beyond it the store starts anew, so memory stays bounded.
WORDS_KEPT = 400_000
#: Pieces of one length are ranked in shares of so many at least, and of so many that the table of shares has at most SHARES rows more than there are lengths.
LEAST_RANKED, SHARES = 1000, 10_000

Run = tuple[list[tuple[int, int]], int]


def shown_bytes() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable Latin-1 characters as they are, the others from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(256 + i) for i, b in enumerate(others)}


SHOWN = shown_bytes()


class WordIds:
    """Token ids of texts, as little-endian 32-bit bytes, encoding each different word once.

    That needs a vocabulary whose rules fold A-Z, never join text across ASCII white space, and
    always part a letter from punctuation that follows. Then a text's ids are those of its
    white-space separated words in lower case, and a word's those of its stem and of its trailing
    punctuation; tests compare this with whole texts. A text that may spell a special token is not
    folded. Whether a vocabulary is like that is tried on PROBES; texts under any other are encoded
    whole.
    """

    TRAILING = b".,;:!?#$%&*+-/=@^_~()[]{}|<>"
    PROBES = ("Ab cD, ef. gh", " x\ty\n\nz  w ", "Word's (note) [a] {b} #1! 2,3.4-5 a-b", "ÀÉ naïve straße", "THE the; end: yes? <no> |x| a/b_c~ d=e@f^g*h&i$j%k+l")

    def __init__(self, path: str, kept: int = WORDS_KEPT):
        from tokenizers import Tokenizer

        self.tokenizer, self.kept, self.ids, self.by_word = Tokenizer.from_file(path), kept, {}, True
        self.parting: dict[str, bool] = {}
        self.by_word = all(self.encode(p.encode()) == self.whole(p.encode()) for p in self.PROBES)

    def whole(self, text: bytes) -> bytes:
        return array("I", self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids).tobytes()

    def learn(self, words: list[bytes]) -> None:
        tokenize, rest = self.tokenizer.model.tokenize, []
        for w in words:
            text = w.decode("utf-8", "replace")
            if text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text):
                # letters only, nothing to normalise: one pre-token, which goes to the model as it is
                self.ids[w] = array("I", [t.id for t in tokenize(w.decode("latin-1").translate(SHOWN))]).tobytes()
            else:
                rest.append((w, text))
        for (w, _), e in zip(rest, self.tokenizer.encode_batch_fast([t for _, t in rest], add_special_tokens=False)):
            self.ids[w] = array("I", e.ids).tobytes()

    def stem(self, word: bytes) -> bytes:
        """The word without trailing punctuation where that parts from it in any case, else the word."""
        out = word.rstrip(self.TRAILING)
        if out == word or not out or b"'" in word or b"<|" in word or not self.parts(out.decode("utf-8", "replace")[-1]):
            return word
        return out

    def parts(self, last: str) -> bool:
        """Whether punctuation parts from a word that ends in this character: a letter that normalising leaves as it is, and does not turn into a letter and a mark."""
        if last not in self.parting:
            normaliser = self.tokenizer.normalizer
            self.parting[last] = last.isalpha() and (normaliser is None or normaliser.normalize_str(last) == last)
        return self.parting[last]

    def encode(self, text: bytes) -> bytes:
        if not self.by_word:
            return self.whole(text)
        return b"".join(self.words((text if b"<|" in text else text.translate(LOWERED)).split()))

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of some words in lower case."""
        if not self.by_word:
            return list(map(self.whole, words))
        new = {w for w in words if w not in self.ids}
        if new:
            if len(self.ids) > self.kept:
                self.ids.clear()
                new = set(words)
            stems = {w: self.stem(w) for w in new}
            parts = {*stems.values(), *(w[len(x) :] for w, x in stems.items() if x is not w)}
            self.learn([p for p in parts if p and p not in self.ids])
            for w, x in stems.items():
                if w not in self.ids:
                    self.ids[w] = self.ids[x] + self.ids[w[len(x) :]]
        return [self.ids[w] for w in words]


_encoders: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """The encoder of this Python worker."""
    if path not in _encoders:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        _encoders[path] = WordIds(path)
    return _encoders[path]


def token_pieces(docs: DataFrame, vocabulary: str, size: int = SIZE) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32): each document's ids, then END_ID, cut into pieces of ``size``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(vocabulary)
        for part in groups_by_bytes(batches, "text"):
            out = []
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                ids = ids_of.encode(text or b"") + END_ID.to_bytes(4, "little")
                for k, at in enumerate(range(0, len(ids), 4 * size)):
                    piece = ids[at : at + 4 * size]
                    out.append((doc_id, k, at // 4, len(piece) // 4, zlib.crc32(piece)))
            columns = list(zip(*out)) or [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[tuple[int, int]]:
    """Lengths with multiplicities whose sum is the largest possible up to room; longer lengths first.

    lengths is in descending order. sets[i] holds the sums that lengths[:i] can make.
    """
    mask, reach, sets, used = (1 << room + 1) - 1, 1, [1], []
    for n in lengths:
        if n > room:
            continue
        left, step = min(counts[n], room // n), 1
        while left:  # multiplicities by binary splitting
            take = min(step, left)
            reach |= reach << take * n & mask
            left, step = left - take, step * 2
        sets.append(reach)
        used.append(n)
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, []
    for n, before in zip(reversed(used), reversed(sets[:-1])):
        times = 0
        while not before >> total & 1:
            total, times = total - n, times + 1
        if times:
            chosen.append((n, times))
    return chosen[::-1]


def minimum_bin_slack(histogram: dict[int, int], size: int = SIZE) -> list[Run]:
    """Runs of equal bins: (lengths with multiplicities, number of bins). All pieces are packed."""
    counts = {n: c for n, c in histogram.items() if c}
    lengths, runs = sorted(counts, reverse=True), []
    while lengths:
        seed = lengths[0]
        counts[seed] -= 1
        chosen = dict(fullest([n for n in lengths if counts[n]], counts, size - seed))
        counts[seed] += 1
        chosen[seed] = chosen.get(seed, 0) + 1
        bins = min(counts[n] // k for n, k in chosen.items())
        for n, k in chosen.items():
            counts[n] -= bins * k
        runs.append((sorted(chosen.items(), reverse=True), bins))
        lengths = [n for n in lengths if counts[n]]
    return runs


def plan_table(runs: list[Run]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: first ranks of its runs, the run's first bin, its multiplicity there, its offset in the bin."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    seen: dict[int, int] = {}
    first_bin = 0
    for chosen, bins in runs:
        offset = 0
        for n, k in chosen:
            rows.setdefault(n, []).append((seen.get(n, 0), first_bin, k, offset))
            seen[n] = seen.get(n, 0) + bins * k
            offset += n * k
        first_bin += bins
    return {n: tuple(np.array(x, np.int64) for x in zip(*r)) for n, r in rows.items()}


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the single id END_ID. Rows that repeat a doc_id are packed one by one.
    A null doc_id stays null. Columns other than doc_id and text are not read. An empty table gives
    an empty result. The driver holds at most ``size`` histogram entries and the runs made of them;
    tasks get those and at most size + SHARES first ranks.
    """
    spark = docs.sparkSession
    pieces = checkpointed(token_pieces(docs, vocabulary, size))
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    table = spark.sparkContext.broadcast(plan_table(minimum_bin_slack(histogram, size)))
    ranked_at_once = max(LEAST_RANKED, -(-sum(histogram.values()) // SHARES))
    shares = spark.createDataFrame([(n, -(-c // ranked_at_once)) for n, c in histogram.items()] or [(0, 1)], "length long, shares long")
    names = ["doc_id", "piece", "start", "ids_crc32"]
    dealt = pieces.join(F.broadcast(shares), "length").withColumn("share", F.pmod(F.xxhash64(*names), "shares"))
    counts = dealt.groupBy("length", "share").count()
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "share", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    order = Window.partitionBy("length", "share").orderBy(*names)
    ranked = dealt.withColumn("rank", F.row_number().over(order)).join(F.broadcast(bases), ["length", "share"])

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        bins, offsets = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        values = rank.to_numpy()
        for n, at in length.groupby(length).indices.items():
            starts, first_bin, times, offset = table.value[n]
            run = np.searchsorted(starts, values[at], "right") - 1
            inside = values[at] - starts[run]
            bins[at] = first_bin[run] + inside // times[run]
            offsets[at] = offset[run] + inside % times[run] * n
        return pd.DataFrame({"sequence_id": bins, "offset": offsets})

    placed = ranked.withColumn("at", place("length", F.col("base") + F.col("rank") - 1))
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
