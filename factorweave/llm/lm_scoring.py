"""LM scoring: a word unigram base and a causal self-attention model on subword ids.

Both learn from the documents whose crc32(doc_id) mod 7 is not 2, all of them and whole:

- One pass encodes every text and counts the training words; codes are written, so nothing is
  tokenised twice, and texts are read from the table again, so that no copy of them is written. The
  counts give the base model and, through the subword ids of each different word, the classes of the
  attention model.
- The attention model is trained for one epoch in ``PHASES`` phases. A phase takes a share of the
  training documents, dealt to shards and ordered by a hash of id and text, so that the model does not
  depend on how the table is laid out. A shard trains its copy of the model on every block of its
  texts, cut as for scoring; Spark then averages the copies, weighted by the blocks they saw. So each
  word and each text's end is a target exactly once.

With ``subwords`` a position of the model is one subword id and whether it ends its word; every id of
every word is read and predicted, one after another. The probability of a position is that of its
class from the attention model times its share of the class, (c + 1) / (N + V), with the class's own N
and V, its positions in training and all that the vocabulary allows; so all texts' probabilities sum
to one. Otherwise a position is a word, read through its first and last id only.

The model's probability of a word is then that of its class from the attention model times the word's
share of the class, (c + 1) / (N + V + 1) with the class's own N and V.

Scoring goes over the codes of whole texts in blocks of overlapping windows; the base goes over their
words, and both meet by id and hash of the text. Words too rare for the table that tasks hold get
their counts by a join. The broadcast table has at most ``FREQUENT`` words. Words are
told apart by 64-bit hashes, made for a whole batch of texts at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import attention
from .common import groups_by_bytes, memory_kept, text_bytes, written
from .packing import WordIds
from .textkit import LOWERED, hashed_words, located_words

FOLDS, HELD_OUT = 7, 2
#: Words whose counts tasks hold; different words a task counts before it hands its counts on.
FREQUENT, COUNTED = 1 << 18, 1_500_000
#: Words whose codes a Python worker keeps (12 bytes each); beyond it the store starts anew. Words that the tokenizer's own store keeps.
CODED, SPELT = 4_000_000, 20_000
#: Training: phases, words a shard of a phase is meant to hold, blocks a step, Adam's rate; bytes of codes that are cut into blocks at once.
PHASES, SHARD, BATCH, RATE = 4, 1_000_000, 64, 0.01
CUT = 1 << 18
#: Blocks that are scored at once: few enough for a processor's cache.
BLOCKS = 96


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS


def lowered(part: pa.RecordBatch) -> list[bytes]:
    return [(t or b"").translate(LOWERED) for t in part.column("text").to_pylist()]


#: The first id of a longer word whose first and last ids are equal, as those of 1-1 and ha-ha are; no vocabulary may have it.
SAME = 0xFFFF


def word_code(ids: bytes) -> int:
    """First and last of a word's 32-bit ids as one number, first | last << 16; they are equal only if the word is one id."""
    if not ids:
        return SAME | SAME << 16
    first, last = (int.from_bytes(x, "little") for x in (ids[:4], ids[-4:]))
    return (SAME if first == last and len(ids) > 4 else first) | last << 16


class Coder:
    """First and last subword ids of words as one number, each different word encoded once; a bounded store as sorted arrays."""

    def __init__(self, vocabulary: str, kept: int = CODED):
        self.ids_of, self.kept = WordIds(vocabulary, SPELT), kept
        if self.ids_of.tokenizer.get_vocab_size() > SAME:
            raise ValueError(f"{vocabulary} has more than {SAME} ids")
        self.hashes, self.known = np.zeros(0, np.uint64), np.zeros(0, np.uint32)

    def encoded(self, words: list[bytes]) -> np.ndarray:
        return np.array([word_code(x) for x in self.ids_of.words(words)], np.uint32)

    def codes(self, hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray, data: bytes) -> np.ndarray:
        """The codes of different words, given their sorted hashes and places in data."""
        at = np.searchsorted(self.hashes, hashes)
        there = at < len(self.hashes)
        there[there] = self.hashes[at[there]] == hashes[there]
        out, new = np.empty(len(hashes), np.uint32), ~there
        out[there] = self.known[at[there]]
        out[new] = self.encoded([data[b:e] for b, e in zip(begins[new].tolist(), ends[new].tolist())])
        if len(self.hashes) + new.sum() > self.kept:
            self.hashes, self.known = hashes, out
        else:
            self.hashes, self.known = np.insert(self.hashes, at[new], hashes[new]), np.insert(self.known, at[new], out[new])
        return out


_coders: dict[str, Coder] = {}


def coder_of(vocabulary: str) -> Coder:
    """The coder of this Python worker."""
    if vocabulary not in _coders:
        _coders[vocabulary] = Coder(vocabulary)
    return _coders[vocabulary]


class Speller:
    """Subword ids of words, each different word encoded once; a bounded store as sorted arrays."""

    def __init__(self, vocabulary: str, kept: int = CODED):
        self.ids_of, self.kept = coder_of(vocabulary).ids_of, kept
        self.hashes, self.starts, self.sizes, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint16)

    def places(self, hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Where in the pool the ids of different words start and how many they are, given the words' sorted hashes and places in data. A word without any has SAME."""
        if len(self.hashes) + len(hashes) > self.kept:
            self.hashes, self.starts, self.sizes, self.pool = self.hashes[:0], self.starts[:0], self.sizes[:0], self.pool[:0]
        at = np.searchsorted(self.hashes, hashes)
        new = at == len(self.hashes)
        new[~new] = self.hashes[at[~new]] != hashes[~new]
        words = [x or SAME.to_bytes(4, "little") for x in self.ids_of.words([data[b:e] for b, e in zip(begins[new].tolist(), ends[new].tolist())])]
        sizes = np.array([len(x) // 4 for x in words], np.int64)
        starts = len(self.pool) + np.cumsum(sizes) - sizes
        self.pool = np.concatenate([self.pool, np.frombuffer(b"".join(words), "<u4").astype(np.uint16)])
        self.hashes, self.starts, self.sizes = (np.insert(a, at[new], b) for a, b in ((self.hashes, hashes[new]), (self.starts, starts), (self.sizes, sizes)))
        at = np.searchsorted(self.hashes, hashes)
        return self.starts[at], self.sizes[at]

    def spelt(self, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words at these places, one word after another, and whether each id ends its word."""
        behind = np.cumsum(sizes)
        final = np.zeros(behind[-1] if len(behind) else 0, bool)
        final[behind - 1] = True
        return self.pool[np.repeat(starts - behind + sizes, sizes) + np.arange(len(final))], final


_spellers: dict[str, Speller] = {}


def speller_of(vocabulary: str) -> Speller:
    """The speller of this Python worker."""
    if vocabulary not in _spellers:
        _spellers[vocabulary] = Speller(vocabulary)
    return _spellers[vocabulary]


#: Positions of the model on subword ids are numbered id + FINAL if the id ends its word, id if not.
FINAL = 1 << 16


def packed(ids: np.ndarray, final: np.ndarray) -> bytes:
    """17 bits for each position."""
    return ids.astype("<u2").tobytes() + np.packbits(final).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """Position numbers."""
    n = 8 * len(data) // 17
    return np.frombuffer(data, "<u2", n).astype(np.int64) + np.unpackbits(np.frombuffer(data, np.uint8, offset=2 * n), count=n).astype(np.int64) * FINAL


class Subwords(attention.Vocabulary):
    """Classes of positions that are subword ids: one that ends its word stands as a word of one id, another as a word that begins with SAME."""

    def __init__(self, n: np.ndarray, size: int):
        """How often each position number occurs in the training texts, and how many ids the vocabulary has."""
        inside, final = n[:FINAL], n[FINAL:]
        read = inside + 2 * final
        read[SAME] += inside.sum()
        super().__init__(read, final, inside)
        ids = np.arange(FINAL)
        self.of = np.concatenate([self.codes(SAME | ids << 16), self.codes(ids | ids << 16)])
        allowed = np.tile((ids < size) | (ids == SAME), 2)
        self.n_in, self.kinds_in = (np.bincount(self.of >> 32, x, attention.OUTPUTS) for x in (n, allowed))
        self.logs = np.log10(n + 1) - np.log10(np.maximum(self.n_in + self.kinds_in, 1))[self.of >> 32]


class Counted:
    """Counts of words by hash, with their codes, that a task adds up."""

    def __init__(self):
        self.parts, self.size = [], 0

    def add(self, hashes: np.ndarray, codes: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((hashes, codes, n))
        self.size += len(hashes)
        if self.size > COUNTED and len(self.parts) > 1:
            self.parts = [self.total()]
            self.size = len(self.parts[0][0])

    def total(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes, codes, n = (np.concatenate(x) for x in zip(*self.parts))
        found, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        return found, codes[first], np.bincount(of, n, len(found)).astype(np.int64)


CODES = "doc_id long, key long, training boolean, codes binary, word long, code long, n long"


def keyed(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, key, text); doc_id and key, a hash of id and text, tell rows with other ids or texts apart."""
    doc_id = F.col("doc_id").cast("long")
    return docs.select(doc_id.alias("doc_id"), F.xxhash64(doc_id, text_bytes()).alias("key"), text_bytes().alias("text"))


def coded(docs: DataFrame, vocabulary: str, subwords: bool = False) -> DataFrame:
    """A row for each row of docs with its words' codes, and rows (word, code, n) of the training words that a task has counted; word is a hash.

    With subwords, codes are the packed positions, and rows (code, n) without a word count them.
    """
    rows = keyed(docs).select("doc_id", "key", (fold(F.col("doc_id")) != HELD_OUT).alias("training"), "text")
    names = [x.split()[0] for x in CODES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_kept()
        coder, counted, positions = coder_of(vocabulary), Counted(), np.zeros(2 * FINAL, np.int64)
        speller = speller_of(vocabulary) if subwords else None

        def out() -> pa.RecordBatch:
            hashes, codes, n = counted.total()
            none = [pa.nulls(len(n), t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.binary())]
            return pa.RecordBatch.from_arrays([*none, pa.array(hashes.view(np.int64)), pa.array(codes.astype(np.int64)), pa.array(n)], names)

        for part in groups_by_bytes(batches, "text"):
            hashes, begins, ends, bounds, data = located_words(lowered(part))
            found, first, of = np.unique(hashes, return_index=True, return_inverse=True)
            learnt = part.column("training").to_numpy(zero_copy_only=False)
            training = np.repeat(learnt, np.diff(bounds))
            if speller:
                own = np.zeros(len(found), np.uint32)
                starts, sizes = speller.places(found, begins[first], ends[first], data)
                ids, final = speller.spelt(starts[of], sizes[of])
                places = np.concatenate([[0], np.cumsum(sizes[of])])[bounds]
                each = [packed(ids[a:b], final[a:b]) for a, b in zip(places, places[1:])]
                seen = np.repeat(learnt, np.diff(places))
                positions += np.bincount(ids[seen].astype(np.int64) + final[seen] * FINAL, minlength=2 * FINAL)
            else:
                own = coder.codes(found, begins[first], ends[first], data)
                codes = own[of]
                each = [codes[a:b].tobytes() for a, b in zip(bounds, bounds[1:])]
            counted.add(found, own, np.bincount(of[training], minlength=len(found)))
            none = [pa.nulls(part.num_rows, pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:3]), pa.array(each, pa.binary()), *none], names)
            if counted.size > COUNTED:
                yield out()
                counted = Counted()
        if counted.parts:
            yield out()
        at = np.flatnonzero(positions)
        none = [pa.nulls(len(at), t) for t in (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64())]
        yield pa.RecordBatch.from_arrays([*none, pa.array(at), pa.array(positions[at])], names)

    return rows.mapInArrow(run, CODES)


def array_of(rows, value: str, size: int) -> np.ndarray:
    out = np.zeros(size)
    for r in rows:
        out[r["id"]] = r[value]
    return out


def classes_from(counts: DataFrame) -> attention.Vocabulary:
    """The classes, from the counts of subword ids over the training words; the driver gets a row for each id, of which there are 65,536 at most."""
    first, last = F.col("code").bitwiseAND(0xFFFF), F.shiftright("code", 16)
    read = counts.select(F.explode(F.array(first, last)).alias("id"), "n").groupBy("id").agg(F.sum("n").alias("read")).collect()
    ends = counts.groupBy(last.alias("id")).agg(F.sum(F.when(first == last, F.col("n"))).alias("alone"), F.sum(F.when(first != last, F.col("n"))).alias("last")).collect()
    ids = attention.Vocabulary.IDS
    return attention.Vocabulary(array_of(read, "read", ids), *(np.nan_to_num(array_of(ends, c, ids)) for c in ("alone", "last")))


def class_counts(counts: DataFrame, known) -> tuple[np.ndarray, np.ndarray]:
    """The training words and the different ones of each output class but the end's."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, kinds = np.zeros(attention.OUTPUTS, np.int64), np.zeros(attention.OUTPUTS, np.int64)
        for batch in batches:
            of = known.value.codes(batch.column("code").to_numpy()) >> 32
            np.add.at(n, of, batch.column("n").to_numpy())
            np.add.at(kinds, of, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(attention.OUTPUTS, dtype=np.int32)), pa.array(n), pa.array(kinds)], ["id", "n", "kinds"])

    rows = counts.select("code", "n").mapInArrow(count, "id int, n long, kinds long").groupBy("id").agg(F.sum("n").alias("n"), F.sum("kinds").alias("kinds")).collect()
    return array_of(rows, "n", attention.OUTPUTS), array_of(rows, "kinds", attention.OUTPUTS)


def steps_of(texts: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """All blocks of texts as arrays of codes, at most BATCH at a time: inputs, targets, begins, and how many blocks have targets.

    Where a step starts inside a text, the block before is there for its keys, without targets.
    """
    x, y, begins, _ = attention.blocked(texts)
    for at in range(0, len(x), BATCH):
        back = int(not begins[at])
        own = slice(at - back, at + BATCH)
        targets = y[own].copy()
        targets[:back] = -1
        yield x[own], targets, begins[own], len(targets) - back


def numbers(known: attention.Vocabulary, part: pa.RecordBatch) -> list[np.ndarray]:
    """The texts as numbers of their positions, or as first | last << 16 of their words' ids."""
    read = unpacked if isinstance(known, Subwords) else lambda c: np.frombuffer(c, np.uint32).astype(np.int64)
    return [read(c) for c in part.column("codes").to_pylist()]


def word_codes(known: attention.Vocabulary, texts: list[np.ndarray]) -> list[np.ndarray]:
    return [known.of.take(t) if isinstance(known, Subwords) else known.codes(t) for t in texts]


def trained(texts: DataFrame, words: int, known, share: np.ndarray) -> dict[str, np.ndarray]:
    """The model's parameters after all phases. The driver holds one copy of them, whose size is fixed."""
    context, training = texts.sparkSession.sparkContext, texts.where("training").select("key", "codes")
    model = attention.flat(attention.fresh(share))
    shards = max(1, -(-words // (PHASES * SHARD)))
    for phase in range(PHASES):
        start = context.broadcast(model)

        def train(batches: Iterator[pa.RecordBatch], phase: int = phase, start=start) -> Iterator[pa.RecordBatch]:
            memory_kept()
            p = attention.unflat(start.value)
            adam, seen = attention.Adam(p, RATE / (1 + phase)), 0
            for part in groups_by_bytes(batches, "codes", CUT):
                for x, y, begins, blocks in steps_of(word_codes(known.value, numbers(known.value, part))):
                    adam.step(attention.gradients(p, x, y, begins)[1])
                    seen += blocks
            if seen:
                value = attention.flat(p).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(value), dtype=np.int32)), pa.array(value * seen), pa.array(np.full(len(value), seen, np.int64))], ["i", "v", "w"])

        own = training.where(F.pmod("key", F.lit(PHASES)) == phase).repartition(shards, "key").sortWithinPartitions("key")
        sums = own.mapInArrow(train, "i int, v double, w long").groupBy("i").agg((F.sum("v") / F.sum("w")).alias("v"))
        for r in sums.collect():
            model[r["i"]] = r["v"]
    return attention.unflat(model)


def score(docs: DataFrame, vocabulary: str, subwords: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    subwords makes every subword id a position of the attention model; else each word is one.
    A null text counts as empty: its one token is the end. score is the log10 probability that the
    model gives to the text's words and the end. Rows that repeat id and text get
    the same answer, and are all learnt from. A null doc_id belongs to the fold of the empty string.
    Columns other than doc_id and text are not read; docs is read twice and has to give the same rows. An empty table gives an empty result; without
    training documents every word is unknown and N and V are 0.
    """
    context = docs.sparkSession.sparkContext
    both = written(coded(docs, vocabulary, subwords), "coded")
    texts = both.where("key is not null")
    counts = written(both.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"), F.min("code").alias("code")).where("n > 0"), "word-counts")
    n_docs = texts.where("training").count()
    sizes = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    n_words = sizes[0] or 0
    total, kinds = n_words + n_docs, sizes[1] + (n_docs > 0)
    by_power = counts.groupBy(F.floor(F.log2("n")).alias("power")).count().orderBy(F.desc("power")).collect()  # at most 64 rows
    least, held = 1 << 62, 0
    for r in by_power:
        held += r["count"]
        if held > FREQUENT:
            break
        least = 1 << r["power"]
    frequent = counts.where(F.col("n") >= least).select("word", "n").toArrow()
    words, logs = frequent.column("word").to_numpy().view(np.uint64), np.log10(frequent.column("n").to_numpy().astype(float) + 1)
    order = np.argsort(words)
    table = context.broadcast((words[order], logs[order]))
    if subwords:
        positions = np.zeros(2 * FINAL)
        for r in both.where("key is null and word is null").groupBy("code").agg(F.sum("n").alias("n")).collect():  # 131,072 rows at most
            positions[r["code"]] = r["n"]
        classes = Subwords(positions, coder_of(vocabulary).ids_of.tokenizer.get_vocab_size())
        known, words_in, kinds_in, n_targets = context.broadcast(classes), classes.n_in, classes.kinds_in, int(positions.sum())
    else:
        known, n_targets = context.broadcast(classes_from(counts)), n_words
        words_in, kinds_in = class_counts(counts, known)
    words_in[attention.END], kinds_in[attention.END] = n_docs, n_docs > 0
    share = (words_in + 1) / (words_in + 1).sum()
    model, below = context.broadcast(trained(texts, n_targets, known, share)), np.log10(words_in + kinds_in + 1)

    def base(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_kept()
        frequent, logs = table.value
        for part in groups_by_bytes(batches, "text", 1 << 20):
            hashes, bounds = hashed_words(lowered(part))
            different, of = np.unique(hashes, return_inverse=True)
            place = np.searchsorted(frequent, different)
            there = place < len(frequent)
            there[there] = frequent[place[there]] == different[there]
            value = np.zeros(len(different))
            value[there] = logs[place[there]]
            per_text = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[bounds])
            unknown = ~there[of]
            offsets = np.concatenate([[0], np.cumsum(unknown)])[bounds]
            rest = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashes[unknown].view(np.int64)))
            arrays = [pa.array(c) for c in (np.diff(bounds), per_text(there[of].astype(np.int64)), per_text(value[of]))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), *arrays, rest], ["doc_id", "key", "n_words", "n_known", "base", "rest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory_kept()
        p = model.value
        for part in groups_by_bytes(batches, "codes", 2 * CUT):
            read = numbers(known.value, part)
            codes = word_codes(known.value, read)
            x, y, begins, first = attention.blocked(codes)
            sums = np.zeros(len(x) + 1)
            for at in range(0, len(x), BLOCKS - 1):  # one block more for its keys, scored with its own part
                back = int(at > 0)
                own = slice(at - back, at + BLOCKS - 1)
                logs_e = attention.log_probabilities(p, x[own], y[own], begins[own])[back:]
                sums[1 + at : 1 + at + len(logs_e)] = logs_e.sum(1, dtype=np.float64)
            sums = np.cumsum(sums)
            inside = known.value.logs.take(np.concatenate(read)) if subwords else -below.take(np.concatenate(codes) >> 32)
            shares = np.concatenate([[0.0], np.cumsum(inside)])[np.concatenate([[0], np.cumsum([len(t) for t in read])])]
            scores = (sums[first[1:]] - sums[first[:-1]]) / np.log(10) + np.diff(shares) - (0.0 if subwords else below[attention.END])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(scores)], ["doc_id", "key", "score"])

    scored = written(keyed(docs).mapInArrow(base, "doc_id long, key long, n_words long, n_known long, base double, rest array<long>"), "scored")
    by_model = texts.select("doc_id", "key", "codes").mapInArrow(run, "doc_id long, key long, score double").groupBy(F.col("doc_id").alias("id"), F.col("key").alias("of")).agg(F.min("score").alias("score"))
    rare = scored.select("key", F.explode("rest").alias("word")).join(counts.where(F.col("n") < least).select("word", "n"), "word")
    rare = rare.groupBy("key").agg(F.sum(F.log10(F.col("n") + 1)).alias("more"), F.count(F.lit(1)).alias("more_known"))
    copies = scored.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    told = rare.join(copies, "key").select("key", (F.col("more") / F.col("copies")).alias("more"), (F.col("more_known") / F.col("copies")).cast("long").alias("more_known"))
    named = scored.drop("rest").join(told, "key", "left").join(by_model, F.col("key").eqNullSafe(F.col("of")) & F.col("doc_id").eqNullSafe(F.col("id")), "left")
    tokens, top = F.col("n_words") + 1, F.col("base") + F.coalesce("more", F.lit(0.0)) + float(np.log10(n_docs + 1))
    return named.select(
        "doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), tokens.alias("n_tokens"),
        (F.col("n_known") + F.coalesce("more_known", F.lit(0)) + int(n_docs > 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (top - tokens * float(np.log10(total + kinds + 1))).alias("base_score"), (F.col("score") if subwords else top + F.col("score")).alias("score"),
    )
