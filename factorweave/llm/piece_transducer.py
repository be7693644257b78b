"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled into three parts: a normaliser (the file's replacement rules, leftmost and
longest first, removal of extra white space, white space to its mark, dummy prefix), an acceptor of
pieces, and byte fallback for characters no piece has. Composed with an input it gives a lattice whose states are places in the text with the last piece; the encoding is the shortest path
in the tropical semiring (weights add along a path, the least wins).

User-defined pieces pass the normaliser as they are; in BPE models nothing merges with them.

For unigram models an arc weighs minus the piece's score. For BPE models scores are merge ranks,
not costs, and the sum of ranks would give other segmentations. There an arc weighs nothing if merging
the last piece and the new one, joined, gives those two pieces back, and infinity if not. Exactly
one path is then finite, and it is the BPE encoding: no merge can cross a boundary that its two
neighbours would not have crossed on their own.

A text falls into stretches that no piece can cross; each different one is solved once and kept in a
bounded store.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import groups_by_bytes, text_bytes

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER_DEFINED, UNUSED, BYTE = 1, 2, 4, 5, 6
#: What a character without a piece costs more than the worst piece, in unigram models; how an unknown piece reads.
UNKNOWN_COST, UNKNOWN_TEXT = 10.0, " \u2047 "
#: Words, stretches and pairs of pieces whose solutions a Python worker keeps; beyond it the store starts anew.
KEPT = 500_000


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protocol-buffer message: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + n]
            at += n


def replacement_rules(charsmap: bytes) -> dict[str, str]:
    """The rules of a compiled character map: a double array of 32-bit units that spells the left sides byte by byte, then the right sides."""
    size = int.from_bytes(charsmap[:4], "little")
    units, texts = np.frombuffer(charsmap, "<u4", size // 4, 4).astype(np.int64), charsmap[4 + size :]
    letters, rules, todo = np.arange(1, 256), {}, [(0, b"")]
    while todo:
        at, key = todo.pop()
        at ^= int(units[at] >> 10) << (int(units[at] & 512) >> 6)
        if key and units[at] >> 31 and rules.get(key) is None:
            begin = int(units[at] & 0x7FFFFFFF)
            rules[key] = texts[begin : texts.index(b"\0", begin)]
        below = at ^ letters
        below = below[below < len(units)]
        found = below[(units[below] & 0x800000FF) == below ^ at]
        todo += [(int(x), key + bytes([int(x) ^ at])) for x in found]
    return {k.decode("utf-8", "replace"): v.decode("utf-8", "replace") for k, v in rules.items()}


class Transducer:
    """A compiled model with encode(text) -> ids and decode(ids) -> text."""

    def __init__(self, data: bytes, kept: int = KEPT):
        import struct

        self.kept, self.words, self.solved, self.joined = kept, {}, {}, {}
        self.pieces: list[bytes] = []
        self.ids: dict[str, int] = {}
        self.score: dict[str, float] = {}
        self.byte_ids: dict[int, int] = {}
        self.user: dict[str, int] = {}
        kind, self.prefix, self.squeeze, self.rules, self.unk, unused, fallback = UNIGRAM, True, True, {}, 0, set(), False
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                text, sort = piece[1].decode(), piece.get(3, NORMAL)
                i = len(self.pieces)
                if sort == BYTE:
                    self.byte_ids[int(text[3:5], 16)] = i
                    self.pieces.append(bytes([int(text[3:5], 16)]))
                elif sort in (NORMAL, USER_DEFINED):
                    self.ids[text], self.score[text] = i, struct.unpack("<f", piece.get(2, bytes(4)))[0]
                    self.pieces.append(text.replace(MARK, " ").encode())
                    if sort == USER_DEFINED:
                        self.user[text] = i
                elif sort == UNKNOWN:
                    self.unk = i
                    self.pieces.append(UNKNOWN_TEXT.encode())
                else:  # control, unused: never made from text
                    unused |= {sort} & {UNUSED}
                    self.pieces.append(b"")
            elif number == 2:
                spec = dict(fields(value))
                kind, fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
                if spec.get(24, 0):
                    raise ValueError("models that put the mark of white space behind words are not compiled")
            elif number == 3:
                spec = dict(fields(value))
                self.rules = replacement_rules(spec[2]) if spec.get(2) else {}
                self.prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
                if not spec.get(5, 1):
                    raise ValueError("models that do not mark white space are not compiled")
        if kind not in (UNIGRAM, BPE):
            raise ValueError(f"model type {kind} is neither unigram nor BPE")
        self.bpe = kind == BPE
        if self.bpe and unused:
            raise ValueError("unused pieces of BPE models are not compiled")
        if not fallback:
            self.byte_ids = {}
        if self.user:
            normal = [v for p, v in self.score.items() if p not in self.user]
            for p in self.user:
                del self.ids[p]
                if not self.bpe:  # their score as the library has it
                    self.ids[p], self.score[p] = self.user[p], len(p) * max(normal, default=0.0) - 0.1
            self.user_marks = re.compile("|".join(re.escape(p) for p in sorted(self.user, key=len, reverse=True)))
        self.widest = max(map(len, self.rules), default=0)
        self.starts = re.compile("[" + "".join(re.escape(c) for c in sorted({k[0] for k in self.rules})) + "]") if self.rules else None
        self.letters = frozenset("".join(self.ids))
        # a piece has the mark at its start only, so a mark after another character begins a new stretch
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has white space after other characters")
        # no piece has these after a letter, so there a stretch ends as well
        after = {b for p in self.ids for a, b in zip(p, p[1:]) if a.isalpha()}
        ends = "".join(re.escape(c) for c in sorted(self.letters - after) if not c.isalpha() and c != MARK)
        line = "" if "\n" in self.letters else "\n"
        first = f"[{ends}]*" if ends else ""
        self.stretches = re.compile(f"{MARK}*{first}[^{MARK}{ends}{line}]+|{MARK}*[{ends}]+|{MARK}+|\n" if ends else f"{MARK}*[^{MARK}{line}]+|{MARK}+|\n")
        self.unknown = len(self.pieces)  # the id of any character without a piece; one more stands for the start
        self.names = {i: p for p, i in self.ids.items()} | {self.unknown: "\0", self.unknown + 1: ""}
        normal = [v for p, v in self.score.items() if p not in self.user]
        self.scores = {i: self.score[p] for p, i in self.ids.items()} | {self.unknown: min(normal, default=0.0) - UNKNOWN_COST}
        self.trie: dict = {}
        for p, i in self.ids.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i

    def replaced(self, text: str) -> str:
        """text under the rules: at each place from the left the longest one that fits."""
        if not self.rules or not self.starts.search(text):
            return text
        out, done, at = [], 0, 0
        while found := self.starts.search(text, at):
            begin = found.start()
            for n in range(min(self.widest, len(text) - begin), 0, -1):
                new = self.rules.get(text[begin : begin + n])
                if new is not None:
                    out += [text[done:begin], new]
                    done = at = begin + n
                    break
            else:
                at = begin + 1
        return "".join([*out, text[done:]])

    def normalised(self, text: str) -> str:
        """text as the pieces read it: rules, white space, marks, dummy prefix; "" for nothing."""
        if self.user:
            gaps, marks = self.user_marks.split(text), self.user_marks.findall(text)
            text = "".join(self.replaced(g) + m for g, m in zip(gaps, [*marks, ""]))
        else:
            text = self.replaced(text)
        if self.squeeze:
            text = re.sub("  +", " ", text.lstrip(" "))
        if not text:
            return ""
        text = (MARK if self.prefix else "") + text.replace(" ", MARK)
        return text.rstrip(MARK) if self.squeeze else text

    def plain(self, text: str) -> str:
        """What decoding the ids of text has to give back, if every character can be told."""
        text = self.normalised(text).replace(MARK, " ")
        return text.lstrip(" ") if self.squeeze else text.removeprefix(" ") if self.prefix else text

    def merge(self, text: str) -> list[str]:
        """Pieces of a short text by merging: the best-scored adjacent pair first, the leftmost of equals."""
        parts = list(text)
        while True:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                s = self.score.get(parts[i] + parts[i + 1], -math.inf)
                if s > best:
                    best, at = s, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def weight(self, last: int, piece: int) -> float:
        """The weight of the arc that reads a piece after last; both are ids, or START or the unknown character's."""
        if not self.bpe:
            return -self.scores[piece]
        if piece == self.unknown:
            return 0.0
        before, text = self.names[last], self.names[piece]
        return 0.0 if self.merge(before + text) == ([before, text] if before else [text]) else math.inf

    def shortest(self, text: str) -> list[tuple[int, int]]:
        """The pieces of a stretch as (id, end): composition with its lattice, arc by arc along the trie, and the shortest path."""
        root, joined, size, many = self.trie, self.joined, len(text), self.unknown + 2
        distance, last, back = [0.0] + [math.inf] * size, [self.unknown + 1] * (size + 1), [0] * (size + 1)
        for begin in range(size):
            so_far = distance[begin]
            if so_far == math.inf:
                continue
            before, node, end = last[begin], root, begin
            base = before * many
            while end < size:
                node = node.get(text[end])
                end += 1
                if node is None:
                    break
                piece = node.get("")
                if piece is not None and so_far < distance[end]:
                    arc = joined.get(base + piece)
                    if arc is None:
                        arc = joined[base + piece] = self.weight(before, piece)
                    if so_far + arc < distance[end]:
                        distance[end], last[end], back[end] = so_far + arc, piece, begin
            if text[begin] not in self.ids:  # it can still be read, as bytes or as unknown
                d = so_far + self.weight(before, self.unknown)
                if d < distance[begin + 1]:
                    distance[begin + 1], last[begin + 1], back[begin + 1] = d, self.unknown, begin
        out, at = [], size
        while at:
            out.append((last[at], at))
            at = back[at]
        return out[::-1]

    def solve(self, stretch: str) -> bytes:
        ids = array("I")
        for piece, end in self.shortest(stretch):
            if piece == self.unknown:
                ids.extend([self.byte_ids[b] for b in stretch[end - 1].encode("utf-8", "replace")] if self.byte_ids else [self.unk])
            else:
                ids.append(piece)
        return ids.tobytes()

    def solve_all(self, parts: list[str]) -> bytes:
        """The ids of stretches that stand one after another."""
        solved = self.solved
        new = set(parts).difference(solved)
        if new:
            if len(solved) > self.kept:
                solved.clear()
                new = set(parts)
            if len(self.joined) > self.kept:
                self.joined.clear()
            for p in new:
                solved[p] = self.solve(p)
        return b"".join(map(solved.__getitem__, parts))

    def marked(self, text: str) -> bytes:
        """The ids of a normalised text: user-defined pieces of BPE models stand alone, the rest is made of stretches."""
        if not (self.user and self.bpe):
            return self.solve_all(self.stretches.findall(text))
        gaps, marks = self.user_marks.split(text), self.user_marks.findall(text)
        ids = [array("I", [self.user[m]]).tobytes() for m in marks]
        return b"".join(self.solve_all(self.stretches.findall(g)) + i for g, i in zip(gaps, [*ids, b""]))

    def encode(self, text: str) -> array:
        """The ids of a text; none for the empty text."""
        text = self.normalised(text)
        if not text:
            return array("I")
        if self.user or not self.prefix or MARK + MARK in text or len(text) == 1:
            return self.without_runs(array("I", self.marked(text)))
        # single marks only: each word with its mark is made of whole stretches, and words recur
        words, known = text[1:].split(MARK), self.words
        new = set(words).difference(known)
        if new:
            if len(known) > self.kept:
                known.clear()
                new = set(words)
            for w in new:
                known[w] = self.solve_all(self.stretches.findall(MARK + w))
        return self.without_runs(array("I", b"".join(map(known.__getitem__, words))))

    def without_runs(self, ids: array) -> array:
        """Without byte fallback, a run of unknown characters is one unknown piece."""
        if self.byte_ids or self.unk not in ids:
            return ids
        return array("I", [x for i, x in enumerate(ids) if x != self.unk or not i or ids[i - 1] != self.unk])

    def decode(self, ids) -> str:
        """The text of ids. The dummy prefix goes; where white space is removed, the mark of each piece goes until a text begins."""
        parts = [self.pieces[i] for i in ids]
        for k, i in enumerate(ids if self.prefix or self.squeeze else ()):
            if i == self.unk:
                break
            marked, parts[k] = parts[k][:1] == b" ", parts[k].removeprefix(b" ")
            if parts[k] or marked and not self.squeeze:
                break
        return b"".join(parts).decode("utf-8", "replace")


_compiled: dict[str, Transducer] = {}


def compiled(path: str) -> Transducer:
    """The transducer of this Python worker; the model file is part of an installed package on every machine."""
    if path not in _compiled:
        with open(path, "rb") as f:
            _compiled[path] = Transducer(f.read())
    return _compiled[path]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """Rows (doc_id, ids): the ids of each row's whole text, null for a null text and empty for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = compiled(model)
        for part in groups_by_bytes(batches, "text"):
            ids = [None if t is None else coder.encode(t.decode("utf-8", "replace")).tolist() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """Rows (doc_id, text) of rows (doc_id, ids); null ids give a null text. Control pieces are silent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = compiled(model)
        for batch in batches:
            text = [None if x is None else coder.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """One row per row of docs: doc_id, n_ids, n_byte_ids, ids_crc32 (of the ids as little-endian 32-bit numbers), same.

    same says whether decoding gives the normalised text back, with the white-space mark read as a space. A null
    text counts as empty. Repeated rows are answered one by one; a null doc_id stays null. Columns
    other than doc_id and text are not read. An empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = compiled(model)
        low, high = min(coder.byte_ids.values(), default=0), max(coder.byte_ids.values(), default=-1)
        for part in groups_by_bytes(batches, "text"):
            rows = []
            for raw in part.column("text").to_pylist():
                text = (raw or b"").decode("utf-8", "replace")
                ids = coder.encode(text)
                values = np.frombuffer(ids, np.uint32)
                rows.append((len(ids), int(((values >= low) & (values <= high)).sum()), zlib.crc32(ids.tobytes()), coder.decode(ids) == coder.plain(text)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            arrays = [pa.array(c, t) for c, t in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *arrays], ["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "same"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, same boolean")
