"""Vectorised words and word hashes of many texts at once, on their UTF-8 bytes.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which in UTF-8 is the rule
``[^\\x20\\x09-\\x0D]+`` on characters. A word's hash is a polynomial over table values of its
bytes modulo 2**64, put through a mixer; equal words have equal hashes wherever they run.
"""

from __future__ import annotations

import numpy as np

WHITE = b" \t\n\x0b\x0c\r"
IS_WHITE = np.zeros(256, bool)
IS_WHITE[list(WHITE)] = True
LOWERED = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
CHUNK = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


TABLE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n or more; the usual chunk size is kept."""
    size = CHUNK + 1 if n <= CHUNK + 1 else n
    if size not in _powers:
        made = []
        for base in (BASE, BASE_INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        if size > CHUNK + 1:
            return made[0], made[1]
        _powers[size] = (made[0], made[1])
    return _powers[size]


def cuts(data: bytes) -> list[int]:
    """Places that cut data into pieces of about CHUNK bytes, each before white space."""
    at, n = [0], len(data)
    while n - at[-1] > CHUNK:
        begin = at[-1]
        found = max(data.rfind(b" ", begin + 1, begin + CHUNK), data.rfind(b"\n", begin + 1, begin + CHUNK))
        if found < 0:
            ahead = [p for p in (data.find(bytes([w]), begin + CHUNK) for w in WHITE) if p >= 0]
            if not ahead:
                break
            found = min(ahead)
        at.append(found)
    return [*at, n]


def located_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """Of all words of all texts in order: hashes, first places and ends in the joined texts; each text's first word (one more at the end); the joined texts."""
    data = b" ".join(t or b"" for t in texts)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t or b"") + 1 for t in texts], out=offsets[1:])
    hashes, places, ends = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at = cuts(data)
    for begin, end in zip(at, at[1:]):
        raw = np.frombuffer(data, np.uint8, end - begin, begin)
        inside = np.zeros(len(raw) + 2, np.int8)
        inside[1:-1] = ~IS_WHITE[raw]
        edge = np.diff(inside)
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(first):
            continue
        up, down = powers(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(TABLE[raw] * up[: len(raw)], out=sums[1:])
        hashes.append(mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64)))
        places.append(first + begin)
        ends.append(last + begin)
    begins = np.concatenate(places)
    return np.concatenate(hashes), begins, np.concatenate(ends), np.searchsorted(begins, offsets), data


def hashed_words(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words of all texts in order, and each text's first place in them (one more at the end)."""
    hashes, _, _, bounds, _ = located_words(texts)
    return hashes, bounds


def windows(words: np.ndarray, bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words inside one text, and the number of the text each belongs to."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = mixed(total + words[k : k + n] * np.uint64(2 * k + 0x1B873593))
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = owner[:n] == owner[width - 1 :]
    return total[inside], owner[:n][inside]


def word_lists(text: bytes | None) -> list[bytes]:
    """The words of one text; bytes.split() splits at the same six bytes."""
    return (text or b"").split()
