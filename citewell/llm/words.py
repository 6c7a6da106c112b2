"""Hashes of all words of a batch of texts at once, with numpy on the UTF-8 bytes. Memory is bounded by the slices worked on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLICE = 1 << 21
_rng = np.random.RandomState(20240229)
_TABLE = _rng.randint(0, 1 << 62, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.full(64, _BASE, dtype=np.uint64).cumprod()

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
FOLDED = _TABLE[_LOWER]  # A-Z count as a-z

SPACED = np.ones(256, dtype=bool)  # runs without ASCII white space
SPACED[[9, 10, 11, 12, 13, 32]] = False
LETTERS = np.zeros(256, dtype=bool)  # runs of letters: ASCII letters and all that is not ASCII
LETTERS[65:91] = LETTERS[97:123] = LETTERS[128:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_words(data: np.ndarray, starts_at: np.ndarray, letters: np.ndarray, stems: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of ``data``, and then of its first bytes for each length in ``stems``; a word never crosses
    the places in ``starts_at``."""
    global _powers
    inside = letters[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = starts_at[starts_at < len(data)]
    first[at] = inside[at]
    begin = np.flatnonzero(first)
    if not len(begin):
        return np.empty(0, np.uint64), begin
    where = np.flatnonzero(inside)
    place = np.searchsorted(where, begin)
    within = np.arange(len(where)) - np.repeat(place, np.diff(np.append(place, len(where))))
    if (top := int(within.max()) + 1) > len(_powers):
        _powers = np.full(2 * top, _BASE, dtype=np.uint64).cumprod()
    values = FOLDED[data[where]] * _powers[within]
    hashes = [mix64(np.add.reduceat(values, place))]
    for k in stems:
        hashes.append(mix64(np.add.reduceat(values * (within < k), place) + np.uint64(k)))
    return (np.stack(hashes, axis=1).ravel(), np.repeat(begin, len(hashes))) if stems else (hashes[0], begin)


def word_hashes(texts: list[str], letters: np.ndarray = SPACED, stems: tuple[int, ...] = ()) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(number of the first text, word hashes of each text) for consecutive runs of texts of about SLICE bytes. A longer text
    is hashed in slices that end between words."""
    at, held, size = 0, [], 0
    for i, text in enumerate(texts):
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) > SLICE:
            if held:
                yield at, _together(held, letters, stems)
            yield i, [_long(raw, letters, stems)]
            at, held, size = i + 1, [], 0
            continue
        held.append(raw)
        size += len(raw)
        if size > SLICE:
            yield at, _together(held, letters, stems)
            at, held, size = i + 1, [], 0
    if held:
        yield at, _together(held, letters, stems)


def _together(raws: list[bytes], letters: np.ndarray, stems: tuple[int, ...]) -> list[np.ndarray]:
    data = np.frombuffer(b"".join(raws), dtype=np.uint8)
    ends = np.cumsum([len(r) for r in raws])
    hashes, begin = _hash_words(data, ends, letters, stems)
    return np.split(hashes, np.searchsorted(begin, ends[:-1]))


def _long(raw: bytes, letters: np.ndarray, stems: tuple[int, ...]) -> np.ndarray:
    data, out, lo = np.frombuffer(raw, dtype=np.uint8), [], 0
    while lo < len(data):
        hi = min(lo + SLICE, len(data))
        while hi < len(data) and letters[data[hi]]:
            hi += 1
        out.append(_hash_words(data[lo:hi], np.empty(0, np.int64), letters, stems)[0])
        lo = hi
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words; of the whole sequence if it is shorter; none without words."""
    if not len(words):
        return words
    n = min(n, len(words))
    with np.errstate(over="ignore"):
        mixed = np.full(len(words) - n + 1, n, dtype=np.uint64)
        for j in range(n):
            mixed = mix64(mixed * np.uint64(0x9FB21C651E98DF25) + words[j:len(words) - n + 1 + j])
    return np.unique(mixed)
