"""Identifiers and hashes: chunk ids, point ids, cache keys, feature hashes and the hashed embedding."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citewell import params as P
from citewell.functions.text import collapse_spaces


def chunk_id(doc_id: Column, index: Column, text: Column) -> Column:
    return F.concat(doc_id, F.lit("#"), index.cast("string"), F.lit("-"), F.left(F.sha2(text, 256), F.lit(12)))


def point_id(tenant: Column, chunk: Column) -> Column:
    """Name-based UUID (version 5) of ``tenant:chunk``."""
    namespace = F.unhex(F.lit(P.POINT_NAMESPACE.replace("-", "")))
    digest = F.sha1(F.concat(namespace, F.encode(F.concat(tenant, F.lit(":"), chunk), "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
        F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def cache_key(tenant: Column, question: Column, top_k: Column) -> Column:
    parts = F.concat_ws("\x1f", tenant, collapse_spaces(F.lower(question)), F.coalesce(top_k.cast("string"), F.lit("None")))
    return F.concat(F.lit("ans:"), F.sha2(parts, 256))


def embedding_head(title: Column, section: Column) -> Column:
    """What stands above a chunk's text in the text that is embedded and searched; a line break separates them."""
    return F.concat(title, F.lit(" | "), F.coalesce(section, F.lit("")))


def embedding_text(title: Column, section: Column, text: Column) -> Column:
    return F.concat(embedding_head(title, section), F.lit("\n"), text)


# ---- hashed features ---------------------------------------------------------------------------
# md5 mode (default): a number any SQL engine can compute: the first 15 hex digits; the sign is the parity of
# the 16th. blake2b mode: 8 bytes, little endian; the sign is the top bit.


def _hash_md5(feature: str) -> tuple[int, bool]:
    digits = hashlib.md5(feature.encode()).hexdigest()
    return int(digits[:15], 16), int(digits[15], 16) % 2 == 1


def _hash_blake2b(feature: str) -> tuple[int, bool]:
    h = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8).digest(), "little")
    return h, bool(h >> 63)


_HASHES: dict[str, Callable[[str], tuple[int, bool]]] = {"md5": _hash_md5, "blake2b": _hash_blake2b}
# FIXED VALUES: weights of a term, of two neighbouring terms, of a run of four letters in a term longer than five
TERM_WEIGHT, PAIR_WEIGHT, GRAM_WEIGHT = 1.0, 0.7, 0.25


@lru_cache(maxsize=1 << 17)
def _places(feature: str, mode: str, dim: int) -> tuple[int, float]:
    h, positive = _HASHES[mode](feature)
    return h % dim, 1.0 if positive else -1.0


@lru_cache(maxsize=1 << 17)
def _term_places(term: str, mode: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots and signed weights of all features that a term has by itself."""
    grams = [f"#{term[i:i + 4]}" for i in range(len(term) - 3)] if len(term) > 5 else []
    slots, signs = zip(*(_places(f, mode, dim) for f in [term, *grams]))
    return np.array(slots), np.array(signs) * np.array([TERM_WEIGHT, *[GRAM_WEIGHT] * len(grams)])


def hash_embedding(terms: Column, dim: int = P.DEFAULTS.embedding_dim, mode: str = "md5") -> Column:
    """Unit vector over ``dim`` slots of hashed term, pair and 4-gram features.

    All features of a chunk come from its own row, so the whole vector is built there: no shuffle. In a slice of a batch every distinct term and
    pair is hashed once, all of them together; occurrences are then laid out and summed as arrays. A slice is bounded in terms, so long chunks take no more memory."""
    if mode not in _HASHES:
        raise ValueError(f"unknown hash mode {mode}")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def embed(batch: pd.Series) -> pd.Series:
        out, part, held = [], [], 0
        for t in batch:
            if part and held + (0 if t is None else len(t)) > _TERMS:
                out, part, held = out + [_embedded(part, mode, dim)], [], 0
            part.append(t)
            held += 0 if t is None else len(t)
        return pd.Series([v for m in [*out, *([_embedded(part, mode, dim)] if part else [])] for v in m], dtype=object)

    return embed(terms)


_TERMS = 1 << 16  # laid out at once, unless one chunk has more


def _embedded(batch: list, mode: str, dim: int) -> np.ndarray:
    """One unit vector a row for lists of terms."""
    lists = [[] if t is None else list(t) for t in batch]
    row = np.repeat(np.arange(len(lists)), [len(t) for t in lists])
    code, names = pd.factorize(np.array([x for t in lists for x in t], dtype=object))
    total = np.zeros(len(lists) * dim)
    if len(code):
        words = _Words(names.tolist(), mode, dim)
        count, slots, weights = words.features()
        n, begin = count[code], (np.cumsum(count) - count)[code]
        at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
        total += np.bincount(np.repeat(row, n) * dim + slots[at], weights=weights[at], minlength=len(total))
        beside = np.flatnonzero(row[1:] == row[:-1])
        pair, kinds = pd.factorize(code[beside] * len(names) + code[beside + 1])
        if len(pair):
            slots, signs = words.pairs(kinds // len(names), kinds % len(names))
            total += PAIR_WEIGHT * np.bincount(row[beside] * dim + slots[pair], weights=signs[pair], minlength=len(total))
    matrix = total.reshape(len(lists), dim)
    norms = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    norms[norms == 0.0] = 1.0
    return matrix / norms


class _Words:
    """Distinct terms as rows of bytes, and the slots and signs of their features. Features of ASCII terms that fit one block of md5 are hashed
    together; the others, and other hashes, one by one."""

    def __init__(self, names: list[str], mode: str, dim: int) -> None:
        self.names, self.mode, self.dim = names, mode, dim
        self.size = np.fromiter(map(len, names), np.int64, len(names))
        self.short = np.fromiter((mode == "md5" and len(x) < _ONE_BLOCK and x.isascii() for x in names), bool, len(names))
        self.bytes = np.array([x if s else "" for x, s in zip(names, self.short.tolist(), strict=True)], "S64").view(np.uint8).reshape(-1, 64)

    def _hashed(self, blocks: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        blocks[np.arange(len(blocks)), size] = 0x80
        heads = _md5_heads(blocks, size)
        return (heads >> np.uint64(4)).astype(np.int64) % self.dim, np.where(heads & np.uint64(1), 1.0, -1.0)

    def features(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per term how many features it has by itself; the slots and signed weights of these, term by term."""
        grams = np.where(self.size > 5, self.size - 3, 0)
        count = grams + 1
        begin = np.cumsum(count) - count
        slots, weights = np.empty(count.sum(), np.int64), np.empty(count.sum())
        for i in np.flatnonzero(~self.short).tolist():
            part = slice(begin[i], begin[i] + count[i])
            slots[part], weights[part] = _term_places(self.names[i], self.mode, self.dim)
        own = np.flatnonzero(self.short)
        if len(own):
            slots[begin[own]], signs = self._hashed(self.bytes[own], self.size[own])
            weights[begin[own]] = signs * TERM_WEIGHT
        grams[~self.short] = 0
        term = np.repeat(np.arange(len(grams)), grams)
        if len(term):
            at = np.arange(len(term)) - np.repeat(np.cumsum(grams) - grams, grams)
            letters = np.stack([self.bytes[term, at + i] for i in range(4)], axis=1)
            gram, kinds = pd.factorize(letters.view("<u4").ravel())
            blocks = np.zeros((len(kinds), 64), np.uint8)
            blocks[:, 0], blocks[:, 1:5] = ord("#"), kinds.astype("<u4").view(np.uint8).reshape(-1, 4)
            places, signs = self._hashed(blocks, np.full(len(kinds), 5))
            slots[begin[term] + 1 + at], weights[begin[term] + 1 + at] = places[gram], signs[gram] * GRAM_WEIGHT
        return count, slots, weights

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots and signs of pairs of terms."""
        slots, signs = np.empty(len(left), np.int64), np.empty(len(left))
        size = self.size[left] + 1 + self.size[right]
        short = self.short[left] & self.short[right] & (size <= _ONE_BLOCK)
        for i in np.flatnonzero(~short).tolist():
            slots[i], signs[i] = _places(f"{self.names[left[i]]}_{self.names[right[i]]}", self.mode, self.dim)
        chosen = np.flatnonzero(short)
        chosen = chosen[np.argsort(self.size[left[chosen]], kind="stable")]  # first terms of one length lie together
        for start in range(0, len(chosen), _BLOCKS):
            part = chosen[start:start + _BLOCKS]
            blocks, lead = self.bytes[left[part]], self.size[left[part]]
            blocks[np.arange(len(part)), lead] = ord("_")
            edges = [0, *(np.flatnonzero(np.diff(lead)) + 1).tolist(), len(part)]
            for a, b in zip(edges, edges[1:], strict=False):
                at, others = int(lead[a]) + 1, right[part[a:b]]
                wide = int(self.size[others].max())
                blocks[a:b, at:at + wide] = self.bytes[others, :wide]
            slots[part], signs[part] = self._hashed(blocks, size[part])
        return slots, signs


_ONE_BLOCK = 55  # bytes of a text of one md5 block
_BLOCKS = 1 << 13  # hashed at once
_TURNS = (7, 12, 17, 22) * 4 + (5, 9, 14, 20) * 4 + (4, 11, 16, 23) * 4 + (6, 10, 15, 21) * 4
_SINES = [np.uint32(int(abs(math.sin(i + 1)) * (1 << 32))) for i in range(64)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)


def _md5_heads(blocks: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The first eight bytes of the md5 digests of texts of one block each (n x 64 bytes, ended by 0x80), as big-endian numbers."""
    out = np.empty(len(blocks), np.uint64)
    for start in range(0, len(blocks), _BLOCKS):
        part = slice(start, start + _BLOCKS)
        words = np.ascontiguousarray(blocks[part].view("<u4").T)
        words[14] = size[part] * 8
        used = words.any(axis=1).tolist()
        a, b, c, d = (np.full(words.shape[1], x, np.uint32) for x in _START)
        f, t = np.empty_like(a), np.empty_like(a)
        for i in range(64):
            if i < 16:
                word = i
                np.bitwise_xor(c, d, out=f)
                f &= b
                f ^= d
            elif i < 32:
                word = (5 * i + 1) % 16
                np.bitwise_xor(b, c, out=f)
                f &= d
                f ^= c
            elif i < 48:
                word = (3 * i + 5) % 16
                np.bitwise_xor(b, c, out=f)
                f ^= d
            else:
                word = 7 * i % 16
                np.invert(d, out=f)
                f |= b
                f ^= c
            f += a
            f += _SINES[i]
            if used[word]:
                f += words[word]
            np.left_shift(f, np.uint32(_TURNS[i]), out=t)
            f >>= np.uint32(32 - _TURNS[i])
            f |= t
            f += b
            a, b, c, d, f = d, f, b, c, a
        first, second = a + np.uint32(_START[0]), b + np.uint32(_START[1])
        out[part] = first.byteswap().astype(np.uint64) << np.uint64(32) | second.byteswap()
    return out
