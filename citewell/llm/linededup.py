"""Line dedup by winnowing over line hashes, and passage dedup over the words themselves.

Lines: a gram starts at a line and spans the fewest lines with at least ``gram_words`` words. From every line a window spans the fewest
lines with at least ``guarantee_words`` words; the smallest gram hash that lies within is a fingerprint. Windows depend on nothing
but the lines inside, so two documents that share a run of lines with ``guarantee_words`` words always choose a common fingerprint.
Fingerprints are joined by hash to their first position in the corpus only, never pair by pair. Each match is extended line by line in
both directions, and the later run is deleted.

Words: a passage may begin and end inside lines, and the first place of a fingerprint need not be the one that agrees longest. So grams of words
are winnowed too, and a chosen gram carries a hash of the words on both sides that a run of ``guarantee_words`` words around it can hold. It
meets the first place with the same gram and surroundings; where a gram has several surroundings, the first place of each is compared run by
run. A word goes if, and only if, one of the runs it lies in has an earlier copy anywhere. No pair of documents is compared.

"Earlier" is the order of (doc_id, hash of the text, line or word), null ids last. A line is only deleted for a strictly earlier equal
line and a word only in a run with a strictly earlier equal run, so the first copy always stays.
"""

from __future__ import annotations

import re
import struct
from bisect import bisect_left, bisect_right
from collections import deque
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, meeting, slices, split_hot, written
from .words import FOLDED, mix64

GRAM_WORDS = 25
PASSAGE_GRAM_WORDS = 16  # grams inside lines; shorter ones are fewer to choose, longer ones stand twice by chance less often
GUARANTEE_WORDS = 50
EDGE_WORDS = 4  # fewer words agree by chance before or after a run of whole lines
_BASE = 0x9E3779B97F4A7C15
_KNOWN_WORDS = 1 << 18
_TABLE = 5 << 18  # powers kept; longer texts compute theirs
_SLICE = 1 << 20  # bytes of text worked on at once


def line_units(text: str) -> tuple[list[int], list[int], list[int]]:
    """Place, hash and number of words of every line that is not blank. White space around a line does not count."""
    at, hashes, words = [], [], []
    for i, line in enumerate(text.split("\n")):
        if line := line.strip():
            at.append(i)
            hashes.append(xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63))
            words.append(len(line.split()))
    return at, hashes, words


def _ends(words: list[int], least: int) -> list[int]:
    """For every start the end (exclusive) of the fewest lines with ``least`` words; past the last line if there are not enough."""
    out, end, total = [], 0, 0
    for i in range(len(words)):
        while total < least and end < len(words):
            total += words[end]
            end += 1
        out.append(end if total >= least else len(words) + 1)
        total -= words[i]
    return out


def winnow(hashes: list[int], words: list[int], gram_words: int = GRAM_WORDS, guarantee_words: int = GUARANTEE_WORDS) -> list[tuple[int, int]]:
    """(fingerprint, line): the chosen grams of one document."""
    n = len(hashes)
    gram_end, window_end = _ends(words, gram_words), _ends(words, max(gram_words, guarantee_words))
    packed = struct.pack(f"<{n}q", *hashes)
    grams = [xxhash.xxh3_64_intdigest(packed[8 * i:8 * e]) - (1 << 63) if e <= n else 0 for i, e in enumerate(gram_end)]
    chosen, queue, nxt = {}, deque(), 0
    for i in range(n):
        if window_end[i] > n:
            break
        while nxt < n and gram_end[nxt] <= window_end[i]:
            while queue and grams[queue[-1]] >= grams[nxt]:
                queue.pop()
            queue.append(nxt)
            nxt += 1
        while queue[0] < i:
            queue.popleft()
        chosen[queue[0]] = grams[queue[0]]
    return [(g, i) for i, g in chosen.items()]


_UNITS = "doc_id long, h long, hashes array<long>, marks array<struct<g:long,line:int>>"


def _scan(gram_words: int, guarantee_words: int):
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.struct([("g", pa.int64()), ("line", pa.int32())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                rows = []
                for d, h, t in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    _, hashes, words = line_units(t)
                    if sum(words) >= guarantee_words:
                        marks = winnow(hashes, words, gram_words, guarantee_words)
                        rows.append((d, h, hashes, [{"g": g, "line": i} for g, i in marks]))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                     names=["doc_id", "h", "hashes", "marks"])

    return run


def extend(later: list[int], first: list[int], i: int, j: int, same: bool) -> tuple[int, int]:
    """The longest run of equal lines through later[i] and first[j], as a range of ``later``. Within one document i > j."""
    lo, hi = 0, 1
    while i - lo > 0 and j - lo > 0 and later[i - lo - 1] == first[j - lo - 1]:
        lo += 1
    while i + hi < len(later) and j + hi < len(first) and later[i + hi] == first[j + hi]:
        hi += 1
    return i - lo, i + hi


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, 256):
            ds, hs, out = [], [], []
            for d, h, later, first, same, anchors in zip(*(c.to_pylist() for c in part.columns), strict=True):
                reached: dict[int, int] = {}
                ranges = []
                for a in sorted(anchors, key=lambda x: x["i"]):
                    i, j = a["i"], a["j"]
                    if reached.get(i - j, -1) <= i:
                        s, e = extend(later, first, i, j, same)
                        reached[i - j] = e
                        ranges.append({"s": s, "e": e})
                ds.append(d)
                hs.append(h)
                out.append(ranges)
            if ds:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ds, pa.int64()), pa.array(hs, pa.int64()), pa.array(out, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())])))],
                    names=["doc_id", "h", "ranges"])


def repeated_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram_words: int = GRAM_WORDS,
                  guarantee_words: int = GUARANTEE_WORDS) -> DataFrame:
    """(doc_id, h, ranges): for each document with repeated runs the line ranges that repeat something earlier; h is xxhash64 of the text."""
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").alias("text"))
    units = base.filter("text is not null").mapInArrow(_scan(gram_words, guarantee_words), _UNITS)
    units = written(units.dropDuplicates(["doc_id", "h"]), "line-units")
    marks = units.select("doc_id", "h", F.explode("marks").alias("m")).select("doc_id", "h", "m.g", "m.line")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h", "line")
    first = written(marks.groupBy("g").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "line-first")
    pairs = meeting(marks, first, ["g"]).filter(place != F.col("first"))
    pairs = pairs.groupBy("doc_id", "h", F.col("first.doc_id").alias("fd"), F.col("first.h").alias("fh")).agg(
        F.collect_set(F.struct(F.col("line").alias("i"), F.col("first.line").alias("j"))).alias("anchors"))
    pairs = written(pairs, "line-pairs")
    later = units.select(F.col("doc_id").alias("ld"), F.col("h").alias("lh"), F.col("hashes").alias("later"))
    earlier = units.select(F.col("doc_id").alias("ed"), F.col("h").alias("eh"), F.col("hashes").alias("first"))
    both = pairs.join(later, F.col("doc_id").eqNullSafe(F.col("ld")) & (F.col("h") == F.col("lh")))
    both = both.join(earlier, F.col("fd").eqNullSafe(F.col("ed")) & (F.col("fh") == F.col("eh")))
    same = F.col("doc_id").eqNullSafe(F.col("fd")) & (F.col("h") == F.col("fh"))
    runs = both.select("doc_id", "h", "later", "first", same.alias("same"), "anchors").mapInArrow(
        _runs, "doc_id long, h long, ranges array<struct<s:int,e:int>>")
    found = written(runs.groupBy("doc_id", "h").agg(F.flatten(F.collect_list("ranges")).alias("ranges")), "line-ranges")
    discard(units, first, pairs)
    return found


# ---- passages of words ---------------------------------------------------------------------------


class _Hashes(dict):
    """Hash of a word; the first _KNOWN_WORDS different ones are remembered."""

    def __missing__(self, word: str) -> int:
        h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(self) < _KNOWN_WORDS:
            self[word] = h
        return h


@cache
def _table() -> tuple[np.ndarray, np.ndarray]:
    return _power_tables(_TABLE)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.full(n, _BASE, np.uint64).cumprod(), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64).cumprod()


def _sums(words: list[list[str]], known: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Over the words of several texts in a row: running sums of their hashes times powers of a base, and the inverse powers. Any run of words
    is hashed from two sums, and alike wherever it stands."""
    return _running(np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, sum(map(len, words))))


def _running(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(h)
    forth, back = _table() if n <= _TABLE else _power_tables(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(h * forth[:n], out=sums[1:])
    return sums, back[:n]


_WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SPACE = np.array([chr(b).isspace() and b < 128 for b in range(256)])
_VALUES = np.where(_SPACE, np.uint64(0), FOLDED ^ mix64(np.arange(256, dtype=np.uint64)))  # of a byte in the hash of its word; A is not a


def text_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (as of ``str.split``) of several texts in a row, and how many each text has. All words are hashed at once, from
    running sums over the bytes of the texts."""
    raws = [(t if t.isascii() else _WIDE_SPACE.sub(" ", t)).encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n" + b"\n".join(raws) + b"\n", np.uint8)
    space = _SPACE[data]
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    begin, end = edges[::2], edges[1::2]
    sums, back = _running(_VALUES[data])
    last = np.cumsum([len(r) + 1 for r in raws])  # where the texts end
    return mix64((sums[end] - sums[begin]) * back[begin]), np.diff(np.searchsorted(begin, last), prepend=0)


def _of_size(sums: np.ndarray, back: np.ndarray, k: int) -> np.ndarray:
    return mix64((sums[k:] - sums[:-k]) * back[:len(back) - k + 1]) if len(back) >= k else np.empty(0, np.uint64)


def word_runs(text: str, sizes: tuple[int, ...], known: dict[str, int]) -> list[np.ndarray]:
    """For each size the hashes of all runs of so many words, by their first word."""
    sums, back = _sums([text.split()], known)
    return [_of_size(sums, back, k) for k in sizes]


def _slide(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """``best`` over every ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = best(x[:-step], x[step:])
        done += step
    return x


def word_marks(texts: list[str], gram_words: int, guarantee_words: int) -> tuple[np.ndarray, ...]:
    """The chosen grams of texts: number of the text, hash, hash of the surroundings, place, and the last start of a run of ``guarantee_words``
    words that holds the gram. A gram is chosen if it has the smallest hash in one of these runs. Its surroundings are all words of such runs
    around it, fewer where the text begins or ends within them."""
    width = guarantee_words - gram_words + 1
    hashes, sizes = text_words(texts)
    sums, back = _running(hashes)
    ends = np.cumsum(sizes)
    if len(back) < guarantee_words:
        return (np.empty(0, np.int64), *[np.empty(0, np.uint64)] * 2, *[np.empty(0, np.int64)] * 2)
    grams = _of_size(sums, back, gram_words)
    left = np.repeat(ends, sizes) - np.arange(len(back))  # words from here to the end of the text
    picks = np.where(left[:len(back) - guarantee_words + 1] >= guarantee_words, _slide(grams, width, np.minimum), np.uint64(0))
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, picks, edge]), width, np.maximum) == grams)
    text = np.searchsorted(ends, at, side="right")
    begin, end = (ends - sizes)[text], ends[text]
    lo, hi = np.maximum(at - width + 1, begin), np.minimum(at + guarantee_words, end)
    around = mix64((sums[hi] - sums[lo]) * back[lo])
    shape = ((at - lo) * (guarantee_words + 1) + hi - at).astype(np.uint64)
    return text, grams[at], mix64(around + shape * np.uint64(_BASE)), at - begin, np.minimum(at, end - guarantee_words) - begin


def seen_before(text: np.ndarray, g: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which grams, in the order of their texts and places, stand earlier in the same text in the same surroundings."""
    again = np.zeros(len(text), dtype=bool)
    keys = c ^ (text.astype(np.uint64) * np.uint64(_BASE))
    twins = np.sort(keys)
    twins = twins[1:][twins[1:] == twins[:-1]]
    if not len(twins):
        return again
    some = np.flatnonzero(np.isin(keys, twins))
    order = some[np.lexsort((c[some], g[some], text[some]))]  # stable: the first place comes first
    a, b = order[:-1], order[1:]
    again[b] = (text[a] == text[b]) & (g[a] == g[b]) & (c[a] == c[b])
    return again


def joined_ranges(text: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ranges (both ends included) of each text, in order of place, as few: those that overlap or touch become one."""
    new = np.ones(len(text), dtype=bool)
    new[1:] = (text[1:] != text[:-1]) | (start[1:] > end[:-1] + 1)
    return text[new], start[new], end[np.append(new[1:], True)[:len(new)]]


_MARKS = "doc_id long, h long, marks array<struct<g:long,c:long,at:int,last:int>>, again array<struct<s:int,last:int>>"


def _per_text(text: np.ndarray, n: int, **columns: np.ndarray) -> pa.ListArray:
    ends = np.searchsorted(text, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(c) for c in columns.values()], names=list(columns)))


def _marked(gram_words: int, guarantee_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256, _SLICE):
                ids, hs, texts = part.columns
                text, g, c, at, last = word_marks(texts.to_pylist(), gram_words, guarantee_words)
                again = seen_before(text, g, c)
                one = ~again
                marks = _per_text(text[one], len(texts), g=g[one].view(np.int64), c=c[one].view(np.int64), at=at[one].astype(np.int32), last=last[one].astype(np.int32))
                of, s, e = joined_ranges(text[again], np.maximum(at[again] - (guarantee_words - gram_words), 0), last[again])
                ranges = _per_text(of, len(texts), s=s.astype(np.int32), last=e.astype(np.int32))
                yield pa.RecordBatch.from_arrays([ids, hs, marks, ranges], names=["doc_id", "h", "marks", "again"])

    return run


def _windows(gram_words: int, guarantee_words: int):
    reach = np.arange(guarantee_words - gram_words + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256, _SLICE):
                ids, hs, texts, marks = part.columns
                hashes, sizes = text_words(texts.to_pylist())
                whole = _of_size(*_running(hashes), guarantee_words)
                ends = np.cumsum(sizes)
                text = np.repeat(np.arange(len(texts)), marks.value_lengths().to_numpy(zero_copy_only=False))
                begin, last = (ends - sizes)[text, None], (ends - guarantee_words)[text, None]
                starts = begin + np.subtract.outer(marks.flatten().to_numpy().astype(np.int64), reach)
                here = np.zeros(len(whole), dtype=bool)
                here[starts[(starts >= begin) & (starts <= last)]] = True
                place = np.flatnonzero(here)
                row = np.searchsorted(ends, place, side="right")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(whole[place].view(np.int64)), ids.take(pa.array(row)), hs.take(pa.array(row)),
                     pa.array((place - (ends - sizes)[row]).astype(np.int32))], names=["w", "doc_id", "h", "at"])

    return run


def repeated_passages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram_words: int = PASSAGE_GRAM_WORDS,
                      guarantee_words: int = GUARANTEE_WORDS) -> DataFrame:
    """(doc_id, h, starts): ranges of first words (both ends included) of all runs of ``guarantee_words`` words of a document that stand earlier; h is
    xxhash64 of the text. The result is the same for every ``gram_words``.

    A chosen gram meets the first place with the same gram in the same surroundings: all runs around it stand there. Where that happens within one
    document, as in words that repeat over and over, it is seen at once, so a document has one mark a gram and surroundings. The first place of each
    surroundings is left; if its gram has others too, they may agree in part, and the at most ``guarantee_words - gram_words + 1`` runs around it
    meet by their own hashes. So every run with an earlier copy is found, and copies cost no row for each run. Grams and runs with very many
    places (`split_hot`) are pre-aggregated; the places of all others are ordered in the tasks that they are shuffled to."""
    gram_words = min(gram_words, guarantee_words)
    base = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("h"), F.col(f"`{text}`").alias("text"))
    base = base.filter("text is not null")
    order = [F.col("doc_id").isNull(), F.col("doc_id"), F.col("h"), F.col("at")]
    place = F.struct(order[0].alias("n"), *order[1:])

    every = written(base.mapInArrow(_marked(gram_words, guarantee_words), _MARKS).filter("size(marks) > 0"), "word-marks")
    marks = every.select("doc_id", "h", F.inline("marks"))
    grams = written(marks.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "word-grams")
    few, many = split_hot(grams, "g")
    begin = F.greatest(F.lit(0), F.col("at") - (guarantee_words - gram_words)).alias("s")
    columns = ["doc_id", "h", "at", begin, "last", "later", "several"]
    again = every.select("doc_id", "h", F.inline("again")).select(
        "doc_id", "h", F.lit(None).cast("int").alias("at"), "s", "last", F.lit(True).alias("later"), F.lit(False).alias("several"))
    usual = marks.join(F.broadcast(few), "g", "left_anti").join(many, "g")
    usual = usual.withColumn("later", F.rank().over(W.partitionBy("g", "c").orderBy(*order)) > 1)
    usual = usual.withColumn("several", F.min("c").over(W.partitionBy("g")) != F.max("c").over(W.partitionBy("g")))
    hot = often = written(marks.join(F.broadcast(few), "g"), "word-marks-hot")
    around = written(hot.groupBy("g", "c").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")), "word-surroundings")
    various = around.groupBy("g").agg((F.min("c") != F.max("c")).alias("several"))  # no more rows than `few`
    hot = meeting(hot, around, ["g", "c"]).withColumn("later", place != F.col("first")).join(F.broadcast(various), "g")
    twice = usual.select(*columns).unionByName(hot.select(*columns)).filter("later or several")
    twice = written(twice.unionByName(again), "word-marks-twice", hash_joins=True)
    discard(every, grams, often, around)

    parts = twice.filter("several and not later").groupBy(F.col("doc_id").alias("d"), F.col("h").alias("dh")).agg(F.collect_set("at").alias("marks"))
    both = base.join(parts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("dh"))).select("doc_id", "h", "text", "marks")
    windows = written(both.mapInArrow(_windows(gram_words, guarantee_words), "w long, doc_id long, h long, at int"), "word-windows", hash_joins=True)
    runs = written(windows.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "word-runs")
    few, many = split_hot(runs, "w")
    usual = windows.join(F.broadcast(few), "w", "left_anti").join(many, "w")
    usual = usual.withColumn("r", F.rank().over(W.partitionBy("w").orderBy(*order))).filter("r > 1")
    hot = windows.join(F.broadcast(few), "w")
    hot = hot.join(F.broadcast(hot.groupBy("w").agg(F.min(place).alias("first"))), "w").filter(place != F.col("first"))
    start = [F.col("at").alias("s"), F.col("at").alias("e")]
    same = twice.filter("later").select("doc_id", "h", "s", F.col("last").alias("e"))
    found = same.unionByName(usual.select("doc_id", "h", *start)).unionByName(hot.select("doc_id", "h", *start))
    found = written(found.groupBy("doc_id", "h").agg(F.collect_set(F.struct("s", "e")).alias("starts")), "word-ranges", hash_joins=True)
    discard(twice, windows, runs)
    return found


def _covered(starts: list, lines: list[tuple[int, int]], n_words: int, guarantee_words: int) -> np.ndarray:
    """Which words lie in the runs that begin within ``starts`` or in ``lines``, the words of repeated runs of lines. Where a repeated run of lines with
    ``guarantee_words`` words ends at a line break in both copies, fewer than EDGE_WORDS words beyond it agree by chance and stay."""
    cover = np.zeros(n_words, dtype=bool)
    runs: list[list[int]] = []
    for s, e in sorted(starts):
        if runs and s <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], e + guarantee_words)
        else:
            runs.append([s, e + guarantee_words])
    whole = sorted({(a, b) for a, b in lines if b - a >= guarantee_words})
    left, right = [a for a, _ in whole], sorted(b for _, b in whole)
    for s, e in runs:
        i, j = bisect_left(left, s), bisect_right(right, e) - 1
        if i < len(left) and left[i] - s < EDGE_WORDS:
            s = left[i]
        if j >= 0 and e - right[j] < EDGE_WORDS:
            e = right[j]
        cover[s:e] = True
    for a, b in lines:
        cover[a:b] = True
    return cover


def _cut(line: str, cover: np.ndarray) -> str:
    """The line without its covered words and the white space after them, or before them at its end."""
    out, at = [], 0
    found = [m.span() for m in re.finditer(r"\S+", line)]
    for i, (s, _) in enumerate(found):
        if cover[i] and (i == 0 or not cover[i - 1]):
            out.append(line[at:s])
        if cover[i]:
            at = found[i + 1][0] if i + 1 < len(found) else len(line)
    kept = "".join(out) + line[at:]
    return kept.rstrip() if cover[-1] else kept


def without(text: str, ranges: list, starts: list, guarantee_words: int = GUARANTEE_WORDS) -> tuple[str, int, int, str]:
    """The text without the units in ``ranges`` and the runs of words that begin within ``starts``; units deleted whole and words deleted; the deleted
    line numbers as ``first-last`` runs."""
    at, _, words = line_units(text)
    first = np.concatenate([[0], np.cumsum(words)]).astype(int)
    cover = _covered([(r["s"], r["e"]) for r in starts], [(first[r["s"]], first[r["e"]]) for r in ranges], sum(words), guarantee_words)
    gone = [u for u in range(len(at)) if cover[first[u]:first[u + 1]].all()]
    drop = {at[u] for u in gone}
    for a, b in zip(gone, gone[1:], strict=False):
        if b == a + 1:
            drop.update(range(at[a] + 1, at[b]))
    runs: list[list[int]] = []
    for x in sorted(drop):
        if runs and runs[-1][1] == x - 1:
            runs[-1][1] = x
        else:
            runs.append([x, x])
    lines = text.split("\n")
    for u, i in enumerate(at):
        if i not in drop and cover[first[u]:first[u + 1]].any():
            lines[i] = _cut(lines[i], cover[first[u]:first[u + 1]])
    kept = "" if len(gone) == len(at) else "\n".join(line for i, line in enumerate(lines) if i not in drop)
    return kept, len(gone), int(cover.sum()), ",".join(f"{a}-{b}" for a, b in runs)


CLEANED = "struct<text:string,n_removed:long,words_removed:long,removed:string>"


def _cleaner(guarantee_words: int):
    def clean(text: pd.Series, ranges: pd.Series, starts: pd.Series) -> pd.DataFrame:
        rows = [(None, 0, 0, "") if t is None or r is None or not len(r) + len(s) else without(t, r, s, guarantee_words)
                for t, r, s in zip(text, ranges, starts, strict=True)]
        return pd.DataFrame(rows, columns=["text", "n_removed", "words_removed", "removed"])

    return F.pandas_udf(clean, CLEANED)


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", gram_words: int = GRAM_WORDS,
                guarantee_words: int = GUARANTEE_WORDS) -> DataFrame:
    """``docs`` with all its columns, ``text`` without later repeated runs, and __removed, __words_removed, __removed_lines.

    Runs of lines go whole; a run of ``guarantee_words`` words that begins or ends inside a line is cut out of it. __removed and __removed_lines
    count lines that went whole, __words_removed all words.

    Null texts stay null and empty ones empty; a document whose lines are all repeated becomes empty. Rows equal in doc_id and text are one
    document and stay alike; rows that share only the doc_id are two, in order of a hash of their text. Null doc_ids come last. An empty table gives
    no rows. Texts shorter than ``guarantee_words`` words neither lose nor lend lines. Other columns pass through, whatever their names."""
    runs = repeated_runs(docs, doc_id, text, gram_words, guarantee_words).withColumn("starts", F.lit(None).cast("array<struct<s:int,e:int>>"))
    passages = repeated_passages(docs, doc_id, text, guarantee_words=max(gram_words, guarantee_words)).withColumn("ranges", F.lit(None).cast(runs.schema["ranges"].dataType))
    runs = runs.unionByName(passages).groupBy(F.col("doc_id").alias("__d"), F.col("h").alias("__h")).agg(
        F.flatten(F.collect_list("ranges")).alias("__ranges"), F.flatten(F.collect_list("starts")).alias("__starts"))
    column = F.col(f"`{text}`")
    joined = docs.join(runs.hint("shuffle_hash"), F.col(f"`{doc_id}`").eqNullSafe(F.col("__d")) & (F.xxhash64(column) == F.col("__h")), "left")
    cleaned = _cleaner(max(gram_words, guarantee_words))(F.when(F.col("__ranges").isNotNull(), column), F.col("__ranges"), F.col("__starts"))
    out = joined.withColumn("__c", cleaned)
    kept = F.when(F.col("__ranges").isNull(), column).otherwise(F.col("__c.text"))
    return out.select(*[kept.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
                      F.col("__c.n_removed").alias("__removed"), F.col("__c.words_removed").alias("__words_removed"),
                      F.col("__c.removed").alias("__removed_lines"))
