"""Target-distribution importance resampling.

Hashed word runs of a corpus and of a target collection are counted by bucket. A bucket's gain is the log ratio of its smoothed
shares; gains fill one array of ``buckets`` numbers, and a document's weight is the mean of the array at its features. Gumbel noise
drawn from the id makes the highest scores a sample without replacement by weight.

The cutoff is found exactly by weighted median-of-medians: each task gives the median of the keys that are still open and how many
there are; at least a quarter of all open keys lies on either side of the median of those medians, weighted by the counts, so
each pass discards that part for sure, until the pivot is the key of the wanted rank. The driver sees a few numbers a task. Open keys are
written anew when few of the written ones are left, so all passes together read about as much as the first few. Only the winners are sorted."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import internal, written
from .scans import scanned

BUCKETS = 10_000
MAX_RUN = 1
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
SLICE = 1 << 20
MEMORY = 300_000
# A-Z count as a-z; digits, letters and all that is not ASCII are kept; all else parts words.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


class Features:
    """Text -> (number of words, buckets, counts) of its runs of 1 to ``longest`` words."""

    def __init__(self, buckets: int, longest: int) -> None:
        self.buckets, self.longest, self.known = buckets, longest, {}

    def _of(self, runs: list[bytes]) -> np.ndarray:
        known = self.known
        try:
            return np.fromiter(map(known.__getitem__, runs), np.int64, len(runs))
        except KeyError:
            if len(known) > MEMORY:
                known.clear()
            known.update((r, zlib.crc32(r) % self.buckets) for r in set(runs) if r not in known)
            return np.fromiter(map(known.__getitem__, runs), np.int64, len(runs))

    def __call__(self, text: str) -> tuple[int, np.ndarray, np.ndarray]:
        raw, at, n, found, held = text.encode("utf-8", "surrogatepass").translate(_FOLD), 0, 0, [], []
        while at < len(raw):
            end = raw.find(b" ", at + SLICE)
            end = len(raw) if end < 0 else end
            words = raw[at:end].split()
            n += len(words)
            found.append(self._of(words))
            run = held + words  # longer runs begin in what the slice before left
            for k in range(2, self.longest + 1):
                found.append(self._of([b" ".join(run[i:i + k]) for i in range(max(0, len(held) - k + 1), len(run) - k + 1)]))
            held = run[max(0, len(run) - self.longest + 1):] if self.longest > 1 else []
            at = end
        return n, *np.unique(np.concatenate(found) if found else np.empty(0, np.int64), return_counts=True)


FEATURES = "n_words long, n_features long, at binary, n binary"


def features(rows: DataFrame, buckets: int = BUCKETS, longest: int = MAX_RUN) -> DataFrame:
    """``rows`` (their last column the text) with n_words, n_features and the sparse array of bucket counts (at, n: little-endian 32-bit and 64-bit
    numbers) in place of the text."""
    keep = rows.columns[:-1]
    schema = ", ".join([*[f"`{c}` {dict(rows.dtypes)[c]}" for c in keep], FEATURES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features(buckets, longest)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                part = batch.slice(lo, 1024)
                found = [of(t.as_py() or "") for t in part.column(part.num_columns - 1)]
                yield pa.RecordBatch.from_arrays([
                    *part.columns[:-1], pa.array([n for n, _, _ in found], pa.int64()), pa.array([int(c.sum()) for _, _, c in found], pa.int64()),
                    pa.array([b.astype("<u4").tobytes() for _, b, _ in found], pa.binary()),
                    pa.array([c.astype("<i8").tobytes() for _, _, c in found], pa.binary())],
                    names=[*keep, "n_words", "n_features", "at", "n"])

    return rows.mapInArrow(run, schema)


def bucket_totals(counted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences by bucket over all rows of `features`: one array a task, summed by bucket; ``buckets`` numbers reach the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for at, n in zip(batch.column(0), batch.column(1), strict=True):
                total[np.frombuffer(at.as_py(), "<u4")] += np.frombuffer(n.as_py(), "<i8")
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    sums = counted.select("at", "n").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for bucket, n in sums.collect():
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln(target share / corpus share)) by bucket, one added to every count."""
    b, s_all, t_all = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((float(t) + 1) * (s_all + b) / ((float(s) + 1) * (t_all + b))))
                     for s, t in zip(corpus, target, strict=True)], dtype=np.int64)


def weighed(counted: DataFrame, gain: np.ndarray) -> DataFrame:
    """The other columns of `features` with weight: the floored mean gain of a row's features, 0 without any."""
    keep = [c for c in counted.columns if c not in ("at", "n")]
    kinds = dict(counted.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            weight = []
            for at, n, all_n in zip(column["at"], column["n"], column["n_features"].to_pylist(), strict=True):
                total = int(gain[np.frombuffer(at.as_py(), "<u4")] @ np.frombuffer(n.as_py(), "<i8")) if all_n else 0
                weight.append(total // all_n if all_n else 0)
            yield pa.RecordBatch.from_arrays([*[column[c] for c in keep], pa.array(weight, pa.int64())], names=[*keep, "weight"])

    return counted.mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], "weight long"]))


def noise(row_id: Column, seed: int = SEED) -> Column:
    """floor(1000 x a standard Gumbel draw) from a hash of the id, the same in every run."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(row_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


KEY = ("score", "later", "doc_id", "row")  # higher score, an id before none, smaller id, smaller row


def _codes(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
    """Columns that ascend from the best key to the worst."""
    parts = [[c.to_numpy(zero_copy_only=False).astype(np.int64) for c in b.columns] for b in batches if b.num_rows]
    columns = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 4
    return [-columns[0], *columns[1:]]


def _below(codes: list[np.ndarray], key: tuple[int, ...], equal: bool) -> np.ndarray:
    """Which keys come before ``key`` (or are it)."""
    out = np.full(len(codes[0]), equal)
    for c, k in zip(reversed(codes), reversed(key), strict=True):
        out = (c < k) | ((c == k) & out)
    return out


MEDIANS = "side int, n long, a long, b long, c long, d long"


def _medians(low: tuple | None, pivot: tuple | None, high: tuple | None):
    """For one task: of the open keys before and behind the pivot, how many there are and the median of each side."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = _codes(batches)
        open_ = np.ones(len(codes[0]), dtype=bool)
        if low is not None:
            open_ &= ~_below(codes, low, equal=True)
        if high is not None:
            open_ &= _below(codes, high, equal=False)
        before = _below(codes, pivot, equal=False) if pivot is not None else np.ones(len(open_), dtype=bool)
        behind = ~_below(codes, pivot, equal=True) if pivot is not None else np.zeros(len(open_), dtype=bool)
        for side, chosen in ((0, open_ & before), (1, open_ & behind)):
            rows = [c[chosen] for c in codes]
            if len(rows[0]):
                at = np.lexsort(rows[::-1])[(len(rows[0]) - 1) // 2]
                values = [[side], [len(rows[0])], *[[int(c[at])] for c in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32() if i == 0 else pa.int64()) for i, v in enumerate(values)],
                                                 names=["side", "n", "a", "b", "c", "d"])

    return run


def _middle(found: list[tuple[int, tuple[int, ...]]]) -> tuple[int, ...] | None:
    """The weighted median of (weight, key)."""
    found, half, seen = sorted(found, key=lambda x: x[1]), sum(n for n, _ in found) / 2, 0
    for n, key in found:
        seen += n
        if seen >= half:
            return key
    return None


def cutoff(keys: DataFrame, k: int) -> tuple[int, ...] | None:
    """The k-th key (1, 2, ...) of ``keys`` (columns KEY, longs without nulls, together unique); none if there is none."""
    def passed(rows: DataFrame, low, pivot, high) -> tuple[list[int], list]:
        found = rows.select(*KEY).mapInArrow(_medians(low, pivot, high), MEDIANS).collect()
        sides = [[(r["n"], tuple(r)[2:]) for r in found if r["side"] == s] for s in (0, 1)]
        return [sum(n for n, _ in s) for s in sides], [_middle(s) for s in sides]

    (n, _), (pivot, _) = passed(keys, None, None, None)
    low = high = None
    in_file, before = n, 0  # keys in the file that is read; open keys' predecessors that were discarded
    if not 0 < k <= n:
        return None
    while True:
        (less, more), medians = passed(keys, low, pivot, high)
        if k == before + less + 1:
            return pivot
        if k <= before + less:
            high, pivot, n = pivot, medians[0], less
        else:
            low, pivot, n, before = pivot, medians[1], more, before + less + 1
        if 4 * n < in_file:  # scores bound the open keys from both sides; ties are told apart in the passes
            kept = keys.filter(f"score <= {-low[0]}") if low else keys
            keys = written(kept.filter(f"score >= {-high[0]}") if high else kept, "resample-open")
            in_file = n


def resample(docs: DataFrame, target: DataFrame, percent: float = PERCENT, min_words: int = MIN_WORDS, buckets: int = BUCKETS,
             longest: int = MAX_RUN, seed: int = SEED, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank for every row of ``docs``; rank (1, 2, ...) only for those drawn: of the rows with at
    least ``min_words`` words, the floor(percent %) highest scores, ties to the smaller doc_id, an id before none, then to either row.

    Null and empty texts have no features, weight 0, and are not drawn; rows without doc_id share one noise; repeated rows are rows
    of their own; an empty table gives no rows, and against an empty target every bucket's target count is 0. Other columns are ignored."""
    base = internal(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counted = written(features(base, buckets, longest), "resample-features")
    wanted = features(internal(target, text=target_text).select(F.col("text").cast("string")), buckets, longest)
    gain = gains(bucket_totals(counted, buckets), bucket_totals(wanted, buckets))
    rows = weighed(counted, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "resample-scores")
    open_ = rows.filter(F.col("n_words") >= min_words)
    keyed = open_.select("score", F.col("doc_id").isNull().cast("long").alias("later"), F.coalesce("doc_id", F.lit(0).cast("long")).alias("doc_id"), "row")
    last = cutoff(keyed, int(open_.count() * percent // 100))
    columns = ["doc_id", "n_words", "n_features", "weight", "score"]
    if last is None:
        return rows.select(*columns, F.lit(None).cast("long").alias("rank"))
    worst = (-last[0], *last[1:])
    key = [F.col("score"), F.col("doc_id").isNull().cast("long"), F.coalesce("doc_id", F.lit(0)), F.col("row")]
    drawn = key[3] <= worst[3]
    for column, value in ((key[2], worst[2]), (key[1], worst[1])):
        drawn = (column < value) | ((column == value) & drawn)
    drawn = (F.col("n_words") >= min_words) & ((key[0] > worst[0]) | ((key[0] == worst[0]) & drawn))
    winners = rows.filter(drawn).withColumn("all", F.lit(0).cast("long"))
    ranked = scanned(winners, "all", [F.desc("score"), F.asc_nulls_last("doc_id"), F.col("row")], "resample-winners")
    others = rows.filter(~drawn).withColumn("rank", F.lit(None).cast("long"))
    return ranked.select(*columns, "rank").unionByName(others.select(*columns, "rank"))
