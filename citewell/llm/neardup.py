"""Near-duplicates by circulant MinHash.

Shingles are permuted once (sigma); a second permutation pi is shifted by k places for coordinate k, so two permutations give the whole
signature: ``min over x of pi(sigma(x) - k mod 2^32)``. Signatures are cut into bands; documents that agree in a band are
candidates, and every link is confirmed on the full shingle sets.

Documents with the same set form a class and are compared once. Within a bucket, pairs are not enumerated: all classes are compared with
the bucket's hub, the class with the most bucket mates over all bands. A pair x, y of the bucket that this leaves in different components has one
end that is not linked with the hub h. By |x ^ y| = |x ^ h| + |y ^ h| - 2 |(x ^ h) & (y ^ h)| (^: symmetric difference) such a pair can only be a
link if the two differences from the hub have elements in common, and how many follows from their sizes. So these pairs are found by an equi-join on
the first elements of the differences (prefix filter), where independent edits share next to nothing, and no link is left out.
Links are edges of components; hubs and copies never gather in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, internal, slices, written
from .words import shingles, word_hashes

SHINGLE_WORDS = 5
SIMILARITY = 80  # percent
BANDS = 40
BAND_ROWS = 6
_BLOCK = 1 << 14
STAR_SAMPLE = 64  # members of a star that tell which elements are frequent there; this orders prefixes, it decides nothing
STAR_COMMON = 256


_NONE = np.empty(0, np.uint64)


def _sigma(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """One row of ``coordinates`` minima per set; no set may be empty."""
    out = np.empty((len(sets), coordinates), dtype=np.uint32)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (size == 0 or size + len(sets[end]) <= _BLOCK):
            size += len(sets[end])
            end += 1
        if end == at + 1:  # a set above the block is done in slices
            out[at] = np.min([_block([sets[at][a:a + _BLOCK]], coordinates)[0] for a in range(0, size, _BLOCK)], axis=0)
        else:
            out[at:end] = _block(sets[at:end], coordinates)
        at = end
    return out


def _block(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    place = _sigma((np.concatenate(sets) >> np.uint64(16)).astype(np.uint32))
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    out = np.empty((len(sets), coordinates), dtype=np.uint32)
    x, y = np.empty_like(place), np.empty_like(place)
    for k in range(coordinates):
        np.subtract(place, np.uint32(k), out=x)
        np.multiply(x, np.uint32(0x9E3779B1), out=x)
        np.right_shift(x, np.uint32(15), out=y)
        np.bitwise_xor(x, y, out=x)
        np.multiply(x, np.uint32(0x2C1B3C6D), out=x)
        np.right_shift(x, np.uint32(14), out=y)
        np.bitwise_xor(x, y, out=x)
        out[:, k] = np.minimum.reduceat(x, starts)
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A 64-bit key per band, different for equal values in different bands."""
    keys = np.arange(1, bands + 1, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93)
    keys = np.repeat(keys, len(signature), axis=0)
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    for j in range(rows):
        keys = (keys ^ parts[:, :, j]) * np.uint64(0xFF51AFD7ED558CCD)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def _class(shingle_set: np.ndarray) -> int:
    return int.from_bytes(blake2b(shingle_set.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(texts: list[str], n: int) -> Iterator[tuple[int, np.ndarray]]:
    for at, group in word_hashes(texts):
        for i, words in enumerate(group):
            yield at + i, shingles(words, n)


def _features(shingle_words: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 512):
                ids, texts = (c.to_pylist() for c in part.columns)
                sets = [s for _, s in _sets(texts, shingle_words)]
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(signatures(full, bands * rows), bands, rows).tolist() if full else ())
                yield pa.RecordBatch.from_arrays([
                    pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_class(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    names=["doc_id", "n", "c", "bands"])

    return run


def _confirm(shingle_words: int, similarity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: tuple[int | None, np.ndarray | None] = (None, None)
        for batch in batches:
            for part in slices(batch, 128):
                a, b, ta, tb = (c.to_pylist() for c in part.columns)
                left = [s for _, s in _sets(ta, shingle_words)]
                good = []
                for i, x in enumerate(left):
                    if kept[0] != b[i]:
                        kept = (b[i], next(_sets([tb[i]], shingle_words))[1])
                    y = kept[1]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= similarity * (len(x) + len(y) - both):
                        good.append((a[i], b[i]))
                if good:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*good, strict=True)], names=["a", "b"])

    return run


def prefixes(x: np.ndarray, h: np.ndarray, out: bool, similarity: int, common: np.ndarray = _NONE) -> tuple[np.ndarray, np.ndarray, int, float]:
    """Of the difference of x from its hub h, the elements that a partner must meet (as the end not linked with h, as the other end), the size of
    the difference, and how much of it x's own size does not allow for: two ends must share at least half of the sum of these.

    With q = (100 - s) / (100 + s), x and y are linked iff |x ^ y| <= q (|x| + |y|), and the end not linked with h has |x ^ h| > q (|x| + |h|).
    Elements come in one order for the whole star, the rarest first: those that h does not have, those that it has, and last the ``common``
    ones of the star by rising frequency."""
    delta, q = _difference(x, h), (100 - similarity) / (100 + similarity)
    if len(common) and len(delta):
        order = np.argsort(common)
        at = np.minimum(np.searchsorted(common[order], delta), len(common) - 1)
        rank = np.where(common[order][at] == delta, order[at], -1)
        delta = delta[np.argsort(rank, kind="stable")]
    free = len(delta) - q * len(x)
    least = lambda bound: max(1, int(np.ceil(bound / 2 - 1e-9)))
    right = len(delta) - least(free + q * len(h)) + 1
    left = len(delta) - least(free + 1 - q * len(x) * 100 / similarity) + 1 if out else 0
    return delta[:max(0, left)], delta[:max(0, right)], len(delta), free


def _difference(x: np.ndarray, h: np.ndarray) -> np.ndarray:
    return np.concatenate([np.setdiff1d(x, h, assume_unique=True), np.setdiff1d(h, x, assume_unique=True)])


def _frequent(shingle_words: int):
    """Of the sampled members of one star, the elements that several differences hold, by rising frequency."""
    def run(table: pa.Table) -> pa.Table:
        h = table.column("h")[0].as_py()
        hub = next(_sets([table.column("th")[0].as_py()], shingle_words))[1]
        found = [_difference(x, hub) for _, x in _sets(table.column("tc").to_pylist(), shingle_words)]
        elements, counts = np.unique(np.concatenate([*found, _NONE]), return_counts=True)
        order = np.argsort(counts, kind="stable")
        order = order[counts[order] > 1][-STAR_COMMON:]
        return pa.table({"h": pa.array([h], pa.int64()), "common": pa.array([elements[order].view(np.int64)], pa.list_(pa.int64()))})

    return run


def _deltas(shingle_words: int, similarity: int):
    kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.int64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 128):
                h, c, component, out, th, tc, common = (x.to_pylist() for x in part.columns)
                hubs, rows = {}, []
                for i, (_, x) in enumerate(_sets(tc, shingle_words)):
                    if h[i] not in hubs:
                        hubs[h[i]] = next(_sets([th[i]], shingle_words))[1]
                    known = np.array(common[i] or (), dtype=np.int64).view(np.uint64)
                    left, right, size, free = prefixes(x, hubs[h[i]], out[i], similarity, known)
                    rows.append((h[i], c[i], component[i], left.view(np.int64), right.view(np.int64), size, free))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                                     names=["h", "c", "component", "left", "right", "size", "free"])

    return run


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle_words: int = SHINGLE_WORDS,
                    similarity: int = SIMILARITY, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Texts are lower-cased (A-Z) and cut at ASCII white space; a document is the set of its distinct runs of ``shingle_words`` words (fewer
    words: the whole sequence). Two documents are linked if ``100 * intersection >= similarity * union``; component_id is the smallest
    doc_id reachable, kept marks the document that stays. Null, empty and blank texts have no shingle and are linked with nothing. Rows
    that share a doc_id are one document with several texts. Rows without doc_id are linked with nothing: component null, kept. An empty table gives no rows;
    other columns are ignored. A pair at the threshold shares a band with probability 1 - (1 - 0.8^6)^40 > 0.99999."""
    base = internal(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = written(base.mapInArrow(_features(shingle_words, bands, band_rows), "doc_id long, n long, c long, bands array<long>"), "shingles")
    usable = found.filter("doc_id is not null and c is not null")
    classes = written(usable.groupBy("c").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")
    members = usable.select("doc_id", "c").join(classes.select("c", "rep"), "c")

    rows = classes.select("c", "n", F.explode("bands").alias("bucket"))
    buckets = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("mates")).filter("mates > 1")
    mates = written(rows.join(buckets, "bucket"), "buckets")
    degree = mates.groupBy("c").agg(F.sum("mates").alias("degree"))
    mates = mates.join(degree, "c")
    hubs = mates.groupBy("bucket").agg(F.max(F.struct("degree", "c", "n")).alias("hub"))
    first = mates.join(hubs, "bucket").select("c", "n", F.col("hub.c").alias("other"), F.col("hub.n").alias("m"))
    wanted = _wanted(first, similarity)
    texts = written(_texts(base, classes, mates, shingle_words), "candidate-texts")
    links = written(_confirmed(wanted, texts, shingle_words, similarity), "links")

    # What a bucket still holds in different components.
    label = components(links, "classes").select(F.col("id").alias("c"), "component")
    placed = mates.filter("mates > 2").join(label, "c", "left").withColumn("component", F.coalesce("component", "c")).select("bucket", "c", "component")
    hub_label = label.select(F.col("c").alias("h"), F.col("component").alias("hc"))
    hub_of = hubs.select("bucket", F.col("hub.c").alias("h")).join(hub_label, "h", "left").select("bucket", "h", F.coalesce("hc", "h").alias("hc"))
    placed = placed.join(hub_of, "bucket").select("h", "c", "component", (F.col("component") != F.col("hc")).alias("out")).distinct()
    placed = written(placed, "stars")
    open_hubs = placed.filter("out").select("h").distinct()
    stars = placed.filter("c <> h").join(open_hubs, "h", "left_semi")
    hub_texts, own_texts = texts.select(F.col("c").alias("h"), F.col("text").alias("th")), texts.select("c", F.col("text").alias("tc"))
    sizes = stars.groupBy("h").agg(F.ceil(F.count(F.lit(1)) / STAR_SAMPLE).alias("step")).filter("step > 1")  # small stars need no order
    sample = stars.select("h", "c").join(sizes, "h").filter(F.pmod(F.xxhash64("c"), F.col("step")) == 0).join(hub_texts, "h").join(own_texts, "c")
    common = sample.select("h", "th", "tc").groupBy("h").applyInArrow(_frequent(shingle_words), "h long, common array<long>")
    deltas = stars.join(common, "h", "left").join(hub_texts, "h").join(own_texts, "c")
    deltas = deltas.select("h", "c", "component", "out", "th", "tc", "common").mapInArrow(
        _deltas(shingle_words, similarity), "h long, c long, component long, `left` array<long>, `right` array<long>, size long, free double")
    deltas = written(deltas, "star-differences")
    outside = deltas.select("h", F.posexplode("left").alias("j", "e"), F.col("c").alias("other"), F.col("component").alias("other_component"),
                            F.col("size").alias("other_size"), F.col("free").alias("other_free"))
    others = deltas.select("h", F.posexplode("right").alias("i", "e"), "c", "component", "size", "free")
    least = F.greatest(F.lit(1), F.ceil((F.col("free") + F.col("other_free")) / 2 - 1e-9))  # elements that a linked pair shares
    second = others.join(outside, ["h", "e"]).filter("component <> other_component")
    second = second.filter((F.col("i") <= F.col("size") - least) & (F.col("j") <= F.col("other_size") - least))
    second = second.select(F.least("c", "other").alias("a"), F.greatest("c", "other").alias("b")).distinct()
    more = _confirmed(second.join(wanted, ["a", "b"], "left_anti"), texts, shingle_words, similarity)

    rep = classes.select("c", "rep")
    linked = links.unionByName(more).join(rep.toDF("a", "ra"), "a").join(rep.toDF("b", "rb"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    edges = members.filter("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).unionByName(linked)
    label = components(edges, "documents").select(F.col("id").alias("doc_id"), "component")
    out = found.select("doc_id", F.col("n").alias("n_shingles")).join(label, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _wanted(pairs: DataFrame, similarity: int) -> DataFrame:
    """Distinct unordered pairs whose set sizes allow a link."""
    pairs = pairs.filter("c <> other").filter(100 * F.least("n", "m") >= similarity * F.greatest("n", "m"))
    return written(pairs.select(F.least("c", "other").alias("a"), F.greatest("c", "other").alias("b")).distinct(), "pairs")


def _texts(base: DataFrame, classes: DataFrame, mates: DataFrame, shingle_words: int) -> DataFrame:
    """(c, text): one text of each class that has a bucket mate."""
    needed = classes.join(mates.select("c").distinct(), "c", "left_semi").select("c", F.col("rep").alias("doc_id"))
    candidates = base.join(needed.select("doc_id").distinct(), "doc_id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 256):
                c = [_class(s) if len(s) else None for _, s in _sets(part.column(1).to_pylist(), shingle_words)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(c, pa.int64()), part.column(1)], names=["doc_id", "c", "text"])

    texts = candidates.mapInArrow(run, "doc_id long, c long, text string").join(needed, ["doc_id", "c"], "left_semi")
    return texts.select("c", "text").dropDuplicates(["c"])


def _confirmed(pairs: DataFrame, texts: DataFrame, shingle_words: int, similarity: int) -> DataFrame:
    left = texts.select(F.col("c").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("c").alias("b"), F.col("text").alias("tb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb")
    return both.mapInArrow(_confirm(shingle_words, similarity), "a long, b long")
