"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are normalised and turned into the principal axes of a bounded sample; a rotation leaves every product as it is. They are ordered
along the first axis and cut into blocks, and block pairs whose intervals there lie too far apart for the threshold are not compared. A
tile compares two blocks: the products over the leading axes come first, the rest is bounded by the product of the suffix norms, and only
pairs that can still reach the threshold are carried on. The comparison is exact whatever the sample was.

A tile returns a row per vector (its number of links and its root in the tile), never pairs. Blocks hold 10 sqrt(n) vectors, so that both the tile and the
number of copies of a vector grow with the root of the input only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, internal, written

THRESHOLD = 0.9
SAMPLE = 8192
LEAD = 16
STRIP = 256
SLACK = 1e-9


def axes(sample: np.ndarray) -> np.ndarray:
    """Principal axes, strongest first, as columns of an orthogonal matrix."""
    values, vectors = np.linalg.eigh(sample.T @ sample)
    return vectors[:, np.argsort(-values)]


def _matrix(column: pa.Array, rows: np.ndarray) -> np.ndarray:
    lists = column.take(pa.array(rows))
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled first, so that very large and very small components neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(column: pa.Array) -> np.ndarray:
    """False for null vectors, empty ones, zero ones, and those with a null or non-finite component."""
    out = np.zeros(len(column), dtype=bool)
    for i, v in enumerate(column):
        if v.is_valid and len(v.values):
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            out[i] = np.isfinite(x).all() and np.any(x)
    return out


def compare(x: np.ndarray, y: np.ndarray, threshold: float, lead: int = LEAD) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Strips of (rows of x, rows of y) whose product is at least ``threshold``; rows are unit vectors on principal axes."""
    d = x.shape[1]
    stages = [*range(lead, d, lead), d] if d > lead else [d]
    tail = lambda z, a: np.sqrt((z[:, a:] ** 2).sum(axis=1))
    tails = [(tail(x, a), tail(y, a)) for a in stages]
    for lo in range(0, len(x), STRIP):
        part = x[lo:lo + STRIP]
        a = stages[0]
        dot = part[:, :a] @ y[:, :a].T
        bound = dot + tails[0][0][lo:lo + STRIP, None] * tails[0][1][None, :]
        r, c = np.nonzero(bound >= threshold - SLACK)
        found = dot[r, c]
        for k in range(1, len(stages)):
            if not len(r):
                break
            b = stages[k]
            found = found + np.einsum("ij,ij->i", part[r, a:b], y[c, a:b])
            a = b
            alive = found + tails[k][0][lo + r] * tails[k][1][c] >= threshold - SLACK
            r, c, found = r[alive], c[alive], found[alive]
        exact = found >= threshold
        close = np.abs(found - threshold) < SLACK
        if close.any():
            exact[close] = (part[r[close]] * y[c[close]]).sum(axis=1) >= threshold
        if exact.any():
            yield lo + r[exact], c[exact]


class Forest:
    """Roots of linked rows, joined for many pairs at once; a root is the smallest row."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if np.array_equal(up, self.parent):
                return up
            self.parent = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            root = self.roots()
            ra, rb = root[a], root[b]
            apart = ra != rb
            if not apart.any():
                return
            np.minimum.at(self.parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])


def _tile(threshold: float, rotation: dict[int, np.ndarray]):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        c, n, block, other = (table.column(k).to_numpy() for k in ("c", "n", "block", "other"))
        vectors = table.column("embedding").combine_chunks()
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        sizes = np.asarray(vectors.value_lengths())
        order = np.lexsort((c, block))
        ids, links, roots = [], [], []
        for d in np.unique(sizes):
            rows = order[sizes[order] == d]
            x = unit(_matrix(vectors, rows)) @ rotation.get(int(d), np.eye(int(d)))
            weight, name = n[rows], c[rows]
            split = np.searchsorted(block[rows], block[rows].min(), side="right") if len(np.unique(block)) > 1 else len(rows)
            same = block[0] == other[0]
            if not same and split == len(rows):
                continue  # one of the two blocks has no vector of this length
            left, right, shift = (x, x, 0) if same else (x[:split], x[split:], split)
            forest, count = Forest(len(rows)), np.zeros(len(rows), dtype=np.int64)
            for r, s in compare(left, right, threshold):
                if same:
                    r, s = r[r != s], s[r != s]
                s = s + shift
                count += np.bincount(r, weights=weight[s], minlength=len(rows)).astype(np.int64)
                if not same:
                    count += np.bincount(s, weights=weight[r], minlength=len(rows)).astype(np.int64)
                forest.join(r, s)
            some = np.flatnonzero(count)
            ids.append(name[some])
            links.append(count[some])
            roots.append(name[forest.roots()[some]])
        cat = lambda parts: np.concatenate([*parts, np.empty(0, np.int64)]).astype(np.int64)
        return pa.table({"c": cat(ids), "links": cat(links), "root": cat(roots)})

    return run


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD,
                 sample: int = SAMPLE) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Two rows are linked if their cosine, in double precision, is at least ``threshold`` (above 0). Vectors that are null, empty, zero or hold null or
    non-finite components are linked with nothing, and so are vectors of different length and rows without vec_id (component null, kept).
    Equal vectors are one class that is compared once; each row still counts all others. Rows that share a vec_id share a component.
    ``sample`` bounds the vectors that the axes are fitted on; it decides speed only. An empty table gives no rows."""
    base = internal(vectors, vec_id=vec_id, embedding=embedding).select(F.col("vec_id").cast("long").alias("vec_id"),
                                                                       F.col("embedding").cast("array<double>").alias("embedding"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(usable(batch.column(1)))], names=["vec_id", "embedding", "ok"])

    rows = base.mapInArrow(check, "vec_id long, embedding array<double>, ok boolean")
    ok = F.col("ok") & F.col("vec_id").isNotNull()
    rows = rows.withColumn("c", F.when(ok, F.xxhash64("embedding"))).drop("ok")
    rows = written(rows, "vectors")
    classes = rows.filter("c is not null").groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("rep"),
                                                            F.first("embedding").alias("embedding"))
    classes = written(classes, "vector-classes")
    total = classes.count()
    share = min(1.0, sample / max(total, 1))
    drawn = classes.filter(F.pmod(F.xxhash64(F.lit(3), "c"), F.lit(1 << 30)) < max(1, int(share * (1 << 30)))).select("embedding").toPandas()
    by_length: dict[int, list] = {}
    for v in drawn["embedding"]:
        by_length.setdefault(len(v), []).append(v)
    rotation = {d: axes(unit(np.array(v, dtype=np.float64))) for d, v in by_length.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(1)
            sizes = np.asarray(column.value_lengths())
            first = np.zeros(len(column))
            for d in np.unique(sizes):
                at = np.flatnonzero(sizes == d)
                axis = rotation[int(d)][:, 0] if int(d) in rotation else np.eye(int(d))[:, 0]
                first[at] = unit(_matrix(column, at)) @ axis
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(first)], names=["c", "first"])

    placed = classes.select("c", "embedding").mapInArrow(place, "c long, first double")
    blocks = max(1, int(np.ceil(np.sqrt(total) / 10)))
    placed = written(placed, "vector-places")
    cuts = placed.agg(F.percentile_approx("first", [i / blocks for i in range(1, blocks)], 100 * blocks).alias("q")).first()["q"] if blocks > 1 else []
    cuts = sorted(set(cuts or []))  # one number for each block
    at = F.lit(0)
    for q in cuts:
        at = at + (F.col("first") > q).cast("int")
    placed = placed.withColumn("block", at)
    spans = placed.groupBy("block").agg(F.min("first").alias("lo"), F.max("first").alias("hi"))
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    right = spans.select(F.col("block").alias("b"), F.col("lo").alias("lo2"))
    near = spans.withColumn("b", F.explode(F.sequence(F.col("block"), F.lit(len(cuts))))).join(right, "b")
    near = near.filter(F.col("lo2") - F.col("hi") <= reach).select(F.col("block").alias("i"), F.col("b").alias("j"))
    near = written(near, "tiles")
    sides = near.select(F.col("i").alias("block"), F.col("j").alias("other"), "i", "j").unionByName(
        near.filter("i <> j").select(F.col("j").alias("block"), F.col("i").alias("other"), "i", "j"))
    tiles = placed.select("c", "block").join(sides, "block").join(classes.select("c", "n", "embedding"), "c")
    found = tiles.select("i", "j", "c", "n", F.col("block"), "other", F.col("embedding").cast("array<float>").alias("narrow"), "embedding")
    exact_floats = dict(vectors.dtypes)[embedding] == "array<float>"
    found = found.drop("embedding").withColumnRenamed("narrow", "embedding") if exact_floats else found.drop("narrow")
    found = found.groupBy("i", "j").applyInArrow(_tile(threshold, rotation), "c long, links long, root long")
    found = written(found, "vector-links")
    links = found.groupBy("c").agg(F.sum("links").alias("links"))
    name = classes.select("c", "rep")
    edges = found.filter("c <> root").select("c", "root").join(name, "c").join(name.toDF("root", "root_rep"), "root")
    edges = edges.select(F.col("rep").alias("a"), F.col("root_rep").alias("b"))
    known = rows.filter("c is not null").select("vec_id", "c").join(classes.select("c", "rep", "n"), "c")
    edges = edges.unionByName(known.filter("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b")))
    label = components(edges, "vectors").select(F.col("id").alias("vec_id"), "component")
    counted = classes.select("c", "n").join(links, "c", "left").select("c", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    out = rows.select("vec_id", "c").join(counted, "c", "left").join(label, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
