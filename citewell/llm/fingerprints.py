"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of sentences.

The pieces of a text partition it: a piece ends at a sentence end or after four words, a paragraph is a line, a section ends at
an empty line, before a heading, or after a paragraph whose digest says so (one in eight), so long texts without headings still
get sections that an edit elsewhere does not move. A node's digest is that of its children's digests; equal roots mean equal
texts, and from unequal ones only differing branches are followed down to the edit.

Written form: ``root/section:paragraph.leaves,paragraph.leaves;section:...`` in hex (32, 16, 16 and 6 digits each).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import internal, written

_PARAGRAPH = re.compile(r"[^\n]*\n|[^\n]+\Z")
_PIECE = re.compile(r"(?:[^\s.!?]{1,64}\s+){0,3}[^\s.!?]{0,64}[.!?]*\s*")


def _digest(data: bytes) -> bytes:
    return blake2b(data, digest_size=16).digest()


def fingerprint(text: str | None) -> str:
    """The tree of a text. Null and empty texts have a root and no branch."""
    sections: list[tuple[bytes, list[str]]] = []
    nodes: list[bytes] = []
    shown: list[str] = []

    def close() -> None:
        if nodes:
            sections.append((_digest(b"s" + b"".join(nodes)), shown.copy()))
            nodes.clear()
            shown.clear()

    for paragraph in _PARAGRAPH.findall(text or ""):
        if paragraph.startswith("#"):
            close()
        leaves = [_digest(p.encode("utf-8", "surrogatepass")) for p in _PIECE.findall(paragraph) if p]
        node = _digest(b"p" + b"".join(leaves))
        nodes.append(node)
        shown.append(node[:8].hex() + "." + "".join([x[:3].hex() for x in leaves]))
        if node[0] & 7 == 0 or not paragraph.strip():
            close()
    close()
    root = _digest(b"r" + b"".join(d for d, _ in sections)).hex()
    return root + "/" + ";".join(d[:8].hex() + ":" + ",".join(p) for d, p in sections)


def _branches(fp: str) -> tuple[str, list[tuple[str, list[str]]]]:
    root, _, rest = fp.partition("/")
    split = [s.partition(":") for s in rest.split(";")] if rest else []
    return root, [(d, p.split(",")) for d, _, p in split]


def _leaves(fp: str) -> list[str]:
    return [leaf[i:i + 6] for _, paragraphs in _branches(fp)[1] for p in paragraphs
            for leaf in (p.partition(".")[2],) for i in range(0, len(leaf), 6)]


def likeness(a: str, b: str) -> float:
    """Twice the common leaves over all leaves of two fingerprints; 1 for equal roots."""
    if a.partition("/")[0] == b.partition("/")[0]:
        return 1.0
    return _likeness(_leaves(a), _leaves(b))


def _likeness(x: list[str], y: list[str]) -> float:
    return 2.0 * (Counter(x) & Counter(y)).total() / (len(x) + len(y)) if x and y else 0.0


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """(section, paragraph) places of ``b`` that ``a`` does not hold. Branches with a digest known to ``a`` are not entered."""
    (root_a, tree_a), (root_b, tree_b) = _branches(a), _branches(b)
    if root_a == root_b:
        return []
    sections, paragraphs = {d for d, _ in tree_a}, {p.partition(".")[0] for _, ps in tree_a for p in ps}
    return [(i, j) for i, (d, ps) in enumerate(tree_b) if d not in sections
            for j, p in enumerate(ps) if p.partition(".")[0] not in paragraphs]


def edited(text: str, following: str) -> str:
    """The last third (code points, rounded down) replaced by as many from the start of the following text, or all of it."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


RESULT = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
          "near_next double")
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
_NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _row(doc_id, text: str, fp: str, following: str, following_fp: str) -> tuple:
    new = edited(text, following)
    new_fp = fp if new == text else fingerprint(new)
    return (doc_id, len(text), sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), fp, new_fp, likeness(fp, new_fp),
            likeness(fp, following_fp))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=_NAMES)


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted; every row but the last of its part meets its successor."""
    held, rows, weight = None, [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            for part, d, t in zip(*(c.to_pylist() for c in batch.slice(at, 128).columns), strict=True):
                fp = fingerprint(t)
                if held and held[0] == part:
                    rows.append(_row(*held[1:], t, fp))
                    weight += len(rows[-1][3])
                held = (part, d, t, fp)
                if len(rows) >= 256 or weight > 1 << 22:
                    if rows:
                        yield _batch(rows)
                    rows, weight = [], 0
    if rows:
        yield _batch(rows)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            rows = [_row(d, t, fingerprint(t), u, fingerprint(u))
                    for d, t, u in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns), strict=True)]
            if rows:
                yield _batch(rows)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fingerprint of every text. Null texts count as empty; repeated rows give repeated rows."""
    make = F.pandas_udf(lambda s: s.map(fingerprint), "string")
    rows = internal(docs, doc_id=doc_id, text=text)
    return rows.select("doc_id", make(F.coalesce("text", F.lit(""))).alias("fingerprint"))


def compare_with_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Every document beside its edited text and the next document in descending doc_id (after the last: the first).

    Null text is empty; null doc_ids come last; equal doc_ids are ordered by a hash of the text, and rows equal in both by chance,
    which does not change the result as a whole. A single document is its own next. An empty table gives no rows; other columns are ignored.

    doc_ids are cut into parts at quantiles; a part is sorted in one task and read as a stream, and only the two ends of each part are
    matched by a join. Texts are shuffled once."""
    spark = docs.sparkSession
    base = internal(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = parts or 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    cuts = base.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 50 * n).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))  # one number for each part
    keyed = base.withColumn("part", _part(F.col("doc_id"), cuts)).withColumn("h", F.xxhash64("text"))
    ordered = keyed.select("part", "doc_id", "text", "h").repartition("part").sortWithinPartitions(
        F.desc("part"), F.desc_nulls_last("doc_id"), F.desc("h"))
    inner = ordered.select("part", "doc_id", "text").mapInArrow(_within, RESULT)

    key = F.struct("doc_id", "h")  # nulls are the smallest
    ends = written(keyed.groupBy("part").agg(F.max(key).alias("head"), F.min(key).alias("tail")), "fingerprint-ends")
    line = W.partitionBy(F.lit(1)).orderBy(F.desc("part"))  # one row for each part
    whole = W.partitionBy(F.lit(1))
    start = F.max(F.struct("part", "head")).over(whole)["head"]
    ends = ends.select("tail", F.coalesce(F.lead("head").over(line), start).alias("head"))
    wanted = ends.select(F.explode(F.array("tail", "head")).alias("k")).select("k.*").distinct()
    wanted = wanted.select(F.col("doc_id").alias("d"), F.col("h").alias("g"))
    texts = keyed.join(F.broadcast(wanted), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("g")), "left_semi")
    texts = written(texts.select("doc_id", "h", "text").dropDuplicates(["doc_id", "h"]), "fingerprint-texts")
    own = texts.select(F.col("doc_id").alias("td"), F.col("h").alias("th"), "text")
    other = texts.select(F.col("doc_id").alias("nd"), F.col("h").alias("nh"), F.col("text").alias("following"))
    outer = ends.join(own, F.col("tail.doc_id").eqNullSafe(F.col("td")) & (F.col("tail.h") == F.col("th")))
    outer = outer.join(other, F.col("head.doc_id").eqNullSafe(F.col("nd")) & (F.col("head.h") == F.col("nh")))
    return inner.unionByName(outer.select("td", "text", "following").mapInArrow(_pairs, RESULT))


def _part(doc_id: Column, cuts: list[int]) -> Column:
    """Place of an id among sorted cuts, by halving; nulls come before all."""
    def place(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(doc_id >= F.lit(cuts[mid]), place(mid + 1, hi)).otherwise(place(lo, mid))

    return F.when(doc_id.isNull(), F.lit(-1)).otherwise(place(0, len(cuts)))
