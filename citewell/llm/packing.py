"""Mixture-controlled packing.

Deficit round-robin over one token queue per source. In every round a source earns its quantum (window x its share of the
mixture); whole tokens are served and the fraction stays as its deficit, so after r rounds it has served exactly
min(its tokens, floor(r x quantum)). Rounds follow one another in one stream that is cut every ``window`` tokens. Deficits
thus carry over windows, and because served totals have a closed form, any task can start at any round without what other
tasks did: deficits carry over partitions too. Sources whose quantum is tiny save up and are served every few rounds.

The default mixture is the sources' own token shares: all queues end together, so every window holds the corpus mixture. A
source that ends early leaves its room to the others; only the last window of all is not full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import internal, running_total, written

WINDOW = 2048
MIN_PIECE = 64
END_ID = 1
TOKENIZER = "byte_bpe_50k.tiktoken"


def tokenizer_file(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_encoders: dict[str, object] = {}


def encoder(path: str | None = None):
    """Text -> ids of the public byte-level BPE vocabulary: ranks for speed, the same ids as the tokenizers file."""
    key = path or ""
    if key not in _encoders:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path or tokenizer_file(), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _encoders[key] = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


PIECE_CHARS = 1 << 20


def encode(text: str, path: str | None = None) -> np.ndarray:
    """ids of the whole text and the end id. A very long text is encoded in parts that end before a space which follows a
    letter and precedes a letter: there the vocabulary's splitting pattern always ends a token."""
    enc, parts, at = encoder(path), [], 0
    while len(text) - at > PIECE_CHARS:
        cut = at + PIECE_CHARS
        while cut < len(text) - 1 and not (text[cut] == " " and text[cut - 1].isalpha() and text[cut + 1].isalpha()):
            cut += 1
        if cut >= len(text) - 1:
            break
        parts.append(np.asarray(enc.encode_ordinary(text[at:cut]), dtype=np.uint32))
        at = cut
    parts.append(np.asarray([*enc.encode_ordinary(text[at:] if at else text), END_ID], dtype=np.uint32))
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


TOKENS = "part int, row long, doc_id long, source string, n long, q long, ids binary"


def tokenized(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """A row per document: its part (task), its place there, its ids as little-endian bytes, and how many tokens of its source
    come before it in this part."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, seen = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                piece = batch.slice(at, 256)
                known: dict[str, np.ndarray] = {}
                rows, ids = [], []
                for d, t, s in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    t = t or ""
                    if t not in known:
                        known[t] = encode(t, tokenizer)
                    tokens = known[t]
                    rows.append((row, d, s, len(tokens), seen.get(s, 0)))
                    ids.append(tokens.astype("<u2" if tokens.max() < 65536 else "<u4").tobytes())
                    seen[s] = seen.get(s, 0) + len(tokens)
                    row += 1
                r, d, s, n, q = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * len(r), pa.int32()), pa.array(r, pa.int64()), pa.array(d, pa.int64()), pa.array(s, pa.string()),
                    pa.array(n, pa.int64()), pa.array(q, pa.int64()), pa.array(ids, pa.binary())],
                    names=["part", "row", "doc_id", "source", "n", "q", "ids"])

    return docs.mapInArrow(run, TOKENS)


class Rounds:
    """The closed form of the round-robin, for arrays of rounds and sources."""

    def __init__(self, totals: list[int], shares: list[float], window: int, least: int = MIN_PIECE) -> None:
        self.totals = np.asarray(totals, dtype=np.int64)
        self.quantum = np.asarray(shares, dtype=np.float64) * window
        self.every = np.maximum(1, np.ceil(least / np.maximum(self.quantum, 1e-12))).astype(np.int64)

    def served(self, r: np.ndarray, s: int | slice = slice(None)) -> np.ndarray:
        """Tokens that source s has sent after r rounds; with all sources, one column each."""
        r = r[:, None] if isinstance(s, slice) else r
        steps = (r // self.every[s]) * self.every[s]
        return np.minimum(self.totals[s], np.floor(steps * self.quantum[s]).astype(np.int64))

    def round_of(self, s: int, q: int) -> int:
        """The round in which token q of source s is sent."""
        r = int(q / self.quantum[s]) // int(self.every[s]) * int(self.every[s]) if self.quantum[s] > 0 else 0
        at = lambda x: int(self.served(np.asarray([x]), s)[0])
        while at(r + 1) <= q:
            r += 1
        while r > 0 and at(r) > q:
            r -= 1
        return r

    def pieces(self, s: int, q: int, n: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(start, length, stream position) of tokens q..q+n of source s, one row per round with some, in bounded blocks."""
        first, last, out = self.round_of(s, q), self.round_of(s, q + n - 1), []
        for a in range(first, last + 1, 4096):
            r = np.arange(a, min(a + 4096, last + 1), dtype=np.int64)
            before, after = self.served(r), self.served(r + 1)
            own = before[:, s]
            position = before.sum(1) + (after - before)[:, :s].sum(1)
            lo, hi = np.maximum(own, q), np.minimum(after[:, s], q + n)
            some = hi > lo
            out.append(((lo - q)[some], (hi - lo)[some], (position + lo - own)[some]))
        return out


def _cut(start: np.ndarray, length: np.ndarray, position: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """Pieces cut again where they cross a window, and joined where two follow each other within one."""
    count = (position + length - 1) // window - position // window + 1
    row = np.repeat(np.arange(len(start)), count)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    sequence = (position // window)[row] + nth
    lo = np.maximum(position[row], sequence * window)
    hi = np.minimum((position + length)[row], (sequence + 1) * window)
    start, length, offset = start[row] + lo - position[row], hi - lo, lo - sequence * window
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = (sequence[1:] != sequence[:-1]) | (offset[1:] != offset[:-1] + length[:-1])
    at = np.flatnonzero(fresh)
    return start[at], np.add.reduceat(length, at), sequence[at], offset[at]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, window: int = WINDOW, shares: dict[str | None, float] | None = None, doc_id: str = "doc_id",
         text: str = "text", source: str = "source", tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (little-endian unsigned
    32-bit; null without ``with_ids``).

    ``shares``: the mixture by source (default: the sources' token shares; sources that are absent get what is left
    of the corpus after the others end). Null and empty texts are one end id; null source is a queue of its own; null or repeated doc_ids
    are packed row by row; an empty table gives no rows. Other columns are ignored. The queues follow the order of the input.
    The table of totals per part and source has one row per task and source; only totals per source reach the driver."""
    base = internal(docs, doc_id=doc_id, text=text, source=source)
    base = base.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string"))
    tokens = written(tokenized(base, tokenizer), "tokens")
    parts = tokens.groupBy("part", "source").agg(F.sum("n").alias("words"))
    parts = written(running_total(parts, ["source"], ["part"], "words", "base"), "token-parts")
    totals = parts.groupBy("source").agg(F.sum("words").alias("words")).orderBy(F.col("source").asc_nulls_last()).collect()
    whole = float(sum(r["words"] for r in totals)) or 1.0
    goal = [(shares or {}).get(r["source"], 0.0) if shares else r["words"] / whole for r in totals]
    floor = min([x for x in goal if x > 0], default=1.0) * 1e-3
    goal = [x if x > 0 else floor for x in goal]
    rounds = Rounds([r["words"] for r in totals], [x / sum(goal) for x in goal], window) if totals else None
    place = {r["source"]: i for i, r in enumerate(totals)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                columns: list[list] = [[] for _ in range(8)]
                part = batch.slice(at, 512)
                for d, s, n, q, ids in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    raw = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4").tobytes()
                    found = rounds.pieces(place[s], q, n)
                    joined = [np.concatenate(x) for x in zip(*found, strict=True)]
                    start, length, sequence, offset = _cut(*joined, window)
                    cuts = [raw[4 * a:4 * (a + m)] for a, m in zip(start.tolist(), length.tolist(), strict=True)]
                    k = len(start)
                    for c, v in zip(columns, ([d] * k, start.tolist(), length.tolist(), [zlib.crc32(x) for x in cuts], [n] * k,
                                              sequence.tolist(), offset.tolist(), cuts if with_ids else [None] * k), strict=True):
                        c.extend(v)
                kinds = [pa.int64()] * 7 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                                 names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
                                                        "offset", "ids"])

    base_of = parts.select(F.col("part").alias("p"), F.col("source").alias("s"), "base")
    # A row per task and source; beyond a fixed size it is joined by shuffle instead.
    base_of = F.broadcast(base_of) if base_of.count() <= 200_000 else base_of
    placed = tokens.join(base_of, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    placed = placed.select("doc_id", "source", "n", (F.col("q") + F.col("base")).alias("q"), "ids")
    return placed.mapInArrow(run, PIECES)


def sequences(pieces: DataFrame) -> DataFrame:
    """sequence_id, ids, n_tokens: the pieces of each window joined in order; a window is a bounded group."""
    grouped = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("p"),
                                                F.sum("length").alias("n_tokens"))
    return grouped.select("sequence_id", F.expr("aggregate(p, cast('' as binary), (a, x) -> concat(a, x.ids))").alias("ids"), "n_tokens")


