"""Best-fit packing planned on the length histogram.

Documents are tokenized and cut where they are longer than a window. The pieces are counted by length: at most ``window`` numbers, whatever
the corpus. Best-fit decreasing runs on those counts alone: open sequences with equal room are one run of numbers, and of a run
that has the least room for a length, as many sequences as needed are filled at once. Each step leaves plan rows (length, first
rank, first sequence, pieces a sequence, offset). A piece then finds its place by its rank among the pieces of its length: the
rank is its number within its task plus the counts of the tasks before, so neither texts nor ids are shuffled to get it."""

from __future__ import annotations

import bisect
import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import internal, running_total, written

WINDOW = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"
SLICE = 1 << 20
MEMORY = 300_000
_encoders: dict[str, Encoder] = {}

# Characters whose splitting and lower case all libraries agree on: printable ASCII, white space, Latin letters up to U+017F.
_SIMPLE = [chr(c) for c in (*range(9, 14), *range(32, 127), *range(160, 0x180)) if c != 0x130]
_ODD = re.compile("[^" + "".join(map(re.escape, _SIMPLE)) + "]")
_RUN, _SPACE = re.compile(r"[^ \t\n\r\f\v]+"), re.compile(r"[ \t\n\r\f\v]")


def _of_kind(kind: str) -> str:
    return "".join(re.escape(c) for c in _SIMPLE if unicodedata.category(c).startswith(kind))


_WORD = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_of_kind('L')}]+|[{_of_kind('N')}]|[^\\s{_of_kind('L')}{_of_kind('N')}]+")


class Encoder:
    """Text -> ids of a public word-level BPE vocabulary, the ids that the tokenizers file gives for the whole text.

    White space always ends a word there and leaves no id. Words of simple characters are merged once each, by rank, and remembered; an
    ending mark that no such word holds stands for the vocabulary's end of word. A run between white space that holds any other character
    goes to the tokenizers library as it is. Strings of special tokens in a text are ordinary text. A text is taken in slices that end at
    white space."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        printed = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the file spells as themselves; the others follow U+0100
        byte = {chr(b): b for b in printed} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(printed)))}
        ranks = {}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if token not in special:
                ends = token.endswith("</w>") and len(token) > 4
                ranks[bytes(byte[c] for c in (token[:-4] if ends else token)) + b"\x01" * ends] = i
        self.merged = tiktoken.Encoding("words", pat_str=r"[^\n]+|\n", mergeable_ranks=ranks, special_tokens={})
        self.newline = self.merged.encode_ordinary("\n")[0]
        self.known: dict[str, bytes] = {}

    def _learn(self, words: list[str], odd: bool) -> None:
        known = self.known
        new = list(set(words).difference(known))
        if len(known) + len(new) > MEMORY:
            known.clear()
            new = list(set(words))
        for at in range(0, len(new), 1024):
            part = new[at:at + 1024]
            if odd:
                found = [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch(part, add_special_tokens=False)]
            else:
                ids = np.asarray(self.merged.encode_ordinary("\x01\n".join(part) + "\x01\n"), dtype="<u4")
                ends, raw = (np.flatnonzero(ids == self.newline) * 4).tolist(), ids.tobytes()
                found = [raw[a:b] for a, b in zip([0, *(e + 4 for e in ends)], ends)]
            known.update(zip(part, found, strict=True))

    def _of(self, text: str) -> bytes:
        if not _ODD.search(text):
            words = _WORD.findall(text.lower())
            self._learn(words, odd=False)
            return b"".join([self.known[w] for w in words])
        out = []
        for run in _RUN.findall(text):
            if not _ODD.search(run):
                out.append(self._of(run))
                continue
            if run not in self.known:
                self._learn([run], odd=True)
            out.append(self.known[run])
        return b"".join(out)

    def __call__(self, text: str) -> np.ndarray:
        parts, at = [], 0
        while at < len(text):
            end = len(text)
            if end - at > SLICE:
                space = _SPACE.search(text, at + SLICE)
                end = space.start() if space else end
            parts.append(self._of(text[at:end]))
            at = end
        return np.frombuffer(b"".join([*parts, np.asarray([END_ID], "<u4").tobytes()]), dtype="<u4")


def encoder(path: str | None = None) -> Encoder:
    import public_tokenizers

    path = path or public_tokenizers.path(TOKENIZER)
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECES = "part int, nth long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def pieces(docs: DataFrame, window: int = WINDOW, tokenizer: str | None = None, with_ids: bool = True) -> DataFrame:
    """A row per piece of each document, with its task and its number among the task's pieces of the same length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, encode = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64), encoder(tokenizer)
        rows: list[tuple] = []
        held = 0

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            nth, doc, piece, start, length, crc, ids = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([
                pa.array([part] * len(rows), pa.int32()), pa.array(nth, pa.int64()), pa.array(doc, pa.int64()), pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.binary())],
                names=["part", "nth", "doc_id", "piece", "start", "length", "ids_crc32", "ids"])

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py() or "")
                for piece, start in enumerate(range(0, len(ids), window)):
                    raw = ids[start:start + window].tobytes()
                    length = len(raw) // 4
                    rows.append((int(seen[length]), doc.as_py(), piece, start, length, zlib.crc32(raw), raw if with_ids else None))
                    seen[length] += 1
                    held += len(raw) if with_ids else 64
                    if held > 4 << 20:
                        yield batch_of(rows)
                        rows, held = [], 0
        if rows:
            yield batch_of(rows)

    return docs.mapInArrow(run, PIECES)


def plan(counts: dict[int, int], window: int = WINDOW) -> np.ndarray:
    """Best-fit decreasing over counts by length. Rows (length, first rank, first sequence, pieces a sequence, offset of the first piece),
    sorted; ranks follow one another within a length.

    Sequences that are open are runs (first, number) by room. A run loses more than half of its room when it is used, and a length splits
    at most one run and opens at most two, so there are at most about 4 x window runs and 4 x window x log2(window) rows."""
    rooms: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    rows, opened = [], 0

    def leave(room: int, first: int, number: int) -> None:
        if room and number:
            if room not in runs:
                bisect.insort(rooms, room)
                runs[room] = []
            runs[room].append((first, number))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, number = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            else:
                room, first = window, opened
                number = -(-left // (window // length))
                opened += number
            each = room // length
            full = min(number, left // each)
            if full:
                rows.append((length, rank, first, each, window - room))
                leave(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
                first, number = first + full, number - full
            if number and left:  # the last sequence that this length begins, and does not fill
                rows.append((length, rank, first, left, window - room))
                leave(room - left * length, first, 1)
                rank, first, number, left = rank + left, first + 1, number - 1, 0
            leave(room, first, number)
    return np.asarray(sorted(rows), dtype=np.int64).reshape(-1, 5)


def pack_best_fit(docs: DataFrame, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None,
                  with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids (little-endian unsigned 32-bit; null without ``with_ids``).

    Only documents above ``window`` ids, their end id included, are cut, into pieces of ``window``. Null and empty texts are one end id;
    null or repeated doc_ids are packed row by row; equal lengths take their slots in the order of the input; an empty table gives no
    rows. Other columns are ignored. Only counts by length, at most ``window`` rows, reach the driver."""
    base = internal(docs, doc_id=doc_id, text=text).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    cut = written(pieces(base, window, tokenizer, with_ids), "fit-pieces")
    parts = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    parts = written(running_total(parts, ["length"], ["part"], "n", "before"), "fit-parts")
    counts = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = plan(counts, window)
    span = max(counts.values(), default=0) + 1  # (length, rank) as one number
    starts = steps[:, 0] * span + steps[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            length, rank = (column[c].to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            row = steps[np.searchsorted(starts, length * span + rank, side="right") - 1]
            nth = rank - row[:, 1]
            sequence, offset = row[:, 2] + nth // row[:, 3], row[:, 4] + nth % row[:, 3] * length
            yield pa.RecordBatch.from_arrays(
                [*[column[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")], pa.array(sequence), pa.array(offset), column["ids"]],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "ids"])

    before = parts.select(F.col("part").alias("p"), F.col("length").alias("l"), "before")
    ranked = cut.join(before, (F.col("part") == F.col("p")) & (F.col("length") == F.col("l")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"), "ids")
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, ids binary")
