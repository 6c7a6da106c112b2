"""Best-fit packing: the plan against one sequence at a time, ids against the tokenizers library, pieces by an exact round trip."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from citewell.llm import bestfit
from pyspark.sql import functions as F
from tokenizers import Tokenizer

DOC = "doc_id long, text string, source string"


def plain_rooms(counts, window):
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            room = min((r for r in rooms if r >= length), default=None)
            if room is not None:
                rooms.remove(room)
            rooms.append((window if room is None else room) - length)
    return sorted(rooms)


@pytest.mark.parametrize("seed", range(60))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    window = r.choice([8, 16, 33, 64])
    counts = {n: r.randint(1, r.choice([2, 9, 40])) for n in r.sample(range(1, window + 1), r.randint(1, window // 2))}
    steps, held = bestfit.plan(counts, window), {}
    for length, n in counts.items():
        rows = steps[steps[:, 0] == length]
        for rank in range(n):
            row = rows[np.searchsorted(rows[:, 1], rank, side="right") - 1]
            nth = rank - row[1]
            held.setdefault(int(row[2] + nth // row[3]), []).append((int(row[4] + nth % row[3] * length), length))
    for found in held.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
    assert sorted(window - sum(n for _, n in v) for v in held.values()) == plain_rooms(counts, window)


def test_plan_stays_small_whatever_the_counts():
    r = np.random.RandomState(2)
    for top in (3, 10**3, 10**9):
        counts = {int(n): int(c) for n, c in zip(range(1, 2049), r.randint(1, top, 2048), strict=True)}
        steps = bestfit.plan(counts)
        assert len(steps) < 4 * 2048 * 11
        assert steps[:, 2].max() < 1.02 * sum(n * c for n, c in counts.items()) / 2048 + 2


def test_ids_are_those_of_the_tokenizers_file():
    plain = Tokenizer.from_file(public_tokenizers.path(bestfit.TOKENIZER))
    plain.encode_special_tokens = True
    r = random.Random(3)
    letters = [chr(c) for c in range(1, 0x260)] + list("’“”—…漢字🙂½ΣςİıſḰ 　́") + list("abcdefghij '  sdtlm") * 20
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 200))) for _ in range(1500)]
    texts += ["", " \n", "x" * 50_000, "don't DON'T i'LL 'sa ''s", "Σας ΣΑΣ é <|endoftext|> \x01 a\x01b", "\x85a\x1cb c"]
    encode = bestfit.encoder()
    for text, want in zip(texts, plain.encode_batch(texts, add_special_tokens=False), strict=True):
        assert encode(text).tolist() == [*want.ids, 0], text[:80]


def test_slices_change_no_ids(monkeypatch):
    text = " ".join(random.Random(8).choice(["don't", "É1½", "漢字", "well-known,", "a"]) for _ in range(5000))
    whole = bestfit.encoder()(text).tolist()
    monkeypatch.setattr(bestfit, "SLICE", 37)
    monkeypatch.setattr(bestfit, "MEMORY", 3)
    assert bestfit.encoder()(text).tolist() == whole


def test_round_trip_on_awkward_rows(spark):
    r = random.Random(4)
    words = [f"{a}{b}" for a in "abcdefg" for b in ("an", "orin", "é", "'s", "17")]
    make = lambda n: " ".join(r.choice(words) for _ in range(n))
    rows = [(i, make(r.choice([5, 40, 300, 900])), "a") for i in range(120)]
    rows += [(500, None, "b"), (501, "", None), (502, make(9000), None), (None, make(50), "a"), (7, make(60), "a"), (7, make(60), "a"), (503, " \n", "c")]
    df = spark.createDataFrame(rows, DOC).repartition(5)
    for c in ("part", "nth", "piece", "start", "length", "rank", "ids", "before", "p", "l", "n"):
        df = df.withColumn(c, F.lit("clash"))
    got = bestfit.pack_best_fit(df).collect()
    encode = bestfit.encoder()
    want = sorted((str(d), tuple(encode(t or "").tolist())) for d, t, _ in rows)
    sequences, whole = {}, {}
    for x in got:
        assert x.start == x.piece * 2048 and x.length == len(x.ids) // 4 and x.ids_crc32 == zlib.crc32(x.ids)
        sequences.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= 2048
    by_doc = {}
    for x in got:
        by_doc.setdefault(str(x.doc_id), {}).setdefault(x.piece, []).append(tuple(np.frombuffer(x.ids, "<u4").tolist()))
    for doc, tokens in want:
        pieces = [tokens[i:i + 2048] for i in range(0, len(tokens), 2048)]
        for i, piece in enumerate(pieces):
            assert len(piece) == 2048 or i == len(pieces) - 1
            by_doc[doc][i].remove(piece)
    assert not any(left for pieces in by_doc.values() for left in pieces.values())
    counts = {}
    for _, tokens in want:
        for i in range(0, len(tokens), 2048):
            n = len(tokens[i:i + 2048])
            counts[n] = counts.get(n, 0) + 1
    assert len(sequences) == len(plain_rooms(counts, 2048))
    assert bestfit.pack_best_fit(df.limit(0)).collect() == []
