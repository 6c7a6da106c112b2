"""The prefix trie, list ranks and scans against plain versions."""

import hashlib
import random
import re
import zlib

import duckdb
import pytest
from citewell.llm import listrank, q_trie, scans, trie
from pyspark.sql import functions as F

TURNS = "conv_id long, turn long, role string, text string"


def plain_rebuilt(rows, share=20, heads=4):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v, key=lambda x: x[:2])] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        base = own.get(c - int(c % share if c >= 0 else -(-c % share)), [])
        out[c] = base[:h] + turns[h:]
    return out


def plain_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    out = {}
    for p in sorted(members, key=len, reverse=True):
        own = (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below = kids.get(p, [])
        ends = sorted(c for c in members[p] if len(convs[c]) == len(p))
        out[p] = (min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(below),
                  sum(out[k][5] for k in below) if below else 1, own + sum(out[k][6] for k in below),
                  hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest())
    return sorted(map(str, out.values()))


def conversations(seed, n, most=7):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(-60, 200), n):
        for turn in range(r.randint(1, most)):
            rows.append((c, turn, r.choice(["user", "assistant"]), r.choice(["a b", "c", "", "d e f"])))
    return rows


@pytest.mark.parametrize("left", [4, 1 << 13])
def test_trie_of_rebuilt_conversations(spark, left, monkeypatch):
    monkeypatch.setattr(trie, "list_ranks", lambda links, name: listrank.list_ranks(links, name, left))
    rows = conversations(left, 90)
    rows += [(300, None, "user", "late"), (300, 0, None, None), (300, 1, "user", "x"), (None, 0, "user", "nobody"), (320, 5, "user", None)]
    rows += [(341, t, "user", f"w{t} " * 3) for t in range(60)]
    got = trie.prefix_trie(spark.createDataFrame(rows, TURNS), rebuild=trie.shared_heads).collect()
    assert sorted(str(tuple(x)) for x in got) == plain_trie(plain_rebuilt(rows))


def test_trie_without_rebuilding_ties_repeats_and_clashes(spark):
    rows = [(1, 0, "u", "a"), (1, 0, "u", "a"), (2, 0, "u", "a"), (2, 1, "u", "a"), (3, 0, "v", "a"), (4, 0, "u", "a"), (4, 0, "u", "b"), (4, 0, "u", "b"),
            (5, 0, "u", "b"), (5, 0, "u", "b"), (5, 0, "u", "a")]
    df = spark.createDataFrame(rows, TURNS)
    for c in ("id", "pos", "a", "b", "x", "y", "words", "part", "rank", "depth", "k", "h", "base", "parent", "place"):
        df = df.withColumn(c, F.lit("clash"))
    got = {(x.conv_id, x.depth): x for x in trie.prefix_trie(df).collect()}
    assert (got[0 + 1, 0].n_convs, got[1, 2].n_convs) == (5, 2)  # 1 and 2 are the same two turns, the first repeated
    ties = [k for k in got if k[1] == 3]
    assert len(ties) == 1 and got[ties[0]].n_convs == 2  # equal turns of 4 and 5 come in one order whatever the input's
    assert sum(x.n_children == 0 for x in got.values()) == got[1, 0].n_leaves


def test_turnless_and_empty(spark):
    empty = spark.createDataFrame([], TURNS)
    assert trie.prefix_trie(empty).collect() == [] and trie.prefix_trie(empty, rebuild=trie.shared_heads).collect() == []
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in range(1, 20)}
    c = next(c for c in h if h[c] > 1)  # its own turn goes, the conversation that it would begin with is absent
    got = trie.prefix_trie(spark.createDataFrame([(c, 0, "u", "t")], TURNS), rebuild=trie.shared_heads).collect()
    assert [tuple(x) for x in got] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_member_hashes_of_many_pieces(spark, monkeypatch):
    ids = spark.range(0, 30_000, 1, 7).select((F.col("id") % 2 * 5).alias("id"), (F.col("id") * 3 - 10_000).alias("conv_id"))
    got = dict(trie.member_hashes(ids).collect())
    for node in (0, 5):
        want = ",".join(str(i * 3 - 10_000) for i in range(30_000) if i % 2 * 5 == node)
        assert got[node] == hashlib.sha256(want.encode()).hexdigest()


def test_list_ranks(spark):
    r = random.Random(5)
    order = list(range(0, 3000, 3))
    r.shuffle(order)
    links = list(zip(order, [*order[1:], None], strict=True))
    r.shuffle(links)
    df = spark.createDataFrame(links, "id long, next long").repartition(5)
    for left in (1, 50, 5000):
        assert sorted(map(tuple, listrank.list_ranks(df, left=left).collect())) == sorted((x, i) for i, x in enumerate(order))
    assert listrank.list_ranks(df.limit(0)).collect() == []


def test_scans_over_hot_and_small_groups(spark):
    r = random.Random(6)
    rows = [(r.choice([1, 1, 1, 1, 2, 3, *range(10, 40)]), i, r.randint(-9, 9), r.getrandbits(62)) for i in range(4000)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g long, o long, v long, x long").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = sorted(map(tuple, scans.scanned(df, "g", ["o"], "t", sums=("v",), xors=("x",)).collect()))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    state, want = {}, []
    for g, o, v, x in sorted(rows):
        n, s, t = state.get(g, (0, 0, 0))
        state[g] = n + 1, s + v, t ^ x
        want.append((g, o, v, x, *state[g]))
    assert got == want
    assert scans.scanned(df.limit(0), "g", ["o"], "t").collect() == []


def test_oracle_agrees_with_the_plain_trie():
    rows = conversations(9, 60)
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    assert sorted(str(tuple(x)) for x in con.execute(q_trie.SQL).fetchall()) == plain_trie(plain_rebuilt(rows))
