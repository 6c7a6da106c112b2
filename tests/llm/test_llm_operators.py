"""Each operator against a plain version, and on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from citewell.llm import (fingerprints, linededup, mixing, neardup, packing, personal, quality, toxicity, vectors, webtext, words)

DOC = "doc_id long, text string, source string"
CLASH = ("size", "h", "c", "n", "key", "bucket", "target", "part", "row", "q", "ids", "ranges", "component", "g", "a", "b", "s", "d", "k")
R = random.Random(4)
LEXICON = ["".join(R.choice("abcdefghij") for _ in range(R.randint(2, 7))) for _ in range(400)]


def prose(n: int, seed: int = 0, per_line: int = 12) -> str:
    r = random.Random(seed)
    found = [r.choice(LEXICON) for _ in range(n)]
    return "\n".join(" ".join(found[i:i + per_line]) for i in range(0, n, per_line))


def awkward():
    long = prose(30_000, 99)
    return [(1, prose(80, 1), "a"), (2, prose(80, 1), "a"), (3, None, "a"), (4, "", None), (5, "   \n ", "b"), (None, prose(60, 5), "b"), (6, long, "b"),
            (7, "one", None), (1, prose(80, 1), "a"), (8, prose(40, 8), "c"), (8, prose(40, 9), "c"), (9, "x" * 100_000, "c"), (10, "É ß 漢字 🙂", "c")]


def clashing(df):
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    return df


# ---- op1 ---------------------------------------------------------------------------------------


def plain_targets(sizes, share=1.5, most=2):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = share * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > most * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mix_targets_and_bounds(spark):
    docs = clashing(spark.createDataFrame([(i, prose(5 + i % 60, i), f"s{i % 7}" if i % 7 else None) for i in range(400)], DOC))
    out = mixing.mix(docs).collect()
    again = {(r.doc_id, r.taken) for r in mixing.mix(docs.repartition(5)).collect()}
    sizes = {}
    for r in out:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    goal = plain_targets(sizes)
    for s in sizes:
        mine = [r for r in out if r.source == s]
        assert mine[0].source_size == sizes[s] and mine[0].target == pytest.approx(goal[s])
        assert sum(r.taken for r in mine) == round(goal[s])
        epochs = int(goal[s] // sizes[s])
        budget = round(goal[s]) - epochs * sizes[s]
        draw = lambda d: (int(hashlib.md5(f"mix-1:{d}".encode()).hexdigest()[:12], 16) + 1) / 2**48
        for r in sorted(mine, key=lambda r: (-math.log(draw(r.doc_id)) / r.weight, r.doc_id)):
            part = min(r.size, max(0, budget))
            assert r.taken == epochs * r.size + part
            budget -= part
    assert again == {(r.doc_id, r.taken) for r in out}


def test_mix_awkward(spark):
    docs = clashing(spark.createDataFrame(awkward(), DOC))
    out = mixing.mix(docs).collect()
    assert len(out) == len(awkward()) and all(0 <= r.taken <= 2 * r.size for r in out)
    assert {r.size for r in out if r.doc_id == 3} == {0}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = mixed.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("w")).collect()
    goal = {r.source: round(r.target) for r in out}
    assert all(abs(r.w - goal[r.source]) <= 2 for r in got if r.w)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0
    flat = mixing.mix(docs, weight=F.lit(None).cast("double")).collect()
    assert len(flat) == len(out)


# ---- op2 ---------------------------------------------------------------------------------------


def plain_components(rows, n, percent=80):
    found = [(d, re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))) for d, t in rows]
    sets = [(d, {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()) for d, w in found]
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (d, x), (e, y) in itertools.combinations(sets, 2):
        if None not in (d, e) and x and y and 100 * len(x & y) >= percent * len(x | y):
            a, b = sorted((root(d), root(e)))
            parent[b] = a
    return sorted((d, len(x), root(d) if d is not None else None) for d, x in sets if d is not None)


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, n):
    r, rows = random.Random(n), []
    for g in range(12):
        text = prose(r.choice([3, 20, 90, 200]), 1000 + g, 9)
        for c in range(r.choice([1, 2, 8, 30])):
            w = text.split(" ")
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(LEXICON)
            rows.append((g * 100 + c, " ".join(w).upper() if c % 3 else " ".join(w), "s"))
    rows += awkward()
    r.shuffle(rows)
    docs = clashing(spark.createDataFrame(rows, DOC))
    out = neardup.near_duplicates(docs, shingle_words=n).collect()
    mine = sorted((x.doc_id, x.n_shingles, x.component_id) for x in out if x.doc_id is not None)
    assert mine == plain_components([x[:2] for x in rows], n)
    assert all(x.kept == (x.doc_id == x.component_id) for x in out if x.doc_id is not None)
    assert [(x.component_id, x.kept) for x in out if x.doc_id is None] == [(None, True)]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0


def test_hub_links_are_found(spark):
    """Copies of one base that are each alike to the base only."""
    r, base = random.Random(1), prose(300, 77, 10).split(" ")
    rows = [(500, " ".join(base), "s")]
    for i in range(40):
        w = list(base)
        for j in r.sample(range(len(w)), 14):
            w[j] = f"new{i}x{j}"
        rows.append((i, " ".join(w), "s"))
    out = neardup.near_duplicates(spark.createDataFrame(rows, DOC), shingle_words=2).collect()
    assert sorted((x.doc_id, x.component_id) for x in out) == [(d, c) for d, _, c in plain_components([x[:2] for x in rows], 2)]


def test_difference_prefixes_meet_for_every_link():
    """Whenever x is not linked with the hub and y is linked with x, their prefixes share an element."""
    r, met = random.Random(3), 0
    for _ in range(4000):
        base = r.sample(range(10_000), r.randint(4, 60))
        edit = lambda s, k: set(r.sample(s, max(1, len(s) - k))) | {r.randrange(10_000) for _ in range(r.randint(0, k))}
        x = edit(base, r.randint(0, len(base) // 2))
        y, h = edit(sorted(x), r.randint(0, 1 + len(x) // 8)), set(base)
        linked = lambda a, b: 100 * len(a & b) >= 80 * len(a | b)
        if x == y or y == h or linked(x, h) or not linked(x, y):
            continue
        arrays = [np.array(sorted(s), dtype=np.uint64) for s in (x, y, h)]
        common = np.array(r.sample(sorted(x | y | h), min(5, len(x))), dtype=np.uint64) if r.random() < 0.5 else np.empty(0, np.uint64)
        left, _, left_size, left_free = neardup.prefixes(arrays[0], arrays[2], True, 80, common)
        _, right, right_size, right_free = neardup.prefixes(arrays[1], arrays[2], False, 80, common)
        least = max(1, math.ceil((left_free + right_free) / 2 - 1e-9))
        place = {e: j for j, e in enumerate(left.tolist())}
        assert any(e in place and place[e] <= left_size - least and i <= right_size - least for i, e in enumerate(right.tolist()))
        met += 1
    assert met > 300


def test_word_hashes_match_plain_words():
    texts = ["A b  c\td", "", "x" * 70, prose(3000, 3), "é É a", "tail "]
    seen = {}
    for at, group in words.word_hashes(texts):
        for i, h in enumerate(group):
            plain = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in texts[at + i]))
            assert len(plain) == len(h)
            for w, x in zip(plain, h.tolist(), strict=True):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    long = prose(600_000, 5)
    [(_, [h])] = list(words.word_hashes([long]))
    parts = [x for _, g in words.word_hashes(long.split("\n")) for y in g for x in y.tolist()]
    assert h.tolist() == parts


# ---- op3 ---------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body class="has-sidebar"><!-- <p>no</p> -->
<header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div id="cookie-notice">We use cookies</div>
<div class="layout sidebar-left"><article class="post"><header><h1>Head &lt;1&gt;</h1></header><p>First&nbsp; <b>bold<br>line</b>
<p>Second &eacute;&#233;&#x41; <script>var a = "</p>";</script>end<div class="ad">Buy</div><form><p>mail</p></form><aside>More</aside>
<ul><li>one<li>two</ul><table><tr><td>1</td><td>2</td></tr></table><section class="comments"><p>Nice!</p></section></article></div>
<div class="sidebar"><article><p>Teaser of another</p></article></div><footer>&copy; x</footer></body></html>"""


def test_main_text_of_a_page():
    text = webtext.main_text(webtext.blocks(PAGE), set())
    assert text.split("\n")[:3] == ["Head <1>", "First bold line", "Second éé A end".replace("é A", "éA")]
    assert "one\ntwo\n1 2" in text
    for word in ("Buy", "mail", "More", "Nice", "Home", "Site", "cookies", "©", "var", "T & t"):
        assert word not in text


def test_blocks_without_article_use_repetition(spark):
    menu = "<div>" + " ".join(LEXICON[:20]) + "</div>"
    rows = [(i, f"http://h.example/{i}", f"<body>{menu}<p>{prose(60, 300 + i)}</p><div>{' '.join(LEXICON[20:32])}</div></body>") for i in range(30)]
    rows += [(100, None, None), (101, "x", ""), (102, "http://h.example/1", PAGE), (102, "http://h.example/1", PAGE), (103, "http://o.example", "<p>a < b & c"),
             (104, "http://o.example", "<p>" + "y " * 200_000), (None, "http://o.example", "<!-- open"), (105, "http://o.example", "<script>open")]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    out = webtext.extract(pages, shard_pages=20)
    got = {}
    for r in out.collect():
        got.setdefault(r.page_id, []).append(r)
    for i in range(30):
        assert got[i][0].text == " ".join(prose(60, 300 + i).split())
    assert got[100][0].text == got[101][0].text == got[None][0].text == got[105][0].text == ""
    assert len(got[102]) == 2 and got[102][0].text == webtext.main_text(webtext.blocks(PAGE), set())
    assert got[103][0].text == "a < b & c" and got[104][0].n_chars == 399_999
    assert webtext.extract(pages.limit(0)).count() == 0


def test_repetition_counts_over_the_whole_host(spark):
    """A notice on few pages of a large host, and the same pages as a small host: the size of the host decides nothing."""
    notice = " ".join(LEXICON[40:60])
    rows = []
    for host, n in (("small", 40), ("large", 400)):
        rows += [(i + 1000 * (host == "large"), f"http://{host}.example/{i}",
                  f"<body><p>{prose(60, 600 + i)}</p>{f'<div>{notice}</div>' if i % 10 == 0 and i < 40 else ''}</body>") for i in range(n)]
    rows += [(5000, "http://large.example/again", rows[-1][2]), (5001, "http://large.example/again", f"<body><article>{notice}</article></body>")]
    out = {r.page_id: r.text for r in webtext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(400):
        assert out[1000 + i] == " ".join(prose(60, 600 + i).split())
        assert i >= 40 or out[i] == out[1000 + i]
    assert out[5000] == out[1399] and out[5001] == notice and len(out) == len(rows)


def test_repeated_runs_equal_plain_search():
    r = random.Random(6)
    stream = np.array([r.randrange(4) for _ in range(400)])
    rank = webtext.suffix_ranks(stream, 8)
    for i, j in itertools.combinations(range(0, 392, 3), 2):
        assert (rank[i] == rank[j]) == bool((stream[i:i + 8] == stream[j:j + 8]).all())


# ---- op4, op5 ----------------------------------------------------------------------------------


def labelled(spark, kind):
    r, docs, labels = random.Random(3), [], []
    for i in range(1500):
        w = [r.choice(LEXICON) for _ in range(r.randint(8, 40))]
        bad = r.random() < 0.25
        if kind == "toxic":
            insult, group = r.random() < 0.4, r.random() < 0.4
            w += ["dolt"] * insult + ["weavers"] * group
            bad = insult and group
            r.shuffle(w)
            text = " ".join(w)
        else:
            text = " ".join([x + "###" for x in w] if bad else w).capitalize() + "."
        docs.append((i, text, "s"))
        if i % 3:
            labels.append((i, int(bad != (kind == "quality")), 1))
    docs += [(5000, None, "s"), (5001, "", "s"), (None, "dolt", "s"), (5002, prose(30_000, 4), "s"), (1, docs[1][1], "s")]
    labels += [(2, None, None), (None, 1, 1)]
    return clashing(spark.createDataFrame(docs, DOC)), clashing(spark.createDataFrame(labels, f"doc_id long, {kind} int, other int"))


@pytest.mark.parametrize(("kind", "module", "folds", "out"), [("toxic", toxicity, 4, 2), ("quality", quality, 5, 0)])
def test_classifiers(spark, kind, module, folds, out):
    docs, labels = labelled(spark, kind)
    rows = module.classify(docs, labels).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    for r in rows:
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % folds == out)
    truth = {r.doc_id: r[kind] for r in labels.collect() if r[kind] is not None and r.doc_id is not None}
    held = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert module.classify(docs, labels.limit(0)).count() == len(rows)
    assert module.classify(docs.limit(0), labels).count() == 0


def test_pair_of_terms_is_learned():
    """Exclusive or of two terms: no additive weights can tell it."""
    r, texts, y = random.Random(2), [], []
    for _ in range(3000):
        a, b = r.random() < 0.5, r.random() < 0.5
        w = [r.choice(LEXICON[:40]) for _ in range(6)] + ["alpha"] * a + ["omega"] * b
        texts.append(" ".join(w))
        y.append(int(a != b))
    model = toxicity.fit(toxicity.terms(texts[:2000]), np.array(y[:2000]), steps=400, factor_ridge=1e-4)
    assert np.mean((model.score(texts[2000:]) > 0.5) == np.array(y[2000:])) > 0.95


def test_prior_is_estimated_without_negatives():
    r = np.random.RandomState(0)
    good, junk = r.randn(4000, quality.FEATURES), r.randn(4000, quality.FEATURES) + 2.5
    mixture = np.concatenate([good[2000:3400], junk[:600]])
    r.shuffle(mixture)
    prior = quality.estimate_prior(good[:2000], mixture)
    assert abs(prior - 0.7) < 0.06
    net = quality.fit(good[:2000], mixture, prior)
    assert net.score(good[3400:]).mean() > 0.9 and net.score(junk[600:]).mean() < 0.15


# ---- op6 ---------------------------------------------------------------------------------------

PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain_spans(text):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = k == 0 or k == 1 and all(int(x) <= 255 for x in m[0].split(".")) or k == 3 and 9 <= len(d) <= 15
            if k == 2 and 12 <= len(d) <= 19:
                twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
                ok = sum(x // 10 + x % 10 for x in twice) % 10 == 0
            if ok:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns():
    r = random.Random(8)
    for _ in range(3000):
        text = "".join(r.choice("0123456789..@@-- +()aZé_\n") for _ in range(r.randint(0, 60)))
        assert personal.base_spans(text) == plain_spans(text)
    for text in ["4111 1111 1111 1111", "a@b.c", "1.2.3.4.5.6.7.8", "+1 (555) 123-4567 8", "0" * 6000 + "1.1.1.1", "9" * 50_000, "a@" * 20_000]:
        assert personal.base_spans(text) == (plain_spans(text) if len(text) < 5000 else personal.base_spans(text))
    assert personal.base_spans("0" * 6000 + "1.1.1.1") == [(0, 1, 6007)]


def test_field_adds_spans_and_keeps_base(spark):
    r = random.Random(9)
    phone = lambda: f"+1 ({r.randint(200, 999)}) {r.randint(200, 999)}-{r.randint(1000, 9999)}"
    rows = [(i, f"{prose(20, i)} {phone() if i % 2 else f'bob.{i}@mail.example.org'} {prose(5, i)} {r.randint(0, 9999)} {prose(9, i + 1)}", "s") for i in range(400)]
    rows += [(1000, "call (415) 555-0134 now", "s"), (1001, "in 1999 we had 3.5 of 2024-01-05", "s"), *awkward()]
    docs = clashing(spark.createDataFrame(rows, DOC))
    out = personal.personal_data(docs, field=personal.train(docs)).collect()
    assert len(out) == len(rows)
    texts = {}
    for d, t, _ in rows:
        texts.setdefault(d, []).append(t or "")
    for x in out:
        mine = [(s.start, personal.KINDS.index(s.kind), s.end) for s in x.base]
        assert mine in [plain_spans(t) for t in texts[x.doc_id]]
        assert all(a.end <= s.start or a.start >= s.end for a in x.added for s in x.base)
    by = {x.doc_id: x for x in out}
    assert [(s.kind, s.start, s.end) for s in by[1000].added] == [("phone", 5, 19)]
    assert by[1001].added == []
    assert sum(len(x.added) for x in out) <= 3
    assert personal.personal_data(docs.limit(0)).count() == 0 and personal.train(docs.limit(0)) is None


def test_segment_sums_equal_enumeration():
    """The forward-backward gradient is zero in expectation at the model's own best distribution: compare with all segmentations."""
    zone = personal.Zone("x 1.2@a", 2, 7)
    field = personal.Field()
    field.w[:] = np.random.RandomState(0).randn(*field.w.shape) * 0.3
    field.t[:] = np.random.RandomState(1).randn(5, 5) * 0.3
    scores = field.scores(zone)

    def walk(at, before):
        if at == zone.n:
            yield 0.0, ()
            return
        for v, rest in walk(at + 1, 4):
            yield v + field.t[before, 4], rest
        for k, (i, j, _) in enumerate(zone.segments):
            if i == at:
                for y in range(4):
                    for v, rest in walk(j, y):
                        yield v + field.t[before, y] + scores[k][y], ((i, j, y), *rest)

    best = max(walk(0, 4), key=lambda x: x[0])
    assert tuple(field.best(zone)) == best[1]


# ---- op7 ---------------------------------------------------------------------------------------


def check_packing(rows, out, window, encode):
    by_seq, by_doc = {}, {}
    for x in out:
        by_seq.setdefault(x.sequence_id, []).append(x)
        by_doc.setdefault(x.doc_id, []).append(x)
    assert sorted(by_seq) == list(range(len(by_seq)))
    for s, pieces in by_seq.items():
        pieces.sort(key=lambda x: x.offset)
        assert pieces[0].offset == 0 and all(a.offset + a.length == b.offset for a, b in itertools.pairwise(pieces))
        total = sum(x.length for x in pieces)
        assert total == window or s == len(by_seq) - 1 and total <= window
    want = sorted(encode(t or "") for _, t, _ in rows)
    got = []
    for pieces in by_doc.values():
        pieces.sort(key=lambda x: x.start)
        for x in pieces:
            assert zlib.crc32(bytes(x.ids)) == x.ids_crc32 and len(x.ids) == 4 * x.length
        got.append(pieces)
    return want, got


def test_packing_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = lambda t: tokenizer.encode(t, add_special_tokens=False).ids + [1]
    rows = [(i, prose(5 + i % 90, i) if i % 17 else None, f"s{i % 5}" if i % 5 else None) for i in range(200)]
    rows += [(900, "É ß 漢字 🙂\r\n  x", "s1"), (901, prose(3000, 3), "s2"), (None, "n", "s3")]
    docs = clashing(spark.createDataFrame(rows, DOC).repartition(3))
    out = packing.pack(docs, window=128).collect()
    _, got = check_packing(rows, out, 128, encode)
    ids = {d: encode(t or "") for d, t, _ in rows}
    for pieces in got:
        joined = [x for p in pieces for x in np.frombuffer(bytes(p.ids), "<u4").tolist()]
        assert joined == ids[pieces[0].doc_id] and pieces[0].doc_tokens == len(joined)
    sequences = packing.sequences(packing.pack(docs, window=128)).collect()
    assert sum(s.n_tokens for s in sequences) == sum(map(len, ids.values()))
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_holds_the_mixture(spark):
    rows = [(i, prose(300, i), "big" if i % 4 else "small") for i in range(120)]
    docs = spark.createDataFrame(rows, DOC).repartition(4)
    source = {d: s for d, _, s in rows}
    out = packing.pack(docs, window=512).collect()
    total = sum(x.length for x in out)
    share = sum(x.length for x in out if source[x.doc_id] == "small") / total
    per = {}
    for x in out:
        per.setdefault(x.sequence_id, {}).setdefault(source[x.doc_id], []).append(x.length)
    for s in range(len(per) - 1):
        assert abs(sum(per[s].get("small", [0])) / 512 - share) < 0.05
    out = packing.pack(docs, window=512, shares={"big": 0.5, "small": 0.5}).collect()
    first = [x for x in out if x.sequence_id < 10]
    assert abs(sum(x.length for x in first if source[x.doc_id] == "small") / sum(x.length for x in first) - 0.5) < 0.05


def test_long_texts_are_encoded_in_parts(monkeypatch):
    text = prose(5000, 1)
    whole = packing.encode(text).tolist()
    monkeypatch.setattr(packing, "PIECE_CHARS", 1000)
    assert packing.encode(text).tolist() == whole


# ---- op8 ---------------------------------------------------------------------------------------


def test_vectors(spark):
    r = np.random.RandomState(5)
    centres = r.randn(30, 24)
    x = [(centres[i % 30] + r.randn(24) * r.choice([0.05, 0.25, 0.4])).astype(np.float32).tolist() for i in range(900)]
    rows = [(i + 10, v) for i, v in enumerate(x)] + [(5, x[3]), (6, x[3]), (10, x[0]), (7, None), (8, []), (9, [0.0] * 24), (2000, [float("nan")] * 24),
                                                     (2001, [None] * 24), (2002, [1.0, 2.0]), (2003, [2.0, 4.0]), (None, x[1]), (2004, [1e30] * 24), (2005, [1e-30] * 24)]
    frame = clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    out = vectors.near_vectors(frame).collect()
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.float32(v)).all() and np.any(v)]
    links, parent = [0] * len(good), {i: i for i, _ in rows}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(good)):
        for b in range(a):
            (i, u), (j, v) = good[a], good[b]
            if len(u) == len(v) and u / np.abs(u).max() @ (v / np.abs(v).max()) / np.linalg.norm(u / np.abs(u).max()) / np.linalg.norm(v / np.abs(v).max()) >= 0.9:
                links[a] += 1
                links[b] += 1
                lo, hi = sorted((root(i), root(j)))
                parent[hi] = lo
    want = sorted((i, n) for (i, _), n in zip(good, links, strict=True))
    bad = {7, 8, 9, 2000, 2001}
    assert sorted((o.vec_id, o.n_links) for o in out if o.vec_id is not None and o.vec_id not in bad) == want
    assert all(o.component_id == (root(o.vec_id) if o.vec_id is not None else None) for o in out)
    assert all(o.n_links == 0 and o.kept for o in out if o.vec_id in bad or o.vec_id is None)
    assert vectors.near_vectors(frame.limit(0)).count() == 0


def test_bounds_drop_no_pair():
    r = np.random.RandomState(2)
    x = vectors.unit(r.randn(300, 64) + 2 * r.randn(1, 64))
    y = vectors.unit(np.concatenate([x[:100] + r.randn(100, 64) * 0.04, r.randn(200, 64)]))
    got = {(a, b) for p, q in vectors.compare(x, y, 0.9) for a, b in zip(p.tolist(), q.tolist(), strict=True)}
    assert got == set(zip(*[v.tolist() for v in np.nonzero(x @ y.T >= 0.9)], strict=True)) and got


# ---- op9 ---------------------------------------------------------------------------------------


def test_fingerprints_with_next(spark):
    rows = [*awkward(), *[(i, prose(40 + i, i), "s") for i in range(100, 160)]]
    docs = clashing(spark.createDataFrame(rows, DOC).repartition(6))
    out = fingerprints.compare_with_next(docs, parts=7).collect()
    hashed = {(r.doc_id, r.text): r.h for r in spark.createDataFrame(rows, DOC).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn(
        "h", F.xxhash64("text")).collect()}
    plain = [(d, t or "") for d, t, _ in rows]
    plain.sort(key=lambda x: (x[0] is None, -(x[0] or 0), -hashed[x]))
    want = []
    for (d, t), (_, u) in zip(plain, plain[1:] + plain[:1], strict=True):
        n = len(t) // 3
        new = t[:len(t) - n] + u[:n]
        f, g = fingerprints.fingerprint(t), fingerprints.fingerprint(new)
        want.append((str(d), len(t), hashlib.sha256(new.encode()).hexdigest(), f, g, fingerprints.likeness(f, g), fingerprints.likeness(f, fingerprints.fingerprint(u))))
    assert sorted((str(x.doc_id), *x[1:]) for x in out) == sorted(want)
    assert fingerprints.compare_with_next(docs.limit(0)).count() == 0
    one = fingerprints.compare_with_next(docs.filter("doc_id = 100")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.fingerprints(docs).count() == len(rows)


def test_fingerprint_tree():
    text = "# A\nfirst line. Second one here.\n\n# B\n" + prose(400, 1)
    lines = text.split("\n")
    lines[20] = lines[20] + " edit"
    a, b = fingerprints.fingerprint(text), fingerprints.fingerprint("\n".join(lines))
    assert a == fingerprints.fingerprint(text) and a.split("/")[0] != b.split("/")[0]
    assert len(fingerprints.differing(a, b)) == 1 and fingerprints.differing(a, a) == []
    assert 0.9 < fingerprints.likeness(a, b) < 1 and fingerprints.likeness(a, a) == 1
    assert fingerprints.likeness(a, fingerprints.fingerprint("")) == 0 and fingerprints.fingerprint(None) == fingerprints.fingerprint("")
    for t in ["a\n", "a", "a \n", " a", "a\n\n", "\n"]:
        assert sum(fingerprints.fingerprint(t) == fingerprints.fingerprint(u) for u in ["a\n", "a", "a \n", " a", "a\n\n", "\n"]) == 1


# ---- op10 --------------------------------------------------------------------------------------


def plain_line_dedup(rows):
    """The same definition with dictionaries: rows are distinct (doc_id, hash, text)."""
    order = sorted(rows, key=lambda x: (x[0] is None, x[0] or 0, x[1]))
    units = {(d, h): linededup.line_units(t) for d, h, t in order}
    first, marks = {}, []
    for d, h, _ in order:
        _, hashes, count = units[d, h]
        if sum(count) >= linededup.GUARANTEE_WORDS:
            for g, i in sorted(linededup.winnow(hashes, count), key=lambda x: x[1]):
                marks.append((g, (d, h), i))
                first.setdefault(g, ((d, h), i))
    gone = {}
    for g, doc, i in marks:
        other, j = first[g]
        if (other, j) != (doc, i):
            x, y = units[doc][1], units[other][1]
            s, e = i, i + 1
            while s > 0 and i - s < j and x[s - 1] == y[j - (i - s) - 1]:
                s -= 1
            while e < len(x) and j + e - i < len(y) and x[e] == y[j + e - i]:
                e += 1
            gone.setdefault(doc, set()).update(range(s, e))
    return {doc: [line for u, line in enumerate(linededup.line_units(t)[0]) if u in gone.get(doc, ())] for doc, t in (((d, h), t) for d, h, t in order)}


def test_line_dedup(spark):
    r, rows = random.Random(11), []
    passages = [prose(r.randint(55, 120), 500 + i, r.choice([8, 12, 70])) for i in range(8)]
    for i in range(120):
        parts = [prose(r.randint(5, 60), 900 + i, 11)]
        for _ in range(r.randint(0, 2)):
            parts += [r.choice(passages), prose(r.randint(5, 40), r.randrange(10**6), 9)]
        rows.append((i + 20, "\n".join(parts), "s"))
    rows += [(300, (passages[0] + "\n") * 4, "s"), (301, "short line\n" * 3, "s"), (302, passages[1].replace("\n", "  \n\n"), "s"), *awkward()]
    docs = clashing(spark.createDataFrame(rows, DOC))
    out = linededup.dedup_lines(docs)
    assert out.columns[:len(docs.columns)] == docs.columns
    keyed = {(x.doc_id, x.text): x.h for x in docs.select("doc_id", "text").withColumn("h", F.xxhash64("text")).collect()}
    distinct = {(d, keyed[d, t], t) for d, t, _ in rows if t is not None}
    want = plain_line_dedup(list(distinct))
    before = {}
    for d, t, _ in rows:
        before.setdefault(d, []).append(t)
    got = {}
    for x in out.collect():
        got.setdefault(x.doc_id, []).append(x.text)
    for d, h, t in distinct:
        drop = set(want[d, h])
        kept = [line.strip() for i, line in enumerate(t.split("\n")) if i not in drop and line.strip()]
        assert any(x is not None and [y.strip() for y in x.split("\n") if y.strip()] == kept for x in got[d]), d
        if not drop:
            assert t in got[d]
    assert got[3] == [None] and len(got[1]) == 2
    everything = "\n".join(t for ts in got.values() for t in ts if t)
    for p in passages:  # runs of 50 words and more are left once
        lines = p.split("\n")
        assert sum(line == lines[0] for line in everything.split("\n")) == 1
    assert linededup.dedup_lines(docs.limit(0)).count() == 0


def test_winnowing_guarantee():
    r = random.Random(12)
    for _ in range(200):
        shared = prose(r.randint(50, 150), r.randrange(10**6), r.choice([3, 9, 60])).split("\n")
        picks = []
        for _ in range(2):
            text = "\n".join([*prose(r.randint(1, 80), r.randrange(10**6), 7).split("\n"), *shared, *prose(r.randint(1, 80), r.randrange(10**6), 7).split("\n")])
            _, hashes, count = linededup.line_units(text)
            picks.append({g for g, _ in linededup.winnow(hashes, count)})
        assert picks[0] & picks[1]


def plain_passages(rows, n=50):
    """Words that stay, by brute force: a run of n words goes if the same run stands at an earlier place."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        w, gone = t.split(), set()
        for i in range(len(w) - n + 1):
            if (run := tuple(w[i:i + n])) in seen:
                gone.update(range(i, i + n))
            seen.add(run)
        out[d] = [x for i, x in enumerate(w) if i not in gone]
    return out


def test_words_hashed_from_bytes():
    """The words of str.split, whatever the white space; equal words and no others hash alike, wherever they stand."""
    r = random.Random(40)
    spaces = [" ", "\t", "\n", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x1f", "\x85", "\xa0", "\u1680", "\u2003", "\u2028", "\u2029", "\u202f", "\u205f", "\u3000", "  "]
    some = ["a", "A", "ab", "ba", "\x00", "\x00a", "a\x00", "\u200b", "é", "e\u0301", "漢字", "字漢", "\ud800", "😀", "x" * 3000, *(f"w{i}" for i in range(300))]
    texts = ["", " ", "\u3000", "a"] + ["".join(x for _ in range(r.randrange(80)) for x in (r.choice(some), r.choice(spaces))) for _ in range(60)]
    texts += ["\n" + t for t in texts] + [chr(i) + "a" for i in range(0x3100)]
    hashes, sizes = linededup.text_words(texts)
    words = [t.split() for t in texts]
    assert sizes.tolist() == [len(w) for w in words]
    pairs = set(zip((x for w in words for x in w), hashes.tolist(), strict=True))
    assert len(pairs) == len({w for w, _ in pairs}) == len({h for _, h in pairs})
    assert linededup.text_words(["x" * (6 << 18), "x"])[0][1] == linededup.text_words(["x"])[0][0]  # longer than the powers kept


def test_passages_inside_lines(spark):
    r, rows = random.Random(21), []
    passages = [prose(r.randint(51, 90), 7000 + i, 10**6) for i in range(6)]
    for i in range(60):  # every passage begins and ends inside a line, and its lines are broken anew in every copy
        words = f"{prose(r.randint(5, 40), 8000 + i, 10**6)} {r.choice(passages)} {prose(r.randint(5, 40), 9000 + i, 10**6)}".split()
        width = 10 + i if i % 3 else 10**6
        rows.append((i, "\n".join(" ".join(words[j:j + width]) for j in range(0, len(words), width)), "s"))
    out = linededup.dedup_lines(spark.createDataFrame(rows, DOC)).collect()
    want = plain_passages([(d, t) for d, t, _ in rows])
    assert {x.doc_id: x.text.split() for x in out} == want
    assert sum(len(t.split()) for _, t, _ in rows) - sum(x["__words_removed"] for x in out) == sum(map(len, want.values()))


def test_first_place_that_ends_early(spark):
    """The first holder of a fingerprint shares one line only; later documents share a longer run with each other."""
    rows = []
    for k in range(20):
        one, two = prose(30, 20_000 + k, 10**6), prose(30, 21_000 + k, 10**6)
        for c, lines in enumerate([[one], [one, two], [one, two]]):
            ends = [prose(40, 22_000 + 10 * k + 3 * c + e, 10**6) for e in (0, 1)]
            rows.append((3 * k + c, "\n".join([ends[0], *lines, ends[1]]), "s"))
    out = {x.doc_id: x.text for x in linededup.dedup_lines(spark.createDataFrame(rows, DOC)).collect()}
    for k in range(20):
        one, two = prose(30, 20_000 + k, 10**6), prose(30, 21_000 + k, 10**6)
        assert one in out[3 * k] and two in out[3 * k + 1]
        assert one not in out[3 * k + 2] and two not in out[3 * k + 2]


def test_surroundings_that_agree_in_part(spark):
    """Random cuts of a few sources, with words that repeat within a document: every run of 50 words with an earlier copy goes, no other word."""
    r, rows = random.Random(31), []
    sources = [prose(300, 30_000 + k, 10**6).split() for k in range(3)] + [["again"] * 200, (prose(7, 30_010, 10**6) + " ").split() * 30]
    for i in range(70):
        words = []
        for _ in range(r.randint(1, 4)):
            source = r.choice(sources)
            a = r.randrange(len(source) - 40)
            words += source[a:a + r.randint(30, 160)] + prose(r.randint(0, 6), r.randrange(10**6), 10**6).split()
        if i % 5 == 0:
            words[len(words) // 2] = f"edit{i}"
        rows.append((i, " ".join(words), "s"))
    out = linededup.dedup_lines(spark.createDataFrame(rows, DOC)).collect()
    assert {x.doc_id: x.text.split() for x in out} == plain_passages([(d, t) for d, t, _ in rows])


def test_words_that_repeat_over_and_over(spark):
    """A document has one mark a gram and surroundings, however often its words repeat; every run with an earlier copy goes, no other word."""
    import pyarrow as pa
    r, rows = random.Random(32), []
    periods = [prose(n, 40_000 + n, 10**6) for n in (1, 2, 3, 20, 60)]
    for i in range(40):
        words = f"{prose(r.randint(0, 30), 41_000 + i, 10**6)} " + f"{periods[i % 5]} " * (2000 // (1 + 9 * (i % 5 > 2))) + prose(r.randint(0, 30), 42_000 + i, 10**6)
        rows.append((i, words.strip(), "s"))
    rows += [(50, rows[3][1], "s"), (3, rows[3][1], "s"), (None, rows[1][1], "s"), (51, f"{periods[1]} " * 30, "s")]
    texts = [t for _, t, _ in rows]
    batch = pa.RecordBatch.from_arrays([pa.array([d for d, _, _ in rows], pa.int64()), pa.array(range(len(rows)), pa.int64()), pa.array(texts)], names=["doc_id", "h", "text"])
    found = [x for out in linededup._marked(16, 50)([batch]) for x in out.to_pylist()]
    assert len(found) == len(rows)
    for x, t in zip(found, texts, strict=True):
        assert len({(m["g"], m["c"]) for m in x["marks"]}) == len(x["marks"]) <= 130 < len(t.split()) or len(t.split()) <= 130
        seen, w = {}, t.split()
        firsts = [seen.setdefault(tuple(w[i:i + 50]), i) for i in range(len(w) - 49)]
        later = {i for i, first in enumerate(firsts) if first < i}
        covered = [i for a in x["again"] for i in range(a["s"], a["last"] + 1)]
        assert len(covered) == len(set(covered)) and set(covered) <= later
        assert len(x["again"]) <= 60
    out = linededup.dedup_lines(spark.createDataFrame(rows, DOC)).collect()
    want = plain_passages([(10**6 if d is None else d, t) for d, t, _ in {row[:2]: row for row in rows}.values()])
    assert all((x.text or "").split() == want[10**6 if x.doc_id is None else x.doc_id] for x in out) and len(out) == len(rows)


def test_meeting_splits_hot_keys(spark):
    """Hot and rare keys give the rows of the plain join."""
    from citewell.llm.common import discard, meeting, written
    rows = spark.createDataFrame([(k if i % 3 else 0, i) for i, k in enumerate(range(9000))], "g long, i int")
    keys = written(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("i").alias("first")), "test-keys")
    got = meeting(rows, keys, ["g"])
    assert got.columns == ["g", "i", "n", "first"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, rows.join(keys, "g").collect()))
    discard(keys)
    with pytest.raises(Exception):
        keys.count()
