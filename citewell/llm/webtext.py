"""Main text of web pages: structure of the page, and a repeated runs over the pages of a host.

A page is read into blocks, each with the part of the page it stands in: main (inside article, else main), plain, or outside (menus, headers,
footers, sidebars, notices, adverts, forms, comments). Pages of a host of bounded size are put together; their token streams are
concatenated and their suffixes ordered by their first RUN tokens by prefix doubling. Suffixes that agree there are the long substrings
that repeat. On a larger host the runs of RUN tokens are hashed and counted over all its pages by an aggregation instead, so the size of a
host changes nothing. Runs that stand on several distinct pages cover boilerplate:

* a plain block on a page without article or main goes if it is mostly covered;
* blocks inside an article stay whatever repeats: mirrored articles and quoted passages are text.

Pages with the same stream count once, and if what is left of a page without main part would be next to nothing, it is a mirror and stays.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import internal, written
from .linededup import _Hashes, word_runs

RUN = 8
LEAST_PAGES = 3
SHARD_PAGES = 64
SHARD_BYTES = 4 << 20
MAIN, PLAIN, OUTSIDE = 0, 1, 2

_BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section select summary table tbody tfoot thead title tr ul""".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp template svg math object audio video canvas".split())
_OUT_TAGS = frozenset("nav footer aside form dialog menu head select button".split())
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Words of class and id that name a part which is not the article. The first group says so of any element, the second also when it wraps the article.
_PARTS = frozenset("""sidebar widget menu nav navbar navigation breadcrumb breadcrumbs footer masthead topbar toolbar pagination pager header
notice cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login search share sharing social promo banner
sticky disclaimer""".split())
_FOREIGN = frozenset("ad ads advert adverts advertisement adsense sponsor sponsored related recommended comment comments disqus respond reply replies".split())
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_WORDS = re.compile(r"[a-z0-9]+")
_ENDS = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in _RAW}


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(raw)} if raw.strip(" /") else {}


def _kind(tag: str, attributes: dict[str, str], in_article: bool) -> str:
    """'' for a part that may be text, 'part' for one that is not, 'foreign' for one whose articles are not either."""
    words = set(_WORDS.findall((attributes.get("class", "") + " " + attributes.get("id", "")).lower())) if attributes else set()
    if tag in ("html", "body"):
        return ""
    if words & _FOREIGN:
        return "foreign"
    if tag in ("article", "main") or attributes.get("role", "").lower() == "main":
        return ""
    if tag in _OUT_TAGS or (tag == "header" and not in_article):
        return "foreign"
    if attributes.get("role", "").lower() in _OUT_ROLES or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true":
        return "foreign"
    return "part" if words & _PARTS - ({"header"} if in_article else set()) else ""


def blocks(page: str | None) -> list[tuple[str, int, float]]:
    """(text, part, share of link text) of each block in page order. Character references are decoded, white space is one space."""
    page = page or ""
    out: list[tuple[str, int, float, bool]] = []
    held: list[str] = []
    linked = [0]
    stack: list[tuple[str, str, bool, bool]] = []  # tag, kind of the path, in article, in main
    state = ("", "", False, False)
    links, at = 0, 0

    def close() -> None:
        text = " ".join("".join(held).split())
        if text:
            out.append((text, OUTSIDE if state[1] else MAIN if state[2] else PLAIN, min(1.0, linked[0] / len(text)), state[3]))
        held.clear()
        linked[0] = 0

    while at < len(page):
        lt = page.find("<", at)
        chunk = page[at:lt] if lt >= 0 else page[at:]
        if chunk:
            decoded = html.unescape(chunk) if "&" in chunk else chunk
            held.append(decoded)
            if links:
                linked[0] += len(decoded)
        if lt < 0:
            break
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page[lt + 1:lt + 2] in ("!", "?"):
            end = page.find(">", lt)
            at = end + 1 if end >= 0 else len(page)
            continue
        if not (m := _TAG.match(page, lt)):
            if re.match(r"</?[a-zA-Z]", page[lt:lt + 3]):  # a tag that never ends
                end = page.find(">", lt)
                at = end + 1 if end >= 0 else len(page)
            else:
                held.append("<")
                at = lt + 1
            continue
        at, tag = m.end(), m[2].lower()
        if m[1]:
            if tag in _BLOCK:
                close()
            place = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if place >= 0:
                del stack[place:]
                state = stack[-1] if stack else ("", "", False, False)
            if tag == "a":
                links = max(0, links - 1)
            if tag in ("td", "th"):
                held.append(" ")
            continue
        if tag in _BLOCK:
            close()
        if tag in ("br", "td", "th"):
            held.append(" ")
        if tag in _RAW:
            if not m[3].endswith("/"):
                end = _ENDS[tag].search(page, at)
                at = page.find(">", end.end()) + 1 or len(page) if end else len(page)
            continue
        if tag in _VOID:
            continue
        if tag == "a":
            links = 1
        if tag == "p" and stack and stack[-1][0] == "p":
            stack.pop()
            state = stack[-1] if stack else ("", "", False, False)
        if tag in _BLOCK or m[3]:
            attributes = _attributes(m[3])
            kind = _kind(tag, attributes, state[2])
            article = tag == "article" or attributes.get("itemprop") == "articleBody"
            main = tag == "main" or attributes.get("role", "").lower() == "main"
            path = "foreign" if "foreign" in (kind, state[1]) else kind or ("" if article or main else state[1])
            state = (tag, path, state[2] or article, state[3] or main)
            stack.append(state)
    close()
    if not any(part == MAIN for _, part, _, _ in out):
        out = [(t, MAIN if inside and part == PLAIN else part, share, inside) for t, part, share, inside in out]
    return [(t, part, share) for t, part, share, _ in out]


# ---- suffix array of a host -------------------------------------------------------------------


def suffix_ranks(stream: np.ndarray, depth: int = RUN) -> np.ndarray:
    """Rank of every suffix by its first ``depth`` tokens (a power of two): equal ranks are equal substrings."""
    rank = np.unique(stream, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < depth:
        after = np.zeros_like(rank)
        after[:-step] = rank[step:] + 1 if step < len(rank) else 0
        rank = np.unique(rank * (len(rank) + 2) + after, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return rank


def _spread(hit: np.ndarray, width: int = RUN) -> np.ndarray:
    """Tokens covered by the windows that start at a hit."""
    edge = np.zeros(len(hit) + 1, dtype=np.int64)
    edge[:-1] += hit
    at = np.flatnonzero(hit)
    np.subtract.at(edge, np.minimum(at + width, len(hit)), 1)
    return np.cumsum(edge[:-1]) > 0


def boilerplate(pages: list[list[tuple[str, int, float]]]) -> list[set[int]]:
    """For each page of a host the numbers of the blocks that repeated runs mark as boilerplate."""
    gone: list[set[int]] = [set() for _ in pages]
    first: dict[tuple, int] = {}
    same: dict[int, int] = {}
    tokens, page_of, block_of, part_of = [], [], [], []
    ids: dict[str, int] = {}
    stop = 0
    for p, page in enumerate(pages):
        key = tuple(page)
        if key in first:
            same[p] = first[key]
            continue
        first[key] = p
        for b, (text, part, _) in enumerate(page):
            words = text.split()
            tokens += [ids.setdefault(w, len(ids)) for w in words]
            page_of += [p] * len(words)
            block_of += [b] * len(words)
            part_of += [part] * len(words)
        stop -= 1  # a token of its own ends the page, so no run crosses pages
        tokens.append(stop)
        page_of.append(p)
        block_of.append(-1)
        part_of.append(MAIN)
    if len(tokens) > RUN:
        page_no, block_no, part = np.array(page_of), np.array(block_of), np.array(part_of)
        rank = suffix_ranks(np.array(tokens))
        n = int(rank.max()) + 1
        pairs = np.unique(rank * len(pages) + page_no)
        spread = np.bincount(pairs // len(pages), minlength=n)
        repeated = _spread(spread[rank] >= LEAST_PAGES)
        starts = np.flatnonzero(np.r_[True, (page_no[1:] != page_no[:-1]) | (block_no[1:] != block_no[:-1])])
        size = np.diff(np.r_[starts, len(tokens)])
        bad = (part[starts] == PLAIN) & (np.add.reduceat(repeated, starts) * 10 >= size * 6)
        for i in np.flatnonzero(bad & (block_no[starts] >= 0)):
            gone[page_no[starts[i]]].add(int(block_no[starts[i]]))
    for p, q in same.items():
        gone[p] = gone[q]
    return gone


def main_text(page: list[tuple[str, int, float]], gone: set[int]) -> str:
    if any(part == MAIN for _, part, _ in page):
        return "\n".join(t for b, (t, part, _) in enumerate(page) if part == MAIN and b not in gone)
    plain = [(b, t) for b, (t, part, share) in enumerate(page) if part == PLAIN and share < 0.6]
    left = [(b, t) for b, t in plain if b not in gone]
    if sum(len(t) for _, t in left) * 4 < sum(len(t) for _, t in plain):
        left = plain
    return "\n".join(t for _, t in left)


_PARSED = "texts array<string>, parts array<int>, shares array<double>"


def _parse(s: pd.Series) -> pd.DataFrame:
    rows = [blocks(t) for t in s]
    return pd.DataFrame({"texts": [[b[0] for b in r] for r in rows], "parts": [[b[1] for b in r] for r in rows], "shares": [[b[2] for b in r] for r in rows]})


def _host(table: pa.Table) -> pa.Table:
    pages = [list(zip(t, p, s, strict=True)) for t, p, s in zip(*(table.column(c).to_pylist() for c in ("texts", "parts", "shares")), strict=True)]
    texts = [main_text(page, gone) for page, gone in zip(pages, boilerplate(pages), strict=True)]
    return pa.table({"page_id": table.column("page_id"), "url": table.column("url"), "text": pa.array(texts, pa.string())})


# ---- hosts of any size ---------------------------------------------------------------------------


def _runs(s: pd.Series) -> pd.Series:
    known = _Hashes()
    return pd.Series([np.unique(word_runs(" ".join(t), (RUN,), known)[0]).view(np.int64) for t in s], dtype=object)


def _marked(page: list[tuple[str, int, float]], runs: np.ndarray, known: dict[str, int]) -> set[int]:
    """The numbers of the plain blocks that ``runs`` cover mostly."""
    size = np.array([len(t.split()) for t, _, _ in page])
    found = np.isin(word_runs(" ".join(t for t, _, _ in page), (RUN,), known)[0].view(np.int64), runs)
    repeated = _spread(np.concatenate([found, np.zeros(size.sum() - len(found), dtype=bool)]))
    bad = np.add.reduceat(repeated, np.cumsum(size) - size) * 10 >= size * 6
    return {b for b in np.flatnonzero(bad).tolist() if page[b][1] == PLAIN}


def _left(texts: pd.Series, parts: pd.Series, shares: pd.Series, runs: pd.Series) -> pd.Series:
    known, out = _Hashes(), []
    for t, p, s, r in zip(texts, parts, shares, runs, strict=True):
        page = list(zip(t, p, s, strict=True))
        out.append(main_text(page, _marked(page, r, known) if page and r is not None and len(r) else set()))
    return pd.Series(out, dtype=object)


def _large(parsed: DataFrame) -> DataFrame:
    """page_id, url, text of the pages of large hosts. Runs are counted on hosts that have pages without a main part: only there they decide."""
    pages = written(parsed.withColumn("key", F.xxhash64("texts", "parts", "shares")).withColumn(
        "open", F.array_contains("parts", PLAIN) & ~F.array_contains("parts", MAIN)), "pages-large")
    undecided = written(pages.filter("open").select("host").distinct(), "open-hosts")
    undecided = F.broadcast(undecided) if undecided.count() <= 100_000 else undecided  # as above: large hosts only
    streams = pages.join(undecided, "host", "left_semi").select("host", "key", "open", F.pandas_udf(_runs, "array<long>")("texts").alias("runs"))
    marks = written(streams.dropDuplicates(["host", "key"]), "page-runs").select("host", "key", "open", F.explode("runs").alias("run"))
    often = marks.groupBy("host", "run").agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("some")).filter(F.col("some") & (F.col("n") >= LEAST_PAGES))
    hits = marks.filter("open").join(often.select("host", "run"), ["host", "run"]).groupBy("host", "key").agg(F.collect_set("run").alias("runs"))
    known = pages.filter("not open").withColumn("runs", F.lit(None).cast("array<long>"))
    both = known.unionByName(pages.filter("open").join(hits, ["host", "key"], "left"))
    return both.select("page_id", "url", F.pandas_udf(_left, "string")("texts", "parts", "shares", "runs").alias("text"))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", page: str = "html", shard_pages: int = SHARD_PAGES,
            shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """page_id, url, text, n_chars of every row.

    Null and empty pages have an empty text. Pages without a host form a host of their own. Repeated rows give repeated rows; an empty table gives no rows;
    other columns are ignored. The runs of a host above ``shard_pages`` pages or ``shard_bytes`` bytes are counted over all its pages by a shuffled
    aggregation; no task ever holds a whole large host."""
    rows = internal(pages, page_id=page_id, url=url, html=page).withColumn(
        "host", F.lower(F.coalesce(F.regexp_extract("url", r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))))
    size = F.coalesce(F.octet_length("html"), F.lit(0))
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes"))
    hosts = hosts.select(F.col("host").alias("h"), F.ceil(F.greatest(F.col("n") / shard_pages, F.col("bytes") / shard_bytes)).alias("shards")).filter("shards > 1")
    # Large hosts only; beyond a fixed number of them they are joined by shuffle instead.
    hosts = F.broadcast(hosts) if hosts.count() <= 100_000 else hosts
    placed = rows.join(hosts, F.col("host") == F.col("h"), "left")

    def parsed(some: DataFrame) -> DataFrame:
        found = some.select("page_id", "url", "host", F.pandas_udf(_parse, _PARSED)(F.coalesce("html", F.lit(""))).alias("p"))
        return found.select("page_id", "url", "host", "p.*")

    kind = dict(rows.dtypes)["page_id"]
    out = parsed(placed.filter("h is null")).groupBy("host").applyInArrow(_host, f"page_id {kind}, url string, text string")
    out = out.unionByName(_large(parsed(placed.filter("h is not null"))))
    return out.withColumn("n_chars", F.length("text").cast("long"))


