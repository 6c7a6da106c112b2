"""Personal data by a semi-Markov conditional random field over the output of fixed patterns.

The base finds e-mail addresses, IPv4 addresses, card numbers and phone numbers by pattern. The field then works on the zones of a
text that hold digits or @: it scores whole candidate segments (shape of the span, digit groups, separators, checks, words beside it) and a
dynamic program over segments of bounded length chooses boundaries and kinds together. It learns from the base spans of a bounded
sample and from written variants of them (a phone number without its country sign, other separators), so it adds spans that the patterns
miss. Base spans always stay; an added span never overlaps one.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import internal
from .quality import bounded

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS = 60_000
SAMPLE_ZONES = 600
MAX_TOKENS = 20
ZONE_CHARS = 400

# Possessive forms of the fixed patterns: a run of the first class always ends where the next class starts, so nothing is lost and no
# text takes more than linear time.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")
Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = sum(int(c) for c in digits[-1::-2])
    return (total + sum(d - 9 if d > 9 else d for d in (2 * int(c) for c in digits[-2::-2]))) % 10 == 0


def _octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or "0") <= 255


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its check, by start, then kind."""
    out: list[Span] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(_octet(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 12 <= m.end() - m.start() <= 40 and 12 <= len(d := _DIGITS.sub("", m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.sub("", m[0])) <= 15]
    return sorted(out)


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


# ---- zones and candidate segments --------------------------------------------------------------

_TRIGGER = re.compile(r"[0-9@]+")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\s+|.", re.S)
_WORD_BEFORE = re.compile(r"([^\W\d_]+)\W*\Z")
_EMAIL_SHAPE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+\Z")
_CUES = ({"mail", "email", "mailto", "contact"}, {"ip", "host", "server", "address"}, {"card", "visa", "pay", "credit", "mastercard"},
         {"phone", "tel", "call", "fax", "mobile", "telephone"})


def zones(text: str) -> list[tuple[int, int]]:
    """Ranges of neighbouring words that hold a digit or @; a longer one is cut at a word's end near ZONE_CHARS."""
    out: list[tuple[int, int]] = []
    for m in _TRIGGER.finditer(text):
        if out and m.start() < out[-1][1]:
            continue
        lo, hi = m.start(), m.end()
        floor = out[-1][1] if out else 0
        while lo > floor and m.start() - lo < ZONE_CHARS and not text[lo - 1].isspace():
            lo -= 1
        while hi < len(text) and hi - m.end() < ZONE_CHARS and not text[hi].isspace():
            hi += 1
        if out and lo - out[-1][1] <= 1 and hi - out[-1][0] <= ZONE_CHARS:
            out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def _bucket(x: int, cuts: tuple[int, ...]) -> int:
    return sum(x > c for c in cuts)


FEATURES: dict[str, int] = {}


def _name(*parts: object) -> int:
    """Index of a feature; the set is closed because every part comes from a short list."""
    return FEATURES.setdefault(":".join(map(str, parts)), len(FEATURES))


for _n in ["bias", "at", "email", "ip", "octets", "luhn", "plus", "paren", "balanced", "letters", "edge", "glued-left", "glued-right", "odd", "at-phone",
           *[f"digits:{i}" for i in range(9)], *[f"groups:{i}" for i in range(7)], *[f"sep:{a}" for a in ("none", "space", "dash", "dot", "mixed")],
           *[f"tail:{i}" for i in range(6)], *[f"cue:{i}" for i in range(5)], *[f"groups-digits:{a}:{b}" for a in range(7) for b in range(9)]]:
    _name(_n)


def _features(span: str, before: str, after: str, cue: int) -> list[int]:
    digits = _DIGITS.sub("", span)
    groups = [g for g in _DIGITS.split(span) if g]
    seps = set(re.sub(r"[^\W_]|[()+@]", "", span))
    sep = "none" if not seps else "space" if seps == {" "} else "dash" if seps == {"-"} else "dot" if seps == {"."} else "mixed"
    email = bool(_EMAIL_SHAPE.match(span))
    letters = any(c.isalpha() for c in span)
    d, g = _bucket(len(digits), (0, 3, 6, 8, 10, 12, 15, 19)), min(len(groups), 6)
    out = [_name("bias"), _name("digits", d), _name("groups", g), _name("sep", sep), _name("cue", cue), _name("tail", min(len(groups[-1]) if groups else 0, 5)),
           _name("groups-digits", g, d)]
    ip = len(groups) == 4 and sep == "dot" and not letters and "@" not in span and span.count(".") == 3
    tests = {
        "at": span.count("@") == 1, "email": email, "ip": ip, "octets": ip and all(_octet(x) for x in groups),
        "luhn": 12 <= len(digits) <= 19 and luhn(digits) and not letters, "plus": span[0] == "+", "paren": "(" in span,
        "balanced": span.count("(") == span.count(")") == 1, "letters": letters and not email, "edge": not (span[0].isalnum() or span[0] in "+(") or not span[-1].isalnum(),
        "glued-left": before.isalnum() or before in "@._%+-/#$=\"'", "glued-right": after.isalnum() or after in "@/\"'",
        "odd": bool(re.search(r"[^\w\s().+@%-]", span)),
    }
    return out + [_name(k) for k, v in tests.items() if v and (before or k != "glued-left") and (after or k != "glued-right")]


class Zone:
    """Tokens of a zone and its candidate segments: (first token, end token, features). A segment starts and ends off white space and
    holds a digit or @."""

    def __init__(self, text: str, lo: int, hi: int) -> None:
        self.at = [lo + m.start() for m in _TOKEN.finditer(text[lo:hi])] + [hi]
        n = self.n = len(self.at) - 1
        word = _WORD_BEFORE.search(text[max(0, lo - 40):lo])
        cue = next((i + 1 for i, c in enumerate(_CUES) if word and word[1].lower() in c), 0)
        self.segments: list[tuple[int, int, list[int]]] = []
        for i in range(n):
            first = text[self.at[i]]
            if not (first.isalnum() or first in "+("):
                continue
            hot = False
            for j in range(i + 1, min(n, i + MAX_TOKENS) + 1):
                piece = text[self.at[j - 1]:self.at[j]]
                hot = hot or piece[0] == "@" or piece[0].isdigit()
                if "\n" in piece:
                    break
                if not hot or not piece[-1].isalnum():
                    continue
                span = text[self.at[i]:self.at[j]]
                a, b = self.at[i], self.at[j]
                self.segments.append((i, j, _features(span, text[a - 1:a] if a else "", text[b:b + 1], cue)))


class Field:
    """Weights of features by kind, and of a kind after another; kind 4 is outside, whose segments are single tokens of score 0."""

    def __init__(self) -> None:
        self.w = np.zeros((len(FEATURES), len(KINDS)))
        self.t = np.zeros((5, 5))

    def scores(self, zone: Zone) -> list[np.ndarray]:
        return [self.w[f].sum(axis=0) for _, _, f in zone.segments]

    def _by_end(self, zone: Zone) -> list[list[int]]:
        ends: list[list[int]] = [[] for _ in range(zone.n + 1)]
        for k, (_, j, _) in enumerate(zone.segments):
            ends[j].append(k)
        return ends

    def best(self, zone: Zone) -> list[tuple[int, int, int]]:
        """The highest-scoring segmentation: (first token, end token, kind) of its spans."""
        scores, ends = self.scores(zone), self._by_end(zone)
        v = np.full((zone.n + 1, 5), -np.inf)
        v[0, 4] = 0.0
        back: dict[tuple[int, int], tuple[int, int]] = {}
        for j in range(1, zone.n + 1):
            step = v[j - 1] + self.t[:, 4]
            v[j, 4] = step.max()
            back[j, 4] = (j - 1, int(step.argmax()))
            for k in ends[j]:
                i = zone.segments[k][0]
                reach = v[i][:, None] + self.t[:, :4]
                into = reach.max(axis=0) + scores[k]
                for y in np.flatnonzero(into > v[j, :4]):
                    v[j, y] = into[y]
                    back[j, int(y)] = (i, int(reach[:, y].argmax()))
        out, j, y = [], zone.n, int(v[zone.n].argmax())
        while j > 0:
            i, before = back[j, y]
            if y < 4:
                out.append((i, j, y))
            j, y = i, before
        return out[::-1]

    def learn(self, zone: Zone, gold: set[tuple[int, int, int]], rate: float) -> None:
        """A gradient step on the log-likelihood of the gold segmentation, by forward and backward sums over segmentations."""
        scores, ends = self.scores(zone), self._by_end(zone)
        starts: list[list[int]] = [[] for _ in range(zone.n + 1)]
        for k, (i, _, _) in enumerate(zone.segments):
            starts[i].append(k)
        n = zone.n
        fwd, bwd = np.full((n + 1, 5), -np.inf), np.full((n + 1, 5), -np.inf)
        fwd[0, 4], bwd[n] = 0.0, 0.0
        with np.errstate(divide="ignore", invalid="ignore"):
            for j in range(1, n + 1):
                fwd[j, 4] = np.logaddexp.reduce(fwd[j - 1] + self.t[:, 4])
                for k in ends[j]:
                    into = np.logaddexp.reduce(fwd[zone.segments[k][0]][:, None] + self.t[:, :4], axis=0) + scores[k]
                    fwd[j, :4] = np.logaddexp(fwd[j, :4], into)
            for i in range(n - 1, -1, -1):
                total = self.t[:, 4] + bwd[i + 1, 4]
                for k in starts[i]:
                    total = np.logaddexp(total, np.logaddexp.reduce(self.t[:, :4] + scores[k] + bwd[zone.segments[k][1], :4], axis=1))
                bwd[i] = total
            z = np.logaddexp.reduce(fwd[n])
            for k, (i, j, f) in enumerate(zone.segments):
                pair = np.exp(fwd[i][:, None] + self.t[:, :4] + scores[k] + bwd[j, :4] - z)
                g = -pair.sum(axis=0)
                for y in range(4):
                    if (i, j, y) in gold:
                        g[y] += 1
                if np.abs(g).max() > 1e-4:
                    self.w[f] += rate * g
        self.w *= 1 - rate * 1e-3


def tokens_of(zone: Zone, spans: list[Span]) -> set[tuple[int, int, int]]:
    """Base spans that fall on token borders of the zone, longest first where they overlap."""
    place = {a: i for i, a in enumerate(zone.at)}
    known = {(i, j) for i, j, _ in zone.segments}
    out: set[tuple[int, int, int]] = set()
    for s, k, e in sorted(spans, key=lambda x: (x[0] - x[2], x[1])):
        i, j = place.get(s), place.get(e)
        if i is not None and j is not None and (i, j) in known and all(j <= a or i >= b for a, b, _ in out):
            out.add((i, j, k))
    return out


def variants(span: str, kind: int, r: random.Random) -> list[tuple[str, bool]]:
    """Other ways to write a found span (kind kept), and number signs of everyday text that are none of the kinds."""
    d = _DIGITS.sub("", span)
    n = lambda a, b: str(r.randint(a, b))
    none = [f"{n(1900, 2099)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", f"{n(0, 23)}:{r.randint(0, 59):02}", f"{n(1, 99)}.{n(0, 99)}.{n(0, 20)}", n(1, 10**r.randint(1, 15)),
            f"{n(1, 999)},{r.randint(0, 999):03}.{n(10, 99)}", f"{n(1, 99)}.{n(0, 99)}%", f"v{n(1, 9)}.{n(0, 9)}", f"{n(1, 500)}-{n(501, 999)}", f"{r.randrange(16**32):032x}",
            f"{n(256, 999)}.{n(256, 999)}.{n(0, 99)}.{n(0, 99)}", f"{n(1, 31)}/{n(1, 12)}/{n(1990, 2030)}", f"@{r.choice('abcdef')}{n(1, 999)}", f"{n(10**11, 10**13)}"]
    out = [(x, False) for x in r.sample(none, 3)]
    if kind == 3 and len(d) >= 10:
        a, b, c = d[-10:-7], d[-7:-4], d[-4:]
        out += [(x, True) for x in r.sample([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"{a} {b} {c}"], 2)]
    return out


def fit(samples: list[tuple[str, int, int]], epochs: int = 4, seed: int = 1) -> Field:
    """``samples``: (context, start and end of the zone in it). The gold segmentation of a zone is its base spans and written variants."""
    r, field, data = random.Random(seed), Field(), []
    for text, lo, hi in samples:
        spans = [s for s in base_spans(text) if lo <= s[0] and s[2] <= hi]
        zone = Zone(text, lo, hi)
        data.append((zone, tokens_of(zone, spans)))
        for s, k, e in spans[:1]:
            for form, positive in variants(text[s:e], k, r):
                new = text[:s] + form + text[e:]
                for a, b in zones(new):
                    if a <= s < b:
                        zone = Zone(new, a, b)
                        data.append((zone, tokens_of(zone, [(s, k, s + len(form))] if positive else [x for x in base_spans(new) if a <= x[0] and x[2] <= b])))
    for epoch in range(epochs):
        r.shuffle(data)
        for zone, gold in data:
            if zone.segments:
                field.learn(zone, gold, 0.5 / (1 + epoch))
    return field


def find(text: str, field: Field | None) -> tuple[list[Span], list[Span]]:
    """Base spans and added spans of a whole text."""
    base = base_spans(text)
    added: list[Span] = []
    if field is not None:
        for lo, hi in zones(text):
            zone = Zone(text, lo, hi)
            for i, j, k in field.best(zone) if zone.segments else []:
                s, e = zone.at[i], zone.at[j]
                if all(e <= a or s >= b for a, _, b in base):
                    added.append((s, k, e))
    return base, added


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_zones: int = SAMPLE_ZONES) -> Field | None:
    """The field, from at most ``sample_zones`` zones of about ``sample_docs`` documents chosen by a hash of doc_id and text. None if they hold
    no base span."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for t in part["text"]:
                for lo, hi in zones(t)[:20]:
                    a = max(0, lo - 60)
                    rows.append((t[a:hi + 20], lo - a, hi - a))
            yield pd.DataFrame(rows, columns=["t", "lo", "hi"])

    base = internal(docs, doc_id="doc_id", text="text").filter(F.col("text").isNotNull()).withColumn("k", F.xxhash64("doc_id", "text"))
    some = bounded(base, "k", sample_docs, docs.count(), 23).select("text")
    found = some.mapInPandas(run, "t string, lo int, hi int").orderBy(F.xxhash64("t", "lo"), "t", "lo").limit(sample_zones)
    samples = [tuple(r) for r in found.collect()]
    return fit(samples) if any(base_spans(t) for t, _, _ in samples) else None


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """doc_id, base and added spans as arrays of (kind, start, end) in code points (end exclusive), of every whole text.

    Null and empty texts have none; rows are read one by one, so repeated rows and null ids give rows of their own; an empty table
    gives no rows; other columns are ignored."""
    kind = "array<struct<kind:string,start:long,end:long>>"

    def run(s: pd.Series) -> pd.DataFrame:
        rows = []
        for t in s:
            if not _TRIGGER.search(t):
                rows.append(([], []))
                continue
            rows.append(tuple([{"kind": KINDS[k], "start": a, "end": b} for a, k, b in sorted(x)] for x in find(t, field)))
        return pd.DataFrame(rows, columns=["base", "added"])

    run.__annotations__ = {"s": pd.Series, "return": pd.DataFrame}
    rows = internal(docs, doc_id=doc_id, text=text)
    out = rows.select("doc_id", F.pandas_udf(run, f"base {kind}, added {kind}")(F.coalesce("text", F.lit(""))).alias("f"))
    return out.select("doc_id", "f.base", "f.added")


