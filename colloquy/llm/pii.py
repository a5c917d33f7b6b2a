"""Personal data: fixed patterns, and a semi-Markov conditional random field over whole spans.

The field scores candidate segments (runs of up to ``MOST_TOKENS`` tokens, about one entity) by features of the whole
span, such as its shape, its digit count and whether Luhn's sum holds; dynamic programming chooses boundaries and
types of a region jointly. Only regions with digits or an at sign are scored. Base spans stay; the field adds spans
that overlap none of them: other spellings of the four kinds, and secrets (keys, tokens, passwords).

There are no labelled spans to learn from, so the field learns from sentences made up here, entities and look-alikes in
many spellings, and is the same for every table.
"""

from __future__ import annotations

import functools
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone", "secret")
#: Kinds that the fixed patterns know.
BASE_KINDS = KINDS[:4]
MOST_TOKENS = 16
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))

LOCAL_PART = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can only begin where a run of digits does, so the look-behind changes nothing but the time that long runs take.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
#: Words with a digit or an at sign, and what joins them: one space.
REGION = re.compile(r"(?:[+(]*[^\s0-9@]{0,40}[0-9@]\S*)(?: [+(]*[^\s0-9@]{0,40}[0-9@]\S*)*")
TOKEN = re.compile(r"[0-9A-Za-z_]+|.", re.S)

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(v * 2 - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def base_spans(text: str | None) -> list[Span]:
    """Spans of the fixed patterns: per kind leftmost and non-overlapping, failing matches dropped without retries."""
    if not text or not TRIGGER.search(text):
        return []
    found: list[Span] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL_PART:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append(("email", start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    for m in IP.finditer(text):
        if all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append(("phone", *m.span()))
    return found


def _bucket(n: int) -> int:
    return n if n < 20 else 20 + min(n // 8, 8)


def span_features(s: str, before: str, after: str) -> tuple[str, ...]:
    """Features of a whole candidate span, of up to 16 characters before it and of the one after it."""
    digits = "".join(c for c in s if "0" <= c <= "9")
    letters = sum(c.isalpha() for c in s)
    shape = re.sub(r"[a-z]+", "a", re.sub(r"[A-Z]+", "A", re.sub(r"[0-9]+", lambda m: "9" * min(len(m[0]), 5), s)))
    plain = s.isalnum()
    mixed = plain and letters > 3 and len(digits) > 0
    found = [f"digits={_bucket(len(digits))}", f"at={s.count('@')}", f"dots={min(s.count('.'), 4)}", f"plus={s[0] == '+'}", f"plain={plain}", f"length={_bucket(len(s))}"]
    found += [f"shape={shape}" if len(shape) <= 24 else "shape=long", f"letters={letters > 0}", f"first={_class(s[0])}", f"last={_class(s[-1])}", f"before={_class(before[-1:])}", f"after={_class(after)}"]
    if mixed:
        found += ["hex" if not re.search("[^0-9a-f]", s) else "capitals" if s.isupper() else "any", f"mixed={_bucket(len(s))}", f"cue={_cue(before)}", f"start={s[:3]}"]
    if len(digits) >= 13 and not letters:
        found.append(f"luhn={luhn(digits)}")
    if s.count(".") == 3 and not letters:
        found.append(f"octets={all(x.isdigit() and int(x) <= 255 for x in s.split('.') if len(x) < 9)}")
    return tuple(found)


def _cue(before: str) -> str:
    """The last word before a span, and what stands between."""
    m = re.search(r"([a-z]{3,12})([\s\"'=:]{1,4})$", before.lower())
    return f"{m[1]}{''.join(sorted(set(m[2]) - {' '}))}" if m else "none"


def _class(c: str) -> str:
    return "edge" if not c else "9" if c.isdigit() else "a" if c.isalpha() else "_" if c.isspace() else c


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


class SemiMarkovField:
    """Weights of (kind, feature); segments outside entities are single tokens that score nothing."""

    def __init__(self, weights: dict[str, list[float]] | None = None) -> None:
        self.weights = {} if weights is None else weights

    @staticmethod
    def segments_to(text: str, edges: list[int], j: int, first: int = 0) -> Iterator[tuple[int, tuple[str, ...]]]:
        """Candidate segments that end with token j - 1: their first token (``first`` or later) and their features."""
        end = edges[j]
        if not text[end - 1].isalnum():
            return
        for i in range(j - 1, max(j - MOST_TOKENS, first) - 1, -1):
            begin = edges[i]
            if end - begin > 80:
                return
            if text[begin].isalnum() or text[begin] in "+(":
                s = text[begin:end]
                if TRIGGER.search(s):
                    yield i, span_features(s, text[max(0, begin - 16) : begin], text[end : end + 1])

    def lattice(self, text: str, start: int, end: int) -> tuple[list[int], list[tuple[int, int, tuple[str, ...]]]]:
        """Token edges of a region, and all its candidate segments (first token, token after the last, features)."""
        edges = [m.start() for m in TOKEN.finditer(text, start, end)] + [end]
        return edges, [(i, j, found) for j in range(1, len(edges)) for i, found in self.segments_to(text, edges, j)]

    def scores(self, features: tuple[str, ...]) -> list[float]:
        found = [w for f in features if (w := self.weights.get(f))]
        return [sum(x) for x in zip(*found)] if found else [0.0] * len(KINDS)

    @staticmethod
    def marginals(edges: list[int], segments: list, score: np.ndarray) -> np.ndarray:
        """Probability of each (segment, kind), by forward and backward sums over all segmentations."""
        n = len(edges) - 1
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        starts: list[list[int]] = [[] for _ in range(n + 1)]
        for k, (i, j, _) in enumerate(segments):
            ends[j].append(k)
            starts[i].append(k)
        total = np.logaddexp.reduce(score, axis=1).tolist()
        a, b = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            a[j] = _log_sum([a[j - 1], *(a[segments[k][0]] + total[k] for k in ends[j])])
        for i in range(n - 1, -1, -1):
            b[i] = _log_sum([b[i + 1], *(b[segments[k][1]] + total[k] for k in starts[i])])
        outside = np.array([a[i] + b[j] for i, j, _ in segments])
        return np.exp(np.minimum(score + outside[:, None] - a[n], 0))

    def best(self, text: str, start: int, end: int) -> list[tuple[str, int, int, float]]:
        """The best joint choice of boundaries and types in a region: (kind, start, end, score).

        Left to right; a segment's features are let go once it is scored, so a long region holds three numbers a token.
        """
        edges = [m.start() for m in TOKEN.finditer(text, start, end)] + [end]
        value, back = [0.0] * len(edges), [None] * len(edges)
        for j in range(1, len(edges)):
            value[j] = value[j - 1]
            for i, found in self.segments_to(text, edges, j):
                score = self.scores(found)
                top = max(score)
                if value[i] + top > value[j]:
                    value[j], back[j] = value[i] + top, (i, score.index(top), top)
        out, j = [], len(edges) - 1
        while j > 0:
            if back[j] is None:
                j -= 1
                continue
            i, kind, score = back[j]
            out.append((KINDS[kind], edges[i], edges[j], score))
            j = i
        return out[::-1]

    def spans(self, text: str, margin: float) -> list[Span]:
        """Spans of every region whose score is at least ``margin`` over leaving them out."""
        return [(kind, a, b) for m in REGION.finditer(text) for kind, a, b, score in self.best(text, *m.span()) if score >= margin]


def _luhn_number(rng: random.Random, n: int) -> str:
    digits = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return digits + next(c for c in "0123456789" if luhn(digits + c))


def _some(rng: random.Random, letters: str, low: int, high: int) -> str:
    return "".join(rng.choice(letters) for _ in range(rng.randint(low, high)))


_LOWER, _NINE, _HEX = "abcdefghijklmnopqrstuvwxyz", "0123456789", "0123456789abcdef"
_ANY = _LOWER + _LOWER.upper() + _NINE


def made_up(rng: random.Random) -> tuple[str, str, str]:
    """What stands before an entity, the entity, and its kind; look-alikes have an empty kind."""
    kind = rng.choice(["email", "ip", "card", "phone", "secret", "secret", "", "", "", ""])
    cue = ""
    if kind == "email":
        s = f"{_some(rng, _LOWER + _NINE, 1, 8)}{rng.choice(['.', '_', '-', '+', ''])}{_some(rng, _LOWER + _NINE, 1, 6)}@{_some(rng, _LOWER + _NINE, 2, 8)}{rng.choice(['.', '-x.'])}{rng.choice(['com', 'org', 'co.uk', 'example.com'])}"
    elif kind == "ip":
        s = ".".join(str(rng.randint(0, 255)) for _ in range(4))
    elif kind == "card":
        number = _luhn_number(rng, rng.choice([15, 16, 16, 16, 19]))
        gap = rng.choice(["", "", " ", "-", "."])
        s = f"{number[:4]}{gap}{number[4:10]}{gap}{number[10:]}" if len(number) == 15 else gap.join(number[i : i + 4] for i in range(0, len(number), 4))
    elif kind == "phone":
        three = lambda n=3: _some(rng, _NINE, n, n)
        s = rng.choice([f"+{three(rng.randint(1, 2))} ({three()}) {three()}-{three(4)}", f"({three()}) {three()}-{three(4)}", f"{three()}-{three()}-{three(4)}", f"{three()}.{three()}.{three(4)}", f"+{three(11)}", f"00{three(2)} {three(2)} {three(6)}", f"1-800-{three()}-{three(4)}"])
    elif kind == "secret":
        cue, s = rng.choice([
            ("", "AKIA" + _some(rng, _LOWER.upper() + "234567", 15, 15) + rng.choice("234567")), (rng.choice(["password=", "passwd=", "pwd: ", "password: ", "secret="]), _some(rng, _HEX, 8, 24)),
            (rng.choice(['token = "', 'token="', 'secret = "', 'key = "', "token: '"]), _some(rng, _HEX, 32, 64)), (rng.choice(["key=", "token: ", "secret: ", 'key: "']), _some(rng, _ANY, 20, 44)), ("", rng.choice(["ghp_", "sk_live_"]) + _some(rng, _ANY, 24, 36)),
            (rng.choice(["password=", "password: "]), _some(rng, _ANY, 10, 16)),
        ])
        if not any(c.isdigit() for c in s) or sum(c.isalpha() for c in s) < 4:
            return made_up(rng)
    else:
        n = lambda low, high: str(rng.randint(low, high))
        cue, s = rng.choice([
            ("", f"{n(0, 12)}.{n(0, 9)}"), ("version ", n(1, 9)), ("v", f"{n(0, 12)}.{n(0, 30)}.{n(0, 9)}"), ("", n(1, 2100)), ("", f"20{n(10, 29)}-{n(10, 12)}-{n(10, 28)}"), ("", f"{n(1, 28)}/{n(1, 12)}/20{n(10, 29)}"),
            ("", f"{n(1, 28)}.{n(1, 12)}.20{n(10, 29)}"), ("", f"{n(10, 23)}:{n(10, 59)}:{n(10, 59)}"), ("", f"{n(1, 9)}-{n(10, 99)}"), ("$", f"{n(1, 999)},{n(100, 999)}.{n(10, 99)}"), ("", n(10**5, 10**11)), ("", f"978-{n(1, 9)}-{n(10, 99)}-{n(100000, 999999)}-{n(0, 9)}"),
            ("", " ".join(n(0, 99) for _ in range(rng.randint(2, 9)))), ("", f"{_some(rng, _LOWER, 1, 6)}{n(0, 99)}"), ("", f"{_some(rng, _LOWER.upper(), 1, 3)}{n(1, 99)}"), ("@", f"{_some(rng, _LOWER, 3, 9)}{n(0, 99)}"), ("", f"{n(256, 999)}.{n(256, 999)}.{n(0, 255)}.{n(0, 255)}"), ("", f"{n(1, 99)}%"), ("", f"{n(4, 99)}th"),
            ("commit ", _some(rng, _HEX, 40, 40)), ("", f"{_some(rng, _HEX, 8, 8)}-{_some(rng, _HEX, 4, 4)}-{_some(rng, _HEX, 4, 4)}-{_some(rng, _HEX, 12, 12)}"), ("http://a.org/", f"{_some(rng, _LOWER, 2, 6)}/{n(1, 9999)}"), ("", f"{n(1000, 1999)}-{n(2000, 2100)}"),
            ("", next(x for x in iter(lambda: _some(rng, "123456789", 16, 16), None) if not luhn(x))),
        ])
    return cue, s, kind


def made_up_texts(examples: int, seed: int) -> list[tuple[str, list[Span]]]:
    """Sentences of one to three entities or look-alikes between made-up words, and their spans."""
    rng, out = random.Random(seed), []
    for _ in range(examples):
        text, spans = "", []
        for _ in range(rng.choice([1, 1, 1, 2, 3])):
            text += f"{_some(rng, _LOWER, 2, 9)}{rng.choice([' ', ' ', ' ', ': ', chr(10), ', '])}" if rng.random() < 0.9 else ""
            cue, s, kind = made_up(rng)
            text += cue
            if kind:
                spans.append((kind, len(text), len(text) + len(s)))
            text += s + ('"' if cue.endswith('"') else "'" if cue.endswith("'") else "") + rng.choice([" ", " ", ". ", ", ", ".\n", "\n"])
        out.append((text + _some(rng, _LOWER, 2, 9), spans))
    return out


@functools.lru_cache(maxsize=4)
def fit_field(examples: int = 900, rounds: int = 10, rate: float = 0.5, decay: float = 0.0005, seed: int = 5) -> SemiMarkovField:
    """Maximum likelihood by stochastic gradient on ``examples`` made-up sentences, ``rounds`` times. No table is read, so
    the field and its size (a few thousand weights) are the same whatever the data; the bound is on training only."""
    field, ready, index = SemiMarkovField(), [], {}
    for text, spans in made_up_texts(examples, seed):
        labels = {(a, b): kind for kind, a, b in spans}
        for m in REGION.finditer(text):
            edges, segments = field.lattice(text, *m.span())
            if segments:
                gold = np.zeros((len(segments), len(KINDS)))
                for k, (i, j, _) in enumerate(segments):
                    if kind := labels.get((edges[i], edges[j])):
                        gold[k, KINDS.index(kind)] = 1
                at = np.array([x for *_, found in segments for x in (index.setdefault(f, len(index)) for f in found)])
                ready.append((edges, segments, gold, at, np.repeat(np.arange(len(segments)), [len(found) for *_, found in segments])))
    weights = np.zeros((len(index), len(KINDS)))
    for turn in range(rounds):
        step = rate / (1 + 0.2 * turn)
        for edges, segments, gold, at, of in ready:
            score = np.zeros_like(gold)
            np.add.at(score, of, weights[at])
            slope = gold - field.marginals(edges, segments, score)
            weights[np.unique(at)] *= 1 - decay * step
            np.add.at(weights, at, step * slope[of])
    field.weights.update({f: weights[k].tolist() for f, k in index.items()})
    return field


def all_spans(text: str | None, field: SemiMarkovField, margin: float) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and added spans together, each by kind as listed and then start."""
    if not text or not TRIGGER.search(text):
        return [], []
    base = base_spans(text)
    starts, reach = [], []
    for _, a, b in sorted(base, key=lambda s: s[1]):
        starts.append(a)
        reach.append(max(b, reach[-1]) if reach else b)
    more = [s for s in field.spans(text, margin) if not (k := bisect_left(starts, s[2])) or reach[k - 1] <= s[1]]
    return base, sorted(base + more, key=lambda s: (KINDS.index(s[0]), s[1]))


def find_spans(docs: DataFrame, field: SemiMarkovField, column: str = "text", margin: float = 2.0) -> DataFrame:
    """Adds ``base_spans`` and ``pii_spans``: arrays of (kind, start, end) in code points, end exclusive.

    Null is an empty text and has no spans; columns of those two names are replaced, all others stay; repeated rows are
    searched one by one; an empty table gives an empty result. A text is searched whole and in one pass; what a region
    of it holds in memory is three numbers a token.
    """
    result = T.StructType([T.StructField("base", SPANS), T.StructField("all", SPANS)])

    @F.pandas_udf(result)
    def search(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        as_dicts = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for batch in texts:
            both = [all_spans(t, field, margin) for t in batch]
            yield pd.DataFrame({"base": [as_dicts(x) for x, _ in both], "all": [as_dicts(x) for _, x in both]})

    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("base_spans", "pii_spans")]
    packed = docs.select(F.struct(*others).alias("doc"), search.asNondeterministic()(F.col(column)).alias("found"))
    return packed.select("doc.*", F.col("found.base").alias("base_spans"), F.col("found.all").alias("pii_spans"))


def redact(docs: DataFrame, field: SemiMarkovField, column: str = "text", margin: float = 2.0) -> DataFrame:
    """Puts <KIND> in place of every span (of spans that overlap, the union under the first one's kind).

    All other columns stay as they are; a null text stays null; cases else as for ``find_spans``.
    """

    @F.pandas_udf("string")
    def cover(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([redacted(t, all_spans(t, field, margin)[1]) for t in batch], dtype=object)

    return docs.withColumn(column, cover(F.col(column)))


def redacted(text: str | None, spans: list[Span]) -> str | None:
    if not spans:
        return text
    merged: list[list] = []
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if merged and a < merged[-1][2]:
            merged[-1][2] = max(merged[-1][2], b)
        else:
            merged.append([kind, a, b])
    parts, at = [], 0
    for kind, a, b in merged:
        parts += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*parts, text[at:]])


def span_text(spans: str) -> Column:
    """kind:start:end, comma-joined, of an array of spans."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
