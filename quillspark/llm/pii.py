"""Personal data: candidates from generous generators, boosted trees, calibrated thresholds.

The base patterns (e-mail addresses, IPv4 addresses, payment cards, phone numbers) always
count. Further generators propose spans that the base patterns miss, such as addresses
with ``(at)`` or numbers without a country code. Numbers that stand in a row are proposed in
every part that starts and ends with a group of digits, so a card before its expiry date
is proposed without it; proposals overlap. Boosted trees, some for each kind, judge each by its format and what
stands around it. They are trained on base spans of a bounded sample of the documents,
and on made-up data, rewritten into such formats, against proposals that are dates,
versions, prices, order numbers, phrases with "at" and the like. The surroundings are
those of base spans; a quarter of the documents' surroundings, with data of their own,
is held out. For each kind, the threshold is the least that keeps the wanted precision
on what is held out; the best-scored spans that overlap no other span are added.

A null text counts as empty. Repeated rows get equal results. Where a sample holds no
base span, the examples alone train the trees. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import hashed_sample, positive_hash, text_batches

KINDS = ("email", "ip", "card", "phone")
#: Documents whose base spans, with their surroundings, train the trees; and spans kept of them.
SAMPLE_ROWS, SAMPLE_SPANS = 20_000, 2_000
PRECISION = 0.99
AROUND = 40
#: Candidates whose features are held at once.
_BLOCK = 10_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: What the generators propose besides base spans.
_DOT = r"(?:\.| ?\((?i:dot)\) ?| ?\[(?i:dot)\] ?| (?i:dot) )"
_AT = rf"(?:@|\((?i:at)\)|\[(?i:at)\]|\{{(?i:at)\}}| (?i:at) (?=[\w-]{{1,40}}{_DOT}))"
_CARD_FORM = r"[0-9]{3,6}(?:[ ./_-]{0,3}[0-9]{2,6}){2,5}"
_PHONE_FORM = r"\(?[0-9]{2,4}\)?(?:[ ./-]{0,2}\(?[0-9]{2,5}\)?){1,4}"
GENERATORS = {
    "email": re.compile(rf"[A-Za-z0-9._%+-]{{1,64}} ?{_AT} ?[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{2,24}}){{1,4}}"),
    "ip": re.compile(r"(?<![\w.])[0-9]{1,3}(?: ?(?:\.|\[\.\]|\(dot\)|\[dot\]| dot ) ?[0-9]{1,3}){3}(?![\w])"),
    "card": re.compile(rf"(?<![\w]){_CARD_FORM}(?![\w])"),
    "phone": re.compile(rf"(?<![\w+])(?:00[ -]?)?{_PHONE_FORM}(?![\w])"),
}
_IPS = re.compile(f"(?=({GENERATORS['ip'].pattern}))")
#: Of numbers in a row: what may part two groups, the form of a part, and its least and most digits.
_GROUP = re.compile(r"[0-9]+")
_LEFT, _RIGHT = re.compile(r"\+?([0-9]+)\)?[ ./_-]{0,2}\(?$"), re.compile(r"\)?[ ./_-]{0,2}\(?([0-9]+)")
PARTS = {
    "card": (re.compile(r"[ ./_-]{1,3}"), re.compile(_CARD_FORM), 13, 19),
    "phone": (re.compile(r"\)?[ ./-]{0,2}\(?"), re.compile(rf"(?:\+[0-9]{{1,3}}(?:[ ./-]{{0,2}}\(?[0-9]{{2,5}}\)?){{1,4}}|(?:00[ -]?)?{_PHONE_FORM})"), 7, 15),
}
_MAY_MAIL = re.compile(r"@|\((?i:at)\)|\[(?i:at)\]|\{(?i:at)\}| (?i:at) [\w-]{1,40}(?: ?\((?i:dot)\)| ?\[(?i:dot)\]| (?i:dot) |\.[A-Za-z0-9-])")
#: Words before a span that speak for its kind.
CUES = {
    "email": ("mail", "contact", "write to", "reach", "address"),
    "ip": (" ip", "host", "server", "address", "connect", "from"),
    "card": ("card", "visa", "credit", "payment", "charge", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "fax", "mobile", "cell", "dial", "reach", "anruf", "appel", "llam"),
}
AGAINST = ("version", "order", "invoice", "isbn", "date", "page", "section", "id ", "no.", "price", "total", "serial", "part")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        x = ord(c) - 48
        if k % 2:
            x = 2 * x - 9 if x > 4 else 2 * x
        total += x
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, by kind and start."""
    out = []
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append(("email", start, m.end()))
            end = m.end()
        at = text.find("@", max(end, at + 1))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(y := x.lstrip("0")) <= 3 and int(y or 0) <= 255 for x in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_digits(m[0])) <= 15:
                    out.append(("phone", *m.span()))
    return out


def parts(kind: str, text: str, groups: list[tuple[int, int]]):
    """Spans from the start of a group of digits to the end of one, of the form and size of ``kind``; they overlap."""
    gap, form, least, most = PARTS[kind]
    for i, (first, _) in enumerate(groups):
        start = first
        if kind == "phone" and first and text[first - 1] in "+(":
            start -= 1
        elif first and text[first - 1].isalnum():
            continue
        n = -2 if kind == "phone" and text.startswith("00", first) else 0
        for j in range(i, len(groups)):
            a, b = groups[j]
            n += b - a
            if n > most or j > i and not gap.fullmatch(text, groups[j - 1][1], a):
                break
            if n < least or text[b : b + 1].isalnum():
                continue
            if kind == "phone":
                # with the brackets that belong to it, and without those around it and more
                inner = text.count("(", first, b) - text.count(")", first, b)
                begins = first if text[start] == "(" and inner == 0 else start
                b += text.startswith(")", b) and inner + (text[begins] == "(" and begins < first) == 1
                if form.fullmatch(text, begins, b):
                    yield begins, b
            elif form.fullmatch(text, start, b):
                yield start, b


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Proposed spans, each once; they may overlap."""
    out = {}
    if _MAY_MAIL.search(text):
        out.update((("email", *m.span()), None) for m in GENERATORS["email"].finditer(text))
    if _DIGIT.search(text):
        out.update((("ip", *m.span(1)), None) for m in _IPS.finditer(text))
        groups = [m.span() for m in _GROUP.finditer(text)]
        for kind in PARTS:
            out.update(((kind, *m.span()), None) for m in GENERATORS[kind].finditer(text))
            out.update(((kind, a, b), None) for a, b in parts(kind, text, groups))
    return list(out)


def _beside(before: str, after: str) -> list[float]:
    """Digits of the groups that the span would go on with, and whether an international prefix stands before it."""
    left, right = _LEFT.search(before), _RIGHT.match(after)
    return [float(len(left[1]) if left else 0), float(len(right[1]) if right else 0), float(bool(left) and (left[1].startswith("00") or left[0].startswith("+")))]


_WORD_DOT, _SHUT_DOT = re.compile(r" (?i:dot) "), re.compile(r"[(\[](?i:dot)[)\]]")
_AROUND_AT = re.compile(_AT)


def _mail(span: str) -> list[float]:
    """How an address writes its marks, and the sizes of its parts."""
    at = _AROUND_AT.search(span)
    if at is None:
        return [0.0] * 10
    mark, local, domain = at[0].strip(), span[: at.start()].strip(), span[at.end() :].strip()
    last = re.split(r"[^A-Za-z0-9-]+", domain)[-1]
    return [
        float(mark == "@"), float(mark[:1] in "([{"), float(mark.isupper()), float(len(_WORD_DOT.findall(domain))), float(len(_SHUT_DOT.findall(domain))),
        float(domain.count(".")), float(len(last)), float(last.isalpha()), float(len(local)), float(any(not c.isalpha() for c in local)),
    ]


def features(kind: str, text: str, start: int, end: int) -> list[float]:
    """Format of the span, and what stands around it."""
    span, before, after = text[start:end], text[max(0, start - AROUND) : start].lower(), text[end : end + AROUND]
    digits, groups = _digits(span), re.findall(r"[0-9]+", span)
    near = before[-12:] + after[:12]
    return [
        len(span), len(digits), len(groups), len(digits) / len(span),
        float(13 <= len(digits) <= 19 and luhn(digits)),
        float(len(groups) == 4 and all(len(g) <= 3 and int(g) <= 255 for g in groups)),
        float(span.startswith("00")), float("(" in span and ")" in span), span.count("."), span.count("-") + span.count("/"), span.count(" "),
        max(map(len, groups), default=0), min(map(len, groups), default=0), len(groups[0]) if groups else 0, len(groups[-1]) if groups else 0,
        float(bool(re.search(r"[A-Za-z]{2,}$", span))), float("@" in span or "at" in span.lower()),
        sum(c in before for c in CUES[kind]), sum(c in before for k in KINDS if k != kind for c in CUES[k]), sum(c in before for c in AGAINST),
        sum("0" <= c <= "9" for c in near), float(bool(before) and before[-1] in "$€£#"), float(after[:1] in ("%", "€", "$")),
        float(bool(re.match(r"(?:19|20)[0-9]{2}[-/.][01]?[0-9]|[0-3]?[0-9][-/.][01]?[0-9][-/.](?:19|20)", span))),
        *_beside(before, after),
        *(_mail(span) if kind == "email" else ()),
        float(len({re.sub(r"[0-9]+", "", x) for x in re.findall(r"[0-9]+[^0-9]+", span)}) == 1), sum(len(g) * 20**k for k, g in enumerate(groups[:4])),
    ]


# boosted trees


@dataclass
class Trees:
    """Each tree is (feature, threshold, left, right), with numbers as leaves."""

    start: float
    trees: list

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.start)
        for tree in self.trees:
            z += _leaves(tree, x)
        return 1 / (1 + np.exp(-z))


def _leaves(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    feature, cut, left, right = tree
    go = x[:, feature] <= cut
    out = np.empty(len(x))
    out[go], out[~go] = _leaves(left, x[go]), _leaves(right, x[~go])
    return out


_BINS = 16


def _grow(bins: np.ndarray, edges: list[np.ndarray], rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int, rate: float):
    """A tree over ``rows``. ``bins``: the bin of each row by feature, numbered on over the features."""
    leaf = float(rate * g[rows].sum() / (h[rows].sum() + 1.0))
    if depth == 0 or len(rows) < 20:
        return leaf
    own, shape = bins[rows].ravel(), (len(edges), _BINS)
    sums = [np.bincount(own, weights=np.repeat(w, shape[0]), minlength=shape[0] * _BINS).reshape(shape).cumsum(axis=1) for w in (g[rows], h[rows], np.ones(len(rows)))]
    (gl, hl, nl), whole = sums, [x[0, -1] for x in sums]
    gain = gl**2 / (hl + 1) + (whole[0] - gl) ** 2 / (whole[1] - hl + 1) - whole[0] ** 2 / (whole[1] + 1)
    gain = np.where((nl >= 5) & (nl <= whole[2] - 5), gain, 0)
    f, cut = np.unravel_index(gain.argmax(), shape)
    if gain[f, cut] <= 1e-3:
        return leaf
    go = bins[rows, f] <= f * _BINS + cut
    grown = [_grow(bins, edges, part, g, h, depth - 1, rate) for part in (rows[go], rows[~go])]
    return (int(f), float(edges[f][cut]), *grown)


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 4, rate: float = 0.3) -> Trees:
    """Gradient boosting of the logistic loss, over bins of each feature. The sample is bounded, so one process does."""
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Trees(float(np.log(share / (1 - share))), [])
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0.03, 0.97, _BINS - 1))) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") + f * _BINS for f, e in enumerate(edges)], axis=1)
    z = np.full(len(x), model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z))
        model.trees.append(_grow(bins, edges, np.arange(len(x)), y - p, p * (1 - p), depth, rate))
        z += _leaves(model.trees[-1], x)
    return model


# examples


# How the marks of an address are written, and what parts the groups of numbers.
_ATS = ["(at)", " (at) ", "[at]", " [at] ", "{at}", " at ", " AT ", " @ ", "(AT)"]
_DOTS = [".", "(dot)", " (dot) ", "[dot]", " [dot] ", " dot ", " DOT "]
_IP_DOTS = ["[.]", " dot ", "[dot]", "(dot)", " . "]
_CARD_GAPS = [".", "/", "  ", "_", " - ", " / "]
_COUNTRIES = ["1", "44", "49", "33", "34", "47"]


def _rewritten(kind: str, span: str, rng: random.Random) -> str | None:
    """The same datum in a format that the base patterns miss."""
    d = _digits(span)
    if kind == "email":
        at = rng.choice(_ATS)
        dot = rng.choice(_DOTS if at.strip() not in ("at", "AT") else [x for x in _DOTS if x.strip("( )[]").lower() == "dot"] + ["."])
        name, _, domain = span.partition("@")
        return name + at + domain.replace(".", dot)
    if kind == "ip":
        return rng.choice(_IP_DOTS).join(span.split("."))
    if kind == "card" and len(d) == 16:
        return rng.choice(_CARD_GAPS).join(d[k : k + 4] for k in range(0, 16, 4))
    if kind == "phone" and len(d) >= 10:
        a, b, c = d[-10:-7], d[-7:-4], d[-4:]
        country = rng.choice(_COUNTRIES)
        return rng.choice([
            f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"{a}/{b}-{c}", f"{a}/{b}{c}", f"({a}){b}-{c}",
            f"00{country} {a} {b} {c}", f"00{country} {a} {b}{c}", f"00{country}-{a}-{b}-{c}", f"0{a} {b}{c}", f"0{a}/{b}{c}",
        ])
    return None


def _plain(kind: str, span: str, rng: random.Random) -> str | None:
    """The same number in a usual format, which the base patterns miss only where other numbers adjoin."""
    d = _digits(span)
    if kind == "card" and len(d) == 16:
        return rng.choice([" ", "-", ""]).join(d[k : k + 4] for k in range(0, 16, 4))
    if kind == "phone":
        return _rewritten(kind, span, rng)
    return None


def _adjoining(rng: random.Random) -> str:
    """A number that may stand beside personal data."""
    r = rng.randrange
    return rng.choice([f"{r(1, 13):02}/{r(20, 40)}", f"{r(1, 13):02}/{r(2020, 2040)}", f"{r(100, 1000)}", f"{r(10, 60)}", f"{r(1950, 2030)}", f"{r(1000, 10000)}"])


def _innocent(rng: random.Random) -> str:
    """A number or phrase that generators propose and that is no personal data."""
    r = rng.randrange
    return rng.choice([
        f"{r(1950, 2030)}-{r(1, 13):02}-{r(1, 29):02}", f"{r(1, 29):02}.{r(1, 13):02}.{r(1950, 2030)}", f"{r(1, 13)}/{r(1, 29)}/{r(1950, 2030)}",
        f"{r(1950, 2030)} {r(1950, 2030)}", f"{r(10, 24)} {r(10, 60)} {r(10, 60)}", f"{r(1, 9)},{r(100, 999)},{r(100, 999)}", f"{r(10**12, 10**13)}", f"{r(10**9, 10**10)}",
        f"{r(10**15, 10**16)}", f"{r(1, 20)}.{r(0, 20)}.{r(0, 20)}.{r(256, 999)}", f"978-{r(0, 9)}-{r(10, 999)}-{r(10000, 99999)}-{r(0, 9)}", f"{r(100, 999)} {r(100, 999)} {r(100, 999)}",
        f"{r(1000, 9999)} {r(1000, 9999)} {r(1000, 9999)} {r(1000, 9999)}", f"{r(10, 99)}-{r(10, 99)}", f"{r(100, 999)}.{r(100, 999)}", f"{r(1950, 2030)}/{r(10, 99)}",
        f"{r(10, 100)} {r(10, 100)} {r(10, 100)} {r(10, 100)}", f"{r(100, 1000)} {r(10, 100)}", f"{r(1, 24)}:{r(10, 60)} {r(1, 29)}.{r(1, 13)}.{r(1950, 2030)}", f"{r(1, 50)} . {r(1, 50)} . {r(1, 50)}", f"v{r(1, 9)}.{r(1, 99)}.{r(1, 99)}.{r(1, 9999)}",
        _phrase(rng), _phrase(rng), _phrase(rng), _phrase(rng), _phrase(rng), _phrase(rng),
    ])


def _word(rng: random.Random, least: int = 2, most: int = 9) -> str:
    return "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randrange(least, most)))


def _phrase(rng: random.Random) -> str:
    """Words with an "at" and a dot that are no address."""
    a, b, c = _word(rng), _word(rng), _word(rng)
    return rng.choice([
        f"{a} at {b}.{c.title()}", f"{a} at {b}. {c}", f"{a} at {b}.{c}", f"{a} at the dot {c}", f"{a} at {b}-{c}.{_word(rng, 5, 12)}", f"{a} @ {rng.randrange(1, 99)}.{rng.randrange(10, 99)}",
        f"{a} @ {rng.randrange(1, 99)}.50 each", f"{a} at {rng.randrange(1, 24)}.{rng.randrange(10, 60)}", f"{a} (at {b}.{c})", f"look at {b}.com", f"{a} at dot {b}",
    ])


def _made_up(rng: random.Random) -> tuple[str, str]:
    r = rng.randrange
    kind = rng.choice(KINDS)
    if kind == "email":
        name = _word(rng, 3) + rng.choice(["", "", f".{_word(rng)}", f"_{r(100)}", f"{r(100)}", f".{r(10, 99)}"])
        return kind, f"{name}@{_word(rng, 3)}{rng.choice(['', '', f'-{_word(rng)}', f'{r(10)}', f'.{_word(rng)}'])}.{rng.choice(['com', 'org', 'net', 'de', 'fr', 'es', 'io', 'co.uk', 'info'])}"
    if kind == "ip":
        return kind, ".".join(str(r(1, 255)) for _ in range(4))
    if kind == "card":
        digits = "4" + "".join(str(r(10)) for _ in range(14))
        return kind, next(digits + str(k) for k in range(10) if luhn(digits + str(k)))
    return kind, f"+1 ({r(200, 999)}) 555-{r(1000, 9999)}"


def examples(spans: list[tuple[str, str, str, str]], seed: int = 23, made_up: int = 2000) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Features and labels by kind, from (kind, before, span, after) and made-up data in the same surroundings."""
    rng = random.Random(seed)
    around = [(b, a) for _, b, _, a in spans] or [("as it was said then ", " and so on")]
    rows, labels = {k: [] for k in KINDS}, {k: [] for k in KINDS}

    def add(before: str, span: str, after: str, of: str | None) -> None:
        text = before + span + after
        for kind, a, b in candidates(text):
            if a < len(before) + len(span) and b > len(before):
                right = kind == of and a == len(before) and b == len(before) + len(span)
                rows[kind].append(features(kind, text, a, b))
                labels[kind].append(float(right))

    made = [(k, *rng.choice(around), s) for k, s in (_made_up(rng) for _ in range(made_up))]
    for kind, before, after, span in [*((k, b, a, s) for k, b, s, a in spans), *made]:
        if (new := _rewritten(kind, span, rng)) is not None:
            if rng.random() < 0.5:
                before = before[:-1] + " " + rng.choice(CUES[kind]).strip() + rng.choice([": ", " ", " is "])
            add(before, new, after, kind)
            for usual in (_plain(kind, span, rng), new if kind == "card" else None):
                if usual is not None:
                    add(before, usual, f" {_adjoining(rng)} {after}", kind)
                    if rng.random() < 0.3:
                        add(f"{before}{_adjoining(rng)} ", usual, after, kind)
    for _ in range(2 * len(made)):
        before, after = rng.choice(around)
        if rng.random() < 0.4:
            before = before + rng.choice(AGAINST).strip() + " "
        add(before, _innocent(rng), after, None)
    return {k: (np.array(rows[k], dtype=float), np.array(labels[k])) for k in KINDS}


@dataclass
class Model:
    trees: dict[str, Trees]
    thresholds: dict[str, float]

    def score(self, text: str, found: list[tuple[str, int, int]]) -> np.ndarray:
        out = np.zeros(len(found))
        for kind in KINDS:
            own = [k for k, c in enumerate(found) if c[0] == kind]
            for k in range(0, len(own), _BLOCK):
                part = own[k : k + _BLOCK]
                out[part] = self.trees[kind].score(np.array([features(kind, text, *found[j][1:]) for j in part], dtype=float))
        return out


def fit(spans: list[tuple[str, str, str, str]], precision: float = PRECISION) -> Model:
    """``spans``: (kind, before, span, after). A quarter of them, by what stands before, is held out."""
    apart = [hashlib.sha256(b.encode("utf-8", "surrogatepass")).digest()[0] % 4 == 3 for _, b, _, _ in spans]
    learned = examples([x for x, h in zip(spans, apart, strict=True) if not h])
    held = examples([x for x, h in zip(spans, apart, strict=True) if h], seed=29, made_up=1000)
    trees, thresholds = {}, {}
    for kind in KINDS:
        trees[kind] = boost(*learned[kind])
        x, y = held[kind]
        p = trees[kind].score(x)
        # from the top, the share that is right among all that score as much
        order = np.argsort(-p, kind="stable")
        right = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
        good = np.flatnonzero((right >= precision) & (p[order] >= 0.5))
        # nothing is added where the precision is out of reach
        thresholds[kind] = float(p[order][good[-1]]) if len(good) else 1.01
    return Model(trees, thresholds)


class _Taken:
    """Disjoint intervals of a text."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts, self.ends = [], []
        for _, a, b in sorted(spans, key=lambda s: s[1:]):
            if self.starts and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        k = bisect_left(self.starts, b)
        return k > 0 and self.ends[k - 1] > a

    def add(self, a: int, b: int) -> None:
        k = bisect_left(self.starts, a)
        self.starts.insert(k, a)
        self.ends.insert(k, b)


def all_spans(model: Model, text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Base spans, and the candidates that the trees accept; these overlap no other span of any kind."""
    taken, out = _Taken(base), list(base)
    found = [c for c in candidates(text) if not taken.meets(*c[1:])]
    if found:
        p = model.score(text, found)
        for k in np.argsort(-p, kind="stable"):
            kind, a, b = found[k]
            if p[k] >= model.thresholds[kind] and not taken.meets(a, b):
                taken.add(a, b)
                out.append(found[k])
    return sorted(out, key=lambda s: (KINDS.index(s[0]), s[1]))


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_spans: int = SAMPLE_SPANS) -> Model:
    """Fit on base spans of a hashed sample; only these and what stands around them come to the driver."""
    text_batches(docs.sparkSession)

    def around(batches):
        for batch in batches:
            rows = [(k, t[max(0, a - AROUND) : a], t[a:b], t[b : b + AROUND]) for t in batch.column(0).to_pylist() if t for k, a, b in base_spans(t) if b - a < 100]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.string()) for j in range(4)], ["kind", "before", "span", "after"])

    share = min(1.0, sample_rows / max(1, docs.count()))
    some = docs.where(hashed_sample(share, 29, "doc_id")).select("text")
    found = some.mapInArrow(around, "kind string, before string, span string, after string")
    rows = found.orderBy(positive_hash(F.lit(31), "span", "before"), "span", "before", "after", "kind").limit(sample_spans).collect()
    return fit([tuple(r) for r in rows])


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def report(docs: DataFrame) -> DataFrame:
    """Counts and digest of the base spans, and all spans."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(train(docs))

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
    def found(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            base = base_spans(text or "")
            counts = [sum(k == kind for k, _, _ in base) for kind in KINDS]
            rows.append((*counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(all_spans(sent.value, text or "", base))))
        return pd.DataFrame(rows, columns=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return docs.select("doc_id", found("text").alias("x")).select("doc_id", "x.*")


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    text_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def without(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            if text is not None:
                last = len(text) + 1
                for kind, a, b in sorted(all_spans(sent.value, text, base_spans(text)), key=lambda s: -s[1]):
                    if b <= last:
                        text, last = f"{text[:a]}[{kind.upper()}]{text[b:]}", a
            out.append(text)
        return pd.Series(out)

    return docs.withColumn("text", without("text"))
