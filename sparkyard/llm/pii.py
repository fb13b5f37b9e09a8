"""Personal data: base patterns, generous candidates, boosted trees, calibrated thresholds.

Base spans follow four fixed patterns and always stay. Generators then propose overlapping spans
with high recall where the base patterns are silent: parts of number runs that are too long as a
whole, other separators, missing plus signs, spelled-out addresses. Trees over format and context
features score the candidates; an isotonic curve turns margins into probabilities, and a
threshold for each kind is the lowest at which held-out precision stays at PRECISION. There are
no labels for personal data in the corpus, so the trees learn from values and look-alikes that
`examples` writes into invented contexts.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .boosting import Trees, boost
from .common import fields, map_texts
from .quality import isotonic

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98

# The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_EMAIL_CHARS = re.compile(r"[A-Za-z0-9._%+@-]*")
_NOT_EMAIL = re.compile(r"[^A-Za-z0-9._%+@-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9][0-9.]*")
_NUMBERS = re.compile(r"[0-9][+0-9\x20().-]*")

Span = tuple[int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _ip_ok(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in s.split("."))


def _card_ok(s: str) -> bool:
    d = _digits(s)
    return 16 <= len(d) <= 19 and luhn(d)


def _phone_ok(s: str) -> bool:
    return 8 <= len(_digits(s)) <= 15


def email_runs(text: str) -> Iterator[Span]:
    """Maximal runs of address characters that hold an at sign: no match leaves its run."""
    at = text.find("@")
    while at >= 0:
        start = at
        while start and not _NOT_EMAIL.match(text, start - 1):
            start -= 1
        end = _EMAIL_CHARS.match(text, at).end()
        yield start, end
        at = text.find("@", end)


def number_runs(text: str) -> Iterator[Span]:
    """Maximal runs of number characters from a digit (or its plus sign) on."""
    for m in _NUMBERS.finditer(text):
        start = m.start()
        yield (start - 1 if start and text[start - 1] == "+" else start), m.end()


def _emails(text: str, a: int, b: int) -> Iterator[Span]:
    """Matches of EMAIL in a run of its characters, in time linear in the run."""
    while (at := text.find("@", a, b)) >= 0:
        domain = _DOMAIN.match(text, at + 1, b) if at > a else None
        if domain:
            yield a, domain.end()
        a = domain.end() if domain else at + 1


def _ips(text: str, a: int, b: int) -> Iterator[Span]:
    """Matches of IP in a run of number characters, in time linear in the run."""
    for run in _DOTTED.finditer(text, a, b):
        at, groups = run.start(), []
        for g in run[0].split("."):
            if g:
                groups.append(at)
                if len(groups) == 4:
                    yield groups[0], at + len(g)
                    groups = []
            else:
                groups = []
            at += len(g) + 1


def base_spans(text: str) -> dict[str, list[Span]]:
    """Spans of each kind as the base patterns find them in the whole text."""
    found: dict[str, list[Span]] = {k: [] for k in KINDS}
    for a, b in email_runs(text):
        found["email"] += _emails(text, a, b)
    for a, b in number_runs(text):
        if b - a < 7:
            continue
        if text.find(".", a, b) >= 0:
            found["ip"] += [(x, y) for x, y in _ips(text, a, b) if _ip_ok(text[x:y])]
        if b - a >= 16:
            found["card"] += [m.span() for m in CARD.finditer(text, a, b) if _card_ok(m[0])]
        if text.find("+", a, b) >= 0:
            found["phone"] += [m.span() for m in PHONE.finditer(text, a, b) if _phone_ok(m[0])]
    return found


_WIDE = re.compile(r"[+(]{0,2}[0-9][0-9\x20().+\-/ ‐-–]{5,}[0-9]")
_PIECES = re.compile(r"[0-9]+")
_AT = r"(?:\s?[\[({]\s?(?:at|@)\s?[\])}]\s?|\s+at\s+|\s?@\s?)"
_DOT = r"(?:\s?[\[({]\s?(?:dot|\.)\s?[\])}]\s?|\s+dot\s+|\.)"
_SPELLED = re.compile(rf"[A-Za-z0-9._%+-]+{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+", re.IGNORECASE)
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]", re.IGNORECASE)
#: The core of every _AT: each alternative starts with a character of its own, so that a search skips fast.
_MARK = re.compile("|".join([*(rf"\{c}\s?(?:[aA][tT]|@)\s?[\])}}]" for c in "[({"), "@", *(rf"{c}[tT](?=\s)(?<=\s..)" for c in "aA")]))


def _spelled(text: str) -> Iterator[Span]:
    """Matches of _SPELLED at every at sign and word at, from the whole run of address characters before it."""
    for mark in _MARK.finditer(text):
        end = mark.start()
        while end and text[end - 1].isspace():
            end -= 1
        start = end
        while start and _LOCAL.match(text, start - 1):
            start -= 1
        # the address characters before a mark hold no other mark, so all runs together are linear
        if start < end and (m := _SPELLED.match(text, start)):
            yield m.span()


def candidates(text: str) -> Iterator[tuple[str, int, int]]:
    """Overlapping (kind, start, end) that might be personal data."""
    for a, b in _spelled(text):
        yield "email", a, b
    for zone in _WIDE.finditer(text):
        groups = [m.span() for m in _PIECES.finditer(text, *zone.span())]
        for i, (a, _) in enumerate(groups):
            count = 0
            for j in range(i, len(groups)):
                b = groups[j][1]
                count += b - groups[j][0]
                if count > 19:
                    break
                if j == i + 3 and re.fullmatch(r"[0-9]+(\s?\.\s?[0-9]+){3}", text[a:b]):
                    yield "ip", a, b
                if 13 <= count <= 19:
                    yield "card", a, b
                if 7 <= count <= 15:
                    lead = a
                    while lead > zone.start() and text[lead - 1] in "+(":
                        lead -= 1
                    yield "phone", lead, b


#: Words near a value that speak for a kind.
_CUES = {
    "email": ("mail", "contact", "write", "address"),
    "ip": ("ip", "host", "server", "addr", "login"),
    "card": ("card", "visa", "credit", "pay", "master"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "number"),
}
_AGAINST = ("order", "id", "version", "total", "price", "date", "isbn", "page", "sum", "ratio", "=", "#", "$", "€", "%")


def features(text: str, kind: str, a: int, b: int) -> list[float]:
    """Numbers that describe a candidate's format and what stands around it."""
    s, before, after = text[a:b], text[max(0, a - 24) : a].lower(), text[b : b + 12].lower()
    digits = _digits(s)
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    left, right = before[-1:], after[:1]
    touches = lambda c: float(c.isalnum() or c in "_") if c else 0.0
    more = bool(re.search(r"[0-9][\x20.()+-]{0,2}$", before)) + bool(re.match(r"[\x20.()-]{0,2}[0-9]", after))
    return [
        float(KINDS.index(kind)),
        len(digits),
        len(s),
        len(groups),
        max(groups),
        min(groups),
        float(len(digits) > 12 and luhn(digits)),
        float(s[:1] == "+"),
        float("(" in s and ")" in s),
        float(s.count("(") != s.count(")")),
        float(digits[:1] in ("3", "4", "5", "6")),
        float(groups in ([4, 4, 4, 4], [16], [4, 6, 5])),
        float(len(groups) == 4 and all(0 <= int(g) <= 255 for g in re.findall(r"[0-9]{1,9}", s)[:4])),
        len(set(digits)),
        float(len(set(re.findall(r"[^0-9]", s.lstrip("+(")))) if kind != "email" else 0),
        touches(left),
        touches(right),
        float(more),
        float(left in "+-.,/:#" if left else 0),
        float(any(c in before for c in _CUES[kind])),
        float(any(c in before or c in after[:3] for c in _AGAINST)),
        float(len(groups) > 1 and groups[-1] == 4),
        float(s.count(".")),
        float(bool(re.search(r"@", s))),
        float(bool(re.search(r"(?i)[\[({]at[\])}]|\bdot\b", s))),
        float(bool(re.search(r"\s", s))),
        float(len(re.findall(r"[A-Za-z]+", s.split("@")[-1])[-1:]) and len(re.findall(r"[A-Za-z]+", s)[-1]) if re.search("[A-Za-z]", s) else 0),
    ]


def _valid_card(rng: random.Random, n: int) -> str:
    d = rng.choice("3456") + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return next(d + c for c in "0123456789" if luhn(d + c))


def _grouped(d: str, sizes: tuple[int, ...], sep: str) -> str:
    out, at = [], 0
    for k in sizes:
        out.append(d[at : at + k])
        at += k
    return sep.join(x for x in [*out, d[at:]] if x)


def examples(count: int, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """Invented texts with the personal spans that were written into them."""
    rng = random.Random(seed)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice(("an", "er", "th", "in", "on", "re", "ly", "st")) for _ in range(rng.randrange(1, 4)))
    sep = lambda: rng.choice((" ", "-", ".", " ", " ", "/"))

    def value() -> tuple[str | None, str]:
        k = rng.randrange(18)
        if k < 3:
            n = rng.choice((15, 16, 16, 16, 19))
            return "card", _grouped(_valid_card(rng, n), (4, 6) if n == 15 else (4, 4, 4), rng.choice(("", " ", "-", ".", " ")))
        if k < 6:
            area, tail = num(3), f"{num(3)}{rng.choice('-. ')}{num(4)}"
            return "phone", rng.choice((f"+{num(rng.randrange(1, 4))} ({area}) {tail}", f"({area}) {tail}", f"+{num(2)} {area} {num(3)} {num(4)}", f"{area}-{num(3)}-{num(4)}", f"+{num(1)}-{area}-{num(3)}-{num(4)}"))
        if k < 8:
            return "ip", ".".join(str(rng.randrange(256)) for _ in range(4))
        if k < 10:
            at, dot = rng.choice(((" [at] ", " [dot] "), (" at ", " dot "), ("(at)", "(dot)"), ("@", ".")))
            return "email", f"{word()}{rng.choice(('', '.', '_'))}{word()}{at}{word()}{dot}{rng.choice(('com', 'org', 'net', 'de'))}"
        fakes = (
            lambda: num(rng.randrange(6, 20)),
            lambda: f"{num(4)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 29):02} {num(2)}.{num(2)}",
            lambda: f"{rng.randrange(10)}.{num(3)}.{num(3)}.{num(3)}",
            lambda: f"{num(3)}.{rng.randrange(256, 999)}.{num(2)}.{num(1)}",
            lambda: f"{num(3)} {num(3)} {num(3)} {num(3)} {num(3)}",
            lambda: f"{num(3)}-{num(1)}-{num(4)}-{num(4)}-{num(1)}",
            lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)),
            lambda: f"{word()} at {word()} dot {word()} {word()}",
            lambda: f"{num(5)}/{num(5)} {num(2)}",
            lambda: f"{num(2)}.{num(2)}.{num(4)} - {num(2)}.{num(2)}.{num(4)}",
            lambda: _grouped(num(16), (4, 4, 4), sep()),
        )
        return None, rng.choice(fakes)()

    made = []
    for _ in range(count):
        text, spans = " ".join(word() for _ in range(rng.randrange(3))), []
        close = False  # right behind the value before
        for _ in range(rng.randrange(1, 4)):
            kind, s = value()
            cue = rng.choice((*_CUES[kind], "", "", "")) if kind else rng.choice((*_AGAINST, "", ""))
            if not close:
                text += rng.choice((" ", ". ", ", ", "\n")) + cue + rng.choice((" ", ": ", " ", " "))
            close = rng.random() < 0.25
            if kind:
                spans.append((kind, len(text), len(text) + len(s)))
            text += s
            if close:
                text += " "
                continue
            text += rng.choice(("", "", "!!", "%%%", ",", " ")) + rng.choice((" ", "\n", ". ")) + " ".join(word() for _ in range(rng.randrange(3)))
        made.append((text, spans))
    return made


@dataclass(frozen=True)
class PiiModel:
    trees: Trees
    knots: np.ndarray
    values: np.ndarray
    thresholds: dict[str, float]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.trees.margin(x), self.knots, self.values)


@lru_cache(maxsize=2)
def fit_pii(count: int = 4000, seed: int = 11, precision: float = PRECISION) -> PiiModel:
    """Trees, curve and thresholds from `count` invented texts, a third of them held out."""
    x, y, held, kinds = [], [], [], []
    for i, (text, spans) in enumerate(examples(count, seed)):
        true = set(spans)
        for c in set(candidates(text)):
            x.append(features(text, *c))
            y.append(c in true)
            held.append(i % 3 == 0)
            kinds.append(c[0])
    x, y, held, kinds = np.array(x), np.array(y, float), np.array(held), np.array(kinds)
    trees = boost(x[~held], y[~held])
    margin = trees.margin(x[held])
    knots, values = isotonic(margin, y[held], np.ones(held.sum()))
    model, thresholds = PiiModel(trees, knots, values, {}), {}
    p = model.probability(x[held])
    for k in KINDS:
        own = kinds[held] == k
        for t in np.unique(p[own]):
            if y[held][own & (p >= t)].mean() >= precision:
                thresholds[k] = float(max(t, 0.5))
                break
        else:
            thresholds[k] = 2.0  # nothing of this kind is added
    return PiiModel(trees, knots, values, thresholds)


def all_spans(text: str, model: PiiModel) -> tuple[dict[str, list[Span]], dict[str, list[Span]]]:
    """Base spans, and base spans with those that the model adds, each kind in order."""
    base = base_spans(text)
    found = list(dict.fromkeys(candidates(text)))
    taken = bytearray(len(text)) if found else bytearray()

    def take(a: int, b: int) -> None:
        taken[a:b] = b"\1" * (b - a)

    def free(a: int, b: int) -> bool:
        return taken.find(1, a, b) < 0

    for spans in base.values() if found else ():
        for a, b in spans:
            take(a, b)
    found = [c for c in found if free(c[1], c[2])]
    if not found:
        return base, base
    p = model.probability(np.array([features(text, *c) for c in found]))
    chosen = {k: list(v) for k, v in base.items()}
    # the likeliest first, then the longest; none may overlap one that was taken
    for score, (kind, a, b) in sorted(zip(p.tolist(), found, strict=True), key=lambda c: (-c[0], c[1][1] - c[1][2], c[1])):
        if score >= model.thresholds[kind] and free(a, b):
            chosen[kind].append((a, b))
            take(a, b)
    return base, {k: sorted(v) for k, v in chosen.items()}


def listed(spans: dict[str, list[Span]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k in KINDS for a, b in spans[k])


def redacted(text: str, spans: dict[str, list[Span]]) -> str:
    """text with every span replaced by its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, k) for k in KINDS for a, b in spans[k]):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def pii_spans(docs: DataFrame, model: PiiModel | None = None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep, base counts, base_sha256, spans and redacted for every row's whole text.

    Null texts count as empty: no spans, the digest of nothing. Whole texts are searched, however
    long, each in one task and in time linear in its length. Repeated rows give repeated results;
    null ids stay; an empty table gives no rows; other columns, clashing names among them, are not
    read.
    """
    model = model or fit_pii()

    def work(texts: list[str]) -> dict[str, list]:
        out: dict[str, list] = {c: [] for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "redacted")}
        for t in texts:
            base, spans = all_spans(t, model)
            for k in KINDS:
                out[f"n_{k}"].append(len(base[k]))
            out["base_sha256"].append(hashlib.sha256(listed(base).encode()).hexdigest())
            out["spans"].append(listed(spans))
            out["redacted"].append(redacted(t, spans))
        return out

    return map_texts(docs, list(keep), fields("n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, redacted string"), work, text)
