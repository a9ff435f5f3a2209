"""Personal data: candidate spans scored by gradient-boosted trees.

Generators with high recall propose spans that may overlap: the four base kinds, looser
forms of them, and kinds that have no fixed format.  A base span (e-mail, IP, card and
phone number, by format and checksum) always stays.  Every other candidate gets features
of its format and context, boosted trees score it, the score is calibrated, and it becomes
a redaction if it reaches its kind's threshold; of overlapping ones the likelier stays.

No table labels spans, so trees and thresholds are learnt from generated examples
(``EXAMPLES`` of them, from a fixed seed): formats with random content in random context,
and look-alikes such as dates, versions, order numbers and long words.  The threshold of
a kind is the least calibrated probability at which held-back examples of it are right in
``PRECISION`` of cases.  Training needs no corpus and takes a few seconds on the driver.

Scans take time linear in the text, also in long runs of digits or letters.  Whole texts
are scanned row by row; nothing is shuffled.

Cases: null and empty texts have no spans; a null id is kept; repeated rows give equal
results; offsets are code points, ends exclusive; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret", "iban", "ssn")
EXAMPLES, PRECISION, SEED = 6000, 0.97, 11

Span = tuple[str, int, int]

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[Span]:
    last = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield "email", start, found.end()
            last = found.end()
        else:
            last = at + 1
        at = text.find("@", max(at + 1, last))


def ips(text: str) -> Iterator[Span]:
    for chain in _CHAIN.finditer(text):
        at, parts = chain.start(), chain.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in four):
                yield "ip", at, end
            at = end + 1


def cards(text: str) -> Iterator[Span]:
    for m in _DIGITS.finditer(text):
        if 12 <= m.end() - m.start() <= 37:
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", m.start(), m.end()


def phones(text: str) -> Iterator[Span]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                yield "phone", m.start(), m.end()


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind as listed."""
    found = [*emails(text), *ips(text), *cards(text), *phones(text)]
    return sorted(found, key=lambda s: (s[1], BASE.index(s[0])))


# --- candidates beyond the base kinds -------------------------------------------------

_KEYS = ("token", "secret", "password", "passwd", "api_key", "api-key", "apikey", "access_key")
_ASSIGNED = re.compile(r"(?i:token|secret|password|passwd|api[_-]?key|access_key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_+/=.-]{6,})")
_HEX = re.compile(r"(?<![0-9A-Za-z])[0-9a-fA-F]{24,}(?![0-9A-Za-z])")
_IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_AT_WORD = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(]dot[\])]) ?[A-Za-z0-9-]{1,63})+")
_LOCAL_PHONE = re.compile(r"(?<![0-9+.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])")


def candidates(text: str) -> list[Span]:
    """Spans that may be personal data and may overlap, base kinds not among them."""
    out: list[Span] = []
    low = text.casefold()  # all that the pattern's case-insensitive letters match
    if any(k in low for k in _KEYS):
        out += [("secret", *m.span(1)) for m in _ASSIGNED.finditer(text)]
    if "at)" in text or "at]" in text:
        out += [("email", *m.span()) for m in _AT_WORD.finditer(text)]
    if any(c in text for c in "0123456789"):
        out += [("secret", *m.span()) for m in _HEX.finditer(text)]
        out += [("iban", *m.span()) for m in _IBAN.finditer(text)]
        out += [("ssn", *m.span()) for m in _SSN.finditer(text)]
        out += [("phone", *m.span()) for m in _LOCAL_PHONE.finditer(text)]
        out += [("card", m.start(), m.end()) for m in _DIGITS.finditer(text) if 14 <= m.end() - m.start() <= 23]
    return out


_CONTEXT = {
    "card": ("card", "visa", "credit"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "secret": ("token", "secret", "password", "passwd", "key"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social", "security"),
    "email": ("mail", "contact", "write"),
}


def _mod97(value: str) -> bool:
    value = value.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in value[4:] + value[:4])) % 97 == 1


def features(text: str, span: Span) -> list[float]:
    kind, a, b = span
    value = text[a:b]
    digits = "".join(c for c in value if "0" <= c <= "9")
    letters = sum(c.isalpha() for c in value)
    before = text[max(0, a - 32) : a].lower()
    after = text[b : b + 16].lower()
    shares = [value.count(c) / len(value) for c in set(value)]
    spread = -sum(p * math.log2(p) for p in shares)
    near = any(w in before or w in after for w in _CONTEXT.get(kind, ()))
    around = text[max(0, a - 80) : b + 80]
    return [
        *(float(kind == k) for k in KINDS),
        len(value),
        len(digits),
        letters,
        spread,
        len(set(value)),
        sum(c in " -.()" for c in value),
        float(len(digits) > 1 and luhn(digits)),
        float(kind == "iban" and _mod97(value)),
        float(near),
        float(before.rstrip(" \"'").endswith(("=", ":"))),
        float(a > 0 and text[a - 1].isalnum()),
        float(b < len(text) and text[b].isalnum()),
        sum("0" <= c <= "9" for c in around) / max(1, len(around)),
        float(len(set(digits)) <= 2),
        float(digits[:3] in ("000", "666") or digits[:1] == "9"),
        sum(1 for x, y in zip(value, value[1:], strict=False) if x.isdigit() != y.isdigit()),
    ]


# --- boosted trees --------------------------------------------------------------------


class Trees:
    """Logistic gradient boosting over binned features, with two-level trees."""

    def __init__(self, rounds: int = 60, rate: float = 0.3, bins: int = 24, depth: int = 3):
        self.rounds, self.rate, self.bins, self.depth = rounds, rate, bins, depth
        self.trees: list[list] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Trees":
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        b = self._binned(x)
        self.base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        z = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-z))
            tree = self._grown(b, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            z += self._applied(tree, b)
        return self

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)], axis=1)

    def _grown(self, b, g, h, at, depth):
        value = self.rate * g[at].sum() / (h[at].sum() + 1.0)
        if depth == 0 or len(at) < 20:
            return value
        total_g, total_h = g[at].sum(), h[at].sum()
        best = (1e-3, None, None)
        for f in range(b.shape[1]):
            sg = np.cumsum(np.bincount(b[at, f], weights=g[at], minlength=self.bins))
            sh = np.cumsum(np.bincount(b[at, f], weights=h[at], minlength=self.bins))
            gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
            k = int(gain[:-1].argmax())
            if gain[k] > best[0] + 1e-12:
                best = (float(gain[k]), f, k)
        _, f, k = best
        if f is None:
            return value
        low = b[at, f] <= k
        return [f, k, self._grown(b, g, h, at[low], depth - 1), self._grown(b, g, h, at[~low], depth - 1)]

    def _applied(self, tree, b) -> np.ndarray:
        if not isinstance(tree, list):
            return np.full(len(b), tree)
        f, k, low, high = tree
        return np.where(b[:, f] <= k, self._applied(low, b), self._applied(high, b))

    def margin(self, x: np.ndarray) -> np.ndarray:
        b = self._binned(x)
        return self.base + sum((self._applied(t, b) for t in self.trees), np.zeros(len(b)))


def _example(r: random.Random) -> tuple[str, Span, int]:
    """(text, candidate span, whether it is personal data) of random kind and content."""
    word = lambda: "".join(r.choice("abcdeghilmnorstu") for _ in range(r.randint(2, 9)))
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    kind, real = r.choice(KINDS[4:] + ("card", "phone", "email")), r.random() < 0.5
    hint = r.random() < (0.6 if real else 0.1) and kind in _CONTEXT
    lead = r.choice(_CONTEXT[kind]) + r.choice(["", ":", " is", " ="]) if hint else word()
    if kind == "secret":
        value = "".join(r.choice(r.choice(["0123456789abcdef", "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz0123456789_-"])) for _ in range(r.randint(12, 48)))
        lead = r.choice(("token", "secret", "password", "api_key")) + r.choice([" = ", "=", ": "]) + r.choice(['"', ""])
        if not real:
            value = r.choice([word() + word(), word(), r.choice("0a") * r.randint(12, 40)])
        return _placed(r, word, lead, value, kind, real, tight=True)
    if kind == "iban":
        body = digits(r.randint(11, 18))
        check = 98 - int("".join(str(int(c, 36)) for c in body + "DE00")) % 97
        value = f"DE{check if real else (check + r.randint(1, 90)) % 97:02d}{body}"
    elif kind == "ssn":
        value = f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}" if real else f"{r.choice(['000', '666', '9' + digits(2)])}-{digits(2)}-{digits(4)}"
    elif kind == "card":
        body = digits(15)
        check = next(c for c in "0123456789" if luhn(body + c))
        hint, lead = real, (r.choice(_CONTEXT["card"]) + " " if real else word())
        value = body + r.choice([c for c in "0123456789" if c != check])
    elif kind == "phone":
        lead = r.choice(_CONTEXT["phone"]) + " " if real else r.choice(["order", "item", "page", word()]) + " "
        value = f"{digits(3)}{r.choice('-. ')}{digits(3)}{r.choice('-. ')}{digits(4)}"
    else:
        value = f"{word()} (at) {word()} (dot) {r.choice(['com', 'org', 'net'])}" if real else f"{word()} (at) {word()} . {word()}"
    return _placed(r, word, lead + " ", value, kind, real, tight=False)


def _placed(r, word, lead: str, value: str, kind: str, real: bool, tight: bool) -> tuple[str, Span, int]:
    head = " ".join(word() for _ in range(r.randint(0, 8))) + " " + lead
    tail = ('"' if tight and head.endswith('"') else "") + " " + " ".join(word() for _ in range(r.randint(0, 8)))
    return head + value + tail, (kind, len(head), len(head) + len(value)), int(real)


class Model:
    """Trees, a calibration line on their margin and a threshold for each kind."""

    def __init__(self, examples: int = EXAMPLES, precision: float = PRECISION, seed: int = SEED):
        r = random.Random(seed)
        made = [_example(r) for _ in range(examples)]
        x = np.array([features(t, s) for t, s, _ in made])
        y = np.array([m[2] for m in made], float)
        cut = examples * 2 // 3
        self.trees = Trees().fit(x[:cut], y[:cut])
        margin, truth = self.trees.margin(x[cut:]), y[cut:]
        self.slope, self.shift = 1.0, 0.0
        for _ in range(200):  # Platt's line by gradient steps on the held-back third
            p = self._calibrated(margin)
            self.slope -= 0.05 * float(((p - truth) * margin).mean())
            self.shift -= 0.05 * float((p - truth).mean())
        p, kinds = self._calibrated(margin), np.array([m[1][0] for m in made[cut:]])
        self.thresholds = {}
        for kind in KINDS:
            q, t = p[kinds == kind], truth[kinds == kind]
            order = np.argsort(-q, kind="stable")
            right = np.cumsum(t[order]) / np.arange(1, len(t) + 1) if len(t) else np.zeros(0)
            good = np.flatnonzero(right >= precision)
            self.thresholds[kind] = max(0.5, float(q[order][good[-1]])) if len(good) else 2.0

    def _calibrated(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))

    def probabilities(self, text: str, spans: list[Span]) -> np.ndarray:
        return self._calibrated(self.trees.margin(np.array([features(text, s) for s in spans])))


@lru_cache(maxsize=1)
def model() -> Model:
    return Model()


class _Taken:
    """Disjoint stretches of a text, kept in order; a look-up is a bisection."""

    def __init__(self, spans: list[Span]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1]):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        at = bisect_left(self.starts, b) - 1
        return at >= 0 and self.ends[at] > a

    def add(self, a: int, b: int) -> None:
        at = bisect_left(self.starts, a)
        self.starts.insert(at, a)
        self.ends.insert(at, b)


def all_spans(text: str, base: list[Span], scorer: Model) -> list[Span]:
    """Base spans and the candidates that reach their threshold, none overlapping a better one."""
    taken = _Taken(base)
    more = [s for s in dict.fromkeys(candidates(text)) if not taken.meets(s[1], s[2])]
    kept = list(base)
    if more:
        p = scorer.probabilities(text, more)
        for k in np.argsort(-p, kind="stable"):
            kind, a, b = more[k]
            if p[k] >= scorer.thresholds[kind] and not taken.meets(a, b):
                taken.add(a, b)
                kept.append(more[k])
    return sorted(kept, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def found(documents: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row."""
    scorer = model()
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, joined = [], [], []
            for k in range(b.num_rows):
                text = b.column(1)[k].as_py() or ""
                base = base_spans(text)
                counts.append([sum(s[0] == kind for s in base) for kind in BASE])
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                joined.append(_joined(all_spans(text, base, scorer)))
            per = np.array(counts, np.int64).reshape(-1, len(BASE))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c) for c in per.T), pa.array(digests, pa.string()), pa.array(joined, pa.string())], names=["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])

    return rows.mapInArrow(mapped, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redacted(documents: DataFrame) -> DataFrame:
    """The rows of documents, all columns, each span replaced by its kind in brackets."""
    scorer = model()
    text = documents.columns.index("text")

    def clean(value: str | None) -> str | None:
        if not value:
            return value
        out, last = [], 0
        for kind, a, b in all_spans(value, base_spans(value), scorer):
            if b > last:
                out += [value[last : max(a, last)], f"[{kind.upper()}]"]
                last = b
        return "".join(out) + value[last:]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = pa.array([clean(b.column(text)[k].as_py()) for k in range(b.num_rows)], pa.string())
            yield pa.RecordBatch.from_arrays([column if k == text else c for k, c in enumerate(b.columns)], schema=b.schema)

    return documents.mapInArrow(mapped, documents.schema)
