"""Personal data: high-recall candidate spans judged by gradient-boosted trees.

Base spans (e-mail, IP, card, phone) have exact formats and are always kept. Generators then propose spans of further
kinds, which may overlap: `account` (a long number, a number in groups, an IBAN-like code), `contact` (an e-mail or phone
spelled otherwise) and `secret` (a key or password). Boosted depth-2 trees score format and context features of each
candidate; a candidate is kept when its score passes the threshold of its kind and it overlaps no base span nor a
better candidate. The trees are fitted in numpy on `TRAINING` examples that are written from rules with a fixed seed
(a documented, bounded sample: there are no labelled spans), and each kind's threshold is the least score, a half at
least, with `PRECISION` precision on held-out examples, or the one of best precision where none has that much.

Every whole text goes through every generator; none is skipped by what else it holds. All patterns take time linear in
the text: their runs are possessive and begin only where a run begins.

Edge cases: null text is empty and has no spans; repeated rows give equal rows; a null doc_id is carried; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import as_string, slices

KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("account", "contact", "secret")
ORDER = {k: i for i, k in enumerate(KINDS + MORE_KINDS)}
#: The domain of an e-mail, a chain of numbers joined by dots, and of digits with single separators, are found whole;
#: the base patterns of the contract are then read off them, which gives the same matches in linear time.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")
DOTTED = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3,}+")
CARD = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: (kind, pattern); the first group is the span, or the whole match if there is none.
GENERATORS = [(k, re.compile(p)) for k, p in (
    ("account", r"(?<![\w.])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    ("account", r"(?<![\w.])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?!\w)"),
    ("account", r"(?<![\w.])[0-9]{9,}+(?!\w)"),
    ("contact", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]++(?:(?: ?(?:\(dot\)|\[dot\]) ?|\.)[A-Za-z0-9-]++)++"),
    ("contact", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)++"),
    ("contact", r"(?<![\w+.])\(?[0-9]{2,5}\)?[ .-][0-9]{3,4}[ .-][0-9]{3,5}(?!\w)"),
    ("secret", r"(?i:passwd|password|pwd|secret|token|api[_-]?key|access[_-]?key)[\"']? ?[:=] ?[\"']?([^\s\"']{6,}+)"),
    ("secret", r"(?<!\w)[A-Z]{4}[A-Z0-9]{12,36}(?!\w)"),
    ("secret", r"(?<!\w)(?=[a-z]*+[0-9])[0-9a-f]{32,}+(?!\w)"),
    ("secret", r"(?<!\w)(?:sk|pk|ghp|xox[bp])[_-][A-Za-z0-9_-]{16,}+"),
)]
CONTEXT = {
    "account": ("account", "acct", "iban", "ssn", "social", "card", "konto", "cuenta", "compte", "tax", "passport", "id"),
    "contact": ("mail", "contact", "write", "call", "phone", "tel", "fax", "mobile", "reach", "kontakt", "correo"),
    "secret": ("password", "passwd", "pwd", "secret", "token", "key", "login", "auth", "credential"),
}
AGAINST = ("version", "page", "order", "invoice", "chapter", "figure", "isbn", "no", "item", "build", "commit", "year", "table", "total")
TRAINING, TREES, RATE, PRECISION, AROUND, SEED = 6000, 60, 0.2, 0.97, 30, 5
N_FEATURES = 18


def luhn(digits: str) -> bool:
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def emails(text: str) -> list[tuple[int, str, int]]:
    """At each @ the local part reaches back to the last other character, or the end of the match before."""
    out, end = [], 0
    for m in DOMAIN.finditer(text):
        start = at = m.start()
        while start > end and not LOCAL.match(text, start - 1, start):
            start -= 1
        if start < at:
            end = m.end()
            out.append((start, "email", end))
    return out


def addresses(text: str) -> list[tuple[int, str, int]]:
    """Of a chain of dotted numbers each four in turn are a match; those with a part over 255 are dropped."""
    out = []
    for m in DOTTED.finditer(text):
        parts, at = m.group().split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            own = parts[i : i + 4]
            size = sum(map(len, own)) + 3
            if all(len(p) <= 3 and int(p) <= 255 for p in (p.lstrip("0") or "0" for p in own)):
                out.append((at, "ip", at + size))
            at += size + 1
    return out


def base_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end), leftmost and non-overlapping within a kind; failing matches are dropped."""
    out = emails(text) + addresses(text)
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), "card", m.end()))
    out += [(m.start(), "phone", m.end()) for m in PHONE.finditer(text) if 9 <= sum(c in "0123456789" for c in m.group()) <= 15]
    return sorted(out, key=lambda s: (s[0], ORDER[s[1]], s[2]))


def candidates(text: str) -> list[tuple[int, str, int]]:
    """All proposed spans, each once, in order."""
    return sorted({(m.start(g), kind, m.end(g)) for kind, pattern in GENERATORS for g in [min(pattern.groups, 1)] for m in pattern.finditer(text)}, key=lambda s: (s[0], ORDER[s[1]], s[2]))


class Taken:
    """Disjoint intervals in order."""

    def __init__(self, spans: list[tuple[int, str, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for s, _, e in spans:  # in order of start
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], e)
            else:
                self.starts.append(s)
                self.ends.append(e)

    def free(self, start: int, end: int) -> bool:
        i = bisect.bisect_right(self.ends, start)
        return i == len(self.starts) or self.starts[i] >= end

    def add(self, start: int, end: int) -> None:
        i = bisect.bisect_right(self.ends, start)
        self.starts.insert(i, start)
        self.ends.insert(i, end)


def features(text: str, start: int, kind: str, end: int) -> list[float]:
    s = text[start:end]
    n, before, after = len(s), text[max(0, start - AROUND) : start].lower(), text[end : end + AROUND].lower()
    counts = Counter(s)
    digits = sum(c.isdigit() for c in s)
    number = re.sub(r"\D", "", s)
    words = re.findall(r"[^\W\d_]+", before)[-3:]
    return [
        float(ORDER[kind]), n, digits / n, sum(c.isupper() for c in s) / n, sum(c.islower() for c in s) / n, sum(not c.isalnum() for c in s) / n,
        len(counts) / n, -sum(v / n * math.log2(v / n) for v in counts.values()), float(all(c in "0123456789abcdef" for c in s)), float(len(number)),
        float(bool(number) and luhn(number)), float(any(w.startswith(k) for w in words for k in CONTEXT[kind])), float(any(w in AGAINST for w in words)),
        float(before.rstrip()[-1:] in ("=", ":", '"', "'")), float(before.rstrip()[-1:] in ("#", "$", "€", "v")), float(after[:1] in ("%", "/", "€")),
        float(sum(a.isdigit() != b.isdigit() for a, b in zip(s, s[1:], strict=False))), float(bool(re.fullmatch(r"(\w)\1*", s))),
    ]


class Boosted:
    """Depth-2 regression trees on the logistic loss; a tree is (feature, cut, [(feature, cut, low, high)] * 2)."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, rate: float = RATE):
        self.base = math.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
        self.trees, f = [], np.full(len(y), self.base)
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)[1:-1])) for j in range(x.shape[1])]
        for _ in range(trees):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            j, c = self._split(x, g, h, cuts)
            sides = []
            for side in (x[:, j] <= c, x[:, j] > c):
                k, d = self._split(x[side], g[side], h[side], cuts)
                low = side & (x[:, k] <= d)
                high = side & (x[:, k] > d)
                leaf = [rate * g[m].sum() / (h[m].sum() + 1.0) for m in (low, high)]
                f[low] += leaf[0]
                f[high] += leaf[1]
                sides.append((k, d, *leaf))
            self.trees.append((j, c, sides))

    @staticmethod
    def _split(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> tuple[int, float]:
        best, total_g, total_h = (-1.0, 0, 0.0), g.sum(), h.sum()
        for j, cs in enumerate(cuts):
            low = x[:, j][:, None] <= cs
            lg, lh = g @ low, h @ low
            gain = lg**2 / (lh + 1) + (total_g - lg) ** 2 / (total_h - lh + 1)
            if len(cs) and gain.max() > best[0]:
                best = (float(gain.max()), j, float(cs[gain.argmax()]))
        return best[1:]

    def score(self, x: np.ndarray) -> np.ndarray:
        f = np.full(len(x), self.base)
        for j, c, sides in self.trees:
            (k0, d0, a0, b0), (k1, d1, a1, b1) = sides
            f += np.where(x[:, j] <= c, np.where(x[:, k0] <= d0, a0, b0), np.where(x[:, k1] <= d1, a1, b1))
        return 1 / (1 + np.exp(-f))


def examples(n: int = TRAINING, seed: int = SEED) -> tuple[list[list[float]], list[int], list[str]]:
    """Labelled candidates from rules: each text is made around a true or a false span of a kind, and the generators find it."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    digits = lambda k: "".join(str(int(d)) for d in rng.integers(0, 10, k))
    chars = lambda k, of: "".join(of[int(i)] for i in rng.integers(0, len(of), k))
    plain = lambda k: " ".join(chars(int(rng.integers(2, 9)), "abcdefghilmnoprstu") for _ in range(k))
    name = lambda: chars(int(rng.integers(4, 9)), "abcdefghilmnoprstu")
    hexa, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567890"
    true = {
        "account": [lambda: f"{pick(CONTEXT['account'])} {pick(['DE', 'FR', 'ES', 'GB'])}{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}", lambda: f"{pick(CONTEXT['account'])} {digits(3)}-{digits(2)}-{digits(4)}", lambda: f"{pick(CONTEXT['account'])}: {digits(int(rng.integers(9, 13)))}"],
        "contact": [lambda: f"{pick(CONTEXT['contact'])} {name()} (at) {name()} (dot) com", lambda: f"{name()} [at] {name()}.org", lambda: f"{plain(1)} {name()} at {name()} dot org", lambda: f"{pick(CONTEXT['contact'])} ({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{pick(CONTEXT['contact'])}: {digits(3)}-{digits(3)}-{digits(4)}"],
        "secret": [lambda: f"password={chars(int(rng.integers(8, 24)), hexa)}", lambda: f'token = "{chars(40, hexa)}"', lambda: f"{plain(1)} AKIA{chars(int(rng.integers(15, 18)), upper)}", lambda: f"api_key: {chars(24, hexa + 'GHJKLmnopqr')}", lambda: f"sk_{chars(24, hexa + 'XYZ')}", lambda: f"secret={name()}{digits(3)}!"],
    }
    false = {
        "account": [lambda: f"{pick(AGAINST)} {digits(int(rng.integers(9, 14)))}", lambda: f"{plain(1)} {digits(int(rng.integers(14, 25)))}", lambda: f"{pick(AGAINST)} {digits(3)}-{digits(2)}-{digits(4)}", lambda: f"{plain(2)} {digits(10)}"],
        "contact": [lambda: f"{name()} at {name()} dot {name()} {name()}", lambda: f"{pick(AGAINST)} {digits(4)}.{digits(4)}.{digits(4)}", lambda: f"{plain(2)} {digits(3)} {digits(3)} {digits(3)}", lambda: f"look at {name()}.{name()}", lambda: f"{plain(1)} {digits(4)}-{digits(4)}-{digits(4)}"],
        "secret": [lambda: f"{pick(['token', 'password', 'secret'])}: {name()}ing", lambda: f"{plain(1)} {chars(int(rng.integers(16, 24)), 'ABCDEFGHILMNOPRSTU')}", lambda: f"commit {chars(40, hexa)}", lambda: f"secret: {name()}", lambda: f"token = {name()},"],
    }
    rows, labels, kinds = [], [], []
    while len(rows) < n:
        kind, good = pick(MORE_KINDS), int(rng.random() < 0.5)
        middle = pick((true if good else false)[kind])()
        lead = plain(int(rng.integers(2, 6)))
        text = f"{lead} {middle} {plain(int(rng.integers(2, 6)))}{pick(['.', ''])}"
        for s, k, e in candidates(text):
            if k == kind and len(lead) < e and s < len(lead) + 1 + len(middle):
                rows.append(features(text, s, k, e))
                labels.append(good)
                kinds.append(kind)
    return rows, labels, kinds


@cache
def model() -> tuple[Boosted, dict[str, float]]:
    """The trees and, for each kind, the least score with PRECISION on the examples held out (every third)."""
    rows, labels, kinds = examples()
    x, y, k = np.array(rows), np.array(labels, float), np.array(kinds)
    out = np.arange(len(y)) % 3 == 0
    trees = Boosted(x[~out], y[~out])
    limits = {}
    for kind in MORE_KINDS:
        own = out & (k == kind)
        scores, good = trees.score(x[own]), y[own]
        order = np.argsort(-scores, kind="stable")
        precision = np.cumsum(good[order]) / np.arange(1, len(order) + 1)
        fine = np.flatnonzero(precision >= min(PRECISION, precision.max()))
        limits[kind] = max(0.5, float(scores[order[fine[-1]]]))
    return trees, limits


def spans(text: str) -> tuple[list[tuple[int, str, int]], list[tuple[int, str, int]]]:
    """(base spans, all spans), each in order. Of equal scores the longer candidate comes first, then the earlier."""
    base = base_spans(text)
    taken = Taken(base)
    found = [c for c in candidates(text) if taken.free(c[0], c[2])]
    if not found:
        return base, base
    trees, limits = model()
    scores = trees.score(np.array([features(text, *c) for c in found]))
    more: list[tuple[int, str, int]] = []
    for i in sorted(range(len(found)), key=lambda i: (-scores[i], found[i][0] - found[i][2], found[i])):
        s, kind, e = found[i]
        if scores[i] >= limits[kind] and taken.free(s, e):
            taken.add(s, e)
            more.append(found[i])
    return base, sorted(base + more, key=lambda s: (s[0], ORDER[s[1]], s[2]))


def joined(found: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in found)


def redact(text: str, found: list[tuple[int, str, int]]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for s, k, e in found:
        if s >= at:
            out += [text[at:s], f"[{k}]"]
        at = max(at, e)
    return "".join(out) + text[at:]


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """key, n_<kind> of the base spans, base (joined), spans (joined), and the redacted text if asked for: one pass, no shuffle."""
    kind = docs.schema[key].dataType.simpleString()
    counts = [f"n_{k}" for k in KINDS]
    names = ["_key", *counts, "base", "spans", *["redacted"] * with_text]

    def run(batches):
        for batch in batches:
            for part in slices(batch, "_text"):
                rows = []
                for t in as_string(part.column("_text")).to_pylist():
                    base, every = spans(t)
                    n = Counter(k for _, k, _ in base)
                    rows.append((*(n[k] for k in KINDS), joined(base), joined(every), redact(t, every))[: 6 + with_text])
                cols = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([part.column("_key"), *(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.string()) for c in cols[4:])], names)

    schema = f"_key {kind}, " + ", ".join(f"{c} long" for c in counts) + ", base string, spans string" + ", redacted string" * with_text
    slim = docs.select(F.col(key).alias("_key"), F.col(text).cast("string").alias("_text"))
    return slim.mapInArrow(run, schema).withColumnRenamed("_key", key)


def digest(found: str) -> str:
    return hashlib.sha256(found.encode()).hexdigest()
