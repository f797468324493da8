"""Secrets in texts: three fixed patterns, and a battery of randomness tests for everything else.

Candidates are runs of encoding letters.  For each its encoding is inferred (hexadecimal, base 32, base 36, base 62, base 64), and three
tests ask how likely ordinary writing of the same length would look as random as it does:

* chi-squared uniformity over the encoding's alphabet, against the skewed letter counts of ordinary writing;
* runs of character classes (lower case, upper case, digits), which ordinary writing changes rarely;
* serial correlation of vowels, which ordinary writing alternates with consonants.

The three probabilities are combined by Fisher's method.  All candidates of a text then pass through a weighted
Benjamini-Hochberg step: weights follow the length, because short strings say little, and the share of false
findings stays below ``FALSE``.  Only the text itself decides, so equal texts give equal spans at every scale.

Null texts count as empty, and empty texts have no spans.  Positions are code points, ends exclusive.
The operator is a column expression over the text; further columns stay as they are.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm._common import table

FALSE = 0.01
#: Lengths that count for the weight of a candidate.
SHORT, LONG = 16, 64
KINDS = ("assign", "access", "hex", "random")

ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}")
KEYWORDS = ("passw", "secret", "token", "apikey", "api_key")

#: (name, letters, alphabet size, usual share of class changes in ordinary writing), the narrowest first.
ENCODINGS = (
    ("hex", re.compile("[0-9a-f]+|[0-9A-F]+"), 16, 0.12),
    ("base32", re.compile("[A-Z2-7]+"), 32, 0.12),
    ("base36", re.compile("[0-9a-z]+|[0-9A-Z]+"), 36, 0.12),
    ("base62", re.compile("[0-9A-Za-z]+"), 62, 0.30),
    ("base64", re.compile("[0-9A-Za-z+/_-]+"), 64, 0.30),
)
#: Chance that two letters of ordinary writing are the same.
REPEAT = 0.07
#: Usual serial correlation of vowels in ordinary writing.
ALTERNATION = -0.3
VOWELS = frozenset("aeiouyAEIOUY")


def _below(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def uniformity(run: str, size: int) -> float:
    """Probability that ordinary writing is at least as even over an alphabet of ``size``."""
    n = len(run)
    observed = sum(c * c for c in Counter(run).values()) * size / n - n
    shift = n * max(0.0, size * REPEAT - 1)
    return _below((observed - (size - 1) - shift) / math.sqrt(2 * (size - 1) + 4 * shift))


def class_runs(run: str, usual: float) -> float:
    """Probability that ordinary writing changes at least as often between lower case, upper case and digits."""
    classes = [0 if c.islower() else 1 if c.isupper() else 2 for c in run if c.isalnum()]
    n, changes = len(classes) - 1, sum(a != b for a, b in zip(classes, classes[1:]))
    if n < 1:
        return 1.0
    term = total = (1 - usual) ** n
    below = 0.0
    for k in range(changes):
        below += term
        term *= (n - k) / (k + 1) * usual / (1 - usual)
    return max(1e-300, min(1.0, 1 - below)) if below < 1 - 1e-12 else max(1e-300, term)


def serial(run: str) -> float:
    """Probability that vowels of ordinary writing follow each other at least as freely."""
    marks = [c in VOWELS for c in run if c.isalpha()]
    n, ones = len(marks), sum(marks)
    if n < 4 or not 0 < ones < n:
        return 1.0
    mean = ones / n
    r = sum((a - mean) * (b - mean) for a, b in zip(marks, marks[1:])) / (n * mean * (1 - mean))
    return 1 - _below((r - ALTERNATION) * math.sqrt(n))


def battery(run: str) -> float:
    """Combined probability that ordinary writing looks as random as ``run``; 1 where no test applies."""
    if run.isdigit() or not any(c.isdigit() for c in run) and (run.islower() or run.isupper() or run.istitle()):
        return 1.0  # numbers and plain words are no encoding
    size, usual = next((s, u) for _, letters, s, u in ENCODINGS if letters.fullmatch(run))
    parts = (uniformity(run, size), class_runs(run, usual), serial(run))
    half = -sum(math.log(max(p, 1e-300)) for p in parts)
    return math.exp(-half) * (1 + half + half * half / 2)


def discoveries(runs: list[str]) -> list[bool]:
    """Which candidates of one text are random, under weighted false-discovery control."""
    if not runs:
        return []
    weights = [min(max(len(r), SHORT), LONG) for r in runs]
    mean = sum(weights) / len(weights)
    values = [battery(r) * mean / w for r, w in zip(runs, weights)]
    order = sorted(range(len(runs)), key=lambda i: values[i])
    passed = max((k for k, i in enumerate(order, 1) if values[i] <= FALSE * k / len(runs)), default=0)
    found = set(order[:passed])
    return [i in found for i in range(len(runs))]


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then by kind as listed; random ones only where no fixed pattern covers them."""
    text = text or ""
    base: list[tuple[str, int, int]] = []
    if ":" in text or "=" in text:
        lowered = text.lower()
        if any(k in lowered for k in KEYWORDS):
            base += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    candidates = list(CANDIDATE.finditer(text))
    for c in candidates:  # a run of 32 hexadecimal digits lies within one candidate
        if len(c[0]) >= 32:
            base += [("hex", m.start() + c.start(), m.end() + c.start()) for m in HEX.finditer(c[0]) if len(m[0]) >= 32]
    random = [("random", c.start(), c.end()) for c, found in zip(candidates, discoveries([c[0] for c in candidates])) if found]
    random = [r for r in random if not any(b[1] < r[2] and r[1] < b[2] for b in base)]
    return sorted(base + random, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(found: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in found)


REPORT = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def report(text: Column) -> Column:
    """Counts, digest of the fixed patterns' spans, and all spans of a text."""
    @F.pandas_udf(REPORT)
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for one in texts:
                found = spans(one)
                count = Counter(kind for kind, _, _ in found)
                base = joined([s for s in found if s[0] != "random"])
                rows.append((count["assign"], count["access"], count["hex"], hashlib.sha256(base.encode()).hexdigest(), joined(found)))
            names = ["n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            yield pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype="int64" if i < 3 else object) for i, n in enumerate(names)})

    return work(text)


def redact(text: str | None, mark: str = "[SECRET]") -> str | None:
    """The text with every span, overlapping ones as one, replaced by ``mark``; a null text stays null."""
    if text is None:
        return None
    out, at, end = [], 0, -1
    for _, start, stop in spans(text):
        if start >= end:
            out += [text[at:start], mark]
        end = max(end, stop)
        at = end
    return "".join([*out, text[at:]])


def redacted(text: Column) -> Column:
    @F.pandas_udf("string")
    def work(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([redact(t) for t in texts], dtype=object)

    return work(text)


def op4_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Counts, digest and spans of the secrets of every document."""
    found = table(spark, sf_dir, "documents").select("doc_id", report(F.col("text")).alias("r"))
    return found.select("doc_id", "r.*")


QUERIES = {"op4_secret_scan": op4_secret_scan}
SQL = {}
