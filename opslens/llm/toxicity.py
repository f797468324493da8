"""Toxicity from a weighted lexicon, matched by an Aho-Corasick automaton.

* Texts are folded first: lower case, look-alike letters of other scripts and accents to plain letters, digits and signs
  inside words to the letters they stand for.
* The lexicon is learned from a bounded sample of labelled documents: whole words and word beginnings whose document
  counts differ between the labels by more than chance, copies of a text counting once, at a fixed rate of false
  discoveries; a beginning gives way to a longer entry of the same documents.  Its weights are log odds.
* Exception phrases are longer entries that cancel the hits inside them: phrases given as a parameter.
* Score: a logistic curve over the logarithms of summed weight and length, fitted to the same sample; so the same
  hits count for less in a longer text as far as the labels say so.

Null texts count as empty, empty texts have no hits and get the curve's value for that.  Documents labelled twice count once,
and of several rows of one identifier one is learned from; without both labels in the sample every score is 0.
Repeated rows and null identifiers are scored like any others.  Only the named columns are read; the score is a
column expression over the text, so further columns stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice, takewhile

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslens.llm._common import held_out, labelled_sample, one_row_each, saved, table

#: Labelled rows that a fit uses at most.
SAMPLE = 20_000
#: An entry occurs in so many toxic documents at least, and is so much likelier there (log odds).
SUPPORT, LEAST_WEIGHT = 3, 3.0
#: False discoveries among the entries.
FALSE = 0.01
PREFIXES = (4, 5, 6)
REJECT = 0.7
#: Phrases in which a word of a usual lexicon is harmless; an entry here cancels the hits inside it.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "idiot proof", "pathetic fallacy", "pond scum")

#: Letters that look like a plain Latin one.
LOOK_ALIKES = {
    "a": "аαɑ", "b": "ьв", "c": "сϲ", "d": "ԁ", "e": "еєε", "g": "ɡ", "h": "һн", "i": "іιıɩ", "j": "ј", "k": "кκ", "l": "ӏ",
    "m": "м", "n": "ո", "o": "оοσ", "p": "рρ", "q": "ԛ", "r": "г", "s": "ѕ", "t": "тτ", "u": "υս", "v": "ѵν", "w": "ԝω", "x": "хχ", "y": "уγ", "z": "ᴢ",
}
#: Digits and signs that stand for a letter.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}

FOLD = {ord(x): plain for plain, alike in LOOK_ALIKES.items() for x in alike}
for code in range(0xC0, 0x250):
    base = unicodedata.normalize("NFD", chr(code).lower())[0]
    if "a" <= base <= "z":
        FOLD[code] = base
FOLD |= {code: None for code in (0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF, 0xAD)}  # invisible characters between letters
FOLD |= {0xFF21 + i: chr(97 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
DISGUISED = re.compile(r"[a-z]*[0-9@$!][a-z0-9@$!]*")
STAND_FOR = str.maketrans(SUBSTITUTES)
WORD = re.compile(r"[^\W\d_]+")


def _plain(match: re.Match) -> str:
    """A word with substitutes, folded; marks behind a word and numbers without letters stay."""
    token = match[0]
    body = token.rstrip("@$!")
    if not any("a" <= c <= "z" for c in body):
        return token
    return body.translate(STAND_FOR) + " " * (len(token) - len(body))


def fold(text: str) -> str:
    folded = text.lower()
    if not folded.isascii():
        folded = folded.translate(FOLD)
    return DISGUISED.sub(_plain, folded)


@dataclass(frozen=True)
class Lexicon:
    """``entries``: (text, whole word?, weight); ``curve``: intercept, slope of the weight's and of the length's logarithm."""
    entries: tuple[tuple[str, bool, float], ...] = ()
    exceptions: tuple[str, ...] = EXCEPTIONS
    curve: tuple[float, float, float] = (0.0, 0.0, 0.0)

    def automaton(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for text, whole, weight in self.entries:
            # A word and a beginning may be the same text.
            known = found.get(text, (len(text), 0.0, 0.0))
            found.add_word(text, (len(text), max(weight, known[1]) if whole else known[1], known[2] if whole else max(weight, known[2])))
        for phrase in self.exceptions:
            folded = fold(phrase)
            if folded not in found:
                found.add_word(folded, (len(folded), -1.0, 0.0))
        found.make_automaton()
        return found


def hits(text: str, automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) in the folded text, the strongest at each start; those inside an exception phrase are left out."""
    best: dict[int, tuple[int, float]] = {}
    harmless = []
    for last, (length, word, beginning) in automaton.iter(text):
        start, end = last + 1 - length, last + 1
        if start and text[start - 1].isalpha():
            continue
        ends = end == len(text) or not text[end].isalpha()
        if word < 0:
            if ends:
                harmless.append((start, end))
            continue
        weight = max(word if ends else 0.0, beginning)
        if weight > best.get(start, (0, 0.0))[1]:
            best[start] = (end, weight)
    return [(s, e, w) for s, (e, w) in sorted(best.items()) if not any(a <= s and e <= b for a, b in harmless)]


def features(text: str | None, automaton) -> tuple[float, int]:
    """Summed weight of the hits, and the length in words."""
    text = text or ""
    return sum(w for _, _, w in hits(fold(text), automaton)) if len(automaton) else 0.0, len(text.split())


def probability(weight, n_words, curve) -> np.ndarray:
    z = curve[0] + curve[1] * np.log1p(weight) + curve[2] * np.log1p(n_words)
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def patterns(text: str | None) -> set[str]:
    """The words of a folded text, and their beginnings with a hyphen behind."""
    words = set(WORD.findall(fold(text or "")))
    return {w for w in words if len(w) > 2} | {w[:k] + "-" for w in words for k in PREFIXES if len(w) > k}


def pattern_counts(train: DataFrame) -> DataFrame:
    """(pattern, toxic, clean): documents of each label that hold the pattern."""
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())

        def out():
            names = list(counts[0].keys() | counts[1].keys())
            for i in range(0, len(names), 50_000):
                some = names[i:i + 50_000]
                yield pd.DataFrame({"pattern": pd.Series(some, dtype=object), "clean": [counts[0][n] for n in some], "toxic": [counts[1][n] for n in some]})
            counts[0].clear(), counts[1].clear()

        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                counts[label].update(patterns(text))
                if len(counts[0]) + len(counts[1]) > 300_000:
                    yield from out()
        yield from out()

    partial = train.select("text", "label").mapInPandas(work, "pattern string, clean long, toxic long")
    return partial.groupBy("pattern").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))


def sketch(text: str | None) -> tuple[int, ...]:
    """Three minima over hashes of three-word shingles: copies of a text share them, near copies most, others hardly any."""
    words = WORD.findall(fold(text or ""))
    codes = [zlib.crc32(" ".join(words[i:i + 3]).encode()) for i in range(max(1, len(words) - 2))]
    return min(codes), min(c * 0x9E3779B1 & 0xFFFFFFFF for c in codes), min(c * 0x85EBCA6B & 0xFFFFFFFF for c in codes)


def chance(toxic: int, clean: int, base: float) -> float:
    """Bound on the probability of so many toxic documents among those that hold a pattern, were it unrelated."""
    n = toxic + clean
    share = toxic / n
    if share <= base:
        return 1.0
    gap = share * np.log(share / base) + ((1 - share) * np.log((1 - share) / (1 - base)) if share < 1 else 0.0)
    return float(np.exp(-n * gap))


def chosen(candidates: dict[str, tuple[int, float]], documents: list[tuple[set[str], tuple[int, ...]]], base: float, tested: int) -> list[tuple[str, float]]:
    """Entries whose documents are toxic too often for chance, at a false-discovery rate of ``FALSE`` among all patterns tested.

    ``candidates``: clean documents and weight of each; ``documents``: the patterns and sketch of each toxic document.
    Copies count once: the support of a pattern is its number of different minima.
    """
    minima: dict[str, tuple[set[int], ...]] = defaultdict(lambda: (set(), set(), set()))
    holders: dict[str, set[int]] = defaultdict(set)
    for i, (found, marks) in enumerate(documents):
        for p in found:
            holders[p].add(i)
            for seen, mark in zip(minima[p], marks):
                seen.add(mark)
    ranked = sorted((chance(min(map(len, seen)), candidates[p][0], base), p) for p, seen in minima.items() if min(map(len, seen)) >= SUPPORT)
    passed = [i for i, (p_value, _) in enumerate(ranked) if p_value <= FALSE * (i + 1) / tested]
    kept = [p for _, p in ranked[:passed[-1] + 1 if passed else 0]]
    in_order = sorted(kept)

    def needless(p: str) -> bool:
        """A beginning whose toxic documents one longer entry has as well says no more than that entry."""
        stem = p.removesuffix("-")
        longer = (q for q in takewhile(lambda q: q.startswith(stem), islice(in_order, bisect_left(in_order, stem), None)) if q != p)
        return p.endswith("-") and any(len(holders[p] & holders[q]) >= 0.98 * len(holders[p]) for q in longer)

    return [(p, candidates[p][1]) for p in kept if not needless(p)]


def fitted_curve(weight: np.ndarray, n_words: np.ndarray, label: np.ndarray) -> tuple[float, float, float]:
    """Logistic regression with a small ridge, by Newton steps."""
    x = np.column_stack([np.ones(len(label)), np.log1p(weight), np.log1p(n_words)])
    ridge, beta = np.diag([1e-6, 1.0, 1.0]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (label - p) - ridge @ beta
        bend = (x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(3)
        step = np.linalg.solve(bend, slope)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(b) for b in beta)


def fit(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """The lexicon of at most ``sample`` labelled documents; only those reach Python and the driver."""
    picked = labelled_sample(labels, "toxic", sample)
    texts = documents.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"))
    train = one_row_each(texts.join(F.broadcast(picked), "doc_id"), "doc_id", "label")
    train = saved(train.select("text", "label"), "toxicity-sample")
    totals = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = totals.get(1, 0), totals.get(0, 0)
    if not toxic or not clean:
        return Lexicon((), exceptions, (-30.0, 0.0, 0.0))
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("clean") + 0.5) / (clean + 1.0))
    counts = saved(pattern_counts(train).where(F.col("toxic") + F.col("clean") >= SUPPORT), "toxicity-patterns")
    strong = counts.where(F.col("toxic") >= SUPPORT).withColumn("weight", weight).where(F.col("weight") >= LEAST_WEIGHT)
    # The sample bounds them.
    candidates = {r["pattern"]: (r["clean"], r["weight"]) for r in strong.collect()}

    def found_in(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [sorted(patterns(t) & candidates.keys()) for t in batch["text"]]
            yield pd.DataFrame({"found": found, "marks": [list(sketch(t)) for t in batch["text"]]})

    toxic_texts = train.where("label = 1").select("text")
    found = [(set(r["found"]), tuple(r["marks"])) for r in toxic_texts.mapInPandas(found_in, "found array<string>, marks array<long>").collect()]
    picks = chosen(candidates, found, toxic / (toxic + clean), max(1, counts.count()))
    entries = tuple((p.removesuffix("-"), not p.endswith("-"), w) for p, w in picks)
    lexicon = Lexicon(entries, exceptions)

    def measured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = lexicon.automaton()
        for batch in batches:
            got = [features(t, automaton) for t in batch["text"]]
            yield pd.DataFrame({"weight": [g[0] for g in got], "n": [g[1] for g in got], "label": batch["label"]})

    seen = train.mapInPandas(measured, "weight double, n long, label int").toPandas()
    return Lexicon(entries, exceptions, fitted_curve(seen["weight"].to_numpy(), seen["n"].to_numpy(), seen["label"].to_numpy()))


def score(lexicon: Lexicon, text: Column) -> Column:
    """Probability that a text is labelled toxic."""
    @F.pandas_udf(T.DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        automaton = lexicon.automaton()
        for texts in batches:
            got = [features(t, automaton) for t in texts]
            yield pd.Series(probability(np.array([g[0] for g in got], float), np.array([g[1] for g in got], float), lexicon.curve))

    return scored(text)


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    documents = table(spark, sf_dir, "documents")
    lexicon = fit(documents, table(spark, sf_dir, "labels"))
    scored = documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score(lexicon, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= REJECT).cast("int"))


QUERIES = {"op7_toxicity": op7_toxicity}
SQL = {}
