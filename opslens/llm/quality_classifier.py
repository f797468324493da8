"""Quality classifier: a sparse ensemble of rules read off decision trees.

1. Statistics of every text, as shares that do not depend on its length (and its length).
2. A random forest of shallow trees is grown on a bounded sample of labelled documents.  Every path from a root to a
   node, leaf or not, is a rule: a conjunction of thresholds.
3. A logistic regression with an L1 penalty on the rules' outcomes keeps the few that matter.
4. These are compiled into one column expression over the statistics, so scoring is a projection.

Only the sample, at most ``SAMPLE`` rows of numbers, is used for fitting; statistics and scores cover all rows.  Null texts
count as empty, and empty texts are scored like others.  With one label only in the sample its share is every score,
without any label it is 0.5.  Documents labelled twice count once, and of several rows of one identifier one
is learned from.  Repeated rows and null identifiers are scored like any others; only the named columns are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslens.llm._common import held_out, labelled_sample, one_row_each, saved, table
from opslens.llm.quality_rules import share, statistics

#: Labelled rows that a fit uses at most.
SAMPLE = 20_000
TREES, DEPTH, PENALTY, SEED = 16, 3, 0.002, 17
NODE = re.compile(r"^( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def measures() -> dict[str, Column]:
    """What trees split on, by name."""
    return {
        "words": F.log1p(F.col("n_words").cast("double")),
        "word_length": share("word_chars", "n_words"),
        "symbols": share("n_symbols", "word_chars"),
        "symbol_words": share("n_symbol_words", "n_words"),
        "letters": share("n_letters", "word_chars"),
        "capitals": share("n_capitals", "word_chars"),
        "marks": share("n_marks", "n_words"),
        "distinct": share("n_distinct", "n_words"),
        "function_words": F.col("n_function_words").cast("double"),
        "repeat_words": share("n_repeat_words", "n_words"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "line_length": share("n_words", "n_lines"),
    }


def measured(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the measures of every document."""
    return statistics(documents, id_col, text_col).select("doc_id", *[c.cast("double").alias(name) for name, c in measures().items()])


@dataclass(frozen=True)
class Rule:
    """All of ``parts`` hold: (measure, is at most?, threshold)."""
    parts: tuple[tuple[str, bool, float], ...]

    def column(self) -> Column:
        whole = F.lit(True)
        for name, at_most, value in self.parts:
            whole = whole & (F.col(name) <= value if at_most else F.col(name) > value)
        return whole


def tightened(parts: list[tuple[str, bool, float]]) -> Rule:
    """A path as a rule: of several bounds on one side of a measure the tightest."""
    bounds: dict[tuple[str, bool], float] = {}
    for name, at_most, value in parts:
        known = bounds.get((name, at_most), value)
        bounds[name, at_most] = min(known, value) if at_most else max(known, value)
    return Rule(tuple((n, side, v) for (n, side), v in sorted(bounds.items())))


def paths(forest: str, names: list[str]) -> list[Rule]:
    """Every path of a forest's description, from its root to each node."""
    open_parts: list[tuple[int, tuple[str, bool, float]]] = []
    found: dict[Rule, None] = {}
    for line in forest.splitlines():
        node = NODE.match(line)
        if not node:
            if line.lstrip().startswith("Tree"):
                open_parts = []
            continue
        indent = len(node[1])
        open_parts = [p for p in open_parts if p[0] < indent] + [(indent, (names[int(node[2])], node[3] == "<=", float(node[4])))]
        found[tightened([p for _, p in open_parts])] = None
    return list(found)


@dataclass(frozen=True)
class Ensemble:
    """Intercept and weighted rules; a score is a logistic curve of their sum."""
    intercept: float
    rules: tuple[tuple[float, Rule], ...] = ()
    constant: float | None = None

    def score(self) -> Column:
        if self.constant is not None:
            return F.lit(self.constant)
        total = F.lit(self.intercept)
        for weight, rule in self.rules:
            total = total + F.when(rule.column(), weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def fit(stats: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ensemble:
    """The ensemble for ``labels.quality`` over the rows of ``stats``."""
    names = list(measures())
    train = stats.select("doc_id", *names).join(F.broadcast(labelled_sample(labels, "quality", sample)), "doc_id")
    train = saved(one_row_each(train, "doc_id", "label").select("label", *names), "quality-sample")
    seen = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(seen) < 2:
        return Ensemble(0.0, constant=float(next(iter(seen), 0.5)))
    vectors = VectorAssembler(inputCols=names, outputCol="measures").transform(train).select(F.col("label").cast("double").alias("label"), "measures", *names)
    forest = RandomForestClassifier(featuresCol="measures", numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird").fit(vectors)
    rules = paths(forest.toDebugString, names)
    if not rules:
        return Ensemble(0.0, constant=seen.get(1, 0) / sum(seen.values()))
    fired = vectors.select("label", *[rule.column().cast("double").alias(f"rule_{i}") for i, rule in enumerate(rules)])
    fired = VectorAssembler(inputCols=[f"rule_{i}" for i in range(len(rules))], outputCol="rules").transform(fired).select("label", "rules")
    model = LogisticRegression(featuresCol="rules", elasticNetParam=1.0, regParam=PENALTY, maxIter=60).fit(saved(fired, "quality-rules"))
    kept = tuple((float(w), rule) for w, rule in zip(model.coefficients, rules) if abs(w) > 1e-9)
    return Ensemble(float(model.intercept), kept)


def op1_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Score and verdict of every document."""
    stats = saved(measured(table(spark, sf_dir, "documents")), "quality-measures")
    ensemble = fit(stats, table(spark, sf_dir, "labels"))
    scored = stats.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), ensemble.score().cast("double").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


QUERIES = {"op1_quality_classifier": op1_quality_classifier}
SQL = {}
