"""Quality classifier: a sparse ensemble of rules (RuleFit; Friedman and Popescu 2008).

A random forest over statistics of the texts gives candidate rules: every path from a root
is a conjunction of bounds. A logistic regression with a lasso penalty weighs the rules
and drops most. What is left is one column expression over the statistics.
"""

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored
from .text_stats import characters, repeats, share, whole, words, written_lines

#: Labelled rows, those with the smallest hashes, from which rules and weights are learnt.
FIT_ROWS = 20_000
#: Characters that sentences rarely hold.
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

STATISTICS = (
    "n_words", "word_length", "symbols", "marks", "capitals", "digits", "short_words", "distinct_words",
    "line_words", "repeated_lines",
)


def text_statistics(docs: DataFrame, keep=("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and the ``STATISTICS`` of each text, as doubles."""
    docs = docs.select(*keep, whole().alias("stat__text"))
    text = F.col("stat__text")
    split = docs.select(*keep, text, words(text).alias("stat__words"), written_lines(text).alias("stat__lines"))
    found = F.col("stat__words")
    n, lines = F.size(found), F.size("stat__lines")
    letters = F.length(F.translate(text, " \t\n\x0b\f\r", ""))
    short = F.size(F.filter(found, lambda w: F.length(w) <= 3))
    columns = {
        "n_words": n.cast("double"),
        "word_length": share(letters, n),
        "symbols": share(characters(text, SYMBOLS), n),
        "marks": share(characters(text, "!?"), n),
        "capitals": share(characters(text, CAPITALS), letters),
        "digits": share(characters(text, "0123456789"), letters),
        "short_words": share(short, n),
        "distinct_words": share(F.size(F.array_distinct(found)), n),
        "line_words": share(n, lines),
        "repeated_lines": share(repeats(F.col("stat__lines")), lines),
    }
    return split.select(*keep, *[column.alias(name) for name, column in columns.items()])


@dataclass(frozen=True)
class Rule:
    """Bounds (statistic, is upper, value) that hold together."""

    bounds: tuple

    def column(self) -> Column:
        out = F.lit(True)
        for name, upper, value in self.bounds:
            out = out & (F.col(name) <= value if upper else F.col(name) > value)
        return out.cast("double")


def rules_of(description: str, names=STATISTICS) -> list[Rule]:
    """The distinct paths, from the roots to every node, in a forest's printed form."""
    path, found = [], {}
    for line in description.splitlines():
        if re.match(r"\s*Tree \d+", line):
            path = []
        step = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if step:
            depth = len(step[1])
            path = [p for p in path if p[0] < depth] + [(depth, names[int(step[2])], step[3] == "<=", float(step[4]))]
            found[Rule(tuple(p[1:] for p in path))] = None
    return list(found)


@dataclass
class RuleModel:
    """A constant and weighted rules; the score is the logistic function of their sum."""

    constant: float
    rules: list[tuple[Rule, float]]

    def score(self) -> Column:
        total = F.lit(self.constant)
        for rule, weight in self.rules:
            total = total + rule.column() * F.lit(weight)
        return 1 / (1 + F.exp(-total))


def fit_rules(labelled: DataFrame, label: str, trees: int, depth: int, penalty: float, seed: int) -> RuleModel:
    """Learn from a bounded table of ``STATISTICS`` and a 0/1 ``label``.

    With one kind of label only, the model is a constant: 0.5 without any row, else the
    share of ones with one row of each kind added.
    """
    counts = labelled.agg(F.count("*").alias("n"), F.sum(label).alias("ones")).first()
    n, ones = counts["n"], int(counts["ones"] or 0)
    if not 0 < ones < n:
        odds = (ones + 1) / (n - ones + 1)
        return RuleModel(math.log(odds), [])
    rows = VectorAssembler(inputCols=list(STATISTICS), outputCol="fit__x").transform(labelled)
    forest = RandomForestClassifier(
        featuresCol="fit__x", labelCol=label, numTrees=trees, maxDepth=depth, maxBins=64, featureSubsetStrategy="0.5", seed=seed
    ).fit(rows)
    rules = rules_of(forest.toDebugString)
    if not rules:
        return RuleModel(math.log(ones / (n - ones)), [])
    met = labelled.select(F.col(label), *[r.column().alias(f"r{i}") for i, r in enumerate(rules)])
    met = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="fit__r").transform(met)
    weighed = LogisticRegression(
        featuresCol="fit__r", labelCol=label, elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False
    ).fit(met.select(label, "fit__r"))
    weights = [(r, float(w)) for r, w in zip(rules, weighed.coefficients) if w]
    return RuleModel(float(weighed.intercept), weights)


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that no label is learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_quality(
    found: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, trees: int = 20, depth: int = 3,
    penalty: float = 0.0005, seed: int = 7,
) -> RuleModel:
    """Learn from ``found`` (doc_id and ``STATISTICS``) and ``labels`` (doc_id, quality).

    At most ``fit_rows`` labelled rows take part, none of them held out: those have
    crc32(doc_id as text) mod 4 = 2. Labels that are null or neither 0 nor 1, or belong to
    no document, are not used. Without usable labels every score is the same.
    """
    usable = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("fit__y"))
    usable = usable.where(F.col("fit__y").isin(0.0, 1.0) & F.col("doc_id").isNotNull() & ~held_out())
    chosen = usable.join(found, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "fit__y", *STATISTICS).limit(fit_rows)
    # One ordered partition, so that the forest's samples do not depend on the cluster.
    labelled = stored(chosen.coalesce(1).sortWithinPartitions("doc_id"))
    return fit_rules(labelled, "fit__y", trees, depth, penalty, seed)


def _statistics(docs: DataFrame) -> DataFrame:
    return stored(text_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit) -> DataFrame:
    """doc_id, held_out, score, predicted and the statistics of each row of ``docs``.

    ``score`` is the probability of label 1 by the model of ``fit_quality``, ``predicted``
    1 where it reaches ``threshold``; ``fit`` are that function's parameters.

    Null and empty texts have all statistics 0 and are scored as such. Every row gives one
    row, repeated ones and null doc_ids too (a null is not held out and has no label); an
    empty table gives an empty result. Other columns are ignored.
    """
    found = _statistics(docs)
    scored = found.withColumn("score", fit_quality(found, labels, **fit).score())
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), *STATISTICS
    )


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **fit) -> DataFrame:
    """The rows of ``docs`` whose score, as in ``score_quality``, reaches ``threshold``.

    The statistics are computed once to learn and once to judge, so that no text is
    shuffled or written.
    """
    model = fit_quality(_statistics(docs), labels, **fit)
    given = [f"given__{i}" for i in range(len(docs.columns))]
    named = docs.select(*[F.col(f"`{c}`").alias(g) for c, g in zip(docs.columns, given)], F.col("text"))
    kept = text_statistics(named, given).where(model.score() >= threshold)
    return kept.select(*[F.col(g).alias(c) for c, g in zip(docs.columns, given)])
