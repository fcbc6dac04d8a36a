"""Quality rules as weak supervision: rules vote or abstain, and EM weighs their votes.

Each rule reads a statistic of the whole text and votes good (1), bad (-1) or abstains
(0). A text is a vote pattern; how often each pattern occurs is all that expectation
maximisation needs to estimate, for good and for bad texts, how often each rule gives each
vote. The posterior probability of a good text is then a logistic sum of log odds, a
column expression. Nothing but SQL functions runs on the texts.
"""

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import stored
from .text_stats import characters, repeats, share, whole, words, written_lines

#: Characters counted as symbols, and the words of a window.
SYMBOLS, WINDOW = "#*$%&|<>", 8
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class VoteRule:
    """Votes bad where ``bad`` holds, else good where ``good`` does, else abstains.

    ``bad`` and ``good`` are SQL conditions over the columns of ``text_counts``.
    """

    name: str
    bad: str
    good: str

    def vote(self) -> Column:
        return F.when(F.expr(self.bad), -1).when(F.expr(self.good), 1).otherwise(0).cast("int")


RULES = (
    VoteRule("symbols", "n_symbols > 0.1 * n_words", "n_symbols <= 0.02 * n_words"),
    VoteRule("marks", "n_marks > 0.15 * n_words", "n_marks <= 0.05 * n_words"),
    VoteRule("capitals", "n_capitals > 0.3 * word_chars", "n_capitals <= 0.1 * word_chars"),
    VoteRule("lines", "n_lines >= 3 and n_dup_lines > 0.5 * n_lines", "n_lines >= 3 and n_dup_lines = 0"),
    VoteRule("repeats", "n_repeat_words > 0.25 * n_words", "n_repeat_words <= 0.02 * n_words"),
    VoteRule("variety", "n_words >= 50 and n_distinct < 0.2 * n_words", "n_words >= 50 and n_distinct > 0.35 * n_words"),
    VoteRule("word_length", "word_chars > 12 * n_words or word_chars < 2.5 * n_words", "word_chars between 3 * n_words and 9 * n_words"),
    VoteRule("short_words", "n_words >= 30 and n_short < 0.12 * n_words", "n_short >= 0.2 * n_words"),
)


def repeat_words(windows: Column) -> Column:
    """Words covered by windows whose hash occurs twice or more; ``windows`` in text order."""
    numbered = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))

    def covered(rows: Column) -> Column:
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        again = F.filter(rows, lambda r, n: same(r, F.get(rows, n - 1)) | same(r, F.get(rows, n + 1)))
        return F.array_sort(F.transform(again, lambda r: r["i"]))

    def lengths(starts: Column) -> Column:
        return F.transform(
            starts, lambda s, n: F.least(F.lit(WINDOW), F.coalesce(F.get(starts, n + 1) - s, F.lit(WINDOW)))
        )

    # One-element arrays bind a value, so that it is not computed for each element again.
    rows = F.transform(F.array(F.sort_array(numbered)), covered)
    added = F.transform(rows, lambda starts: F.aggregate(lengths(starts), F.lit(0), lambda a, b: a + b))
    return F.get(added, F.lit(0))


def text_counts(docs: DataFrame) -> DataFrame:
    """doc_id, the ``BASE`` counts, and the further counts that rules read."""
    docs = docs.select("doc_id", whole().alias("rules__text"))
    text = F.col("rules__text")
    split = docs.select("doc_id", text, words(text).alias("rules__words"), written_lines(text).alias("rules__lines"))
    found = F.col("rules__words")
    hashed = split.withColumn("rules__hashes", F.transform(found, lambda w: F.xxhash64(w)))
    n = F.size(found)
    starts = F.sequence(F.lit(1), n - WINDOW + 1)
    windows = F.transform(starts, lambda i: F.xxhash64(F.slice("rules__hashes", i, WINDOW)))
    hashed = hashed.withColumn("rules__windows", F.when(n >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    windows = F.col("rules__windows")
    counted = {
        "n_words": n,
        "word_chars": F.length(F.translate(text, " \t\n\x0b\f\r", "")),
        "n_symbols": characters(text, SYMBOLS),
        "n_dup_lines": repeats(F.col("rules__lines")),
        "n_repeat_words": F.when(repeats(windows) > 0, repeat_words(windows)).otherwise(0),
        "n_lines": F.size("rules__lines"),
        "n_marks": characters(text, "!?"),
        "n_capitals": characters(text, CAPITALS),
        "n_distinct": F.size(F.array_distinct("rules__hashes")),
        "n_short": F.size(F.filter(found, lambda w: (F.length(w) <= 3) & ~w.isin(*SYMBOLS))),
    }
    return hashed.select("doc_id", *[c.cast("long").alias(name) for name, c in counted.items()])


#: How often a good and a bad text get the votes -1, 0 and 1 before any text is seen.
EXPECTED = {1: {-1: 0.01, 0: 0.14, 1: 0.85}, 0: {-1: 0.25, 0: 0.15, 1: 0.60}}


def estimate_accuracies(patterns: list[tuple[tuple, int]], rules: int, rounds: int = 50, trust: float = 0.05):
    """(log odds of good, for each rule the log odds that a vote adds) by EM.

    ``patterns`` are vote patterns with their counts: at most 3 ** ``rules`` of them. It
    starts from the votes in ``EXPECTED``, which go on to count as ``trust`` times the
    texts (and as one text more): that keeps apart which class is the good one.
    """
    texts = sum(count for _, count in patterns)
    weight = {kind: {v: 1 + trust * texts * p for v, p in EXPECTED[kind].items()} for kind in (0, 1)}
    prior, odds = 0.9, [{v: math.log(EXPECTED[1][v] / EXPECTED[0][v]) for v in (-1, 0, 1)}] * rules
    for _ in range(rounds):
        seen = {kind: [dict(weight[kind]) for _ in range(rules)] for kind in (0, 1)}
        good = 1.0
        for votes, count in patterns:
            x = math.log(prior / (1 - prior)) + sum(odds[i][v] for i, v in enumerate(votes))
            p = 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))
            good += count * p
            for i, v in enumerate(votes):
                seen[1][i][v] += count * p
                seen[0][i][v] += count * (1 - p)
        prior = min(max(good / (texts + 2), 1e-6), 1 - 1e-6)
        sums = {kind: [sum(s.values()) for s in seen[kind]] for kind in (0, 1)}
        odds = [
            {v: math.log(seen[1][i][v] / sums[1][i]) - math.log(seen[0][i][v] / sums[0][i]) for v in (-1, 0, 1)}
            for i in range(rules)
        ]
    return math.log(prior / (1 - prior)), odds


def judge_quality(docs: DataFrame, rules: tuple[VoteRule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """doc_id, the ``BASE`` counts, base_failed, kept, quality (posterior) and the votes.

    A text fails the base rules with fewer than 20 words, or if more than 30 % of its
    words lie in 8-word windows found twice or more in it. ``kept`` is false then, else it
    tells whether the posterior probability of a good text is ``least`` or more. The
    patterns of all texts that pass the base rules take part in the estimate.

    Null and empty texts have no words and fail. Every row gives one row, repeated ones
    and null doc_ids too; other columns are ignored; an empty table gives an empty result.
    The driver gets the vote patterns with their counts, at most 3 ** len(rules) rows.
    """
    counts = text_counts(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    votes = [f"vote_{rule.name}" for rule in rules]
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    voted = stored(
        counts.withColumns({name: rule.vote() for name, rule in zip(votes, rules)}).withColumn("base_failed", failed)
    )
    met = voted.where("not base_failed").groupBy(*votes).agg(F.count("*").alias("n")).collect()
    patterns = [(tuple(row[v] for v in votes), row["n"]) for row in met]
    prior, odds = estimate_accuracies(patterns, len(rules))
    total = F.lit(prior)
    for name, by_vote in zip(votes, odds):
        vote = F.col(name)
        total = total + F.when(vote == 1, by_vote[1]).when(vote == -1, by_vote[-1]).otherwise(by_vote[0])
    quality = 1 / (1 + F.exp(-total))
    kept = ~F.col("base_failed") & (quality >= least)
    return voted.select("doc_id", *BASE, "base_failed", kept.alias("kept"), quality.alias("quality"), *votes)
