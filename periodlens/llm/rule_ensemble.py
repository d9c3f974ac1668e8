"""Quality classifier: a sparse rule ensemble.

Boosted shallow trees over text statistics are fitted by Spark; every path from a
root to a node becomes a conjunctive rule; a lasso logistic regression over the
rules' truth values keeps few of them; the kept rules and weights are compiled
into one Spark column expression.

Only the text's statistics enter a score. Rows learn where ``label`` is 0 or 1.

Defined cases: null and empty texts have all statistics 0 and are scored like any
other; null labels and ids do not learn, repeated label rows count as often as
they stand; without labelled rows the score is 0.5, with one class only it is
that label's add-one share; an empty table gives an empty result. Extra columns
pass through where ``keep`` names them.

Scale: one pass over the texts, the statistics are written, and all fitting reads
only those. The driver holds trees and weights: a few hundred numbers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text_stats import COUNTS

TREES, DEPTH, LASSO = 12, 3, 0.0005
Rule = tuple[tuple[int, str, float], ...]  # (statistic, "<=" or ">", threshold), all of them


def statistics() -> dict[str, Column]:
    """Ratios of the counts: none grows with the text but the log of its length."""
    def per(a: str, b: str) -> Column:
        return F.col(a) / F.greatest(F.col(b), F.lit(1))

    return {
        "log_words": F.log1p(F.col("n_words").cast("double")),
        "word_length": per("word_chars", "n_words"),
        "symbols": per("n_symbols", "n_words"),
        "bangs": per("n_bangs", "n_words"),
        "pipes": per("n_pipes", "n_words"),
        "punctuation": per("n_punct", "n_words"),
        "digits": per("n_digits", "n_chars_all"),
        "upper": per("n_upper", "n_chars_all"),
        "upper_words": per("n_upper_words", "n_words"),
        "short_words": per("n_short_words", "n_words"),
        "long_words": per("n_long_words", "n_words"),
        "distinct_words": per("n_distinct_words", "n_words"),
        "repeated_words": per("n_repeat_words", "n_words"),
        "repeated_lines": per("n_dup_lines", "n_lines"),
        "line_words": per("n_words", "n_lines"),
    }


def with_statistics(counts: DataFrame) -> DataFrame:
    """The counts' other columns and the array ``stats``."""
    keep = [c for c in counts.columns if c not in COUNTS]
    return counts.select(*keep, F.array(*statistics().values()).alias("stats"))


def tree_rules(model) -> list[Rule]:
    """The conjunction on the way to every node but the roots, each once."""
    found: dict[Rule, None] = {}

    def walk(node, path: Rule) -> None:
        if path:
            found[tightened(path)] = None
        if node.numDescendants():
            split = node.split()
            k, limit = split.featureIndex(), split.threshold()
            walk(node.leftChild(), (*path, (k, "<=", limit)))
            walk(node.rightChild(), (*path, (k, ">", limit)))

    for tree in model._java_obj.trees():
        walk(tree.rootNode(), ())
    return list(found)


def tightened(path: Rule) -> Rule:
    """One bound per statistic and side, in order."""
    best: dict[tuple[int, str], float] = {}
    for k, side, limit in path:
        known = best.get((k, side), limit)
        best[k, side] = min(known, limit) if side == "<=" else max(known, limit)
    return tuple((k, side, limit) for (k, side), limit in sorted(best.items()))


def rule_column(rule: Rule, stats: str = "stats") -> Column:
    out = F.lit(True)
    for k, side, limit in rule:
        value = F.col(stats)[k]
        out = out & ((value <= limit) if side == "<=" else (value > limit))
    return out.cast("double")


@dataclass
class RuleEnsemble:
    """``bias`` and weighted rules; ``score`` is the compiled column."""

    bias: float
    rules: list[tuple[float, Rule]]

    def score(self, stats: str = "stats") -> Column:
        total = F.lit(self.bias)
        for weight, rule in self.rules:
            total = total + F.lit(weight) * rule_column(rule, stats)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def describe(self) -> list[str]:
        names = list(statistics())
        return [f"{w:+.3f} if " + " and ".join(f"{names[k]} {s} {x:.4g}" for k, s, x in r)
                for w, r in sorted(self.rules, key=lambda x: -abs(x[0]))]


def fit(rows: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO
        ) -> RuleEnsemble:
    """``rows``: the array ``stats`` and ``label`` (0 or 1)."""
    import math

    rows = rows.where(F.col("label").isin(0, 1)).select(
        "stats", F.col("label").cast("double").alias("label"))
    seen = {int(r["label"]): r["count"] for r in rows.groupBy("label").count().collect()}
    if len(seen) < 2:
        n, ones = sum(seen.values()), seen.get(1, 0)
        return RuleEnsemble(math.log((ones + 1) / (n - ones + 1)), [])
    vectors = rows.select("label", "stats", array_to_vector("stats").alias("features"))
    boosted = GBTClassifier(maxIter=trees, maxDepth=depth, seed=11, maxMemoryInMB=64)
    rules = tree_rules(boosted.fit(vectors))
    if not rules:
        return RuleEnsemble(math.log(seen[1] / seen[0]), [])
    truth = rows.select("label", array_to_vector(F.array(*[rule_column(r) for r in rules]))
                        .alias("features"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=60).fit(truth)
    weights = model.coefficients.toArray()
    return RuleEnsemble(float(model.intercept),
                        [(float(w), r) for w, r in zip(weights, rules) if w])
