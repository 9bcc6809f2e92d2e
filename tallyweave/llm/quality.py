"""Quality classifier: a sparse ensemble of rules over text statistics.

Shallow trees are grown on the statistics of labelled texts. Every path from a
root to a node is a rule, a conjunction of bounds. A lasso logistic regression
over the rules keeps few of them; these are compiled into one column expression.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.labels import learning_rows
from tallyweave.runtime import cut

# Rows that a fit learns from at most.
MOST_ROWS = 20_000


def statistics(text: Column) -> dict[str, Column]:
    """Name to value; all are finite, and 0 for an empty text unless stated otherwise."""

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern)).cast("double")

    chars = F.char_length(text).cast("double")
    words = count(r"\S+")
    distinct = F.size(F.array_distinct(F.split(text, r"\s+"))).cast("double")
    per_char = {
        "capitals": r"\p{Lu}",
        "digits": r"[0-9]",
        "symbols": r"[^\p{L}\p{N}\s.,;:'\"!?()-]",
        "marks": r"[!?]",
        "beyond_ascii": r"[^\x00-\x7F]",
        "char_runs": r"(\S)\1{3,}",
    }
    per_word = {
        "stops": r"[.,;:]",
        "lines": r"\n",
        "long_words": r"\S{16,}",
        "lone_signs": r"(?<!\S)[^\p{L}\p{N}\s]+(?!\S)",
        "same_word_again": r"(?<!\S)(\S+)\s+(?=\1(?!\S))",
    }
    return {
        "log_chars": F.log1p(chars),
        "word_length": chars / (words + 1),
        "distinct_words": distinct / (words + 1),  # 1 for an empty text
        **{name: count(pattern) / (chars + 1) for name, pattern in per_char.items()},
        **{name: count(pattern) / (words + 1) for name, pattern in per_word.items()},
    }


@dataclass(frozen=True)
class Bound:
    """``statistic`` above ``value``, or at most ``value``."""

    statistic: str
    above: bool
    value: float

    def holds(self, row: Column) -> Column:
        given = row[self.statistic]
        return given > self.value if self.above else given <= self.value


Rule = tuple[Bound, ...]


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted rules; the score is the logistic function of their sum."""

    intercept: float
    weighted: tuple[tuple[Rule, float], ...]

    def score(self, text: Column) -> Column:
        """0 to 1, higher where label 1 is likelier. Null counts as empty.

        The statistics are bound to one variable, so each is computed once
        however often rules or a later filter refer to it.
        """
        given = F.coalesce(text, F.lit(""))
        row = F.struct(*[v.alias(k) for k, v in statistics(given).items()])

        def total(s: Column) -> Column:
            out = F.lit(self.intercept)
            for rule, weight in self.weighted:
                out = out + F.when(_all_hold(rule, s), weight).otherwise(0.0)
            return 1.0 / (1.0 + F.exp(-out))

        return F.get(F.transform(F.array(row), total), 0)


def _all_hold(rule: Rule, row: Column) -> Column:
    held = F.lit(True)
    for bound in rule:
        held = held & bound.holds(row)
    return held


def _tightest(path: Iterable[Bound]) -> Rule:
    """One upper and one lower bound per statistic, in a fixed order."""
    kept: dict[tuple[str, bool], Bound] = {}
    for bound in path:
        key = (bound.statistic, bound.above)
        pick = max if bound.above else min
        value = pick(bound.value, kept[key].value) if key in kept else bound.value
        kept[key] = Bound(*key, value)
    return tuple(kept[key] for key in sorted(kept))


def paths(described: str, names: list[str]) -> list[Rule]:
    """The rules of all paths of trees, from Spark's own description of them."""
    line_form = re.compile(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)")
    path: list[tuple[int, Bound]] = []
    rules: dict[Rule, None] = {}
    for line in described.splitlines():
        found = line_form.match(line)
        if not found:
            if line.lstrip().startswith("Tree"):
                path = []
            continue
        depth = len(found[1])
        path = [(d, bound) for d, bound in path if d < depth]
        path.append((depth, Bound(names[int(found[2])], found[3] == ">", float(found[4]))))
        rules[_tightest(bound for _, bound in path)] = None
    return list(rules)


def fit(
    documents: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    folds: int = 5,
    held: int = 0,
    most_rows: int = MOST_ROWS,
    trees: int = 20,
    depth: int = 3,
    penalty: float = 0.001,
) -> RuleEnsemble:
    """Learn from about ``most_rows`` labelled rows at most, none of the held-out fold.

    Null texts count as empty, null labels are left out. Without any usable row
    the score is 0.5 everywhere; with one class only it is that class's value.
    """
    names = list(statistics(F.lit("")))
    rows = learning_rows(documents, labels, label, folds, held, most_rows).select(
        "label", F.array(*statistics(F.col("text")).values()).alias("statistics")
    )
    # measured by the tasks of the scan; only the bounded rows left are gathered into a few
    rows = cut(rows, "quality-statistics").coalesce(8)
    seen = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    if len(seen) < 2:
        return RuleEnsemble({0.0: -30.0, 1.0: 30.0}.get(next(iter(seen), None), 0.0), ())
    forest = RandomForestClassifier(
        labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth,
        minInstancesPerNode=5, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=17,
    ).fit(rows.select("label", array_to_vector("statistics").alias("features")))
    rules = paths(forest.toDebugString, names)
    row = F.struct(*[F.get("statistics", i).alias(name) for i, name in enumerate(names)])
    bound = rows.select("label", row.alias("row"))
    held_rules = [F.when(_all_hold(r, F.col("row")), 1.0).otherwise(0.0) for r in rules]
    if not rules:
        held_rules = [F.lit(0.0)]
    lasso = LogisticRegression(
        elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=False
    ).fit(bound.select("label", array_to_vector(F.array(*held_rules)).alias("features")))
    weights = zip(rules, lasso.coefficients.toArray().tolist(), strict=False)
    return RuleEnsemble(lasso.intercept, tuple((r, w) for r, w in weights if abs(w) > 1e-9))
