"""Toxicity by weak supervision.

Voters are lexicon entries (a word) and patterns (a word's beginning), mined from
labelled texts; each votes "toxic" or abstains. A generative model of the votes,
fitted by expectation maximisation, estimates how often each voter fires in toxic
and in other texts, and how much voters move together beyond that; a voter counts
the less, the more it only repeats others. Given labels take part as one more
voter of stated accuracy. A linear classifier over the votes is then trained on
the model's posterior labels. Texts without a label take part through their votes
alone, in the rates, the correlations and the classifier.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.common import rows_of, text_of
from tallyweave.llm.labels import learning_rows, unlabelled_rows
from tallyweave.runtime import cut

# Labelled and unlabelled rows that a fit learns from at most, and voters whose correlations are held at a time.
MOST_ROWS, MOST_UNLABELLED, BLOCK = 20_000, 20_000, 256
# Lengths of word beginnings that can be patterns; a pattern is written with a final star.
STEMS = (4, 5, 6)
LABEL_ACCURACY = 0.999
# What a text without label weighs beside a labelled one, and from which correlation on voters repeat each
# other: two rare voters that share one text by chance stay below.
UNLABELLED_WEIGHT, REPEATING = 0.1, 0.6
_WORD = re.compile(r"\w+")


def traits(text: str) -> set[str]:
    """The words of a text in lower case, and the beginnings of the longer ones."""
    words = set(_WORD.findall(text.lower()))
    stems = {word[:n] + "*" for word in words for n in STEMS if len(word) > n}
    return words | stems


def _tallies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each batch: texts with a trait, by label; the empty trait counts the texts."""
    for batch in batches:
        seen: tuple[Counter, Counter] = (Counter(), Counter())
        for text, label in rows_of([batch], ("text", "label")):
            seen[int(label)].update(traits(text) | {""})
        names = sorted(seen[0] | seen[1])
        yield pa.RecordBatch.from_pydict(
            {
                "trait": names,
                "clean": pa.array([seen[0][t] for t in names], pa.int64()),
                "toxic": pa.array([seen[1][t] for t in names], pa.int64()),
            }
        )


def mine_voters(rows: DataFrame, least_texts: int, least_lift: float) -> list[str]:
    """All traits of at least ``least_texts`` toxic texts that are ``least_lift`` times as frequent there.

    ``rows`` holds ``text`` and ``label``. The strongest come first, ties by name.
    """
    by_trait = rows.mapInArrow(_tallies, "trait string, clean bigint, toxic bigint")
    counts = cut(
        by_trait.groupBy("trait").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")),
        "toxicity-traits",
    )
    total = counts.where("trait = ''").first()
    if total is None or not total.toxic:
        return []
    rate = (F.col("toxic") + 0.5) / (total.toxic + 1)
    lift = rate / ((F.col("clean") + 0.5) / ((total.clean or 0) + 1))
    chosen = (
        counts.where("trait <> ''")
        .where((F.col("toxic") >= least_texts) & (lift >= least_lift))
        .orderBy((F.log(lift) * F.sqrt("toxic")).desc(), "trait")
    )
    return [row.trait for row in chosen.select("trait").collect()]


@dataclass(frozen=True)
class Votes:
    """0/1 votes, a row per text, as the places of the ones, by row."""

    row: np.ndarray
    voter: np.ndarray
    shape: tuple[int, int]

    @staticmethod
    def of(votes: Votes | np.ndarray) -> Votes:
        return votes if isinstance(votes, Votes) else Votes(*np.nonzero(votes), votes.shape)

    def sums(self, of_voters: np.ndarray) -> np.ndarray:
        """Of each row, the sum over the voters that fire."""
        return np.bincount(self.row, of_voters[self.voter], self.shape[0])

    def totals(self, of_rows: np.ndarray) -> np.ndarray:
        """Of each voter, the sum over the rows it fires in."""
        return np.bincount(self.voter, of_rows[self.row], self.shape[1])

    def together(self, texts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """How many texts each two voters share: a block of voters at a time, places and values."""
        ends = np.searchsorted(self.row, np.arange(self.shape[0] + 1))
        out = []
        for low in range(0, self.shape[1], BLOCK):
            shared = np.zeros((min(BLOCK, self.shape[1] - low), self.shape[1]))
            for row in np.unique(self.row[(self.voter >= low) & (self.voter < low + BLOCK)]):
                fired = self.voter[ends[row] : ends[row + 1]]
                inside = fired[(fired >= low) & (fired < low + BLOCK)] - low
                shared[np.ix_(inside, fired)] += texts[row]
            places = np.flatnonzero(shared)
            out.append((places, shared.ravel()[places]))
        return out


def _repeats(
    votes: Votes,
    shared: list[tuple[np.ndarray, np.ndarray]],
    texts: np.ndarray,
    posterior: np.ndarray,
    rates: tuple[np.ndarray, np.ndarray],
    noise: float,
) -> np.ndarray:
    """Of each voter, the sum of its absolute correlations above ``noise`` with others.

    Correlated are the votes less what the row's posterior and the voters'
    ``rates`` make of them, so all but the shared texts is of rank four.
    """
    p, q = posterior * texts, (1 - posterior) * texts
    a, c = rates
    in_p, in_q = votes.totals(p), votes.totals(q)
    pp, pq, qq = p @ posterior, p @ (1 - posterior), q @ (1 - posterior)
    left = np.c_[in_p, in_q, a, c]
    right = np.c_[a, c, in_p - pp * a - pq * c, in_q - pq * a - qq * c]
    norm = np.sqrt(np.maximum(votes.totals(texts) - (left * right).sum(1), 0)) + 1e-9
    out = np.zeros(votes.shape[1])
    for low, (places, values) in zip(range(0, len(out), BLOCK), shared, strict=True):
        high = min(low + BLOCK, len(out))
        block = -left[low:high] @ right.T
        block.ravel()[places] += values
        block = np.abs(block / norm[low:high, None] / norm)
        block[np.arange(high - low), np.arange(low, high)] = 0
        block[block <= noise] = 0
        out[low:high] = block.sum(1)
    return out


@dataclass(frozen=True)
class LabelModel:
    """Of each voter: how often it fires in toxic and in other texts, and its weight."""

    prior: float
    in_toxic: np.ndarray
    in_clean: np.ndarray
    weight: np.ndarray

    def posterior(self, votes: Votes | np.ndarray) -> np.ndarray:
        """P(toxic) from 0/1 votes, a row per text."""
        fired = np.log(self.in_toxic / self.in_clean) * self.weight
        silent = np.log((1 - self.in_toxic) / (1 - self.in_clean)) * self.weight
        z = np.log(self.prior / (1 - self.prior)) + Votes.of(votes).sums(fired - silent) + silent.sum()
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_label_model(
    votes: Votes | np.ndarray,
    labels: np.ndarray,
    texts: np.ndarray | None = None,
    rounds: int = 20,
    accuracy: float = LABEL_ACCURACY,
    noise: float | None = None,
) -> tuple[LabelModel, np.ndarray]:
    """The model and the posterior of each row.

    A row stands for ``texts`` texts (default one) of equal votes; ``labels`` are
    0, 1 or NaN for none. Correlations up to ``noise`` do not count (default: what
    chance makes of independent voters that fire often). The first round sees the
    labelled rows alone, if there are any. A round estimates the voters' rates from the
    posteriors, then their correlations within either class; a voter's weight is
    one over one plus the sum of its absolute correlations with others.
    """
    votes = Votes.of(votes)
    texts = np.ones(votes.shape[0]) if texts is None else texts
    known = ~np.isnan(labels)
    sure = np.log(accuracy / (1 - accuracy))
    offset = np.where(known, np.where(labels == 1, sure, -sure), 0.0)
    posterior = np.where(
        known,
        np.where(labels == 1, accuracy, 1 - accuracy),
        np.where(np.bincount(votes.row, minlength=votes.shape[0]) > 0, 0.7, 0.05),
    )
    noise = 4 / np.sqrt(texts.sum()) if noise is None else noise
    every, first = texts, texts * known if known.any() else texts
    shared, model = votes.together(every), None
    for k in range(rounds):
        texts = every if k else first
        p, q = posterior * texts, (1 - posterior) * texts
        in_toxic = (votes.totals(p) + 0.1) / (p.sum() + 1)
        in_clean = (votes.totals(q) + 0.01) / (q.sum() + 1)
        both = shared if k or first is every else votes.together(first)
        repeats = _repeats(votes, both, texts, posterior, (in_toxic, in_clean), noise)
        prior = float(np.clip(p.sum() / texts.sum(), 1e-3, 1 - 1e-3))
        model = LabelModel(prior, in_toxic, in_clean, 1 / (1 + repeats))
        from_votes = model.posterior(votes)
        z = np.log(from_votes) - np.log1p(-from_votes) + offset
        posterior = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    return model, posterior


def _steepest(votes: Votes, share: np.ndarray) -> float:
    """A bound just above the largest eigenvalue of the weighted votes' squares, intercept included.

    For any positive vector the largest ratio of its image to itself is one
    (Collatz and Wielandt); a power iteration makes it tight.
    """
    one, of_voters, bound = 1.0, votes.totals(share), share.sum()
    fires = of_voters > 0
    for _ in range(100):
        rows = share * (one + votes.sums(of_voters))
        new, new_of = rows.sum(), votes.totals(rows)
        bound = max(new / one, (new_of[fires] / of_voters[fires]).max(initial=0.0))
        one, of_voters = 1.0, new_of / new
    return float(bound)


def fit_linear(
    votes: Votes | np.ndarray,
    target: np.ndarray,
    texts: np.ndarray | None = None,
    penalty: float = 1e-5,
    rounds: int = 1500,
) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic regression on soft labels, by accelerated descent."""
    votes = Votes.of(votes)
    texts = np.ones(votes.shape[0]) if texts is None else texts
    share = texts / texts.sum()
    w, momentum = np.zeros(votes.shape[1] + 1), np.zeros(votes.shape[1] + 1)
    rate = 4 / (_steepest(votes, share) + 4 * penalty)
    for k in range(rounds):
        ahead = w + momentum * (k / (k + 3))
        p = 1 / (1 + np.exp(-np.clip(ahead[0] + votes.sums(ahead[1:]), -30, 30)))
        miss = share * (p - target)
        slope = np.r_[miss.sum(), votes.totals(miss)] + penalty * np.r_[0, ahead[1:]]
        new = ahead - rate * slope
        momentum, w = new - w, new
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class ToxicityModel:
    """A linear classifier over votes; ``weights`` by trait."""

    intercept: float
    weights: dict[str, float]

    def score_text(self, text: str) -> float:
        z = self.intercept + sum(
            self.weights[t] for t in traits(text) & self.weights.keys()
        )
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    def score(self, documents: DataFrame, text: str = "text") -> DataFrame:
        """``row`` (all columns given, as a struct) and ``score``, 0 to 1. Null counts as empty."""
        rows = documents.select(F.struct("*").alias("row"), text_of(text).alias("text"))
        row_type = rows.schema["row"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                scores = [self.score_text(given) for (given,) in rows_of([batch], ("text",))]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row"), pa.array(scores, pa.float64())], names=["row", "score"]
                )

        return rows.mapInArrow(run, f"row {row_type}, score double")


def _votes(rows: DataFrame, voters: list[str]) -> tuple[Votes, np.ndarray, np.ndarray]:
    """Votes, labels and number of texts of a bounded number of rows, equal ones as one, on the driver.

    A label of -1 stands for none and comes out as NaN.
    """
    place = {name: i for i, name in enumerate(voters)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fired = [
                sorted(place[t] for t in traits(text) & place.keys())
                for (text,) in rows_of([batch], ("text",))
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array(fired, pa.list_(pa.int32()))],
                names=["label", "fired"],
            )

    given = rows.mapInArrow(run, "label double, fired array<int>").toArrow()
    alike = Counter(
        zip(map(tuple, given.column("fired").to_pylist()), given.column("label").to_pylist(), strict=True)
    )
    kinds = sorted(alike)
    sizes = [len(fired) for fired, _ in kinds]
    votes = Votes(
        np.repeat(np.arange(len(kinds)), sizes),
        np.array([voter for fired, _ in kinds for voter in fired], np.int64),
        (len(kinds), len(voters)),
    )
    labels = np.array([np.nan if label < 0 else label for _, label in kinds], float)
    return votes, labels, np.array([alike[kind] for kind in kinds], float)


def fit(
    documents: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    folds: int = 4,
    held: int = 2,
    most_rows: int = MOST_ROWS,
    least_texts: int = 3,
    least_lift: float = 8.0,
    most_unlabelled: int = MOST_UNLABELLED,
    unlabelled_weight: float = UNLABELLED_WEIGHT,
) -> ToxicityModel:
    """Learn from about ``most_rows`` labelled rows at most, none of the held-out fold.

    Voters are mined from these. About ``most_unlabelled`` texts without a label,
    at most and none of that fold, have votes in the label model too, each with
    ``unlabelled_weight`` of a labelled text's.

    Null texts count as empty, null labels are left out. Without usable rows, or
    without a toxic one, there are no voters and the score is the labels' mean
    (0 without labels) everywhere.
    """
    rows = cut(
        learning_rows(documents, labels, label, folds, held, most_rows), "toxicity-texts"
    )
    voters = mine_voters(rows, least_texts, least_lift)
    if not voters:
        mean = rows.agg(F.avg("label")).first()[0] or 0.0
        mean = float(np.clip(mean, 1e-9, 1 - 1e-9))
        return ToxicityModel(float(np.log(mean / (1 - mean))), {})
    others = unlabelled_rows(documents, labels, label, folds, held, most_unlabelled)
    every = rows.select("text", "label").unionByName(others.select("text", F.lit(-1.0).alias("label")))
    votes, given, texts = _votes(every, voters)
    texts = np.where(np.isnan(given), unlabelled_weight, 1.0) * texts
    _, posterior = fit_label_model(votes, given, texts, noise=REPEATING)
    intercept, weights = fit_linear(votes, posterior, texts)
    return ToxicityModel(intercept, dict(zip(voters, weights.tolist(), strict=True)))
