"""Toxicity by two class-conditional Kneser-Ney models.

A word is generated along its stems (its first four, six and eight letters, all of it); each step has in either class
an interpolated Kneser-Ney estimate whose history is the stem so far. Counts are continuation counts (in how many
documents an expression occurs), and every step backs off to one table of counts shared by both classes. An expression
that either class hardly knows is then about as likely in both and says nothing, while a stem that a class knows
informs the words that it has not seen.

A text's statistics are its toxic minus its ordinary log-likelihood, normalised by length: the mean ratio of its
words, measured from the text's median ratio (which takes out what language and topic alone make of it), and the mean
of what exceeds that median clearly. A logistic fit on rows that the models have not seen turns them into a probability.

The models are fitted on a bounded sample of labelled rows (``per_class`` texts of up to ``max_chars`` characters
for each class), which bounds what is broadcast; scoring covers every whole text.

Nulls: a null text scores as an empty one, whose likelihoods are equal, i.e. by the fit's bias. With labels of one
class only the score is the share of toxic labels. An empty table gives no rows; repeated rows score alike; extra
columns are ignored by ``score`` and kept by ``without_toxic``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, free_name, labelled_sample, shared, small_batches, whole_text

WORDS = re.compile(r"[^\W_]+")
DISCOUNT = 6.0
STEMS = (4, 6, 8)
#: Ratios this far above a text's median are counted by themselves.
CLEAR = (1.5,)
PER_CLASS = 3000
MAX_CHARS = 20_000
REJECT = 0.3
#: Words whose ratio a worker keeps.
CACHE = 300_000


def tokens(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def path(word: str) -> tuple[str, ...]:
    """The stems of a word and, marked as whole, the word."""
    return (*(word[:n] for n in STEMS), word + "$")


class Models:
    """The log-likelihood ratio (toxic to ordinary) of every known word, stem, and unseen continuation of a stem."""

    def __init__(self, texts: list[str], toxic):
        counts = [Counter(), Counter()]
        for t, y in zip(texts, toxic):
            counts[y].update({step for w in set(tokens(t)) for step in self._steps(path(w))})
        totals = [Counter(), Counter()]
        spare = [Counter(), Counter()]
        shared, children = Counter(), Counter()
        for (history, x), n in (counts[0] + counts[1]).items():
            shared[history] += n
            children[history] += 1
        for y in (0, 1):
            for (history, x), n in counts[y].items():
                totals[y][history] += n
                spare[y][history] += min(n, DISCOUNT)
        self.seen, self.unseen = {}, {}
        for history in shared:
            self.unseen[history] = self._ratio([spare[y][history] / totals[y][history] if totals[y][history] else 1.0 for y in (0, 1)])
        for (history, x) in counts[0].keys() | counts[1].keys():
            both = counts[0][history, x] + counts[1][history, x]
            base = (both + 0.5) / (shared[history] + 0.5 * (children[history] + 1))
            p = []
            for y in (0, 1):
                n, all_n = counts[y][history, x], totals[y][history]
                p.append((max(n - DISCOUNT, 0) + spare[y][history] * base) / all_n if all_n else base)
            self.seen[x] = self._ratio(p)
        self.words: dict[str, float] = {}

    @staticmethod
    def _steps(parts: tuple[str, ...]):
        return zip(("", *parts), parts)

    @staticmethod
    def _ratio(p) -> float:
        return float(np.log(p[1]) - np.log(p[0]))

    def ratio(self, word: str) -> float:
        total, history = 0.0, ""
        for x in path(word):
            if x not in self.seen:
                return total + self.unseen.get(history, 0.0)
            if x != history:
                total += self.seen[x]
            history = x
        return total

    def statistics(self, texts: list[str]):
        """One row for each text: mean ratio less the median, means of clear excesses, and the same by the root of
        the length."""
        out = np.zeros((len(texts), 2 * (1 + len(CLEAR))))
        known = self.words
        for i, t in enumerate(texts):
            words = tokens(t)
            if not words:
                continue
            if len(known) > CACHE:
                known.clear()
            for w in set(words).difference(known):
                known[w] = self.ratio(w)
            r = np.fromiter(map(known.__getitem__, words), float, len(words))
            r -= np.median(r)
            own = np.array([r.mean(), *(np.maximum(r - c, 0).mean() for c in CLEAR)])
            out[i] = np.r_[10 * own, np.sqrt(len(words)) * own]
        return out


def logistic(x, y, weight, rounds: int = 50, ridge: float = 1e-2):
    """Weighted logistic regression with a bias, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))])
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = sigmoid(x @ b)
        grad = x.T @ (weight * (p - y)) + ridge * b
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), grad)
        b = b - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return b


class Scorer:
    """Both models and the logistic fit; three of four sample texts fit the models, the others the logistic."""

    def __init__(self, texts: list[str], toxic, share: float):
        self.share = share
        self.models = None
        if len(set(toxic.tolist())) < 2:
            return
        held = np.arange(len(texts)) % 4 == 3
        self.models = Models([t for t, h in zip(texts, held) if not h], toxic[~held])
        x, y = self.models.statistics([t for t, h in zip(texts, held) if h]), toxic[held]
        n1 = max(1, y.sum())
        n0 = max(1, len(y) - y.sum())
        self.fit = logistic(x, y, np.where(y == 1, share / n1, (1 - share) / n0) * len(y))

    def scores(self, texts: list[str]):
        if self.models is None:
            return np.full(len(texts), float(self.share))
        x = self.models.statistics(texts)
        return sigmoid(x @ self.fit[:-1] + self.fit[-1])


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Scorer:
    return Scorer(*labelled_sample(docs, labels, "toxic", lambda c: fold(c, 4) != 2, per_class, max_chars))


def restored(share: float, models: dict | None, fit) -> Scorer:
    """A scorer from plain values."""
    s = Scorer([], np.zeros(0, np.int64), share)
    if models is not None:
        s.models, s.fit = Models.__new__(Models), fit
        vars(s.models).update(models)
    return s


def score_column(scorer: Scorer, spark):
    small_batches(spark)
    model = shared(spark, restored, scorer.share, scorer.models and vars(scorer.models), scorer.models and scorer.fit)

    @F.pandas_udf("double")
    def run(texts):
        import pandas as pd

        return pd.Series(model().scores(texts.tolist()))

    return run(whole_text())


def score(docs: DataFrame, labels: DataFrame, threshold: float = REJECT) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    column = score_column(train(docs, labels), docs.sparkSession)
    return docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), column.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def without_toxic(docs: DataFrame, scorer: Scorer, threshold: float = REJECT) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic."""
    made = free_name(docs, "_toxic")
    return docs.withColumn(made, score_column(scorer, docs.sparkSession)).where(F.col(made) < threshold).drop(made)
