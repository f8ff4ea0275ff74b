"""Toxicity by class-conditional Kneser-Ney models.

Two models of how words are spelt, one of toxic and one of ordinary texts. A word's log-likelihoods under both are compared, and
a text's value is the sum of what the toxic one is ahead by, divided by the number of words. A lead counts from ``margin`` on: smaller leads, and all those
of the ordinary model, come from the languages and topics that the classes happen to hold, and would hide a few insults in a long text.
A logistic curve turns the value into a score. Both models are built alike.
A word counts as often as there are different words that it follows in the class (the continuation count, so that copied
texts count once). Within a word, each letter is predicted from up to ``order - 1`` letters before it, with absolute discounting: what
is taken from the counts of a context, at most ``discount`` from each, is passed on to the next shorter context as its
counts. The last back-off is shared by both classes, so an expression that neither knows says nothing. Spelling generalises
to words that the sample does not hold.

The models are fitted on a documented sample: the ``max_docs`` labelled training documents of each class with the smallest hash of the
id, as many of one class as of the other. So the sample, the letter groups counted from it and what is sent to the tasks are
bounded, however large the input is. Counting runs on Spark. The curve is fitted on a part of the sample that the models had not seen
(fold ``calibration_fold``), weighted back to the classes' true shares.

Only texts enter a score. Words are runs of letters, digits and underscores of the lower-cased text.

Defined cases: a null or empty text gets the score of value zero. A document is toxic if any of its label
rows says 1; null labels are ignored. If a class has no training document, every score is the share of toxic rows (0 without rows).
Repeated rows and null ids are scored like others; extra columns stay.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.common import add_columns, held_out, require, sample_by_hash, text_or_empty
from topicloom.session import cut_lineage

WORD = re.compile(r"\w+")
BEGIN, END = "\x02", "\x03"
_BATCH_WORDS = 400_000
_KNOWN = 300_000


@dataclass(frozen=True)
class Settings:
    folds: int = 4
    held_out_fold: int = 2
    calibration_fold: int = 3
    max_docs: int = 4_000
    order: int = 4
    discount: float = 0.75
    margin: float = 3.0
    threshold: float = 0.3


class Spelling:
    """A Kneser-Ney model of one class; ``counts`` maps groups of up to ``order`` letters, the last one predicted, to counts."""

    def __init__(self, counts: dict[str, float], order: int, discount: float):
        self.discount = discount
        self.levels: list[dict[str, float]] = [defaultdict(float) for _ in range(order)]
        for group, n in counts.items():
            self.levels[len(group) - 1][group] += n
        for k in range(order - 1, 0, -1):
            for group, n in self.levels[k].items():
                self.levels[k - 1][group[1:]] += min(n, discount)
        self.total: dict[str, float] = defaultdict(float)
        self.passed: dict[str, float] = defaultdict(float)
        for level in self.levels:
            for group, n in level.items():
                self.total[group[:-1]] += n
                self.passed[group[:-1]] += min(n, discount)

    def probability(self, group: str, shared: float) -> float:
        """The probability of the last letter after the others; ``shared`` is that of the last back-off."""
        p = shared
        for k in range(len(group)):
            part = group[len(group) - 1 - k :]
            total = self.total.get(part[:-1])
            if total:
                p = max(self.levels[k].get(part, 0.0) - self.discount, 0.0) / total + self.passed[part[:-1]] / total * p
        return p


class Ratios(dict):
    """The values of words seen before; a new word is spelt out on demand."""

    def __init__(self, toxic: dict[str, float], plain: dict[str, float], settings: Settings):
        super().__init__()
        order, discount = settings.order, settings.discount
        self.order, self.margin = order, settings.margin
        self.models = Spelling(toxic, order, discount), Spelling(plain, order, discount)
        self.shared: dict[str, float] = defaultdict(float)
        for model in self.models:
            for letter, n in model.levels[0].items():
                self.shared[letter] += min(n, discount)
        self.size = sum(self.shared.values()) + len(self.shared) + 1
        self.groups: dict[str, float] = {}

    def group(self, letters: str) -> float:
        value = self.groups.get(letters)
        if value is None:
            if len(self.groups) >= _KNOWN:
                self.groups.clear()
            shared = (self.shared.get(letters[-1], 0.0) + 1) / self.size
            toxic, plain = (m.probability(letters, shared) for m in self.models)
            value = self.groups[letters] = math.log(toxic / plain)
        return value

    def __missing__(self, word: str) -> float:
        value = max(0.0, sum(map(self.group, letter_groups(word, self.order))) - self.margin)
        if len(word) < 64:  # longer ones hardly come again
            if len(self) >= _KNOWN:
                self.clear()
            self[word] = value
        return value

    def value(self, text: str) -> float:
        """The toxic model's leads, summed over the words and divided by their number."""
        words = WORD.findall(text.lower())
        return math.fsum(map(self.__getitem__, words)) / len(words) if words else 0.0


def letter_groups(word: str, order: int) -> list[str]:
    marked = BEGIN + word + END
    return [marked[max(0, i - order + 1) : i + 1] for i in range(1, len(marked))]


def _word_pairs(train: DataFrame) -> DataFrame:
    """``(toxic, v, w)``: each word ``w`` that follows ``v`` in a class, once; a text starts with an empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(pairs: set) -> pa.RecordBatch:
            columns = [pa.array([p[i] for p in pairs], kind) for i, kind in enumerate((pa.int32(), pa.string(), pa.string()))]
            return pa.RecordBatch.from_arrays(columns, ["toxic", "v", "w"])

        pairs: set = set()
        for batch in batches:
            for toxic, text in zip(batch.column("toxic").to_pylist(), batch.column("text"), strict=True):
                words = WORD.findall(text.as_py().lower())
                pairs.update(zip(repeat(toxic), ["", *words], words))
                if len(pairs) >= _BATCH_WORDS:
                    yield rows(pairs)
                    pairs.clear()
        yield rows(pairs)

    return train.select("toxic", "text").mapInArrow(run, "toxic int, v string, w string").distinct()


def fit(train: DataFrame, settings: Settings) -> Ratios | None:
    """Both classes' models; None if one has no words. The driver gets the letter groups of the sample."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[tuple[int, str], float] = defaultdict(float)
        for batch in batches:
            for toxic, word, n in zip(*(batch.column(c).to_pylist() for c in ("toxic", "w", "n")), strict=True):
                for group in letter_groups(word, settings.order):
                    counts[toxic, group] += n
        columns = [pa.array([k[0] for k in counts], pa.int32()), pa.array([k[1] for k in counts], pa.string())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(counts.values()), pa.float64())], ["toxic", "letters", "n"])

    follows = _word_pairs(train).groupBy("toxic", "w").agg(F.count(F.lit(1)).alias("n"))
    groups = follows.mapInArrow(spell, "toxic int, letters string, n double").groupBy("toxic", "letters").agg(F.sum("n").alias("n"))
    found: tuple[dict, dict] = {}, {}
    for row in groups.collect():
        found[row["toxic"]][row["letters"]] = row["n"]
    return Ratios(found[1], found[0], settings) if found[0] and found[1] else None


@dataclass
class Model:
    ratios: Ratios | None
    slope: float
    base: float

    def score(self, text: str) -> float:
        x = self.base + (self.slope * self.ratios.value(text) if self.ratios is not None else 0.0)
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, x))))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and base of a weighted logistic curve by Newton's method with a slight pull to zero."""
    scale = np.abs(x).mean() or 1.0
    design = np.stack([x / scale, np.ones(len(x))], axis=1)
    beta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        slope = design.T @ (weight * (y - p)) - np.array([1e-2, 0]) * beta
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + np.diag([1e-2, 1e-9])
        step = np.linalg.solve(curve, slope)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0] / scale), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit the models and the curve on labelled documents outside the held-out fold."""
    s = settings
    known = require(labels, "doc_id", "toxic").where("doc_id is not null and toxic is not null")
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out("doc_id", s.folds, s.held_out_fold))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect() if r["toxic"] in (0, 1)}
    n_toxic, n_plain = counts.get(1, 0), counts.get(0, 0)
    share = n_toxic / (n_toxic + n_plain) if n_toxic + n_plain else 0.0
    prior = math.log(share / (1 - share)) if 0 < share < 1 else (-700.0 if share == 0 else 700.0)
    taken = {1: min(n_toxic, s.max_docs), 0: min(n_plain, s.max_docs)}  # each class by its own bound
    if not min(taken.values()):
        return Model(None, 0.0, prior)
    sample = sample_by_hash(known.where("toxic = 1"), taken[1], "doc_id").unionByName(sample_by_hash(known.where("toxic = 0"), taken[0], "doc_id"))
    sample = cut_lineage(sample)  # 2 * max_docs rows at most
    texts = require(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text")).join(F.broadcast(sample), "doc_id")
    texts = cut_lineage(texts.withColumn("late", held_out("doc_id", s.folds, s.calibration_fold)))
    early = fit(texts.where("not late"), s)
    final = fit(texts, s)
    if early is None or final is None:
        return Model(None, 0.0, prior)

    def values(column: pa.Array) -> list[pa.Array]:
        return [pa.array([early.value(t) for t in column.to_pylist()], pa.float64())]

    late = add_columns(texts.where("late"), "text", [T.StructField("value", T.DoubleType())], values).select("value", "toxic").collect()
    x, y = np.array([r["value"] for r in late]), np.array([r["toxic"] for r in late], float)
    if len(set(y)) < 2:
        return Model(final, 0.0, prior)
    weight = np.where(y == 1, n_toxic / taken[1], n_plain / taken[0])
    slope, base = _logistic(x, y, weight / weight.mean())
    return Model(final, slope, base)


def score(docs: DataFrame, model: Model, settings: Settings = Settings()) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 from the threshold on) added."""

    def compute(texts: pa.Array) -> list[pa.Array]:
        found = [model.score(t or "") for t in texts.to_pylist()]
        return [pa.array(found, pa.float64()), pa.array([int(p >= settings.threshold) for p in found], pa.int32())]

    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return add_columns(require(docs, "text"), "text", fields, compute)
