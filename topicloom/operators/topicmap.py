"""Topics on a plane by the distances of their word distributions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.session import cut_lineage

_FAR = math.log(2)  # the distance of topics that share no word


def distributions(topic_terms: DataFrame, topic: str = "topic_id", term: str = "term", weight: str = "weight") -> DataFrame:
    """``(topic, term, p)``: weights above zero, scaled to one per topic. Null topics are left out, and topics without such a weight."""
    kept = topic_terms.where(F.col(topic).isNotNull() & (F.col(weight) > 0)).groupBy(topic, term).agg(F.sum(weight).alias("_w"))
    return kept.join(kept.groupBy(topic).agg(F.sum("_w").alias("_all")), topic).select(F.col(topic).alias("topic"), F.col(term).alias("term"), (F.col("_w") / F.col("_all")).alias("p"))


def _distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two topics from the words both hold: every other word adds its share of ``ln 2``."""
    both = p * F.ln(p / (p + q)) + q * F.ln(q / (p + q))
    return F.greatest(F.lit(_FAR) + F.sum(both) / 2, F.lit(0.0))


def js_distances(words: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """``(topic_a, topic_b, distance)`` of topics that share a word, from :func:`distributions`; all others are ``ln 2`` apart.

    Pairs meet on the word, whose rows are bounded by the number of topics. ``others`` takes the place of the right side; without it each pair comes once.
    """
    a, b = words.select("term", F.col("topic").alias("topic_a"), F.col("p").alias("_p")), (words if others is None else others).select("term", F.col("topic").alias("topic_b"), F.col("p").alias("_q"))
    met = a.join(b, "term")
    return (met.where("topic_a < topic_b") if others is None else met).groupBy("topic_a", "topic_b").agg(_distance(F.col("_p"), F.col("_q")).alias("distance"))


def map_topics(topic_terms: DataFrame, topic: str = "topic_id", term: str = "term", weight: str = "weight", dims: int = 2, landmarks: int = 500) -> DataFrame:
    """``(topic, x, y)`` (more axes: ``x3`` …): principal coordinates of the Jensen-Shannon distances.

    The ``landmarks`` topics with the largest summed weights (ties: smallest id) span the axes: their distances alone, at most ``landmarks`` squared numbers, meet the
    driver. Every topic is then placed by its distances to them, which for the landmarks themselves gives their own coordinates; so with
    no more topics than landmarks this is the plain method. The sign of an axis makes its largest landmark coordinate positive. Axes beyond those that the distances span are zero.
    One row per topic with a weight above zero; an empty table gives no rows.
    """
    words = cut_lineage(distributions(topic_terms, topic, term, weight))
    total = topic_terms.where(F.col(topic).isNotNull() & (F.col(weight) > 0)).groupBy(F.col(topic).alias("topic")).agg(F.sum(weight).alias("_all"))
    chosen = [r["topic"] for r in total.orderBy(F.desc("_all"), "topic").limit(landmarks).collect()]
    marks = F.broadcast(topic_terms.sparkSession.createDataFrame([(t,) for t in chosen], f"topic {words.schema['topic'].dataType.simpleString()}"))
    near = cut_lineage(js_distances(words, words.join(marks, "topic", "left_semi")))
    place = {t: i for i, t in enumerate(sorted(chosen))}
    square = np.full((len(place), len(place)), _FAR**2)
    for r in near.join(marks.toDF("topic_a"), "topic_a", "left_semi").collect():
        square[place[r["topic_a"]], place[r["topic_b"]]] = r["distance"] ** 2
    np.fill_diagonal(square, 0.0)
    loads, shift = _axes(square, dims)
    # The place of a topic that shares no word with any landmark; shared words move it from there.
    start = -0.5 * (loads * (_FAR**2 - shift)[:, None]).sum(axis=0) if len(place) else np.zeros(dims)
    rows = [(t, *map(float, loads[i])) for t, i in place.items()]
    kind = words.schema["topic"].dataType.simpleString()
    axes = ["x", "y", *(f"x{i}" for i in range(3, dims + 1))][:dims]
    loaded = F.broadcast(topic_terms.sparkSession.createDataFrame(rows, f"topic_b {kind}, " + ", ".join(f"_l{i} double" for i in range(dims))))
    off = F.when(F.col("topic_a") == F.col("topic_b"), F.lit(0.0)).otherwise(F.col("distance") * F.col("distance")) - F.lit(_FAR**2)
    moved = near.join(loaded, "topic_b").groupBy(F.col("topic_a").alias("topic")).agg(*[F.sum(F.col(f"_l{i}") * off * -0.5).alias(f"_m{i}") for i in range(dims)])
    placed = words.select("topic").distinct().join(moved, "topic", "left")
    return placed.select(F.col("topic").alias(topic), *[(F.lit(float(start[i])) + F.coalesce(f"_m{i}", F.lit(0.0))).alias(axes[i]) for i in range(dims)])


def _axes(square: np.ndarray, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """Per landmark its loading on each axis, and its mean squared distance."""
    n = len(square)
    loads, shift = np.zeros((n, dims)), square.mean(axis=0) if n else np.zeros(0)
    if n:
        centred = -0.5 * (square - shift - shift[:, None] + shift.mean())
        values, vectors = np.linalg.eigh(centred)
        for i, k in enumerate(np.argsort(-values)[:dims]):
            if values[k] > 1e-12:
                v = vectors[:, k]
                loads[:, i] = v * np.sign(v[np.argmax(np.abs(v))]) / np.sqrt(values[k])
    return loads, shift
