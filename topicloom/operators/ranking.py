"""Top-N per group, arg-max and model selection, each with a full tie-break."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(df: DataFrame, group: list[str] | str, order: list, n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of every group. Spark limits each group per task before the shuffle."""
    keys = [group] if isinstance(group, str) else list(group)
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def top_words(topic_words: DataFrame, n: int = 10, topic: str = "topic_id") -> DataFrame:
    return top_n(topic_words, topic, [F.desc("weight"), F.col("word")], n)


def examples_per_category(df: DataFrame, category: str, order: str, n: int = 2) -> DataFrame:
    """The first ``n`` rows of each category in input order; rows without a category are left out."""
    return top_n(df.where(F.col(category).isNotNull()), category, [F.col(order)], n)


def dominant_topic(theta: Column) -> Column:
    """The position of the largest value; the lowest id wins a tie."""
    return (F.array_position(theta, F.array_max(theta)) - 1).cast("long")


def representative_docs(doc_topics: DataFrame, n: int = 2, doc_id: str = "doc_id", theta: str = "theta") -> DataFrame:
    """The ``n`` documents with the highest probability for every topic, in one pass over ``theta``.

    A probability floor changes nothing: the list is sorted, so the top ``n`` are the same.
    """
    pairs = doc_topics.select(doc_id, F.posexplode(theta).alias("topic_id", "probability"))
    return top_n(pairs, "topic_id", [F.desc("probability"), F.col(doc_id)], n)


def best_k(sweep: DataFrame, group: str = "variant") -> DataFrame:
    """The chosen K per variant: fewest empty topics, then highest coherence, then smallest K.

    Models without empty topics come first by themselves, so one order covers the rule and its
    fallback. A coherence that is not a number never wins.
    """
    scored = sweep.withColumn("_c", F.when(~F.isnan("coherence_c_v"), F.col("coherence_c_v")))
    order = [F.col("empty_topics"), F.desc_nulls_last("_c"), F.col("k")]
    return top_n(scored, group, order, 1).drop("rank", "_c")


def best_k_marker(sweep: DataFrame, group: str = "variant") -> DataFrame:
    """The K with the highest coherence of all, as marked in a chart; may differ from ``best_k``."""
    scored = sweep.withColumn("_c", F.when(~F.isnan("coherence_c_v"), F.col("coherence_c_v")))
    return top_n(scored, group, [F.desc_nulls_last("_c"), F.col("k")], 1).drop("rank", "_c")
