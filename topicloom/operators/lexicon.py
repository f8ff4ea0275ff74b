"""Lemmas and tags from a lexicon table, stop words, vocabulary filters on token sequences."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.operators.heavy import heavy_join


def positioned(docs: DataFrame, tokens: Column, doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, pos, token)`` in text order."""
    return docs.select(doc_id, F.posexplode_outer(tokens).alias("pos", "token")).where("token is not null")


def recollect(tokens: DataFrame, column: str = "token", doc_id: str = "doc_id") -> DataFrame:
    """Token lists in position order; one document's own text bounds each list."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", F.col(column).alias("t"))))
    return tokens.groupBy(doc_id).agg(F.transform(ordered, lambda s: s["t"]).alias("tokens"))


def lemmatise(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Adds ``lemma`` from ``(token, lemma)``; a token without an entry is its own lemma.

    The rows of a frequent token are dealt over several tasks.
    """
    found = lexicon.select("token", F.col("lemma").alias("_lemma"))
    return heavy_join(tokens, found, ["token"], how="left").withColumn("lemma", F.coalesce("_lemma", "token")).drop("_lemma")


def tag(tokens: DataFrame, lexicon: DataFrame, default: str = "X") -> DataFrame:
    """Adds ``pos_tag`` from ``(token, pos_tag)``."""
    found = lexicon.select("token", F.col("pos_tag").alias("_tag"))
    return tokens.join(found, "token", "left").withColumn("pos_tag", F.coalesce("_tag", F.lit(default))).drop("_tag")


def strong_lemmas(tokens: DataFrame, lexicon: DataFrame, stopwords: Iterable[str], lowercase: bool = True) -> DataFrame:
    """The second half of strong cleaning with a lexicon: lemma, lower case, stop words, short words."""
    lemmas = lemmatise(tokens, lexicon)
    if lowercase:
        lemmas = lemmas.withColumn("lemma", F.lower("lemma"))
    return lemmas.where((F.length("lemma") >= 3) & ~F.col("lemma").isin(list(stopwords)))


def without_stopwords(tokens: DataFrame, stopwords: Iterable[str]) -> DataFrame:
    return tokens.where(~F.col("token").isin(list(stopwords)))


def in_vocabulary(tokens: DataFrame, vocabulary: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Tokens that are vocabulary terms, repeats kept, renumbered within their document."""
    weight = next((c for c in ("cf", "df") if c in vocabulary.columns), None)  # else the tokens are counted
    terms = vocabulary.select(F.col("term").alias("token"), *[F.col(c).cast("long").alias("_weight") for c in [weight] if c])
    kept = heavy_join(tokens, terms, ["token"], "_weight" if weight else None, "left_semi", hashed=True)
    order = Window.partitionBy(doc_id).orderBy("pos")
    return kept.select(doc_id, (F.row_number().over(order) - 1).alias("pos"), "token")


def token_counts(tokens: DataFrame) -> DataFrame:
    """``(token, n)``. Tags are looked up once per distinct token, so a frequent one is a single row of the join."""
    return tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def _rows(tagged: DataFrame) -> Column:
    """How many tokens the rows of a group stand for: their ``n``, or one each without it."""
    return F.sum("n") if "n" in tagged.columns else F.count(F.lit(1))


def tag_distribution(tagged: DataFrame) -> DataFrame:
    """Count and percent (two decimals) per tag, of tagged tokens or tagged token counts."""
    per_tag = tagged.groupBy("pos_tag").agg(_rows(tagged).alias("n"))
    total = per_tag.agg(F.sum("n").alias("t")).scalar()
    return per_tag.withColumn("percentage", F.round(F.col("n") / total * 100, 2))


def top_tokens_with_tag(tagged: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` most frequent tokens with their most frequent tag (first in tag order on ties)."""
    per_pair = tagged.groupBy("token", "pos_tag").agg(_rows(tagged).alias("n"))
    top = Window.partitionBy("token").orderBy(F.desc("n"), "pos_tag")
    ranked = per_pair.withColumn("r", F.row_number().over(top))
    return (
        ranked.groupBy("token")
        .agg(
            F.sum("n").alias("freq"),
            F.coalesce(F.max(F.when(F.col("r") == 1, F.col("pos_tag"))), F.lit("NA")).alias("dominant_pos"),
        )
        .orderBy(F.desc("freq"), "token")
        .limit(k)
    )
