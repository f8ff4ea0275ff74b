"""Data-quality and corpus profiles. Each is one aggregation with map-side partial results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import is_blank, words
from topicloom.operators.features import count_rows


def distinct_categories(df: DataFrame, column: str) -> DataFrame:
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    return values.withColumn("n_categories", count_rows(values)).orderBy(column)


def duplicate_id_rows(df: DataFrame, id_column: str) -> DataFrame:
    """How many rows carry an id that occurs more than once."""
    per_id = df.groupBy(id_column).agg(F.count(F.lit(1)).alias("n"))
    return per_id.agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicate_rows"),
        F.count_if(F.col("n") > 1).alias("duplicated_ids"),
    )


def empty_text_report(df: DataFrame, text: str) -> DataFrame:
    empty = F.count_if(is_blank(F.col(text)))
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        empty.alias("empty_rows"),
        (empty / F.count(F.lit(1)) * 100).alias("empty_percent"),
    )


def quality_counts(df: DataFrame, strong: str = "strong_text", light: str = "light_text") -> DataFrame:
    """Nulls, blanks, literal ``nan`` per text and rows blank in both, in one pass."""
    def literal_nan(c: str) -> Column:
        return F.count_if(F.lower(F.coalesce(F.col(c), F.lit("nan"))) == "nan")

    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col(strong).isNull()).alias("strong_nulls"),
        F.count_if(F.col(light).isNull()).alias("light_nulls"),
        F.count_if(is_blank(F.col(strong))).alias("strong_blank"),
        F.count_if(is_blank(F.col(light))).alias("light_blank"),
        F.count_if(is_blank(F.col(strong)) & is_blank(F.col(light))).alias("both_blank"),
        literal_nan(strong).alias("strong_nan"),
        literal_nan(light).alias("light_nan"),
    )


def blank_in_both(df: DataFrame, strong: str = "strong_text", light: str = "light_text") -> DataFrame:
    return df.where(is_blank(F.col(strong)) & is_blank(F.col(light)))


def assert_quality(df: DataFrame, strong: str = "strong_text", light: str = "light_text") -> None:
    """Fail fast on nulls, literal ``nan`` texts and rows that are blank in both texts."""
    row = quality_counts(df, strong, light).first()
    bad = {k: row[k] for k in ("strong_nulls", "light_nulls", "strong_nan", "light_nan", "both_blank") if row[k]}
    if bad:
        raise ValueError(f"cleaned text fails its checks: {bad}")


def describe_integers(df: DataFrame, value: Column, name: str) -> DataFrame:
    """Count, mean, deviation, minimum, quartiles and maximum of an integer measure.

    Values are counted first, so the exact percentiles see one row per distinct value.
    """
    counted = df.select(value.alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    quart = F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    n, total = F.sum("n"), F.sum(F.col("v") * F.col("n"))
    square = F.sum(F.col("v").cast("double") * F.col("v") * F.col("n"))
    return counted.agg(
        n.alias("n"), (total / n).alias("mean"),
        F.sqrt((square - total.cast("double") * total / n) / (n - 1)).alias("std"),
        F.min("v").alias("min"), quart.alias("q"), F.max("v").alias("max"),
    ).select(
        F.lit(name).alias("measure"), "n", "mean", "std", "min",
        F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max",
    )


def length_profile(df: DataFrame, strong: str = "strong_text", light: str = "light_text") -> DataFrame:
    """Word counts of the strong text and character lengths of the light text."""
    return describe_integers(df, F.size(words(F.col(strong))).cast("long"), "strong_tokens").unionByName(
        describe_integers(df, F.length(F.col(light)).cast("long"), "light_chars")
    )


def term_frequency(counts: DataFrame, k: int = 30) -> DataFrame:
    return counts.groupBy("term").agg(F.sum("tf").alias("freq")).orderBy(F.desc("freq"), "term").limit(k)


def document_frequency(counts: DataFrame, n_docs: Column) -> DataFrame:
    """Documents per term and their share of all documents."""
    return counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("df_ratio", F.col("df") / n_docs)


def document_frequency_range(counts: DataFrame, n_docs: Column) -> DataFrame:
    return document_frequency(counts, n_docs).agg(
        F.min("df_ratio").alias("min_ratio"), F.max("df_ratio").alias("max_ratio")
    )


def terms_per_document(counts: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    per_doc = counts.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n"))
    return per_doc.agg(F.min("n").alias("min_terms"), F.avg("n").alias("mean_terms"), F.max("n").alias("max_terms"))


def nonzeros_per_document(features: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Mean non-zero cells per document in the counts and in the weights; they should agree."""
    per_doc = features.groupBy(doc_id).agg(
        F.count_if(F.col("tf") != 0).alias("bow"), F.count_if(F.col("tfidf") != 0).alias("tfidf")
    )
    n = F.count(F.lit(1))
    return per_doc.agg((F.sum("bow") / n).alias("bow_nnz"), (F.sum("tfidf") / n).alias("tfidf_nnz"))


def mean_weight(features: DataFrame, n_docs: Column, k: int = 20) -> DataFrame:
    """Mean TF-IDF over all documents, zero cells included; the ``k`` largest."""
    return (
        features.groupBy("term").agg((F.sum("tfidf") / n_docs).alias("mean_tfidf"))
        .orderBy(F.desc("mean_tfidf"), "term").limit(k)
    )


def sample_texts(df: DataFrame, id_column: str, columns: list[str], n: int = 10, seed: int = 42) -> DataFrame:
    """A repeatable random sample: the ``n`` rows whose seeded hash of the id is smallest."""
    return df.orderBy(F.xxhash64(F.col(id_column), F.lit(seed)), id_column).select(id_column, *columns).limit(n)
