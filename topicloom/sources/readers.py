"""Readers for raw records, cleaned text, features, model tables and landed JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.functions.text import is_blank, text_or_empty
from topicloom.schema import (
    CLEANED_COLUMNS,
    RAW_SCHEMA,
    require_columns,
    require_language,
    require_settings,
    require_variant,
)


def read_raw_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SCHEMA) -> DataFrame:
    """Raw records from CSV. Texts may hold line breaks, so one record can span lines.

    Columns are matched by name. All files of one call must share one header: Spark reads the first one and raises on a file whose
    header differs, so values never land under a wrong name. Files of another layout are another call, joined by
    ``unionByName``. A missing path raises when Spark resolves it.
    """
    header = spark.read.csv(path, header=True, multiLine=True, escape='"').limit(0)
    require_columns(header, ["description"], "raw records")
    types = {f.name: f.dataType for f in schema}
    by_name = T.StructType([T.StructField(c, types.get(c, T.StringType())) for c in header.columns])
    rows = spark.read.csv(path, schema=by_name, header=True, multiLine=True, escape='"', enforceSchema=False)
    return keep_text(rows.select(*[c for c in header.columns if c in types]))


def keep_text(df: DataFrame, text: str = "description") -> DataFrame:
    """Require the text column and turn its nulls into empty text."""
    return require_columns(df, [text], "raw records").withColumn(text, text_or_empty(F.col(text)))


def raw_columns(df: DataFrame, id_column: str = "service_request_id", keep_id: bool = True) -> DataFrame:
    """The identifier (when there is one) and the text; the other columns are never read."""
    wanted = [id_column] if keep_id and id_column in df.columns else []
    return keep_text(df).select(*wanted, "description")


def read_cleaned(spark: SparkSession, path: str) -> DataFrame:
    return cleaned_table(spark.read.parquet(path))


def cleaned_table(df: DataFrame) -> DataFrame:
    require_columns(df, CLEANED_COLUMNS, "cleaned records")
    return df.withColumns({c: text_or_empty(F.col(c)) for c in CLEANED_COLUMNS})


def corpus_for(
    cleaned: DataFrame, variant: str, id_column: str = "service_request_id", keep_id: bool = True
) -> DataFrame:
    """The id and one cleaned text (``strong`` or ``light``), without blank rows."""
    if variant not in ("strong", "light"):
        raise ValueError(f"corpus variant must be 'strong' or 'light', not {variant!r}")
    column = f"{variant}_text"
    require_columns(cleaned, [column], "cleaned records")
    wanted = [id_column] if keep_id and id_column in cleaned.columns else []
    return cleaned.withColumn(column, text_or_empty(F.col(column))).select(*wanted, column).where(
        ~is_blank(F.col(column))
    )


def read_features(spark: SparkSession, path: str, settings: dict | None = None) -> DataFrame:
    """The feature table ``(doc_id, term, tf, tfidf)``; settings, when given, must be complete."""
    if settings is not None:
        require_settings(settings)
    return require_columns(spark.read.parquet(path), ["doc_id", "term", "tf", "tfidf"], "features")


def alignment(bow: DataFrame, tfidf: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Documents in one feature table but not in the other; zero means aligned."""
    left = bow.select(id_column).distinct().withColumn("in_bow", F.lit(1))
    right = tfidf.select(id_column).distinct().withColumn("in_tfidf", F.lit(1))
    return left.join(right, id_column, "full_outer").agg(
        F.count("in_bow").alias("bow_docs"),
        F.count("in_tfidf").alias("tfidf_docs"),
        F.count_if(F.col("in_tfidf").isNull()).alias("only_bow"),
        F.count_if(F.col("in_bow").isNull()).alias("only_tfidf"),
    )


def assert_aligned(bow: DataFrame, tfidf: DataFrame, id_column: str = "doc_id") -> None:
    row = alignment(bow, tfidf, id_column).first()
    if row["only_bow"] or row["only_tfidf"]:
        raise ValueError(
            f"feature tables differ: {row['only_bow']} documents only in the counts, "
            f"{row['only_tfidf']} only in the weights"
        )


def read_model_table(spark: SparkSession, path: str, variant: str | None = None) -> DataFrame:
    """A topic, document-topic, info or sweep table; the variant is a partition of it."""
    table = spark.read.parquet(path)
    if variant is None:
        return table
    require_columns(table, ["variant"], "model table")
    return table.where(F.col("variant") == require_variant(variant))


def read_labelled_table(spark: SparkSession, path: str, language: str, variant: str | None = None) -> DataFrame:
    """A labelled table for one language, pruned to its partition."""
    table = require_columns(spark.read.parquet(path), ["language"], "labelled table")
    table = table.where(F.col("language") == require_language(language))
    if variant is not None:
        table = table.where(F.col("variant") == require_variant(variant))
    return table


def language_suffix(language: str | None) -> str:
    return "_en" if language == "en" else ""


def read_landed_json(spark: SparkSession, path: str, record: T.StructType = RAW_SCHEMA) -> DataFrame:
    """Landed service responses: a JSON list of records, or an object with a list in some field.

    Each file is one response. A list is read as it is; of an object the first field that
    holds a list gives the rows; anything else gives none.
    """
    rows_type = T.ArrayType(record)
    payload = spark.read.text(path, wholetext=True).select(F.trim("value").alias("body"))
    fields = F.from_json(F.col("body"), "map<string,string>")
    first_list = F.get(F.filter(F.map_values(fields), lambda v: v.startswith("[")), F.lit(0))
    body = F.when(F.col("body").startswith("["), F.col("body")).when(F.col("body").startswith("{"), first_list)
    rows = payload.select(F.from_json(body, rows_type).alias("rows"))
    return rows.select(F.explode_outer("rows").alias("r")).where("r is not null").select("r.*")
