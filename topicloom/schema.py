"""Schemas and the column checks that every reader applies."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# The columns of raw records.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("service_request_id", T.StringType()),
        T.StructField("service_name", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("requested_datetime", T.StringType()),
        T.StructField("status", T.StringType()),
    ]
)

CLEANED_COLUMNS = ("description", "strong_text", "light_text")

# The settings a vectorised corpus has to carry.
SETTING_KEYS = ("lowercase", "token_pattern", "ngram_range", "min_df", "max_df")

# Names of the weightings and of the label languages, and the topic of outliers.
LDA_VARIANTS = ("bow", "tfidf")
LANGUAGES = ("de", "en")
OUTLIER = -1


def require_columns(df: DataFrame, required: Iterable[str], what: str = "table") -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}; it has {df.columns}")
    return df


def require_settings(settings: dict) -> dict:
    missing = sorted(set(SETTING_KEYS) - set(settings))
    if missing:
        raise ValueError(f"vectoriser settings lack {missing}")
    return settings


def require_variant(variant: str) -> str:
    if variant not in LDA_VARIANTS:
        raise ValueError(f"variant must be one of {LDA_VARIANTS}, not {variant!r}")
    return variant


def require_language(language: str) -> str:
    if language not in LANGUAGES:
        raise ValueError(f"language must be one of {LANGUAGES}, not {language!r}")
    return language
