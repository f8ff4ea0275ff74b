"""Clean-up of model-written labels and translations, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from topicloom.functions.text import trim_any

# Prefixes a translation may carry.
TRANSLATION_PREFIX = r"(?i)^(english|translation):"
LABEL_PREFIX = r"(?s)^(-*\d+)_(.*)$"


def clean_label(label: Column) -> Column:
    """Trim, then strip double quotes, then single quotes, then trim again."""
    bare = F.btrim(trim_any(label), F.lit('"'))
    return trim_any(F.btrim(bare, F.lit("'")))


def strip_translation_prefix(text: Column) -> Column:
    return F.when(
        text.rlike(TRANSLATION_PREFIX), trim_any(F.regexp_replace(text, TRANSLATION_PREFIX, ""))
    ).otherwise(text)


def capitalise_phrase(text: Column) -> Column:
    """Upper-case the first letter of a phrase; a comma-separated list is left alone."""
    return F.when(
        ~F.contains(text, F.lit(",")) & (text != ""),
        F.concat(F.upper(F.substring(text, 1, 1)), F.substr(text, F.lit(2))),
    ).otherwise(text)


def clean_translation(text: Column) -> Column:
    return capitalise_phrase(strip_translation_prefix(text))


def split_words(text: Column) -> Column:
    """Split on commas and trim each part."""
    return F.transform(F.split(text, ","), trim_any)


def label_prefix(label: Column) -> Column:
    """The ``id`` of ``id_label``, or null when the label has none."""
    found = F.regexp_extract(label, LABEL_PREFIX, 1)
    return F.when(found != "", found)


def label_body(label: Column) -> Column:
    return F.when(label.rlike(LABEL_PREFIX), F.regexp_extract(label, LABEL_PREFIX, 2)).otherwise(label)


def join_prefix(prefix: Column, body: Column) -> Column:
    return F.when(prefix.isNotNull(), F.concat(prefix, F.lit("_"), body)).otherwise(body)


def default_label(topic_id: Column) -> Column:
    return F.concat(F.lit("Topic "), topic_id.cast("string"))


def keyword_label(keywords: Column, n: int = 3) -> Column:
    return F.array_join(F.slice(keywords, 1, n), " ")


def reconcile_keywords(scored: Column, translated: Column) -> Column:
    """Give each (word, score) its translated word; extra ones are cut, missing ones keep the original."""
    return F.transform(
        scored,
        lambda o, i: F.struct(
            F.coalesce(F.get(translated, i), o["word"]).alias("word"), o["score"].alias("score")
        ),
    )
