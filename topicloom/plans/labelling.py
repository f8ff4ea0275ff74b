"""Topic labels and translations around a plugged-in text function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions import labels as lb
from topicloom.functions.text import fill_template, is_blank, numbered_list
from topicloom.operators import topics as tp
from topicloom.operators.features import dense_ids
from topicloom.operators.ranking import top_n
from topicloom.schema import OUTLIER
from topicloom.session import cut_lineage

# Sizes of a prompt.
N_KEYWORDS, N_DOCS, N_CONTEXT_DOCS, WORDS_PER_BATCH = 10, 6, 3, 20
LDA_DOC_CHARS, CLUSTER_DOC_CHARS, CONTEXT_DOC_CHARS = 200, 400, 150
KEYWORDS_MARKER, DOCUMENTS_MARKER, TEXT_MARKER = "[KEYWORDS]", "[DOCUMENTS]", "[TEXT]"

LABEL_TEMPLATE = (
    "Name the topic of these citizen reports in three to five German words.\n"
    "Use only what the keywords and the examples say.\n\n"
    "Keywords: [KEYWORDS]\n\nExamples:\n[DOCUMENTS]\n\nAnswer with the name only:"
)
TRANSLATE_TEMPLATE = "Translate into English and keep every comma.\n\nGerman: [TEXT]\n\nEnglish:"
TRANSLATE_IN_CONTEXT_TEMPLATE = (
    "Translate the keywords into English, same number and order, separated by commas.\n\n"
    "Keywords: [TEXT]\n\nReports that use them:\n[DOCUMENTS]\n\nEnglish keywords:"
)

TextFunction = Callable[[list[str]], list[str]]


def keyword_lists(topic_words: DataFrame, n: int = N_KEYWORDS, topic: str = "topic_id") -> DataFrame:
    best = top_n(topic_words, topic, [F.desc("weight"), F.col("word")], n)
    return best.groupBy(topic).agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("_w")).select(
        topic, F.col("_w")["word"].alias("keywords")
    )


def example_lists(examples: DataFrame, n: int, topic: str = "topic_id") -> DataFrame:
    """``examples`` has ``(topic, rank, text)``; the first ``n`` texts of each topic in rank order."""
    first = examples.where(F.col("rank") <= n)
    return first.groupBy(topic).agg(F.array_sort(F.collect_list(F.struct("rank", "text"))).alias("_d")).select(
        topic, F.col("_d")["text"].alias("docs")
    )


def label_prompts(
    topic_words: DataFrame, examples: DataFrame, doc_chars: int = LDA_DOC_CHARS, template: str = LABEL_TEMPLATE,
    topic: str = "topic_id", n_keywords: int = N_KEYWORDS, n_docs: int = N_DOCS,
) -> DataFrame:
    """One prompt per topic; without examples the first three keywords stand in."""
    both = keyword_lists(topic_words, n_keywords, topic).join(example_lists(examples, n_docs, topic), topic, "left")
    docs = F.coalesce("docs", F.slice("keywords", 1, 3))
    return both.select(
        topic, "keywords",
        fill_template(template, {KEYWORDS_MARKER: F.array_join("keywords", ", "), DOCUMENTS_MARKER: numbered_list(docs, doc_chars)}).alias("prompt"),
    )


def translation_prompts(
    texts: DataFrame, text: Column, docs: Column | None = None, doc_chars: int = CONTEXT_DOC_CHARS, n_docs: int = N_CONTEXT_DOCS
) -> DataFrame:
    """Adds ``prompt``: the text, and up to three example reports when there are any."""
    plain = fill_template(TRANSLATE_TEMPLATE, {TEXT_MARKER: text})
    if docs is None:
        return texts.withColumn("prompt", plain)
    context = fill_template(
        TRANSLATE_IN_CONTEXT_TEMPLATE, {TEXT_MARKER: text, DOCUMENTS_MARKER: numbered_list(F.slice(docs, 1, n_docs), doc_chars)}
    )
    return texts.withColumn("prompt", F.when(F.size(docs) > 0, context).otherwise(plain))


def call_text_function(prompts: DataFrame, fn: TextFunction, prompt: str = "prompt", answer: str = "answer") -> DataFrame:
    """Adds the answer per prompt, and ``failed``: whether the text function gave none for it.

    Only the distinct prompts visit Python, a batch at a time, and their answers are written down, so that no later step of the plan
    asks again. When a batch fails, or its answers do not match its prompts in number, the prompts are asked one by one, so a bad one costs
    only its own answer.
    """

    def ask(texts: list[str]) -> list[str | None]:
        answers = list(fn(texts))
        if len(answers) != len(texts):
            raise ValueError(f"{len(answers)} answers to {len(texts)} prompts")
        return answers

    def ask_one(text: str) -> tuple[str | None, bool]:
        try:
            return ask([text])[0], False
        except Exception:  # counted in the output
            return None, True

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["_prompt"].tolist()
            try:
                found = [(a, False) for a in ask(texts)]
            except Exception:  # which prompt it was shows when each is asked alone
                found = [ask_one(t) for t in texts]
            yield batch.assign(_answer=[a for a, _ in found], _failed=[f for _, f in found])

    asked = prompts.where(F.col(prompt).isNotNull()).select(F.col(prompt).alias("_prompt")).distinct()
    answers = cut_lineage(asked.mapInPandas(run, "_prompt string, _answer string, _failed boolean"))
    renamed = answers.select(F.col("_prompt").alias(prompt), F.col("_answer").alias(answer), F.col("_failed").alias("failed"))
    return prompts.join(renamed, prompt, "left").withColumn("failed", F.coalesce("failed", F.lit(False)))


def apply_labeler(prompts: DataFrame, fn: TextFunction | None = None, topic: str = "topic_id") -> DataFrame:
    """``(topic_id, label)``: the cleaned answer, or the first three keywords without one."""
    fallback = lb.keyword_label(F.col("keywords"))
    if fn is None:
        return prompts.select(F.col(topic).alias("topic_id"), fallback.alias("label"))
    answered = call_text_function(prompts, fn)
    return answered.select(F.col(topic).alias("topic_id"), F.coalesce(lb.clean_label(F.col("answer")), fallback).alias("label"))


def translate_texts(texts: DataFrame, text: str, fn: TextFunction | None, out: str, docs: str | None = None) -> DataFrame:
    """Adds the translation; blank text gives blank text, and no answer keeps the text."""
    if fn is None:
        return texts.withColumn(out, F.when(is_blank(F.col(text)), F.lit("")).otherwise(F.col(text)))
    asked = translation_prompts(texts, F.col(text), F.col(docs) if docs else None)
    asked = asked.withColumn("prompt", F.when(~is_blank(F.col(text)), F.col("prompt")))
    answered = call_text_function(asked, fn, answer="_answer")
    cleaned = lb.clean_translation(lb.clean_label(F.col("_answer")))
    return answered.withColumn(
        out, F.when(is_blank(F.col(text)), F.lit("")).otherwise(F.coalesce(cleaned, F.col(text)))
    ).drop("prompt", "_answer", "failed")


def word_pairs(topic_lists: DataFrame, keywords: str = "keywords", translated: str = "translated", topic: str = "topic_id") -> DataFrame:
    """``(topic_id, word, translation)``; a list of another length keeps the topic's own words."""
    parts = lb.split_words(F.col(translated))
    usable = F.when(F.size(parts) == F.size(keywords), parts).otherwise(F.col(keywords))
    zipped = F.arrays_zip(F.col(keywords).alias("word"), usable.alias("translation"))
    return topic_lists.select(F.col(topic).alias("topic_id"), F.explode(zipped).alias("p")).select("topic_id", "p.word", "p.translation")


def word_batches(topic_words: DataFrame, size: int = WORDS_PER_BATCH) -> DataFrame:
    """``(topic_id, keywords)``: all distinct words in their order, ``size`` to a list; ``topic_id`` numbers the lists."""
    numbered = dense_ids(topic_words.select("word").distinct(), ["word"], "_at")
    lists = numbered.groupBy(F.floor(F.col("_at") / size).cast("long").alias("topic_id")).agg(F.array_sort(F.collect_list("word")).alias("keywords"))
    return lists.withColumn("_text", F.array_join("keywords", ", "))


def translate_topic_words(
    topic_words: DataFrame, fn: TextFunction | None, examples: DataFrame | None = None, topic: str = "topic_id", n_words: int | None = None
) -> DataFrame:
    """Words of all topics through one global word map.

    With example reports the map is built topic by topic, from the ``n_words`` heaviest words of each (all of them unless given);
    without, from batches of ``WORDS_PER_BATCH`` distinct words. A list whose translation has another length keeps its own words.
    """
    if examples is None:
        lists = word_batches(topic_words)
    else:
        most = n_words or topic_words.groupBy(topic).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 1
        lists = keyword_lists(topic_words, most, topic).withColumn("_text", F.array_join("keywords", ", "))
        lists = lists.join(example_lists(examples, N_CONTEXT_DOCS, topic), topic, "left").withColumn(
            "docs", F.coalesce("docs", F.array().cast("array<string>"))
        )
    done = translate_texts(lists, "_text", fn, "translated", "docs" if examples is not None else None)
    return tp.translate_words(topic_words, tp.word_translations(word_pairs(done, topic=topic if examples is not None else "topic_id")))


def translate_topic_names(labels: DataFrame, fn: TextFunction | None) -> DataFrame:
    """Labels such as ``3_name`` keep their prefix; only the name is translated."""
    parts = labels.select(
        "topic_id", lb.label_prefix(F.col("label")).alias("_prefix"), lb.label_body(F.col("label")).alias("_body")
    )
    done = translate_texts(parts, "_body", fn, "_out")
    return done.select("topic_id", lb.join_prefix(F.col("_prefix"), F.col("_out")).alias("label"))


def translate_representation(info: DataFrame, fn: TextFunction | None, topic: str = "topic_id") -> DataFrame:
    """Scored words of each topic with translated words; the outlier topic keeps its own."""
    asked = info.withColumn("_text", F.array_join(F.slice(F.col("representation")["word"], 1, N_KEYWORDS), ", "))
    done = translate_texts(asked, "_text", fn, "_translated")
    mapped = lb.reconcile_keywords(F.col("representation"), lb.split_words(F.col("_translated")))
    return done.withColumn(
        "representation", F.when(F.col(topic) == OUTLIER, F.col("representation")).otherwise(mapped)
    ).drop("_text", "_translated")


def labelled_topic_model(
    topic_words: DataFrame, doc_topics: DataFrame, labels: DataFrame, variant: str, language: str
) -> tuple[DataFrame, DataFrame]:
    """Topic words and document topics with names, ready to be written by variant and language."""
    keyed = lambda df: df.withColumns({"variant": F.lit(variant), "language": F.lit(language)})
    return (
        keyed(tp.with_labels(topic_words, labels, "topic_id")),
        keyed(tp.with_labels(doc_topics, labels, "dominant_topic", "dominant_topic_name")),
    )


def labelled_clusters(
    info: DataFrame, assigned: DataFrame, labels: DataFrame, language: str
) -> tuple[DataFrame, DataFrame]:
    """Cluster topic info and document topics with names; a document's missing name stays null."""
    counted = tp.override_names(tp.corrected_counts(info, assigned), labels)
    names = counted.select("topic_id", F.col("name").alias("label"))
    docs = tp.with_labels(assigned, names, "topic_id", default=False)
    return counted.withColumn("language", F.lit(language)), docs.withColumn("language", F.lit(language))


def run_labelling(
    topic_words: DataFrame, doc_topics: DataFrame, examples: DataFrame, variant: str,
    labeler: TextFunction | None = None, translator: TextFunction | None = None, languages: tuple[str, ...] = ("de", "en"),
) -> dict[str, tuple[DataFrame, DataFrame]]:
    """German labels first; English is a translation of them. Works without any model as well."""
    german = apply_labeler(label_prompts(topic_words, examples), labeler)
    out = {}
    if "de" in languages:
        out["de"] = labelled_topic_model(topic_words, doc_topics, german, variant, "de")
    if "en" in languages:
        english = translate_topic_names(german, translator)
        words = translate_topic_words(topic_words, translator, examples)
        out["en"] = labelled_topic_model(words, doc_topics, english, variant, "en")
    return out


def run_cluster_labelling(
    info: DataFrame, assigned: DataFrame, topic_words: DataFrame, examples: DataFrame,
    labeler: TextFunction | None = None, translator: TextFunction | None = None, languages: tuple[str, ...] = ("de", "en"),
) -> dict[str, tuple[DataFrame, DataFrame]]:
    """The same for cluster topics: names carry the topic id as prefix and keep it in English."""
    prompts = label_prompts(topic_words, examples, CLUSTER_DOC_CHARS)
    named = apply_labeler(prompts, labeler).select(
        "topic_id", lb.join_prefix(F.col("topic_id").cast("string"), F.col("label")).alias("label")
    )
    out = {}
    if "de" in languages:
        out["de"] = labelled_clusters(info, assigned, named, "de")
    if "en" in languages:
        english = translate_topic_names(named, translator)
        out["en"] = labelled_clusters(translate_representation(info, translator), assigned, english, "en")
    return out
