import pytest
from pyspark.sql import functions as F

from topicloom.operators import coherence as ch
from topicloom.operators import ctfidf as ct


@pytest.mark.parametrize("sent", [200_000, 1])
def test_token_lists_are_read_once_and_counted_like_a_sentence(spark, monkeypatch, sent):
    monkeypatch.setattr(ch, "SENT_WORDS", sent)
    calls = spark.sparkContext.accumulator(0)

    def told(text):
        calls.add(1)
        return None if text is None else [None if t == "-" else t for t in text.split()]

    texts = ["a b c a", "a x", "b - b", "", None, "a x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").select("doc_id", F.udf(told, "array<string>")("text").alias("tokens"))
    words = spark.createDataFrame([(0, "a"), (0, "b"), (1, "b"), (1, None)], "topic_id int, word string").where("word is not null")
    got = {(r["topic_id"], r["word_a"], r["word_b"]): (r["n"], r["n_windows"]) for r in ch.window_counts(docs, words, 2).collect()}
    # Windows: ab bc ca | ax | b- -b | ax
    assert got == {(0, "a", "a"): (4, 7), (0, "a", "b"): (1, 7), (0, "b", "a"): (1, 7), (0, "b", "b"): (4, 7), (1, "b", "b"): (4, 7)}
    assert sent == 1 or calls.value == len(texts)


def test_words_end_where_no_word_character_follows(spark):
    text = "Straße über_x a1 a ́b éte naïve—co-op x. zz‍y 12 ١٢"
    rows = spark.createDataFrame([(text,)], "t string")
    with_borders = F.regexp_extract_all(F.lower("t"), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))
    assert rows.select(ct.topic_terms(F.col("t"), ngram_range=(1, 1)) == with_borders).first()[0]
