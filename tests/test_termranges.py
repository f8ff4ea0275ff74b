import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from topicloom.functions import text as tx
from topicloom.operators import ctfidf as ct
from topicloom.operators import features as ft
from topicloom.operators import lexicon as lx
from topicloom.operators import termranges as tr
from topicloom.session import cut_lineage

WORDS = ["ab", "b", "cc", "dé", "ö", "zz", "a", "abc"]


@pytest.fixture(params=[40, 1 << 20])
def odd_docs(spark, request, monkeypatch):
    """Null ids and classes, ids that come twice, null and empty lists; many chunks and one."""
    monkeypatch.setattr(tr, "CHUNK_WORDS", request.param)
    rng = random.Random(1)
    rows = [
        (rng.choice([None, i, i, i // 2]), rng.choice([None, "x", "y", "z"]), None if rng.random() < 0.05 else rng.choices(WORDS, k=rng.randint(0, 9)))
        for i in range(200)
    ]
    return spark.createDataFrame(rows, "doc_id long, c string, t array<string>").repartition(3)


def plain(df):
    show = lambda x: f"{x:.9g}" if isinstance(x, float) else str(x)
    return sorted(tuple(map(show, r)) for r in df.collect())


def test_vocabulary_and_weights_equal_the_long_form(odd_docs):
    n = odd_docs.count()
    counts = cut_lineage(ft.term_counts(odd_docs, F.col("t")))
    vocabulary = cut_lineage(ft.fit_vocabulary(counts, F.lit(n), 2, 0.3))
    features = cut_lineage(ft.tf_idf(counts, vocabulary, F.lit(n)))
    found = tr.vocabulary(tr.pack(odd_docs, ["doc_id"], F.col("t")), n, 2, 0.3)
    assert plain(found.rows()) == plain(vocabulary)
    assert plain(found.features()) == plain(features.select("doc_id", "term", "tf", "tfidf"))
    assert plain(found.features(term=False)) == plain(features.select("doc_id", "tf", "tfidf"))
    numbered = cut_lineage(ft.numbered_vocabulary(vocabulary))
    assert plain(found.numbered()) == plain(numbered.select("term_id", "term", "df"))
    rows = ft.sparse_rows(features, numbered)
    assert plain(found.sparse_rows().select("doc_id", "terms", "bow")) == plain(rows.select("doc_id", "terms", "bow"))
    want = lx.recollect(lx.in_vocabulary(lx.positioned(odd_docs, tx.ngrams(F.col("t"))), vocabulary))
    bags = lambda df: sorted((str(r[0]), sorted(Counter(r[1]).items())) for r in df.collect())
    assert bags(found.sequences()) == bags(want)


def test_sequences_keep_the_order_of_the_text(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b", "x"]), (2, ["a", "b"]), (3, ["y"])], "doc_id long, t array<string>")
    found = tr.vocabulary(tr.pack(df, ["doc_id"], F.col("t")), 3, 2, 1.0)
    assert {r[0]: r[1] for r in found.sequences().collect()} == {1: ["b", "a", "b", "a b"], 2: ["a", "b", "a b"]}


@pytest.mark.parametrize("k", [1, 5, 500])
def test_largest_mean_weights(odd_docs, k):
    n = odd_docs.count()
    found = tr.vocabulary(tr.pack(odd_docs, ["doc_id"], F.col("t")), n, 2, 0.9)
    want = found.features().groupBy("term").agg((F.sum("tfidf") / n).alias("m")).orderBy(F.desc(F.round("m", 9)), "term").limit(k).collect()
    got = found.mean_weight(k).collect()
    assert [r["mean_tfidf"] for r in got] == pytest.approx([r["m"] for r in want])
    assert sorted(r["term"] for r in got) == sorted(r["term"] for r in want)


def test_rare_terms_with_large_weights_are_found(spark):
    # 80 words of 40 documents have small weights, words of six documents large ones.
    rows = [(i, [f"f{j}" for j in range(80)]) for i in range(40)] + [(100 + i, [f"rare{i // 6:03}"]) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, t array<string>")
    found = tr.vocabulary(tr.pack(df, ["doc_id"], F.col("t"), pairs=False), len(rows), 2, 1.0)
    assert [r["term"] for r in found.mean_weight(1).collect()] == ["rare000"]


@pytest.mark.parametrize("least", [1, 2])
def test_class_terms_equal_the_long_form(odd_docs, least):
    counted = tr.class_terms(tr.pack(odd_docs, ["c"], F.col("t"), whole=False), "c", least)
    assert plain(counted.rows()) == plain(ct.shared_terms(ct.class_counts(odd_docs, "c", tx.ngrams(F.col("t"))), "c", least))


def test_nearest_documents_equal_the_long_form(odd_docs):
    per_doc = cut_lineage(ct.class_counts(odd_docs, "c", tx.ngrams(F.col("t")), per_doc=True))
    weights = cut_lineage(ct.c_tf_idf(per_doc.groupBy("c", "term").agg(F.sum("n").alias("n")), "c", 1))
    want = ct.nearest_documents(per_doc, weights, "c", 1000)
    counted = tr.class_terms(tr.pack(odd_docs, ["doc_id", "c"], F.col("t")), "c", 1, answers=True)
    keep = lambda df: plain(df.select("c", "doc_id", F.round("similarity", 8)))
    assert keep(ct.nearest_in_classes(counted, 1000)) == keep(want)


def test_similarity_of_classes_equals_that_of_weights(odd_docs):
    from topicloom.operators.similarity import topic_similarity

    packed = tr.pack(odd_docs, ["c"], F.col("t"), whole=False)
    weights = cut_lineage(ct.class_weights(odd_docs, "c", F.col("t"), 2))
    got = ct.class_similarity(tr.class_terms(packed, "c", 2))
    assert plain(got) == plain(topic_similarity(weights, "c")) and got.count() == 9
    left, right = (weights.select(F.col("c").alias(f"topic_{s}"), "term", F.col("weight").alias(s)) for s in "ab")
    size = lambda s: F.sqrt(F.sum(F.col(s) * F.col(s)))
    sizes = {r[0]: r[1] for r in left.groupBy("topic_a").agg(size("a")).collect()}
    for r in left.join(right, "term").groupBy("topic_a", "topic_b").agg(F.sum(F.col("a") * F.col("b")).alias("dot")).collect():
        there = got.where((F.col("topic_a") == r["topic_a"]) & (F.col("topic_b") == r["topic_b"])).first()
        assert there["similarity"] == pytest.approx(r["dot"] / sizes[r["topic_a"]] / sizes[r["topic_b"]])


def test_rows_of_one_topic_and_term_meet_in_both_orders(spark):
    from topicloom.operators.similarity import topic_similarity

    rows = [(1, "x", 1.0), (1, "x", 2.0), (2, "x", 3.0), (2, "y", 4.0), (None, "x", 1.0), (3, None, 1.0), (4, "y", 0.0)]
    got = topic_similarity(spark.createDataFrame(rows, "topic_id long, term string, weight double"))
    assert {(r[0], r[1]): round(r[2], 9) for r in got.collect()} == {
        (1, 1): round(9 / 5, 9), (1, 2): round(9 / 5**0.5 / 5, 9), (2, 1): round(9 / 5**0.5 / 5, 9), (2, 2): 1.0
    }


def test_no_documents(spark):
    df = spark.createDataFrame([], "doc_id long, c string, t array<string>")
    found = tr.vocabulary(tr.pack(df, ["doc_id"], F.col("t")), 0)
    for table in (found.rows(), found.features(), found.sequences(), found.sparse_rows(), found.mean_weight(3)):
        assert table.collect() == []
    assert ct.class_weights(df, "c", F.col("t")).collect() == []
    assert ct.nearest_in_classes(tr.class_terms(tr.pack(df, ["doc_id", "c"], F.col("t")), "c", answers=True)).collect() == []


def test_no_pair_of_document_and_term_is_shuffled(spark):
    """What the exchanges carry is one row a chunk and one row for a chunk and a range."""
    df = spark.createDataFrame([(i, [f"w{i % 7}", "x"]) for i in range(50)], "doc_id long, t array<string>").coalesce(1)
    found = tr.vocabulary(tr.pack(df, ["doc_id"], F.col("t")), 50, 2, 1.0)
    assert found.packed.table.count() == 1 and found.table.where("chunk is not null").count() <= len(found.packed.borders) + 1
    plan = found.features()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_nulls_in_lists_are_refused(spark):
    df = spark.createDataFrame([(1, ["x", None])], "doc_id long, t array<string>")
    with pytest.raises(Exception, match="holds a null"):
        tr.pack(df, ["doc_id"], F.col("t"))


def test_hits_of_words_are_shuffled_once(spark):
    """By document and topic, which every later step of a document's stretches can use."""
    from topicloom.operators.coherence import window_sets

    places = spark.createDataFrame([(1, 3, 0, "a"), (1, 3, 2, "b")], "doc long, length int, p int, word string")
    words = spark.createDataFrame([(0, "a", 0), (0, "b", 1)], "topic_id int, word string, bit int")
    plan = window_sets(places, F.broadcast(words), 2)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # and one for the sums


def test_lda_reads_its_corpus_from_chunks(spark):
    """Rows and token lists are made where they are read; before, each was written and terms were shuffled for both."""
    from topicloom.operators import lda
    from topicloom.plans import pipeline as pl

    rows = [(i if i else None, "lampe defekt lampe" if i % 2 else "brunnen wasser defekt") for i in range(40)]
    corpus = pl.vectorise_corpus(spark.createDataFrame(rows, "doc_id int, strong_text string"))
    settings = lda.LdaSettings(passes=2)
    numbered = corpus.terms.numbered()
    buckets = lda.deal(corpus.terms.sparse_rows(), numbered.count(), settings, n_rows=corpus.n_docs)
    assert sum(buckets.sizes) == 40 and buckets.named == 39
    some = lda.deal(corpus.terms.sparse_rows(), numbered.count(), settings, n_rows=corpus.n_docs, variants=("bow",))
    assert spark.read.parquet(some.path).columns == ["terms", "bow", "named", "bucket"]
    assert plain(some.read(1, "bow")) == plain(buckets.read(1, "bow"))
    run = pl.run_lda(corpus, ("bow",), auto_k=False, k=2, settings=settings)["bow"]
    assert run.info.first()["n_docs"] == 39 and run.doc_topics.count() == 40
    assert {r["word"] for r in run.topic_words.collect()} <= {r["term"] for r in corpus.vocabulary.collect()}
