import math
import re

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from topicloom.functions import text as tx
from topicloom.operators import features as ft
from topicloom.operators import lexicon as lx
from topicloom.plans.pipeline import vectorise_corpus

TEXTS = ["lampe defekt lampe", "lampe kaputt", "brunnen wasser", "brunnen defekt wasser", "xyz", "lampe brunnen"]


def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, strong_text string")


def grams(text):
    w = text.split()
    return w + [" ".join(p) for p in zip(w, w[1:])]


def expected(min_df=2, max_df=0.85):
    lists = [grams(t) for t in TEXTS]
    df = {t: sum(t in g for g in lists) for g in lists for t in g}
    vocab = {t: d for t, d in df.items() if min_df <= d <= max_df * len(TEXTS)}
    out = {}
    for i, g in enumerate(lists):
        w = {t: g.count(t) * (math.log((1 + len(TEXTS)) / (1 + vocab[t])) + 1) for t in set(g) if t in vocab}
        norm = math.sqrt(sum(v * v for v in w.values()))
        out.update({(i, t): v / norm for t, v in w.items()})
    return vocab, out


def test_corpus_matches_brute_force(spark):
    corpus = vectorise_corpus(docs(spark))
    vocab, weights = expected()
    assert {r["term"]: r["df"] for r in corpus.vocabulary.collect()} == vocab
    got = {(r["doc_id"], r["term"]): r["tfidf"] for r in corpus.features.collect()}
    assert got.keys() == weights.keys() and all(abs(got[k] - weights[k]) < 1e-12 for k in got)
    assert sorted(r["doc_id"] for r in corpus.docs.collect()) == [0, 1, 2, 3, 5]  # "xyz" has no kept term
    assert corpus.n_docs == 6


def test_vectors_equal_the_long_form(spark):
    corpus = vectorise_corpus(docs(spark))
    numbered = ft.numbered_vocabulary(corpus.vocabulary)
    names = [r["term"] for r in numbered.orderBy("term_id").collect()]
    assert names == sorted(names)
    out = ft.vectors(corpus.features, numbered, len(names))
    assert {(r["doc_id"], names[i]): x for r in out.collect() for i, x in zip(r["bow"].indices, r["bow"].values)} == {
        (r["doc_id"], r["term"]): r["tf"] for r in corpus.features.collect()
    }
    got = {}
    for r in out.select("doc_id", vector_to_array("tfidf").alias("v")).collect():
        got.update({(r["doc_id"], names[i]): x for i, x in enumerate(r["v"]) if x})
    _, weights = expected()
    assert got.keys() == weights.keys() and all(abs(got[k] - weights[k]) < 1e-12 for k in got)


def test_vocabulary_bounds(spark):
    # 20 documents: one term in exactly 2, one in exactly 17 = 0.85 * 20, one in 18.
    rows = [(i, ["two"] * (i < 2) + ["edge"] * (i < 17) + ["over"] * (i < 18) + ["once"] * (i == 0)) for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id int, t array<string>")
    counts = ft.term_counts(df, F.col("t"), ngram_range=(1, 1))
    assert sorted(r["term"] for r in ft.fit_vocabulary(counts, ft.count_rows(df)).collect()) == ["edge", "two"]


def test_everything_pruned_raises(spark):
    with pytest.raises(ValueError, match="no term"):
        vectorise_corpus(docs(spark), min_df=5)


def test_lexicon_and_sequence_steps(spark):
    df = spark.createDataFrame([(1, ["Lampen", "sind", "Lampen", "neu"]), (2, ["neu"])], "doc_id int, t array<string>")
    words = lx.positioned(df, F.col("t"))
    lexicon = spark.createDataFrame([("Lampen", "Lampe")], "token string, lemma string")
    kept = lx.strong_lemmas(words, lexicon, ["sind"])
    assert {r["doc_id"]: r["tokens"] for r in lx.recollect(kept, "lemma").collect()} == {1: ["lampe", "lampe", "neu"], 2: ["neu"]}
    vocab = spark.createDataFrame([("Lampen",), ("neu",)], "term string")
    got = lx.in_vocabulary(words, vocab).orderBy("doc_id", "pos").collect()
    assert [(r["doc_id"], r["pos"], r["token"]) for r in got] == [(1, 0, "Lampen"), (1, 1, "Lampen"), (1, 2, "neu"), (2, 0, "neu")]
    tags = spark.createDataFrame([("Lampen", "NOUN")], "token string, pos_tag string")
    dist = {r["pos_tag"]: (r["n"], r["percentage"]) for r in lx.tag_distribution(lx.tag(words, tags)).collect()}
    assert dist == {"NOUN": (2, 40.0), "X": (3, 60.0)}


def test_cleaning_with_a_lexicon(spark):
    from topicloom.plans.pipeline import clean_corpus

    records = spark.createDataFrame([(1, "Die Lampen sind kaputt"), (2, "12 34")], "id int, t string")
    lexicon = spark.createDataFrame([("Lampen", "Lampe")], "token string, lemma string")
    got = clean_corpus(records, "id", "t", ["die", "sind"], lexicon).collect()
    assert [(r["id"], r["strong_text"], r["light_text"]) for r in got] == [(1, "lampe kaputt", "die lampen sind kaputt")]


@pytest.mark.parametrize("chunk", [1, 5, 1 << 19])
def test_rows_of_one_id_are_one_document_in_every_chunk(spark, monkeypatch, chunk):
    from collections import Counter

    monkeypatch.setattr(ft, "_CHUNK_TERMS", chunk)
    rows = [(i % 7 if i % 5 else None, ["a", "b", None, f"w{i % 3}"][: i % 5] if i % 11 else None) for i in range(60)]
    want = Counter((i, t) for i, ts in rows for t in ts or [] if t is not None)
    df = spark.createDataFrame(rows, "doc_id int, t array<string>")
    # The counter's own rows, batch by batch, as Spark hands them over.
    import pyarrow as pa

    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    batches = [pa.RecordBatch.from_arrays([pa.array([i for i, _ in part], pa.int32()), pa.array([t for _, t in part], pa.list_(pa.string()))], ["doc_id", "t"])
               for part in (ordered[:9], ordered[9:10], ordered[10:])]
    made = [r for b in ft._counted(["doc_id", "term", "tf"])(iter(batches)) for r in b.to_pylist()]
    assert Counter({(r["doc_id"], r["term"]): r["tf"] for r in made}) == want and len(made) == len(want)
    got = ft.term_counts(df, F.col("t"), ngram_range=(1, 1)).collect()
    assert {(r["doc_id"], r["term"]): r["tf"] for r in got} == want and len(got) == len(want)


def test_counts_shuffle_documents_not_terms(spark):
    """No shuffle for ids that come once, else one of token lists; before, every pair of document and term went through one map and a shuffle."""
    plan = lambda ids: ft.term_counts(spark.createDataFrame([(i, ["a", "b"]) for i in ids], "doc_id int, t array<string>"), F.col("t"))._jdf.queryExecution().executedPlan().toString()
    once, twice = plan([1, 2]), plan([1, 1])
    assert "Exchange" not in once and "HashAggregate" not in once + twice
    assert twice.count("Exchange hashpartitioning") == 1 and twice.index("Exchange hashpartitioning") > twice.index("MapInArrow")


def test_vocabulary_of_tokens_is_written_once(spark, tmp_path, monkeypatch):
    """The join reads the vocabulary several times; before, each of them counted the documents' terms again."""
    from topicloom.checks import text_checks as tc

    spark.createDataFrame([(i, "Lampe defekt Brunnen"[: 6 + 7 * (i % 2)]) for i in range(4)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    calls = []
    monkeypatch.setattr(tc, "cut_lineage", lambda df: calls.append(df.columns) or df)
    assert {r["doc_id"] for r in tc.tokens_in_vocab(spark, str(tmp_path)).collect()} == {1, 3}
    assert ["term", "df", "cf"] in calls


@pytest.mark.parametrize("chunk", [1, 1 << 19])
def test_class_counts_are_added_up_in_pieces(spark, monkeypatch, chunk):
    """Before, a task held one map of all its classes' terms."""
    from collections import Counter

    from topicloom.operators import ctfidf as ct

    monkeypatch.setattr(ft, "_CHUNK_TERMS", chunk)
    rows = [(i % 4, (None, "a", "b")[i % 3], ["x", None, f"w{i % 5}"] if i % 7 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id int, c string, t array<string>")
    by_class = ct.class_counts(df, "c", F.col("t"))
    plan = by_class._jdf.queryExecution().executedPlan().toString()  # before it runs
    want = Counter((c, t) for _, c, ts in rows for t in ts or [] if t is not None)
    assert {(r["c"], r["term"]): r["n"] for r in by_class.collect()} == want
    assert plan.count("Exchange hashpartitioning") == 1 and plan.rindex("HashAggregate") < plan.index("Exchange hashpartitioning")
    want = Counter((i, c, t) for i, c, ts in rows for t in ts or [] if t is not None)
    got = ct.class_counts(df, "c", F.col("t"), per_doc=True).collect()
    assert {(r["doc_id"], r["c"], r["term"]): r["n"] for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("chunk", [1, 1 << 19])
def test_pairs_of_classes_are_counted_by_numbers(spark, monkeypatch, chunk):
    """Before, every pair of a text was made as a text of its own."""
    from topicloom.functions.text import ngrams
    from topicloom.operators import ctfidf as ct

    monkeypatch.setattr(ft, "_CHUNK_TERMS", chunk)
    rows = [((None, "a", "b")[i % 3], [f"w{j * i % 5}" for j in range(i % 6)] if i % 7 else None) for i in range(60)] + [("c", [""]), ("c", ["", "w1", ""])]
    df = spark.createDataFrame(rows, "c string, t array<string>")
    got = ct.token_counts(df, "c", F.col("t"))
    assert "zip_with" not in got._jdf.queryExecution().executedPlan().toString()
    want = ct.class_counts(df, "c", ngrams(F.col("t"))).collect()
    assert sorted(got.collect(), key=str) == sorted(want, key=str) and len(want) > 40
    assert ct.token_counts(df.limit(0), "c", F.col("t")).collect() == []
    with pytest.raises(Exception, match="holds a null"):
        ct.token_counts(spark.createDataFrame([("a", ["x", None])], df.schema), "c", F.col("t")).collect()


def test_class_weights_look_at_the_terms_twice(spark):
    """Before, three times: the mean of the totals was counted anew."""
    from topicloom.operators import ctfidf as ct

    rows = [(None, "a", 3), (1, "a", 2), (1, "b", 1), (2, "a", 1), (2, "c", 5)]
    counts = spark.createDataFrame(rows, "c int, term string, n long")
    weights = ct.c_tf_idf(counts, "c", 1)
    assert len(re.findall(r"Window \[.*\], \[term#", weights._jdf.queryExecution().executedPlan().toString())) == 2
    got = {(r.c, r.term): (r.n, round(r.idf, 9), round(r.weight, 9)) for r in weights.collect()}
    mean = (3 + 3 + 6) // 3
    idf = lambda f: round(math.log(mean / f + 1), 9)
    assert got == {(1, "a"): (2, idf(6), round(2 / 3 * math.log(mean / 6 + 1), 9)), (1, "b"): (1, idf(1), round(1 / 3 * math.log(mean + 1), 9)),
                   (2, "a"): (1, idf(6), round(1 / 6 * math.log(mean / 6 + 1), 9)), (2, "c"): (5, idf(5), round(5 / 6 * math.log(mean / 5 + 1), 9))}


def test_class_weights_do_not_gather_a_class_in_one_task(spark):
    """Before, the totals met the counts in a shuffle by class."""
    from topicloom.operators import ctfidf as ct

    counts = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1)], "c int, term string, n long")
    plan = ct.c_tf_idf(counts, "c", 1)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
