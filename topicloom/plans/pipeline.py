"""The steps from raw records to topics. Each returns lazy tables; fits are the only barriers."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions import text as tx
from topicloom.functions.wordlists import cluster_stopwords, strong_stopwords
from topicloom.operators import cluster as cl
from topicloom.operators import ctfidf as ct
from topicloom.operators import embed as em
from topicloom.operators import features as ft
from topicloom.operators import lda
from topicloom.operators import lexicon as lx
from topicloom.operators import similarity as sm
from topicloom.operators import termranges as tr
from topicloom.operators.hierarchy import merge_topics
from topicloom.operators.topics import corrected_counts
from topicloom.schema import LDA_VARIANTS, require_variant
from topicloom.session import cut_lineage, release

# Fixed value: word characters in a row.
TOKEN_PATTERN = r"(?u)\b\w+\b"


def clean_corpus(
    records: DataFrame, id_column: str = "service_request_id", text: str = "description",
    stopwords: Iterable[str] | None = None, lexicon: DataFrame | None = None, lowercase: bool = True,
) -> DataFrame:
    """``(id, description, strong_text, light_text)`` for rows that keep text in both forms.

    Without a lexicon this is one projection: no shuffle, and it runs on a stream as well.
    """
    stop = strong_stopwords() if stopwords is None else list(stopwords)
    base = records.select(id_column, tx.text_or_empty(F.col(text)).alias("description"))
    base = tx.compute_once(base, {"_words": tx.raw_words(F.col("description"))})
    light = tx.light_text(F.col("_words"), lowercase)
    if lexicon is None:
        strong = F.array_join(tx.strong_words(F.col("_words"), stop, lowercase), " ")
        out = tx.compute_once(base, {"strong_text": strong, "light_text": light})
    else:
        words = lx.positioned(base, tx.candidate_words(F.col("_words")), id_column)
        kept = lx.strong_lemmas(words, lexicon, stop, lowercase)
        strong = lx.recollect(kept, "lemma", id_column).select(id_column, F.array_join("tokens", " ").alias("strong_text"))
        out = tx.compute_once(base, {"light_text": light}).join(strong, id_column)
    out = out.select(id_column, "description", "strong_text", "light_text")
    return out.where(drop_blank_both())


def drop_blank_both(strong: str = "strong_text", light: str = "light_text") -> Column:
    return (F.trim(strong) != "") & (F.trim(light) != "")


@dataclass
class Corpus:
    """A vectorised corpus: long-form features, vocabulary, token lists and their settings.

    ``terms`` is written: the documents as chunks with their vocabulary. Features and documents are made from it when they are read; who reads them
    more than once writes them first.
    """

    docs: DataFrame
    features: DataFrame
    vocabulary: DataFrame
    n_docs: int
    settings: dict
    terms: tr.Vocabulary

    def shape(self) -> DataFrame:
        return vector_shape(self.features, self.vocabulary)


def vector_shape(features: DataFrame, vocabulary: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    per_doc = features.groupBy(doc_id).agg(F.count(F.lit(1)).alias("nnz"))
    return per_doc.agg(F.count(F.lit(1)).alias("n_docs"), F.sum("nnz").alias("nnz")).withColumn(
        "n_terms", vocabulary.agg(F.count(F.lit(1))).scalar()
    )


def vectorise_corpus(
    docs: DataFrame, text: str = "strong_text", doc_id: str = "doc_id", min_df: int = 2, max_df: float = 0.85,
    ngram_range: tuple[int, int] = (1, 2),
) -> Corpus:
    """The documents as chunks and their vocabulary, written once; later steps read these tables."""
    if tuple(ngram_range) not in ((1, 1), (1, 2)):
        raise ValueError("ngram_range must be (1, 1) or (1, 2)")
    tokens = docs.select(doc_id, text, tx.words(F.col(text)).alias("tokens"))
    n_docs = docs.count()
    terms = tr.vocabulary(tr.pack(tokens, [doc_id], F.col("tokens"), tuple(ngram_range) == (1, 2)), n_docs, min_df, max_df)
    vocabulary = terms.rows()
    if vocabulary.isEmpty():
        raise ValueError("no term is left: lower min_df or raise max_df")
    kept = ft.drop_empty_vectors(tokens, terms.features(term=False), doc_id)
    settings = {
        "lowercase": False, "token_pattern": TOKEN_PATTERN, "ngram_range": tuple(ngram_range), "min_df": min_df, "max_df": max_df,
    }
    return Corpus(kept, terms.features(), vocabulary, n_docs, settings, terms)


@dataclass
class LdaRun:
    model: lda.TopicModel
    k: int
    topic_words: DataFrame
    doc_topics: DataFrame
    info: DataFrame
    sweep: DataFrame | None


def run_lda(
    corpus: Corpus, variants: tuple[str, ...] = ("bow", "tfidf"), auto_k: bool = True, k: int = lda.K_FIXED,
    k_min: int = lda.K_MIN, k_max: int = lda.K_MAX, settings: lda.LdaSettings = lda.LdaSettings(), doc_id: str = "doc_id",
) -> dict[str, LdaRun]:
    """Both variants: choose K by coherence (or take ``k``), train, and build the tables.

    The sweep's model of the chosen K is the trained one. The documents are dealt into buckets once for all fits.
    """
    for variant in variants:
        require_variant(variant)
    numbered = corpus.terms.numbered()
    n_terms = numbered.count()
    # Made from the chunks when they are read: on disk they would be several times the texts.
    rows = corpus.terms.sparse_rows()
    token_lists = corpus.terms.sequences().where(F.col(doc_id).isNotNull())
    buckets = lda.deal(rows, n_terms, settings, doc_id, corpus.n_docs, tuple(dict.fromkeys(variants)) or LDA_VARIANTS)
    release(rows.sparkSession)
    n = buckets.named
    if not n:
        buckets.drop()
        raise ValueError("every token list is empty: check the vectoriser settings")
    out = {}
    for variant in variants:
        if auto_k:
            sweep, models = lda.sweep_k(buckets, rows, token_lists, numbered, variant, k_min, k_max, settings, doc_id)
            model = models[lda.choose_k(sweep)]
            coherence = sweep.where(F.col("k") == model.k).first()["coherence_c_v"]
        else:
            sweep, model = None, lda.fit(buckets, variant, [k], settings)[0]
            coherence = lda.coherences([model], token_lists, numbered, doc_id)[0]
        info = lda.training_info(rows.sparkSession, variant, model, coherence, n, n_terms, settings)
        topics = lda.doc_topics(model, rows, variant, settings, doc_id)
        out[variant] = LdaRun(model, model.k, lda.topic_words(model, numbered), topics, info, sweep)
    buckets.drop()
    return out


@dataclass
class ClusterRun:
    """A fitted cluster model."""

    assigned: DataFrame
    info: DataFrame
    weights: DataFrame
    stats: DataFrame
    centroids: DataFrame

    def save(self, path: str) -> None:
        """Write every table of the model below ``path``."""
        for f in fields(self):
            getattr(self, f.name).write.parquet(f"{path}/{f.name}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ClusterRun:
        return cls(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(cls)})

    def assign(self, embeddings: DataFrame, threshold: float = 0.6, doc_id: str = "doc_id") -> DataFrame:
        """Topics of new documents by their embeddings; the model stays as it is."""
        return sm.assign_topics(embeddings, self.centroids, threshold, doc_id=doc_id)


def run_clusters(
    docs: DataFrame, text: str = "light_text", doc_id: str = "doc_id", embeddings: DataFrame | None = None,
    encoder: Callable[[list[str]], list[list[float]]] | None = None, n_components: int = 10, min_topic_size: int = 40,
    min_samples: int = 1, threshold: float = 0.6, nr_topics: int | str | None = None, min_classes: int = 2,
    stopwords: Iterable[str] | None = None,
) -> ClusterRun:
    """Embed, reduce, cluster, name the topics, then hand confident outliers to their nearest topic."""
    stop = cluster_stopwords() if stopwords is None else list(stopwords)
    if embeddings is None:
        embeddings = em.encode(docs, text, encoder, doc_id) if encoder else em.hashed_embeddings(docs, tx.words(F.col(text)), doc_id)
    embeddings = cut_lineage(embeddings)
    _, reduced = em.reduce_dims(embeddings, n_components, doc_id)
    before = cut_lineage(cl.density_clusters(cut_lineage(reduced), min_topic_size, min_samples, doc_id))
    tokens = ct.topic_terms(F.col(text), stop, (1, 1))

    def weigh(assigned: DataFrame) -> DataFrame:
        joined = docs.select(doc_id, text).join(assigned, doc_id)
        return cut_lineage(ct.class_weights(joined, "topic_id", tokens, min_classes))

    weights = weigh(before)
    if nr_topics is not None:
        before = cut_lineage(merge_topics(weights, before, nr_topics))
        weights = weigh(before)
    vectors = embeddings.join(before, doc_id)
    after = cut_lineage(sm.reassign_outliers(vectors, threshold, doc_id=doc_id))
    info = corrected_counts(ct.topic_info(before, weights), after)
    return ClusterRun(after, info, weights, sm.outlier_stats(before, after), sm.centroids(vectors))
