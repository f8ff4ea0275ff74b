"""Cleaning steps, n-grams, lexicon steps and text features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.checks import sql as q
from topicloom.checks.registry import check, table
from topicloom.functions import text as tx
from topicloom.functions.wordlists import STRONG_EXTRA_STOPWORDS, strong_stopwords
from topicloom.operators import features as ft
from topicloom.operators import lexicon as lx
from topicloom.operators import profile as pf
from topicloom.operators import termranges as tr
from topicloom.plans.pipeline import vector_shape
from topicloom.plans.reports import term_frequencies
from topicloom.session import cut_lineage
from topicloom.sources.readers import alignment


@check("strip_urls", f"SELECT page_id, {q.no_urls('html')} AS text FROM pages")
def strip_urls(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.strip_urls(F.col("html")).alias("text"))


@check("strip_emails", f"SELECT doc_id, {q.no_emails('text')} AS text FROM documents")
def strip_emails(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.strip_emails(F.col("text")).alias("text"))


@check("strip_symbols", f"SELECT page_id, {q.no_symbols('html')} AS text FROM pages")
def strip_symbols(spark, sf):
    return table(spark, sf, "pages").select("page_id", tx.strip_symbols(F.col("html")).alias("text"))


@check("clean_light", f"SELECT doc_id, {q.light('text')} AS light_text FROM documents")
def clean_light(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.clean_light(F.col("text")).alias("light_text"))


@check("clean_strong", f"SELECT doc_id, {q.strong('text')} AS strong_text FROM documents")
def clean_strong(spark, sf):
    cleaned = tx.clean_strong(F.col("text"), strong_stopwords())
    return table(spark, sf, "documents").select("doc_id", cleaned.alias("strong_text"))


@check(
    "ngram_tokens",
    f"""SELECT conv_id, turn, array_to_string({q.grams('t')}, '|') AS terms
    FROM (SELECT conv_id, turn, {q.light_list('text')} AS t FROM conversations)""",
)
def ngram_tokens(spark, sf):
    tokens = table(spark, sf, "conversations").select("conv_id", "turn", tx.light_tokens(F.col("text")).alias("t"))
    return tokens.select("conv_id", "turn", F.array_join(tx.ngrams(F.col("t")), "|").alias("terms"))


def light_words(spark: SparkSession, sf: str) -> DataFrame:
    return lx.positioned(table(spark, sf, "documents"), tx.light_tokens(F.col("text")))


@check(
    "remove_stopwords",
    f"""SELECT doc_id, array_to_string(k, ' ') AS text FROM (SELECT doc_id, list_filter({q.light_list('text')},
    lambda w: NOT list_contains([{q.quoted(STRONG_EXTRA_STOPWORDS)}], w)) AS k FROM documents) WHERE len(k) > 0""",
)
def remove_stopwords(spark, sf):
    kept = lx.without_stopwords(light_words(spark, sf), STRONG_EXTRA_STOPWORDS)
    return lx.recollect(kept).select("doc_id", F.array_join("tokens", " ").alias("text"))


# A lexicon learned from the documents: a word whose form without the last letter is a word as well.
LEXICON_SQL = f"""
words AS (SELECT doc_id, generate_subscripts(t, 1) AS pos, unnest(t) AS token
  FROM (SELECT doc_id, {q.light_list('text')} AS t FROM documents)),
vocab AS (SELECT token FROM words GROUP BY token HAVING count(*) >= 2),
lexicon AS (SELECT a.token, b.token AS lemma FROM vocab a JOIN vocab b ON b.token = left(a.token, length(a.token) - 1) AND length(b.token) >= 4)
"""


def learned_lexicon(words: DataFrame) -> DataFrame:
    vocab = words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").select("token")
    stems = vocab.where(F.length("token") >= 4).withColumnRenamed("token", "lemma")
    cut = F.expr("substring(token, 1, length(token) - 1)")
    return vocab.withColumn("lemma", cut).join(stems, "lemma").select("token", "lemma")


@check(
    "lemmatise",
    f"""WITH {LEXICON_SQL} SELECT doc_id, string_agg(coalesce(lemma, token), ' ' ORDER BY pos) AS text
    FROM words LEFT JOIN lexicon USING (token) GROUP BY doc_id""",
)
def lemmatise(spark, sf):
    words = light_words(spark, sf)
    done = lx.recollect(lx.lemmatise(words, learned_lexicon(words)), "lemma")
    return done.select("doc_id", F.array_join("tokens", " ").alias("text"))


# Tags learned from the documents: by the most common spelling of a word.
TAGGED_SQL = f"""
spelled AS (SELECT doc_id, unnest(list_filter(string_split({q.norm('text')}, ' '), lambda w: w <> '')) AS w FROM documents),
shapes AS (SELECT lower(w) AS token, count(*) AS n, count(*) FILTER (regexp_matches(w, '^[A-ZÄÖÜ]')) AS n_upper,
  bool_and(regexp_full_match(w, '[0-9]+')) AS is_number FROM spelled GROUP BY 1),
lex AS (SELECT token, CASE WHEN is_number THEN 'NUM' WHEN n_upper * 2 > n THEN 'NOUN' WHEN n >= 50 THEN 'FREQ' END AS pos_tag FROM shapes WHERE n >= 2),
tagged AS (SELECT s.token, coalesce(l.pos_tag, 'X') AS pos_tag FROM (SELECT lower(w) AS token FROM spelled) s LEFT JOIN lex l USING (token)
  WHERE NOT list_contains([{q.quoted(STRONG_EXTRA_STOPWORDS)}], s.token))
"""


def tagged_words(spark: SparkSession, sf: str) -> DataFrame:
    spelled = table(spark, sf, "documents").select(
        F.explode_outer(tx.words(tx.normalise(F.col("text")))).alias("w")
    ).where("w is not null")
    upper, number = F.col("w").rlike("^[A-ZÄÖÜ]"), F.col("w").rlike("^[0-9]+$")
    shapes = spelled.groupBy(F.lower("w").alias("token")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(upper).alias("n_upper"), F.bool_and(number).alias("is_number")
    )
    tag = F.when(F.col("is_number"), "NUM").when(F.col("n_upper") * 2 > F.col("n"), "NOUN").when(F.col("n") >= 50, "FREQ")
    lexicon = shapes.where("n >= 2").select("token", tag.alias("pos_tag"))
    words = lx.without_stopwords(spelled.select(F.lower("w").alias("token")), STRONG_EXTRA_STOPWORDS)
    return lx.tag(lx.token_counts(words), lexicon)


@check(
    "pos_distribution",
    f"""WITH {TAGGED_SQL} SELECT pos_tag, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM tagged) * 100, 2) AS percentage
    FROM tagged GROUP BY pos_tag""",
)
def pos_distribution(spark, sf):
    return lx.tag_distribution(tagged_words(spark, sf))


@check(
    "top_tokens_pos",
    f"""WITH {TAGGED_SQL}, pairs AS (SELECT token, pos_tag, count(*) AS n FROM tagged GROUP BY ALL)
    SELECT token, sum(n)::BIGINT AS freq, first(pos_tag ORDER BY n DESC, pos_tag) AS dominant_pos FROM pairs
    GROUP BY token ORDER BY freq DESC, token LIMIT 50""",
)
def top_tokens_pos(spark, sf):
    return lx.top_tokens_with_tag(tagged_words(spark, sf), 50)


def strong_docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", tx.strong_tokens(F.col("text"), strong_stopwords()).alias("t"))


def n_documents(spark: SparkSession, sf: str):
    return ft.count_rows(table(spark, sf, "documents"))


def all_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ft.term_counts(strong_docs(spark, sf), F.col("t"))


def counts(spark: SparkSession, sf: str) -> DataFrame:
    """The counts as a written table, for queries that read them more than once."""
    return cut_lineage(all_counts(spark, sf))


def vocabulary(spark: SparkSession, sf: str, of: DataFrame | None = None) -> DataFrame:
    """The vocabulary of counts; of written ones it is written as well, since the steps that take it read it several times."""
    found = ft.fit_vocabulary(all_counts(spark, sf) if of is None else of, n_documents(spark, sf))
    return found if of is None else cut_lineage(found)


def learned(spark: SparkSession, sf: str) -> tr.Vocabulary:
    """The documents as chunks with their vocabulary, for queries that need no pair of document and term outside its chunk."""
    return tr.vocabulary(tr.pack(strong_docs(spark, sf), ["doc_id"], F.col("t")), table(spark, sf, "documents").count())


@check("fit_vocabulary", f"WITH {q.TERMS} SELECT term, df, cf FROM vocab")
def fit_vocabulary(spark, sf):
    return vocabulary(spark, sf)


@check("bag_of_words", f"WITH {q.TERMS} SELECT doc_id, term, tf FROM bow")
def bag_of_words(spark, sf):
    terms = counts(spark, sf)
    return ft.bag_of_words(terms, vocabulary(spark, sf, terms)).select("doc_id", "term", "tf")


@check("tf_idf", f"WITH {q.TERMS} SELECT doc_id, term, tf, round(tfidf, 6) AS tfidf FROM tfidf")
def tf_idf(spark, sf):
    return learned(spark, sf).features().withColumn("tfidf", F.round("tfidf", 6))


@check(
    "vector_shape",
    f"""WITH {q.TERMS} SELECT count(DISTINCT doc_id) AS n_docs, count(*) AS nnz, (SELECT count(*) FROM vocab) AS n_terms FROM bow""",
)
def shape(spark, sf):
    terms = counts(spark, sf)
    vocab = vocabulary(spark, sf, terms)
    return vector_shape(ft.bag_of_words(terms, vocab), vocab)


@check(
    "drop_empty_vectors",
    f"""WITH t AS (SELECT item_id, {q.light_list('text')} AS t FROM benchmark),
    g AS (SELECT DISTINCT item_id, unnest({q.grams('t')}) AS term FROM t),
    v AS (SELECT term FROM g GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.06::DOUBLE * (SELECT count(*) FROM benchmark))
    SELECT item_id, text FROM benchmark WHERE item_id IN (SELECT item_id FROM g SEMI JOIN v USING (term))""",
)
def drop_empty_vectors(spark, sf):
    items = table(spark, sf, "benchmark")
    terms = ft.term_counts(items.select("item_id", tx.light_tokens(F.col("text")).alias("t")), F.col("t"), "item_id")
    vocab = ft.fit_vocabulary(terms, ft.count_rows(items), 2, 0.06)
    return ft.drop_empty_vectors(items, ft.bag_of_words(terms, vocab), "item_id")


@check(
    "feature_alignment",
    f"""WITH {q.TERMS} SELECT (SELECT count(DISTINCT doc_id) FROM bow) AS bow_docs, (SELECT count(DISTINCT doc_id) FROM tfidf) AS tfidf_docs,
    (SELECT count(*) FROM (SELECT doc_id FROM bow EXCEPT SELECT doc_id FROM tfidf)) AS only_bow,
    (SELECT count(*) FROM (SELECT doc_id FROM tfidf EXCEPT SELECT doc_id FROM bow)) AS only_tfidf""",
)
def feature_alignment(spark, sf):
    terms = counts(spark, sf)
    vocab = vocabulary(spark, sf, terms)
    return alignment(ft.bag_of_words(terms, vocab), ft.tf_idf(terms, vocab, n_documents(spark, sf)))


@check("term_frequency", f"WITH {q.TERMS} SELECT term, sum(tf)::BIGINT AS freq FROM bow GROUP BY term ORDER BY freq DESC, term LIMIT 30")
def term_frequency(spark, sf):
    terms = counts(spark, sf)
    return pf.term_frequency(ft.bag_of_words(terms, vocabulary(spark, sf, terms)))


@check(
    "doc_frequency",
    f"WITH {q.TERMS} SELECT term, count(*) AS df, round(count(*)::DOUBLE / (SELECT n FROM n), 6) AS df_ratio FROM bow GROUP BY term",
)
def doc_frequency(spark, sf):
    terms = counts(spark, sf)
    kept = ft.bag_of_words(terms, vocabulary(spark, sf, terms))
    return pf.document_frequency(kept, n_documents(spark, sf)).withColumn("df_ratio", F.round("df_ratio", 6))


@check(
    "doc_frequency_range",
    f"WITH {q.TERMS} SELECT round(min(df)::DOUBLE / (SELECT n FROM n), 6) AS min_ratio, round(max(df)::DOUBLE / (SELECT n FROM n), 6) AS max_ratio FROM vocab",
)
def doc_frequency_range(spark, sf):
    terms = counts(spark, sf)
    kept = ft.bag_of_words(terms, vocabulary(spark, sf, terms))
    found = pf.document_frequency_range(kept, n_documents(spark, sf))
    return found.select(F.round("min_ratio", 6).alias("min_ratio"), F.round("max_ratio", 6).alias("max_ratio"))


@check(
    "terms_per_doc",
    f"""WITH {q.TERMS}, p AS (SELECT doc_id, count(*) AS n FROM bow GROUP BY doc_id)
    SELECT min(n) AS min_terms, round(avg(n), 6) AS mean_terms, max(n) AS max_terms FROM p""",
)
def terms_per_doc(spark, sf):
    terms = counts(spark, sf)
    kept = ft.bag_of_words(terms, vocabulary(spark, sf, terms))
    return pf.terms_per_document(kept).withColumn("mean_terms", F.round("mean_terms", 6))


@check(
    "nnz_per_doc",
    f"""WITH {q.TERMS} SELECT round(count(*) FILTER (tf <> 0)::DOUBLE / count(DISTINCT doc_id), 6) AS bow_nnz,
    round(count(*) FILTER (tfidf <> 0)::DOUBLE / count(DISTINCT doc_id), 6) AS tfidf_nnz FROM tfidf""",
)
def nnz_per_doc(spark, sf):
    found = pf.nonzeros_per_document(learned(spark, sf).features(term=False))
    return found.select(F.round("bow_nnz", 6).alias("bow_nnz"), F.round("tfidf_nnz", 6).alias("tfidf_nnz"))


@check(
    "mean_tfidf_top",
    f"""WITH {q.TERMS} SELECT term, round(sum(tfidf) / (SELECT n FROM n), 6) AS mean_tfidf FROM tfidf GROUP BY term
    ORDER BY sum(tfidf) DESC, term LIMIT 20""",
)
def mean_tfidf_top(spark, sf):
    return learned(spark, sf).mean_weight(20).withColumn("mean_tfidf", F.round("mean_tfidf", 6))


@check(
    "tokens_in_vocab",
    f"""WITH {q.TERMS}, pos AS (SELECT doc_id, generate_subscripts(t, 1) AS pos, unnest(t) AS term FROM (SELECT doc_id, {q.grams('t')} AS t FROM toks))
    SELECT doc_id, string_agg(term, '|' ORDER BY pos) AS terms FROM pos SEMI JOIN vocab USING (term) GROUP BY doc_id""",
)
def tokens_in_vocab(spark, sf):
    found = learned(spark, sf)
    cut_lineage(found.rows())  # the query leaves its vocabulary as a table of its own, as before
    return found.sequences().select("doc_id", F.array_join("tokens", "|").alias("terms"))


@check("term_doc_collection_freq", f"WITH {q.TERMS} SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM bow GROUP BY term")
def term_doc_collection_freq(spark, sf):
    terms = counts(spark, sf)
    return term_frequencies(ft.bag_of_words(terms, vocabulary(spark, sf, terms)))
