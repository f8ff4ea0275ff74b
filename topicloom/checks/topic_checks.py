"""Topic tables, class-based TF-IDF, similarity, outliers, model selection and reports.

The documents' language stands in for a topic assignment with a known answer, and the first
embedding dimensions (as a softmax) for a topic model's document distribution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.checks import sql as q
from topicloom.checks.registry import check, table
from topicloom.functions import text as tx
from topicloom.functions.wordlists import CLUSTER_EXTRA_STOPWORDS
from topicloom.operators import ctfidf as ct
from topicloom.operators import ranking as rk
from topicloom.operators import similarity as sm
from topicloom.operators import termranges as tr
from topicloom.operators import topics as tp
from topicloom.operators.components import connected_components
from topicloom.operators.lda import empty_topics
from topicloom.plans import reports as rp
from topicloom.session import cut_lineage

K_MIN, K_MAX = 3, 10


def language_id() -> Column:
    lang = F.col("lang")
    return F.when(lang == "de", 0).when(lang == "en", 1).when(lang == "es", 2).when(lang == "fr", 3).cast("long")


def by_language(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", language_id().alias("topic_id"), "text", "source", "lang")


def assigned(spark: SparkSession, sf: str) -> DataFrame:
    """The language as topic; documents marked as low quality are outliers."""
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    topic = F.when(F.col("quality") == 0, F.lit(-1)).otherwise(F.col("topic_id")).cast("long")
    return table(spark, sf, "documents").select("doc_id", language_id().alias("topic_id"), "source", "lang").join(
        labels, "doc_id", "left"
    ).withColumn("topic_id", topic)


def class_terms(text: Column) -> Column:
    """Class terms of the lightly cleaned text: its words are tokens already."""
    kept = F.filter(tx.light_tokens(text), lambda w: (F.length(w) >= 2) & ~w.isin(list(CLUSTER_EXTRA_STOPWORDS)))
    return kept


def class_counts(docs: DataFrame, cls: str = "topic_id", per_doc: bool = False) -> DataFrame:
    return ct.class_counts(docs.select("doc_id", cls, class_terms(F.col("text")).alias("t")), cls, tx.ngrams(F.col("t")), per_doc=per_doc)


def language_weights(spark: SparkSession, sf: str) -> DataFrame:
    return ct.class_weights(by_language(spark, sf), "topic_id", class_terms(F.col("text")), 1)


def language_documents(spark: SparkSession, sf: str) -> tr.ClassTerms:
    """The documents in chunks and their terms counted by language, for queries that look for the documents nearest to a language."""
    packed = tr.pack(by_language(spark, sf), ["doc_id", "topic_id"], class_terms(F.col("text")))
    return tr.class_terms(packed, "topic_id", 1, answers=True)


def language_words(spark: SparkSession, sf: str, n: int = 15, of: tr.ClassTerms | None = None) -> DataFrame:
    """``(topic_id, word, weight)``, the shape of a topic model's word table; from counts ``of`` the documents if they are there."""
    weights = language_weights(spark, sf) if of is None else ct.term_weights(of.rows(), "topic_id")
    words = weights.select("topic_id", F.col("term").alias("word"), "weight")
    return cut_lineage(rk.top_words(words, n).drop("rank"))  # a few rows, which labels and prompts read several times


WORDS_SQL = f"{q.LANG_WEIGHTS}, words AS (SELECT topic_id, term AS word, weight, rank FROM cranked WHERE rank <= 15)"


@check("topic_counts", f"WITH {q.ASSIGNED} SELECT topic_id, count(*) AS n_docs FROM assigned GROUP BY topic_id")
def topic_counts(spark, sf):
    return tp.topic_counts(assigned(spark, sf)).orderBy("topic_id")


@check(
    "topic_balance",
    f"""WITH {q.ASSIGNED}, k AS (SELECT unnest(range(0, 6)) AS topic_id)
    SELECT k.topic_id, count(a.doc_id) AS n_docs FROM k LEFT JOIN assigned a USING (topic_id) GROUP BY k.topic_id""",
)
def topic_balance(spark, sf):
    return rp.topic_balance(assigned(spark, sf), 6)


SHARE_SQL = """round(n_docs::DOUBLE / (SELECT sum(n_docs) FROM c) * 100, 6) AS percentage,
  (n_docs = (SELECT max(n_docs) FROM c) AND n_docs > 0) AS is_predominant"""


@check(
    "topic_share",
    f"""WITH {q.ASSIGNED}, k AS (SELECT unnest(range(0, 6)) AS topic_id),
    c AS (SELECT k.topic_id, count(a.doc_id) AS n_docs FROM k LEFT JOIN assigned a USING (topic_id) GROUP BY k.topic_id)
    SELECT topic_id, n_docs, {SHARE_SQL} FROM c""",
)
def topic_share(spark, sf):
    shares = tp.topic_share(rp.topic_balance(assigned(spark, sf), 6))
    return shares.withColumn("percentage", F.round("percentage", 6))


@check(
    "topic_balance_cv",
    f"""WITH {q.ASSIGNED}, k AS (SELECT unnest(range(0, 6)) AS topic_id),
    c AS (SELECT k.topic_id, count(a.doc_id) AS n_docs FROM k LEFT JOIN assigned a USING (topic_id) GROUP BY k.topic_id)
    SELECT round(stddev_samp(n_docs) / avg(n_docs), 6) AS balance_cv FROM c""",
)
def topic_balance_cv(spark, sf):
    return tp.balance_cv(rp.topic_balance(assigned(spark, sf), 6)).select(F.round("balance_cv", 6).alias("balance_cv"))


# Document distributions: a softmax over the first k embedding dimensions, for two variants.
def theta(embedding: Column, k: int, variant: str) -> Column:
    part = F.transform(F.slice(embedding, 1 if variant == "bow" else 11, k), lambda x: F.exp(x.cast("double")))
    return F.transform(part, lambda x: F.round(x / F.aggregate(part, F.lit(0.0), lambda a, b: a + b), 9))


def theta_sql(k: str, first: str = "1") -> str:
    part = f"list_transform(embedding[{first}:{first} + {k} - 1], lambda x: exp(x::DOUBLE))"
    return f"list_transform({part}, lambda x: round(x / list_sum({part}), 9))"


@check(
    "dominant_topic",
    f"""WITH t AS (SELECT vec_id, {theta_sql('10')} AS theta FROM embeddings)
    SELECT vec_id, (list_position(theta, list_max(theta)) - 1)::BIGINT AS dominant_topic, round(list_max(theta), 6) AS probability FROM t""",
)
def dominant(spark, sf):
    t = table(spark, sf, "embeddings").select("vec_id", theta(F.col("embedding"), 10, "bow").alias("theta"))
    return t.select("vec_id", rk.dominant_topic(F.col("theta")).alias("dominant_topic"), F.round(F.array_max("theta"), 6).alias("probability"))


THETA_LONG_SQL = f"""
t AS (SELECT vec_id, {theta_sql('10')} AS theta FROM embeddings SEMI JOIN documents ON vec_id = doc_id),
l AS (SELECT vec_id, unnest(range(0, 10)) AS topic_id, unnest(theta) AS p FROM t),
reps AS (SELECT vec_id AS doc_id, topic_id, p, row_number() OVER (PARTITION BY topic_id ORDER BY p DESC, vec_id) AS rank FROM l)
"""


def representatives(spark: SparkSession, sf: str, n: int) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    t = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), theta(F.col("embedding"), 10, "bow").alias("theta"))
    # Only vectors with a document can represent a topic, so that none vanishes after the ranking.
    found = rk.representative_docs(t.join(docs.select("doc_id"), "doc_id", "left_semi"), n)
    return found.join(docs, "doc_id")


@check(
    "representative_docs",
    f"""WITH {THETA_LONG_SQL} SELECT topic_id, rank, doc_id, round(p, 6) AS probability, text FROM reps JOIN documents USING (doc_id) WHERE rank <= 6""",
)
def representative_docs(spark, sf):
    return representatives(spark, sf, 6).select(
        F.col("topic_id").cast("long").alias("topic_id"), F.col("rank").cast("long").alias("rank"), "doc_id", F.round("probability", 6).alias("probability"), "text"
    )


# A K sweep over those distributions: the mean largest probability stands in for the coherence.
SWEEP_SQL = " UNION ALL ".join(
    f"""SELECT '{v}' AS variant, {k}::BIGINT AS k, CASE WHEN {k} = {K_MAX} AND '{v}' = 'bow' THEN 'NaN'::DOUBLE ELSE
    round(avg(list_max({theta_sql(str(k), f)})) * {k}, 4) END AS coherence_c_v,
    {k} - count(DISTINCT list_position({theta_sql(str(k), f)}, list_max({theta_sql(str(k), f)}))) AS empty_topics, count(*) AS n_docs FROM embeddings"""
    for v, f in (("bow", "1"), ("tfidf", "11")) for k in range(K_MIN, K_MAX + 1)
)


def sweep(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    cases = F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(k).cast("long").alias("k"), theta(F.col("embedding"), k, v).alias("theta"))
                      for v in ("bow", "tfidf") for k in range(K_MIN, K_MAX + 1)])
    long = vectors.select(F.inline(cases))
    found = long.groupBy("variant", "k").agg(
        F.round(F.avg(F.array_max("theta")) * F.col("k"), 4).alias("coherence_c_v"),
        (F.col("k") - F.count_distinct(rk.dominant_topic(F.col("theta")))).alias("empty_topics"),
        F.count(F.lit(1)).alias("n_docs"),
    )
    broken = (F.col("k") == K_MAX) & (F.col("variant") == "bow")
    return found.withColumn("coherence_c_v", F.when(broken, F.lit(float("nan"))).otherwise(F.col("coherence_c_v")))


SWEEP_CTE = f"sweep AS ({SWEEP_SQL}), scored AS (SELECT *, CASE WHEN isnan(coherence_c_v) THEN NULL ELSE coherence_c_v END AS c FROM sweep)"
BEST_SQL = """best AS (SELECT variant, k, coherence_c_v, empty_topics, n_docs FROM scored
  QUALIFY row_number() OVER (PARTITION BY variant ORDER BY empty_topics, c DESC NULLS LAST, k) = 1)"""


@check("best_k", f"WITH {SWEEP_CTE}, {BEST_SQL} SELECT * FROM best")
def best_k(spark, sf):
    return rk.best_k(sweep(spark, sf))


@check(
    "best_k_chart",
    f"""WITH {SWEEP_CTE}, m AS (SELECT variant, k AS b FROM scored QUALIFY row_number() OVER (PARTITION BY variant ORDER BY c DESC NULLS LAST, k) = 1)
    SELECT variant, k, c AS coherence_c_v, empty_topics, (k = b) AS is_marked FROM scored JOIN m USING (variant)""",
)
def best_k_chart(spark, sf):
    series = rp.k_series(sweep(spark, sf))
    return series.withColumn("coherence_c_v", F.when(~F.isnan("coherence_c_v"), F.col("coherence_c_v")))


@check(
    "empty_topics",
    f"""SELECT 10 - count(DISTINCT list_position({theta_sql('10')}, list_max({theta_sql('10')}))) AS empty_topics FROM embeddings""",
)
def empty_topics_query(spark, sf):
    t = table(spark, sf, "embeddings").select(rk.dominant_topic(theta(F.col("embedding"), 10, "bow")).alias("dominant_topic"))
    return empty_topics(t, 10)


DOMINANT_COUNTS_SQL = f"""
dom AS (
  SELECT 'bow' AS variant, list_position({theta_sql('8')}, list_max({theta_sql('8')})) - 1 AS topic_id FROM embeddings
  UNION ALL SELECT 'tfidf', list_position({theta_sql('8', '11')}, list_max({theta_sql('8', '11')})) - 1 FROM embeddings
),
kk AS (SELECT unnest(range(0, 8)) AS topic_id),
cnt AS (SELECT v.variant, kk.topic_id, count(dom.topic_id) AS n_docs FROM (SELECT DISTINCT variant FROM dom) v CROSS JOIN kk
  LEFT JOIN dom ON dom.variant = v.variant AND dom.topic_id = kk.topic_id GROUP BY ALL)
"""


@check(
    "variant_summary",
    f"""WITH {SWEEP_CTE}, {BEST_SQL}, {DOMINANT_COUNTS_SQL},
    cv AS (SELECT variant, stddev_samp(n_docs) / avg(n_docs) AS cv FROM cnt GROUP BY variant),
    r AS (SELECT best.*, cv.cv, min(cv.cv) OVER () AS m FROM best JOIN cv USING (variant))
    SELECT variant, 'coherence_c_v' AS metric, round(coherence_c_v, 4) AS value FROM r
    UNION ALL SELECT variant, 'optimal_k', k::DOUBLE FROM r UNION ALL SELECT variant, 'total_documents', n_docs::DOUBLE FROM r
    UNION ALL SELECT variant, 'balance_cv', round(cv, 2) FROM r UNION ALL SELECT variant, 'better_balance', (cv = m)::INT::DOUBLE FROM r""",
)
def variant_summary(spark, sf):
    infos = rk.best_k(sweep(spark, sf)).withColumnRenamed("k", "num_topics")
    vectors = table(spark, sf, "embeddings")
    parts = []
    for variant in ("bow", "tfidf"):
        t = vectors.select(rk.dominant_topic(theta(F.col("embedding"), 8, variant)).alias("topic_id"))
        parts.append(rp.topic_balance(t, 8).withColumn("variant", F.lit(variant)))
    return rp.variant_summary(infos, parts[0].unionByName(parts[1]))


@check("class_tfidf", f"WITH {q.LANG_WEIGHTS} SELECT topic_id, term, n, round(weight, 9) AS weight FROM cweights")
def class_tfidf(spark, sf):
    return language_weights(spark, sf).select("topic_id", "term", "n", F.round("weight", 9).alias("weight"))


SOURCE_CLASSES = f"srcs AS (SELECT doc_id, source FROM documents), {q.class_weights('srcs', 'source', 2)}"


@check("class_tfidf_by_source", f"WITH {SOURCE_CLASSES} SELECT source, rank, term, n, round(weight, 9) AS weight FROM cranked WHERE rank <= 10")
def class_tfidf_by_source(spark, sf):
    weights = ct.c_tf_idf(class_counts(by_language(spark, sf), "source"), "source", 2)
    best = ct.class_top_words(weights, "source", 10)
    return best.select("source", F.col("rank").cast("long").alias("rank"), "term", "n", F.round("weight", 9).alias("weight"))


@check("top_words", f"WITH {WORDS_SQL} SELECT topic_id, rank, word, round(weight, 9) AS weight FROM words WHERE rank <= 10")
def top_words(spark, sf):
    found = rk.top_words(language_words(spark, sf), 10)
    return found.select("topic_id", F.col("rank").cast("long").alias("rank"), "word", F.round("weight", 9).alias("weight"))


# Topics with outliers: the assignment above, its words, and its report.
ASSIGNED_WEIGHTS = f"{q.ASSIGNED}, {q.class_weights('assigned', 'topic_id', 2)}"
INFO_SQL = f"""{ASSIGNED_WEIGHTS},
acount AS (SELECT topic_id, count(*) AS count FROM assigned GROUP BY topic_id),
info AS (
  SELECT a.topic_id, a.count, a.topic_id || '_' || string_agg(r.term, '_' ORDER BY rank) FILTER (rank <= 4) AS name,
    string_agg(r.term, ', ' ORDER BY rank) AS words
  FROM acount a JOIN cranked r ON r.topic_id = a.topic_id AND r.rank <= 10 GROUP BY a.topic_id, a.count
)"""


def assigned_info(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    topics = assigned(spark, sf)
    docs = topics.join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    weights = ct.c_tf_idf(class_counts(docs), "topic_id", 2)
    return ct.topic_info(topics, weights), topics


@check("topic_info", f"WITH {INFO_SQL} SELECT topic_id, count, name, words AS representation FROM info")
def topic_info(spark, sf):
    info, _ = assigned_info(spark, sf)
    return info.withColumn("representation", F.array_join(F.col("representation")["word"], ", "))


@check(
    "cluster_topic_report",
    f"""WITH {INFO_SQL} SELECT topic_id, name AS topic_name, count AS doc_count,
    round(count::DOUBLE / (SELECT count(*) FROM assigned) * 100, 6) AS percentage, words AS top_words,
    (count = (SELECT max(count) FROM info WHERE topic_id <> -1) AND topic_id <> -1) AS is_predominant, (topic_id = -1) AS is_outlier FROM info""",
)
def cluster_topic_report(spark, sf):
    return rp.cluster_report(*assigned_info(spark, sf)).withColumn("percentage", F.round("percentage", 6))


@check(
    "cluster_predominance",
    f"""WITH {q.ASSIGNED}, info AS (SELECT topic_id, count(*) AS count FROM assigned GROUP BY topic_id)
    SELECT topic_id, CASE WHEN topic_id = -1 THEN 'OUT' ELSE 'T' || topic_id END AS axis_label, count AS doc_count,
    round(count::DOUBLE / (SELECT count(*) FROM assigned) * 100, 6) AS percentage,
    (topic_id <> -1 AND count = (SELECT max(count) FROM info WHERE topic_id <> -1)) AS is_predominant FROM info""",
)
def cluster_predominance(spark, sf):
    topics = assigned(spark, sf)
    info = topics.groupBy("topic_id").agg(F.count(F.lit(1)).alias("count"))
    return rp.cluster_predominance(info, topics).withColumn("percentage", F.round("percentage", 6))


@check(
    "lda_topic_report",
    f"""WITH {WORDS_SQL}, {q.ASSIGNED}, c AS (SELECT topic_id, count(*) AS n FROM assigned WHERE topic_id <> 0 GROUP BY topic_id),
    w AS (SELECT topic_id, string_agg(word, ', ' ORDER BY rank) AS top_words FROM words WHERE rank <= 10 GROUP BY topic_id)
    SELECT w.topic_id, 'Topic ' || w.topic_id AS topic_name, coalesce(c.n, 0) AS doc_count,
    round(coalesce(c.n, 0)::DOUBLE / (SELECT sum(n) FROM c) * 100, 6) AS percentage,
    top_words, (coalesce(c.n, 0) = (SELECT max(n) FROM c)) AS is_predominant FROM w LEFT JOIN c USING (topic_id)""",
)
def lda_topic_report(spark, sf):
    """The documents outside topic 0, so that one topic has words and no document."""
    words = language_words(spark, sf).withColumn("topic_name", F.concat(F.lit("Topic "), F.col("topic_id").cast("string")))
    report = rp.topic_model_report(assigned(spark, sf).where("topic_id <> 0"), words)
    return report.withColumn("percentage", F.round("percentage", 6))


@check(
    "topic_relevance",
    f"""WITH {q.LANGS}, {q.class_weights('langs', 'topic_id', 1)},
    tt AS (SELECT topic_id, sum(n)::DOUBLE AS total FROM ccounts GROUP BY topic_id),
    wt AS (SELECT term, sum(n)::BIGINT AS term_total FROM ccounts GROUP BY term), g AS (SELECT sum(total) AS everything FROM tt),
    x AS (SELECT topic_id, term, term_total, total / everything AS proportion, n / total AS phi, term_total / everything AS p,
      n::DOUBLE / term_total AS given FROM ccounts JOIN tt USING (topic_id) JOIN wt USING (term) CROSS JOIN g),
    s AS (SELECT *, p * sum(given * ln(given / proportion)) OVER (PARTITION BY term) AS saliency,
      0.6 * ln(phi) + 0.4 * ln(phi / p) AS relevance FROM x)
    SELECT topic_id, term, term_total, round(proportion, 6) AS proportion, round(phi, 9) AS phi, round(relevance, 6) AS relevance,
      round(saliency, 9) AS saliency, row_number() OVER (PARTITION BY topic_id ORDER BY relevance DESC, term) AS rank FROM s
    QUALIFY rank <= 10""",
)
def topic_relevance(spark, sf):
    found = rp.term_relevance(class_counts(by_language(spark, sf)))
    return found.select(
        "topic_id", "term", "term_total", F.round("proportion", 6).alias("proportion"), F.round("phi", 9).alias("phi"),
        F.round("relevance", 6).alias("relevance"), F.round("saliency", 9).alias("saliency"), F.col("rank").cast("long").alias("rank"),
    )


@check(
    "topic_similarity",
    f"""WITH {SOURCE_CLASSES}, z AS (SELECT source, sqrt(sum(weight * weight)) AS z FROM cweights GROUP BY source),
    u AS (SELECT source, term, weight / z AS w FROM cweights JOIN z USING (source))
    SELECT a.source AS topic_a, b.source AS topic_b, round(sum(a.w * b.w), 6) AS similarity FROM u a JOIN u b USING (term) GROUP BY ALL""",
)
def topic_similarity(spark, sf):
    packed = tr.pack(by_language(spark, sf), ["source"], class_terms(F.col("text")), whole=False)
    return ct.class_similarity(tr.class_terms(packed, "source", 2)).withColumn("similarity", F.round("similarity", 6))


@check(
    "representative_docs_by_class",
    f"""WITH {q.LANG_WEIGHTS}, dcounts AS (SELECT doc_id, topic_id, term, count(*) AS n FROM cgrams GROUP BY ALL),
    x AS (SELECT topic_id, doc_id, sum(d.n * idf * weight) AS dot, sqrt(sum(d.n * idf * d.n * idf)) AS len
      FROM dcounts d JOIN cweights w USING (topic_id, term) GROUP BY topic_id, doc_id),
    z AS (SELECT topic_id, sqrt(sum(weight * weight)) AS z FROM cweights GROUP BY topic_id)
    SELECT topic_id, doc_id, round(dot / (len * z), 6) AS similarity,
    row_number() OVER (PARTITION BY topic_id ORDER BY round(dot / (len * z), 9) DESC, doc_id) AS rank FROM x JOIN z USING (topic_id) QUALIFY rank <= 6""",
)
def representative_docs_by_class(spark, sf):
    found = ct.nearest_in_classes(language_documents(spark, sf), 6)
    return found.withColumns({"similarity": F.round("similarity", 6), "rank": F.col("rank").cast("long")})


# Embeddings with their label as topic; label 9 stands for the outliers.
VECTORS_SQL = """
v AS (SELECT vec_id, CASE WHEN label = 9 THEN -1 ELSE label END::BIGINT AS topic_id, embedding::DOUBLE[] AS e FROM embeddings),
dims AS (SELECT vec_id, topic_id, generate_subscripts(e, 1) AS d, unnest(e) AS x FROM v),
cdims AS (SELECT topic_id, d, avg(x) AS x FROM dims WHERE topic_id <> -1 GROUP BY topic_id, d),
cents AS (SELECT topic_id, list(x ORDER BY d) AS c FROM cdims GROUP BY topic_id),
sims AS (SELECT v.vec_id, cents.topic_id, list_cosine_similarity(v.e, cents.c) AS s FROM v CROSS JOIN cents WHERE v.topic_id = -1),
bst AS (SELECT vec_id, topic_id, s FROM sims QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, topic_id) = 1),
after AS (SELECT v.vec_id, CASE WHEN v.topic_id = -1 AND bst.s >= 0.25 THEN bst.topic_id ELSE v.topic_id END AS topic_id FROM v LEFT JOIN bst USING (vec_id))
"""


def labelled_vectors(spark: SparkSession, sf: str) -> DataFrame:
    topic = F.when(F.col("label") == 9, F.lit(-1)).otherwise(F.col("label")).cast("long")
    return table(spark, sf, "embeddings").select("vec_id", topic.alias("topic_id"), "embedding")


def reassigned(spark: SparkSession, sf: str) -> DataFrame:
    return sm.reassign_outliers(labelled_vectors(spark, sf), 0.25, doc_id="vec_id")


@check("reassign_outliers", f"WITH {VECTORS_SQL} SELECT vec_id, topic_id FROM after")
def reassign_outliers(spark, sf):
    return reassigned(spark, sf)


@check(
    "nearest_topic",
    f"WITH {VECTORS_SQL} SELECT vec_id, topic_id AS nearest, round(s, 6) AS similarity FROM bst",
)
def nearest_topic(spark, sf):
    vectors = labelled_vectors(spark, sf)
    found = sm.nearest_topic(vectors.where("topic_id = -1"), sm.centroids(vectors))
    return found.select("vec_id", "nearest", F.round("similarity", 6).alias("similarity"))


@check(
    "assign_new_documents",
    f"""WITH {VECTORS_SQL}, n AS (SELECT vec_id, topic_id, s FROM
      (SELECT v.vec_id, cents.topic_id, list_cosine_similarity(v.e, cents.c) AS s FROM v CROSS JOIN cents)
      QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, topic_id) = 1)
    SELECT vec_id, CASE WHEN s >= 0.25 THEN topic_id ELSE -1 END AS topic_id, round(s, 6) AS similarity FROM n""",
)
def assign_new_documents(spark, sf):
    """Every vector against the saved centroids of the labelled ones, read back from their table."""
    vectors = labelled_vectors(spark, sf)
    saved = cut_lineage(sm.centroids(vectors))
    return sm.assign_topics(vectors, saved, 0.25, doc_id="vec_id").withColumn("similarity", F.round("similarity", 6))


@check(
    "corrected_counts",
    f"""WITH {VECTORS_SQL}, b AS (SELECT topic_id, 'topic ' || topic_id AS name FROM v GROUP BY topic_id),
    a AS (SELECT topic_id, count(*) AS count FROM after GROUP BY topic_id)
    SELECT topic_id, name, coalesce(count, 0) AS count FROM b LEFT JOIN a USING (topic_id)""",
)
def corrected_counts(spark, sf):
    info = labelled_vectors(spark, sf).groupBy("topic_id").agg(F.count(F.lit(1)).alias("count")).withColumn(
        "name", F.concat(F.lit("topic "), F.col("topic_id").cast("string"))
    )
    return tp.corrected_counts(info, reassigned(spark, sf))


@check(
    "outlier_stats",
    f"""WITH {VECTORS_SQL}, s AS (SELECT (SELECT count(*) FROM v) AS n_docs, (SELECT count(*) FROM v WHERE topic_id = -1) AS outliers_before,
      (SELECT count(*) FROM after WHERE topic_id = -1) AS outliers_after)
    SELECT *, round(outliers_before::DOUBLE / n_docs * 100, 6) AS percent_before, round(outliers_after::DOUBLE / n_docs * 100, 6) AS percent_after,
    outliers_before - outliers_after AS reduced_by,
    round(outliers_before::DOUBLE / n_docs * 100 - outliers_after::DOUBLE / n_docs * 100, 6) AS reduced_points FROM s""",
)
def outlier_stats(spark, sf):
    found = sm.outlier_stats(labelled_vectors(spark, sf), reassigned(spark, sf))
    return found.withColumns({c: F.round(c, 6) for c in ("percent_before", "percent_after", "reduced_points")})


@check(
    "graph_components",
    """WITH c AS (SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
    SELECT o_orderkey AS node, component FROM c WHERE n > 1""",
)
def graph_components(spark, sf):
    """Every order is linked to the customer's order before it: chains that must end up as one component each."""
    chain = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    links = table(spark, sf, "orders").select("o_orderkey", F.lag("o_orderkey").over(chain).alias("before")).where("before is not null")
    return connected_components(links, "o_orderkey", "before")


@check(
    "topic_category_crosstab",
    f"""WITH {q.ASSIGNED}, c AS (SELECT topic_id, source, count(*) AS n FROM assigned GROUP BY ALL),
    p AS (SELECT topic_id, round(max(n)::DOUBLE / sum(n), 6) AS purity FROM c GROUP BY topic_id) SELECT * FROM c JOIN p USING (topic_id)""",
)
def topic_category_crosstab(spark, sf):
    return rp.topic_category_crosstab(assigned(spark, sf), "topic_id", "source").withColumn("purity", F.round("purity", 6))


@check(
    "open_share_by_topic",
    """SELECT o_orderpriority, count(*) AS n, count(*) FILTER (o_orderstatus = 'O') AS n_open,
    round(count(*) FILTER (o_orderstatus = 'O')::DOUBLE / count(*), 6) AS open_share FROM orders GROUP BY o_orderpriority""",
)
def open_share_by_topic(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", F.lit(" Open ")).otherwise(F.lit("closed"))
    return rp.open_share_by_topic(table(spark, sf, "orders"), "o_orderpriority", status).withColumn("open_share", F.round("open_share", 6))
