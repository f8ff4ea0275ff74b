"""Label look-ups, prompts, clean-up of answers and translations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.checks import sql as q
from topicloom.checks.registry import check, table
from topicloom.checks.topic_checks import (
    THETA_LONG_SQL,
    WORDS_SQL,
    assigned,
    assigned_info,
    by_language,
    INFO_SQL,
    language_documents,
    language_words,
)
from topicloom.functions import labels as lb
from topicloom.operators import ctfidf as ct
from topicloom.operators import topics as tp
from topicloom.operators.ranking import top_words
from topicloom.operators.termranges import ClassTerms
from topicloom.plans import labelling as lab
from topicloom.session import cut_lineage

# Labels: the first three words of the topics that have an even id; the others have none.
LABELS_SQL = f"""{WORDS_SQL}, labels3 AS (SELECT topic_id, string_agg(word, ' ' ORDER BY rank) AS label FROM words WHERE rank <= 3 GROUP BY topic_id)"""
SOME_LABELS_SQL = f"""{LABELS_SQL}, named AS (SELECT topic_id, label FROM labels3 WHERE length(label) > (SELECT min(length(label)) FROM labels3))"""


def all_labels(spark: SparkSession, sf: str) -> DataFrame:
    return lab.apply_labeler(lab.keyword_lists(language_words(spark, sf)))


def some_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Labels that are longer than the shortest one: at least one topic stays without a label."""
    labels = all_labels(spark, sf)
    return labels.where(F.length("label") > labels.agg(F.min(F.length("label"))).scalar())


@check("keyword_labels", f"WITH {LABELS_SQL} SELECT topic_id, label FROM labels3")
def keyword_labels(spark, sf):
    return all_labels(spark, sf)


@check(
    "label_doc_topics",
    f"""WITH {SOME_LABELS_SQL}, {q.ASSIGNED} SELECT a.doc_id, a.topic_id, coalesce(s.label, 'Topic ' || a.topic_id) AS topic_name
    FROM assigned a LEFT JOIN named s USING (topic_id)""",
)
def label_doc_topics(spark, sf):
    docs = assigned(spark, sf).select("doc_id", "topic_id")
    return tp.with_labels(docs, some_labels(spark, sf), "topic_id")


@check(
    "label_doc_topics_nullable",
    f"WITH {SOME_LABELS_SQL}, {q.ASSIGNED} SELECT a.doc_id, a.topic_id, s.label AS topic_name FROM assigned a LEFT JOIN named s USING (topic_id)",
)
def label_doc_topics_nullable(spark, sf):
    docs = assigned(spark, sf).select("doc_id", "topic_id")
    return tp.with_labels(docs, some_labels(spark, sf), "topic_id", default=False)


@check(
    "override_topic_names",
    f"""WITH {INFO_SQL}, {SOME_LABELS_SQL.replace('ctoks', 'ltoks').replace('cgrams', 'lgrams').replace('ccounts', 'lcounts').replace('cterm', 'lterm')
    .replace('ckept', 'lkept').replace('ctotal', 'ltotal').replace('cmean', 'lmean').replace('cweights', 'lweights').replace('cranked', 'lranked')}
    SELECT topic_id, count, coalesce(s.label, i.name) AS name FROM info i LEFT JOIN named s USING (topic_id)""",
)
def override_topic_names(spark, sf):
    info, _ = assigned_info(spark, sf)
    return tp.override_names(info.drop("representation"), some_labels(spark, sf))


# Translations: each topic turns its words to upper case; the last topic keeps its own.
PAIRS_SQL = f"""{WORDS_SQL}, pairs AS (SELECT topic_id, word, CASE WHEN topic_id = (SELECT max(topic_id) FROM words) THEN word
  ELSE upper(word) || '/' || topic_id END AS translation FROM words),
map AS (SELECT word, arg_max(translation, topic_id) AS translation FROM pairs WHERE length(word) > 2 GROUP BY word)"""


@check(
    "translate_words",
    f"WITH {PAIRS_SQL} SELECT topic_id, coalesce(translation, word) AS word, round(weight, 9) AS weight FROM words LEFT JOIN map USING (word)",
)
def translate_words(spark, sf):
    words = language_words(spark, sf)
    last = words.agg(F.max("topic_id")).scalar()
    translation = F.when(F.col("topic_id") == last, F.col("word")).otherwise(F.concat(F.upper("word"), F.lit("/"), F.col("topic_id").cast("string")))
    pairs = words.where(F.length("word") > 2).select("topic_id", "word", translation.alias("translation"))
    return tp.translate_words(words, tp.word_translations(pairs)).withColumn("weight", F.round("weight", 9))


LISTS_SQL = f"""{WORDS_SQL}, lists AS (SELECT topic_id, list(word ORDER BY rank) AS k, list(weight ORDER BY rank) AS s FROM words WHERE rank <= 10 GROUP BY topic_id)"""


@check(
    "reconcile_keywords",
    f"""WITH {LISTS_SQL}, tr AS (SELECT topic_id, k, s, list_concat(list_transform(k, lambda w: upper(w)), ['extra', 'words'])[1:8 + topic_id] AS t FROM lists),
    p AS (SELECT topic_id, k, s, t, unnest(range(1, 11)) AS i FROM tr)
    SELECT topic_id, i AS position, coalesce(t[i], k[i]) AS word, round(s[i], 9) AS score FROM p""",
)
def reconcile_keywords(spark, sf):
    """Translated lists of 8, 9, 10 and 11 words for ten scored ones: shorter, equal and longer."""
    best = top_words(language_words(spark, sf), 10)
    lists = best.groupBy("topic_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "word", F.col("weight").alias("score")))).alias("r")
    )
    scored = F.transform("r", lambda x: F.struct(x["word"], x["score"]))
    upper = F.concat(F.transform(F.col("r")["word"], F.upper), F.array(F.lit("extra"), F.lit("words")))
    both = lists.select("topic_id", scored.alias("scored"), F.slice(upper, F.lit(1), (F.col("topic_id") + 8).cast("int")).alias("translated"))
    done = both.select("topic_id", F.posexplode(lb.reconcile_keywords(F.col("scored"), F.col("translated"))).alias("p", "c"))
    return done.select("topic_id", (F.col("p") + 1).cast("long").alias("position"), "c.word", F.round("c.score", 9).alias("score"))


@check(
    "clean_labels",
    """SELECT doc_id, trim(trim(trim(trim(' "''' || source || ' "' || lang || '''" '), '"'), '''')) AS label FROM documents""",
)
def clean_labels(spark, sf):
    dirty = F.concat(F.lit(' "\''), F.col("source"), F.lit(' "'), F.col("lang"), F.lit('\'" '))
    return table(spark, sf, "documents").select("doc_id", lb.clean_label(dirty).alias("label"))


DIRTY_TRANSLATION_SQL = """CASE lang WHEN 'de' THEN 'English: broken ' || source WHEN 'fr' THEN 'TRANSLATION:' || source || ', lamp'
  WHEN 'es' THEN 'note: ' || source ELSE source || ', ' || lang END"""


@check(
    "clean_translations",
    f"""WITH t AS (SELECT doc_id, {DIRTY_TRANSLATION_SQL} AS t FROM documents),
    p AS (SELECT doc_id, CASE WHEN lower(split_part(t, ':', 1)) IN ('english', 'translation') AND contains(t, ':')
      THEN trim(substr(t, strpos(t, ':') + 1)) ELSE t END AS t FROM t),
    c AS (SELECT doc_id, CASE WHEN NOT contains(t, ',') THEN upper(t[1]) || substr(t, 2) ELSE t END AS t FROM p)
    SELECT doc_id, t AS translation, array_to_string(list_transform(string_split(t, ','), lambda w: trim(w)), '|') AS words FROM c""",
)
def clean_translations(spark, sf):
    lang, source = F.col("lang"), F.col("source")
    dirty = (
        F.when(lang == "de", F.concat(F.lit("English: broken "), source))
        .when(lang == "fr", F.concat(F.lit("TRANSLATION:"), source, F.lit(", lamp")))
        .when(lang == "es", F.concat(F.lit("note: "), source))
        .otherwise(F.concat(source, F.lit(", "), lang))
    )
    done = table(spark, sf, "documents").select("doc_id", lb.clean_translation(dirty).alias("translation"))
    return done.withColumn("words", F.array_join(lb.split_words(F.col("translation")), "|"))


@check(
    "split_label_prefix",
    f"""WITH {q.ASSIGNED}, l AS (SELECT doc_id, CASE WHEN lang = 'es' THEN source || '_x' ELSE topic_id || '_' || source || '_x' END AS label FROM assigned)
    SELECT doc_id, CASE WHEN regexp_matches(label, '^-*[0-9]+_') THEN split_part(label, '_', 1) END AS prefix,
    CASE WHEN regexp_matches(label, '^-*[0-9]+_') THEN substr(label, strpos(label, '_') + 1) ELSE label END AS body, label AS joined FROM l""",
)
def split_label_prefix(spark, sf):
    plain = F.concat(F.col("source"), F.lit("_x"))
    label = F.when(F.col("lang") == "es", plain).otherwise(F.concat(F.col("topic_id").cast("string"), F.lit("_"), plain))
    parts = assigned(spark, sf).select("doc_id", lb.label_prefix(label).alias("prefix"), lb.label_body(label).alias("body"))
    return parts.withColumn("joined", lb.join_prefix(F.col("prefix"), F.col("body")))


def examples(spark: SparkSession, sf: str, n: int, of: ClassTerms) -> DataFrame:
    texts = table(spark, sf, "documents").select("doc_id", "text")
    found = cut_lineage(ct.nearest_in_classes(of, n))  # n rows a topic, sent to the texts
    return texts.join(F.broadcast(found), "doc_id").select("topic_id", "rank", "text")


EXAMPLES_SQL = f"""{LISTS_SQL}, dcounts AS (SELECT doc_id, topic_id, term, count(*) AS n FROM cgrams GROUP BY ALL),
x AS (SELECT topic_id, doc_id, sum(d.n * idf * weight) AS dot, sqrt(sum(d.n * idf * d.n * idf)) AS len
  FROM dcounts d JOIN cweights w USING (topic_id, term) GROUP BY topic_id, doc_id),
z AS (SELECT topic_id, sqrt(sum(weight * weight)) AS z FROM cweights GROUP BY topic_id),
near AS (SELECT topic_id, doc_id, row_number() OVER (PARTITION BY topic_id ORDER BY round(dot / (len * z), 9) DESC, doc_id) AS rank FROM x JOIN z USING (topic_id))"""


def _template_sql(template: str, **values: str) -> str:
    out = "'" + template.replace("'", "''") + "'"
    for marker, value in values.items():
        out = f"replace({out}, '[{marker}]', {value})"
    return out


@check(
    "label_prompts",
    f"""WITH {EXAMPLES_SQL}, docs AS (SELECT topic_id, string_agg(rank || '. ' || left(text, 400), chr(10) ORDER BY rank) AS d
      FROM near JOIN documents USING (doc_id) WHERE rank <= 6 GROUP BY topic_id)
    SELECT topic_id, array_to_string(k, ', ') AS keywords,
    {_template_sql(lab.LABEL_TEMPLATE, KEYWORDS="array_to_string(k, ', ')", DOCUMENTS="d")} AS prompt FROM lists JOIN docs USING (topic_id)""",
)
def label_prompts(spark, sf):
    docs = language_documents(spark, sf)
    prompts = lab.label_prompts(language_words(spark, sf, of=docs), examples(spark, sf, 6, docs), lab.CLUSTER_DOC_CHARS)
    return prompts.withColumn("keywords", F.array_join("keywords", ", "))


@check(
    "label_prompts_by_probability",
    f"""WITH {THETA_LONG_SQL}, w AS (SELECT topic_id, ('word' || topic_id || i) AS word FROM (SELECT DISTINCT topic_id FROM reps), (SELECT unnest(range(0, 3)) AS i)),
    k AS (SELECT topic_id, string_agg(word, ', ' ORDER BY word) AS k FROM w GROUP BY topic_id),
    docs AS (SELECT topic_id, string_agg(rank || '. ' || left(text, 200), chr(10) ORDER BY rank) AS d FROM reps JOIN documents USING (doc_id)
      WHERE rank <= 6 GROUP BY topic_id)
    SELECT topic_id::BIGINT AS topic_id, {_template_sql(lab.LABEL_TEMPLATE, KEYWORDS="k", DOCUMENTS="d")} AS prompt FROM k JOIN docs USING (topic_id)""",
)
def label_prompts_by_probability(spark, sf):
    from topicloom.checks.topic_checks import representatives

    found = representatives(spark, sf, 6).select(F.col("topic_id").cast("long").alias("topic_id"), "rank", "text")
    ids = found.select("topic_id").distinct()
    words = ids.select("topic_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("i")).select(
        "topic_id", F.concat(F.lit("word"), F.col("topic_id").cast("string"), F.col("i").cast("string")).alias("word"), F.lit(1.0).alias("weight")
    )
    return lab.label_prompts(words, found).select("topic_id", "prompt")


@check(
    "translation_prompts",
    f"""WITH {EXAMPLES_SQL}, docs AS (SELECT topic_id, string_agg(rank || '. ' || left(text, 150), chr(10) ORDER BY rank) AS d
      FROM near JOIN documents USING (doc_id) WHERE rank <= 3 AND topic_id <> 2 GROUP BY topic_id)
    SELECT topic_id, CASE WHEN d IS NULL THEN {_template_sql(lab.TRANSLATE_TEMPLATE, TEXT="array_to_string(k, ', ')")}
    ELSE {_template_sql(lab.TRANSLATE_IN_CONTEXT_TEMPLATE, TEXT="array_to_string(k, ', ')", DOCUMENTS="d")} END AS prompt FROM lists LEFT JOIN docs USING (topic_id)""",
)
def translation_prompts(spark, sf):
    """Topic 2 has no examples, so its prompt is the plain one."""
    counted = language_documents(spark, sf)
    docs = lab.example_lists(examples(spark, sf, 3, counted).where("topic_id <> 2"), 3)
    lists = lab.keyword_lists(language_words(spark, sf, of=counted)).join(docs, "topic_id", "left")
    asked = lists.withColumns({"t": F.array_join("keywords", ", "), "docs": F.coalesce("docs", F.array().cast("array<string>"))})
    return lab.translation_prompts(asked, F.col("t"), F.col("docs")).select("topic_id", "prompt")


@check(
    "labelled_tables",
    f"""WITH {LABELS_SQL}, {q.LANGS.replace('langs', 'langs2')} SELECT doc_id, l.topic_id AS dominant_topic, label AS dominant_topic_name, 'bow' AS variant, lang AS language
    FROM langs2 l JOIN labels3 USING (topic_id) CROSS JOIN (SELECT unnest(['de', 'en']) AS lang)""",
)
def labelled_tables(spark, sf):
    """German labels and, without a translator, the same labels as English ones."""
    docs = by_language(spark, sf).select("doc_id", F.col("topic_id").alias("dominant_topic"))
    counted = language_documents(spark, sf)
    done = lab.run_labelling(language_words(spark, sf, of=counted), docs, examples(spark, sf, 6, counted), "bow")
    return done["de"][1].unionByName(done["en"][1])
