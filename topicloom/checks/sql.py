"""SQL fragments of the oracles: the same semantics, said independently in DuckDB's dialect."""

from __future__ import annotations

from topicloom.functions.wordlists import CLUSTER_EXTRA_STOPWORDS, STRONG_EXTRA_STOPWORDS, base_stopwords


def quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def strong_stop_list() -> str:
    return quoted(sorted(set(base_stopwords()) | set(STRONG_EXTRA_STOPWORDS)))


def no_urls(c: str) -> str:
    return rf"regexp_replace({c}, 'http\S+|www\.\S+', ' ', 'g')"


def no_emails(c: str) -> str:
    return rf"regexp_replace({c}, '\S+@\S+\.\S+', ' ', 'g')"


def no_symbols(c: str) -> str:
    return f"regexp_replace({c}, '[^0-9A-Za-zÄÖÜäöüß ]+', ' ', 'g')"


def norm(c: str) -> str:
    bare = no_symbols(no_emails(no_urls(f"coalesce({c}, '')")))
    return rf"trim(regexp_replace({bare}, '\s+', ' ', 'g'))"


def light_list(c: str) -> str:
    return (
        f"list_filter(string_split(lower({norm(c)}), ' '), "
        "lambda w: w <> '' AND NOT regexp_full_match(w, '[A-Za-zÄÖÜäöüß]'))"
    )


def light(c: str) -> str:
    return f"array_to_string({light_list(c)}, ' ')"


def candidates(c: str) -> str:
    return f"list_filter(string_split({norm(c)}, ' '), lambda w: w <> '' AND NOT regexp_full_match(w, '[0-9]+'))"


def strong_list(c: str) -> str:
    return (
        f"list_filter(list_transform({candidates(c)}, lambda w: lower(w)), "
        f"lambda w: length(w) >= 3 AND NOT list_contains([{strong_stop_list()}], w))"
    )


def strong(c: str) -> str:
    return f"array_to_string({strong_list(c)}, ' ')"


def bigrams(c: str) -> str:
    return f"list_transform(range(1, len({c})), lambda i: {c}[i] || ' ' || {c}[i + 1])"


def grams(c: str) -> str:
    return f"list_concat({c}, {bigrams(c)})"


# Term counts of the strongly cleaned documents, their vocabulary and weights.
TERMS = f"""
toks AS (SELECT doc_id, {strong_list('text')} AS t FROM documents),
grams AS (SELECT doc_id, unnest({grams('t')}) AS term FROM toks),
counts AS (SELECT doc_id, term, count(*) AS tf FROM grams GROUP BY ALL),
n AS (SELECT count(*) AS n FROM documents),
vocab AS (
  SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM counts GROUP BY term
  HAVING count(*) >= 2 AND count(*) <= 0.85::DOUBLE * (SELECT n FROM n)
),
bow AS (SELECT doc_id, term, tf FROM counts SEMI JOIN vocab USING (term)),
raw AS (
  SELECT b.doc_id, b.term, b.tf, b.tf * (ln((1 + n.n)::DOUBLE / (1 + v.df)) + 1) AS w
  FROM bow b JOIN vocab v USING (term) CROSS JOIN n
),
norms AS (SELECT doc_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY doc_id),
tfidf AS (SELECT doc_id, term, tf, w / norm AS tfidf FROM raw JOIN norms USING (doc_id))
"""

LANG_ID = "CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'es' THEN 2 WHEN 'fr' THEN 3 END"

# A stand-in assignment: the language as topic, documents of low quality as outliers.
ASSIGNED = f"""
assigned AS (
  SELECT d.doc_id, CASE WHEN l.quality = 0 THEN -1 ELSE {LANG_ID} END::BIGINT AS topic_id, d.lang, d.source, l.quality
  FROM documents d LEFT JOIN labels l USING (doc_id)
)
"""


def class_weights(classes: str, cls: str, min_classes: int) -> str:
    """Class-based TF-IDF of the lightly cleaned documents; ``classes`` has ``(doc_id, cls)``."""
    return f"""
ctoks AS (
  SELECT c.doc_id, c.{cls}, list_filter({light_list('d.text')}, lambda w: length(w) >= 2 AND
    NOT list_contains([{quoted(CLUSTER_EXTRA_STOPWORDS)}], w)) AS t
  FROM documents d JOIN {classes} c USING (doc_id)
),
cgrams AS (SELECT doc_id, {cls}, unnest({grams('t')}) AS term FROM ctoks),
ccounts AS (SELECT {cls}, term, count(*) AS n FROM cgrams GROUP BY ALL),
cterm AS (SELECT term, sum(n)::BIGINT AS f FROM ccounts GROUP BY term HAVING count(*) >= {min_classes}),
ckept AS (SELECT c.{cls}, c.term, c.n, t.f FROM ccounts c JOIN cterm t USING (term)),
ctotal AS (SELECT {cls}, sum(n)::BIGINT AS total FROM ckept GROUP BY {cls}),
cmean AS (SELECT floor(avg(total)) AS a FROM ctotal),
cweights AS (
  SELECT k.{cls}, k.term, k.n, ln(1 + m.a / k.f) AS idf, k.n::DOUBLE / t.total * ln(1 + m.a / k.f) AS weight
  FROM ckept k JOIN ctotal t USING ({cls}) CROSS JOIN cmean m
),
cranked AS (SELECT *, row_number() OVER (PARTITION BY {cls} ORDER BY weight DESC, term) AS rank FROM cweights)
"""


LANGS = f"langs AS (SELECT doc_id, ({LANG_ID})::BIGINT AS topic_id FROM documents)"
LANG_WEIGHTS = f"{LANGS}, {class_weights('langs', 'topic_id', 1)}"
