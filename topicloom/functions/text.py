"""Text cleaning as column expressions: no Python runs per row.

``(?U)`` makes Java's ``\\s`` and ``\\S`` cover Unicode whitespace such as a no-break space.
"""

from __future__ import annotations

import string
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as a URL, an e-mail address and a kept character.
URL = r"(?U)http\S+|www\.\S+"
EMAIL = r"(?U)\S+@\S+\.\S+"
# The same matches in linear time. A match is always a whole run without spaces, so it starts where a run starts; in it, the first @ after one
# character and the first dot after one more decide, and nothing is tried twice.
EMAIL_RUN = r"(?U)(?<!\S)\S[^\s@]*+@\S[^\s.]*+\.\S++"
# The kept characters are spelled out: Java looks single characters up in a table, ranges one by one.
KEPT = string.digits + string.ascii_letters + "ÄÖÜäöüß"
NOT_KEPT = f"[^{KEPT} ]+"
NOT_KEPT_OR_SPACE = f"[^{KEPT}]+"
NBSP = "\u00a0"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def trim_any(text: Column) -> Column:
    """Trim every kind of whitespace (Spark's ``trim`` only knows the space character)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


def compute_once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Adds columns behind a one-row generator, so a filter above cannot copy their expressions."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def strip_urls(text: Column) -> Column:
    """A plain substring test spares the pattern for texts that cannot match."""
    may_match = F.contains(text, F.lit("http")) | F.contains(text, F.lit("www."))
    return F.when(may_match, F.regexp_replace(text, URL, " ")).otherwise(text)


def strip_emails(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, EMAIL_RUN, " ")).otherwise(text)


def strip_symbols(text: Column) -> Column:
    return F.regexp_replace(text, NOT_KEPT, " ")


def collapse_spaces(text: Column) -> Column:
    return trim_any(F.regexp_replace(text, r"(?U)\s+", " "))


def without_noise(text: Column) -> Column:
    """URLs out first, then e-mails; text without an ``@`` has none before and after."""
    no_urls = strip_urls(text_or_empty(text))
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(no_urls, EMAIL_RUN, " ")).otherwise(no_urls)


def normalise(text: Column) -> Column:
    """URLs, e-mails and symbols out, single spaces between words.

    After the symbols are gone the space is the only whitespace left, so one pattern does both steps.
    """
    return F.trim(F.regexp_replace(without_noise(text), NOT_KEPT_OR_SPACE, " "))


def raw_words(text: Column) -> Column:
    """The words of the normalised text; the first and the last may be empty."""
    return F.split(without_noise(text), NOT_KEPT_OR_SPACE)


def words(text: Column) -> Column:
    """Split cleaned text on single spaces; empty text has no words."""
    return F.filter(F.split(text, " "), lambda w: w != "")


def light_words(found: Column) -> Column:
    """One-letter alphabetic words go, single digits stay."""
    return F.filter(found, lambda w: (F.length(w) > 1) | ((w >= "0") & (w <= "9")))


def light_tokens(text: Column, lowercase: bool = True) -> Column:
    """Light cleaning as tokens."""
    kept = light_words(raw_words(text))
    return F.transform(kept, F.lower) if lowercase else kept


def light_text(found: Column, lowercase: bool = True) -> Column:
    joined = F.array_join(light_words(found), " ")
    return F.lower(joined) if lowercase else joined


def clean_light(text: Column, lowercase: bool = True) -> Column:
    return light_text(raw_words(text), lowercase)


def candidate_words(found: Column) -> Column:
    """Words that may be lemmatised: neither empty nor pure digits, in their original case."""
    return F.filter(found, lambda w: F.ltrim(w, F.lit(string.digits)) != "")


def strong_candidates(text: Column) -> Column:
    return candidate_words(raw_words(text))


def keep_lemmas(lemmas: Column, stopwords: Iterable[str]) -> Column:
    """Drop stop words and lemmas under three characters; repeats stay."""
    stop = list(stopwords)
    return F.filter(lemmas, lambda w: (F.length(w) >= 3) & ~w.isin(stop))


def strong_words(found: Column, stopwords: Iterable[str], lowercase: bool = True) -> Column:
    """Strong cleaning with the identity lemmatiser; see ``operators.lexicon`` for a lexicon."""
    lemmas = candidate_words(found)
    return keep_lemmas(F.transform(lemmas, F.lower) if lowercase else lemmas, stopwords)


def strong_tokens(text: Column, stopwords: Iterable[str], lowercase: bool = True) -> Column:
    return strong_words(raw_words(text), stopwords, lowercase)


def clean_strong(text: Column, stopwords: Iterable[str], lowercase: bool = True) -> Column:
    return F.array_join(strong_tokens(text, stopwords, lowercase), " ")


def bigrams(tokens: Column) -> Column:
    """Adjacent pairs by ``zip_with``, which stays cheap when the optimiser copies it."""
    rest = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.zip_with(
        F.slice(tokens, F.lit(1), rest),
        F.slice(tokens, F.lit(2), rest),
        lambda a, b: F.concat_ws(" ", a, b),
    )


def ngrams(tokens: Column, ngram_range: tuple[int, int] = (1, 2)) -> Column:
    """All unigrams, then all bigrams, in text order."""
    if tuple(ngram_range) == (1, 1):
        return tokens
    if tuple(ngram_range) == (1, 2):
        return F.concat(tokens, bigrams(tokens))
    raise ValueError("ngram_range must be (1, 1) or (1, 2)")


def is_real_text_strict(text: Column, placeholders: Iterable[str]) -> Column:
    """Not null, not blank and no placeholder once no-break spaces and runs are normalised."""
    clean = collapse_spaces(F.replace(text, F.lit(NBSP), F.lit(" ")))
    return text.isNotNull() & (clean != "") & ~F.lower(clean).isin(list(placeholders))


def is_real_text_loose(text: Column, placeholders: Iterable[str]) -> Column:
    """The weaker test: a null reads as the placeholder ``nan``."""
    clean = trim_any(F.coalesce(text, F.lit("nan")))
    return (clean != "") & ~F.lower(clean).isin(list(placeholders))


def numbered_list(texts: Column, max_chars: int) -> Column:
    """``1. first`` … one line per text, each cut to ``max_chars``."""
    lines = F.transform(
        texts,
        lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), F.substring(t, 1, max_chars)),
    )
    return F.array_join(lines, "\n")


def fill_template(template: str, values: dict[str, Column]) -> Column:
    filled = F.lit(template)
    for marker, value in values.items():
        filled = F.replace(filled, F.lit(marker), value)
    return filled
