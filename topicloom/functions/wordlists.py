"""Word lists used while cleaning and while naming topics."""

from __future__ import annotations

from functools import cache
from importlib import resources

# Courtesy, salutation and address words dropped from strongly cleaned text.
STRONG_EXTRA_STOPWORDS = (
    "bitte", "danke", "vielen", "dank",
    "hallo", "guten", "tag",
    "sehr", "geehrt", "geehrte", "geehrter",
    "freundlich", "freundlichen", "grüße", "gruss", "gruß", "gruesse",
    "mit", "besten", "anbei", "bzgl", "bzw",
    "herr", "damen", "dame",
    "str", "strasse", "straße", "nr", "nummer", "hausnummer",
)

# Words kept out of cluster topic names only.
CLUSTER_EXTRA_STOPWORDS = (
    "bitte", "danke", "hallo",
    "freundlich", "freundlichen",
    "grüße", "grüßen", "gruß", "gruss", "grussen", "grüssen", "gruesse",
    "herzlich", "herzlichen",
    "hochachtungsvoll",
    "sehr", "geehrt", "geehrte", "geehrter", "geehrten",
    "etc", "usw",
    "mfg", "vg",
    "bzw",
    "str", "straße", "strasse", "nr", "hausnummer",
)

# Texts that stand for "no text".
PLACEHOLDERS_STRICT = ("nan", "none", "null")
PLACEHOLDERS_LOOSE = ("none", "nan")


@cache
def base_stopwords(language: str = "german") -> tuple[str, ...]:
    """The base list, which equals Spark's own list of the language; any other can be passed wherever stop words are taken.

    It is a data file of the package, so neither a session nor Spark's files are needed to read it.
    """
    text = resources.files(__package__).joinpath(f"stopwords_{language}.txt").read_text(encoding="utf-8")
    return tuple(text.split())


def strong_stopwords(language: str = "german") -> list[str]:
    return sorted(set(base_stopwords(language)) | set(STRONG_EXTRA_STOPWORDS))


def cluster_stopwords(language: str = "german") -> list[str]:
    return sorted(set(base_stopwords(language)) | set(CLUSTER_EXTRA_STOPWORDS))
