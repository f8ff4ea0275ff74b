"""Quality rules: base rules, and a hashed n-gram log-likelihood ratio between trusted and raw text.

Words and pairs of neighbouring words are hashed into ``buckets``. One multinomial over the buckets is counted from trusted documents, one
from all documents of the corpus; each bucket's weight is the logarithm of the ratio of its two smoothed probabilities. A document's
value is the mean weight of its words and pairs, so it does not depend on the length. It is kept if it passes the base rules
and its value reaches ``threshold``; nothing is drawn at random.

Base rules: fewer than ``min_words`` words, or more than ``max_repeat_percent`` % of the words inside windows of eight words that occur
twice or more in the text, fail.

Trusted documents are a documented sample: the ``max_trusted`` documents with the smallest hash of the id among those whose labels all
say ``quality = 1``. The raw counts cover all documents. Everything is DataFrame functions; documents are never shuffled: only
partial counts of buckets and the sample of ids move. Windows are compared by 64-bit hashes within one text.

Defined cases: a null or empty text has no words and fails the base rules; its value is 0. Without trusted documents all values are
alike for all buckets and near 0. Repeated rows and null ids are counted and judged like others; extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.functions.text import compute_once
from topicloom.llm.common import WHITE, require, sample_by_hash, text_or_empty
from topicloom.session import cut_lineage

# The characters counted as symbols.
SYMBOLS = "#*$%&|<>"
_WINDOW = 8


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 16
    smoothing: float = 1.0
    max_trusted: int = 20_000
    threshold: float = -0.1
    min_words: int = 20
    max_repeat_percent: int = 30


def _shifted_pairs(hashes: Column, by: int) -> Column:
    """Hashes of each element with the one ``by`` places later."""
    left = F.greatest(F.size(hashes) - by, F.lit(0))
    return F.zip_with(F.slice(hashes, F.lit(1), left), F.slice(hashes, F.lit(1 + by), left), lambda a, b: F.xxhash64(a, b))


def word_hashes(docs: DataFrame) -> DataFrame:
    """``docs`` with ``one`` and ``two``: the hashes of its words and of its pairs of neighbouring words."""
    words = F.filter(F.split("text", f"[{WHITE}]+"), lambda w: w != "")
    hashed = compute_once(docs, {"one": F.transform(words, lambda w: F.xxhash64(w))})
    return compute_once(hashed, {"two": _shifted_pairs(F.col("one"), 1)})


def _bucket(buckets: int):
    return lambda h: F.pmod(h, F.lit(buckets)).cast("int")


def trusted_ids(labels: DataFrame, max_trusted: int) -> DataFrame:
    """At most ``max_trusted`` ids, so the table may be broadcast."""
    known = require(labels, "doc_id", "quality").where("doc_id is not null and quality is not null")
    good = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    return sample_by_hash(good, max_trusted, "doc_id")


def bucket_weights(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """``(bucket, weight)`` for every bucket, from all documents and the trusted ones."""
    spark, s = docs.sparkSession, settings
    trusted = cut_lineage(trusted_ids(labels, s.max_trusted)).withColumn("trusted", F.lit(True))
    texts = require(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text")).join(F.broadcast(trusted), "doc_id", "left")
    hashed = word_hashes(texts.select("trusted", "text"))
    found = hashed.select("trusted", F.explode(F.concat("one", "two")).alias("h")).select("trusted", _bucket(s.buckets)(F.col("h")).alias("bucket"))
    counts = cut_lineage(found.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("target")))
    total = counts.agg(F.coalesce(F.sum("raw"), F.lit(0)).alias("raw"), F.coalesce(F.sum("target"), F.lit(0)).alias("target")).first()
    every = spark.range(s.buckets).select(F.col("id").cast("int").alias("bucket")).join(counts, "bucket", "left")
    log_p = lambda c: F.log((F.coalesce(F.col(c), F.lit(0)) + s.smoothing) / (total[c] + s.smoothing * s.buckets))
    return every.select("bucket", (log_p("target") - log_p("raw")).alias("weight"))


def with_repeat_words(hashed: DataFrame) -> DataFrame:
    """``hashed`` with ``n_repeat_words``: the words inside repeated windows of eight, from the pairs' hashes.

    Windows of four and eight are hashed from smaller ones. Only texts in which a window repeats are looked at closely: their windows are
    sorted by hash, those with an equal neighbour repeat, and the words that they cover are summed from the gaps between them.
    """
    eight = compute_once(hashed, {"eight": _shifted_pairs(_shifted_pairs(F.col("two"), 2), 4)})
    sorted_ = F.array_sort(F.transform("eight", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    placed = compute_once(eight, {"placed": F.when(F.size(F.array_distinct("eight")) < F.size("eight"), sorted_)})
    same = lambda x, k, by: F.coalesce(F.get(F.col("placed"), k + by)["h"] == x["h"], F.lit(False))
    repeated = F.transform(F.filter("placed", lambda x, k: same(x, k, -1) | same(x, k, 1)), lambda x: x["i"])
    at = compute_once(placed, {"at": F.when(F.col("placed").isNotNull(), F.array_sort(repeated))})
    but_last, but_first = F.slice("at", F.lit(1), F.size("at") - 1), F.slice("at", F.lit(2), F.size("at") - 1)
    gaps = F.zip_with(but_last, but_first, lambda a, b: F.least(b - a, F.lit(_WINDOW)))
    covered = F.when(F.col("at").isNotNull(), F.aggregate(gaps, F.lit(_WINDOW), lambda acc, x: acc + x)).otherwise(0)
    return at.select(*hashed.columns, covered.cast("long").alias("n_repeat_words"))


def score(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Counts, base verdict, value and verdict of every document."""
    s = settings
    weights = bucket_weights(docs, labels, s)
    # One value per bucket, at its place; it reaches the tasks as one constant of the plan.
    table = weights.select(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "weight"))), lambda x: x["weight"])).scalar()
    hashed = word_hashes(require(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text")))
    worked = with_repeat_words(hashed)
    bare = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(f"[^{WHITE}]"))
    add = lambda acc, h: acc + F.element_at(F.col("_weights"), _bucket(s.buckets)(h) + 1)
    total = F.aggregate("two", F.aggregate("one", F.lit(0.0), add), add)
    n_grams = F.size("one") + F.size("two")
    counted = worked.withColumn("_weights", table)
    counted = compute_once(
        counted,
        {
            "n_words": F.size("one").cast("long"),
            "word_chars": F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long"),
            "n_symbols": bare(SYMBOLS).cast("long"),
            "lines": lines,
            "llr": F.when(n_grams > 0, total / n_grams).otherwise(0.0),
        },
    )
    failed = (F.col("n_words") < s.min_words) | (100 * F.col("n_repeat_words") > s.max_repeat_percent * F.col("n_words"))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("llr") >= s.threshold)).alias("kept"), "llr",
    )
