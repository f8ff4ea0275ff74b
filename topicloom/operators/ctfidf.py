"""Class-based TF-IDF: topic words, topic info and the documents nearest to a topic."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.text import ngrams
from topicloom.operators.features import count_terms, count_terms_of_classes
from topicloom.operators.heavy import heavy_join
from topicloom.operators.ranking import top_n
from topicloom.operators.similarity import similarity_of_lists
from topicloom.operators.termranges import ClassTerms, class_terms, pack


def topic_terms(text: Column, stopwords: Iterable[str] = (), ngram_range: tuple[int, int] = (1, 2)) -> Column:
    """Lower-case words of two characters or more, stop words out, and only then the bigrams."""
    stop = list(stopwords)
    # A match takes a whole run of word characters, so it needs no tests of its borders.
    found = F.regexp_extract_all(F.lower(text), F.lit(r"(?U)\w\w+"), F.lit(0))
    if stop:
        found = F.filter(found, lambda w: ~w.isin(stop))
    return ngrams(found, ngram_range)


def class_counts(
    docs: DataFrame, cls: str, terms: Column, doc_id: str = "doc_id", per_doc: bool = False
) -> DataFrame:
    """Term counts per class (or per document and class), added up in pieces of text before the shuffle; no task holds a table of all its terms.

    Bigrams that come with every token need not be made as texts: :func:`token_counts` counts them by numbers.
    """
    if per_doc:
        return count_terms(docs, [doc_id, cls], terms, lambda t: t, "n")
    return count_terms_of_classes(docs, cls, terms)


def token_counts(docs: DataFrame, cls: str, tokens: Column) -> DataFrame:
    """Counts per class of tokens and of pairs of tokens in a row, as :func:`class_counts` gives of their ``ngrams``; token lists hold no nulls."""
    return count_terms_of_classes(docs, cls, tokens, pairs=True)


def shared_terms(counts: DataFrame, cls: str, min_classes: int = 2) -> DataFrame:
    """``(class, term, n, f)`` of the terms of ``min_classes`` classes or more, ``f`` being the term's count over all classes.

    The window sees one term's row per class, so the number of classes bounds it.
    """
    per_term = Window.partitionBy("term")
    return (
        counts.withColumn("f", F.sum("n").over(per_term))
        .withColumn("_classes", F.count(F.lit(1)).over(per_term))
        .where(F.col("_classes") >= min_classes)
        .select(cls, "term", "n", "f")
    )


def c_tf_idf(counts: DataFrame, cls: str, min_classes: int = 2) -> DataFrame:
    """``(class, term, n, weight, idf)`` with weight = share in the class times ``ln(1 + A / f)``.

    ``f`` is the term's count over all classes, ``A`` the whole-number mean of the class
    totals. ``min_classes`` is the least number of classes a term has to occur in.
    """
    return term_weights(shared_terms(counts, cls, min_classes), cls)


def term_weights(kept: DataFrame, cls: str) -> DataFrame:
    """The weights of :func:`c_tf_idf` from its :func:`shared_terms`, which are read twice: who can writes them first.

    Class totals are a table with one row per class, and each row holds their mean as well.
    """
    totals = kept.groupBy(cls).agg(F.sum("n").alias("class_total"))
    totals = totals.withColumn("_mean", F.floor(F.avg("class_total").over(Window.partitionBy(F.lit(0)))))
    # Sent to the tasks: a shuffle by class would bring all terms of a class into one.
    return kept.join(F.broadcast(totals), cls).select(
        cls, "term", "n",
        F.ln(F.col("_mean") / F.col("f") + F.lit(1.0)).alias("idf"),
        (F.col("n") / F.col("class_total")).alias("share"),
    ).withColumn("weight", F.col("share") * F.col("idf"))


def class_weights(docs: DataFrame, cls: str, tokens: Column, min_classes: int = 2, pairs: bool = True) -> DataFrame:
    """The weights of :func:`c_tf_idf` of tokens and, with ``pairs``, of two in a row; counted by chunks and ranges of terms, and written."""
    return term_weights(class_terms(pack(docs, [cls], tokens, pairs, whole=False), cls, min_classes).rows(), cls)


def class_top_words(weights: DataFrame, cls: str, n: int = 10) -> DataFrame:
    return top_n(weights, cls, [F.desc("weight"), F.col("term")], n)


def topic_info(assigned: DataFrame, weights: DataFrame, cls: str = "topic_id", words: int = 10) -> DataFrame:
    """``(topic, count, name, representation)``; the name is the id and the first four words."""
    best = (
        class_top_words(weights, cls, words)
        .groupBy(cls)
        .agg(F.array_sort(F.collect_list(F.struct("rank", F.col("term").alias("word"), F.col("weight").alias("score")))).alias("r"))
        .select(cls, F.transform("r", lambda x: F.struct(x["word"], x["score"])).alias("representation"))
    )
    counts = assigned.groupBy(cls).agg(F.count(F.lit(1)).alias("count"))
    names = F.concat_ws("_", F.col(cls).cast("string"), F.slice(F.col("representation")["word"], 1, 4))
    return counts.join(best, cls, "left").select(cls, "count", names.alias("name"), "representation")


def nearest_documents(
    doc_counts: DataFrame, weights: DataFrame, cls: str, n: int = 3, doc_id: str = "doc_id"
) -> DataFrame:
    """The ``n`` documents of each class whose own weighted terms are closest to the class (cosine)."""
    # A class's count of a term bounds the documents that hold it.
    cell = heavy_join(doc_counts, weights.select(cls, "term", "idf", "weight", F.col("n").alias("_class_n")), [cls, "term"], "_class_n", hashed=True)
    own = F.col("n") * F.col("idf")  # the document's length scales out of the cosine
    sims = cell.groupBy(cls, doc_id).agg(
        F.sum(own * F.col("weight")).alias("_dot"), F.sqrt(F.sum(own * own)).alias("_len")
    )
    sizes = weights.groupBy(cls).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_class_len"))
    scored = sims.join(sizes, cls).withColumn(
        "similarity", F.when(F.col("_len") * F.col("_class_len") > 0, F.col("_dot") / (F.col("_len") * F.col("_class_len"))).otherwise(F.lit(0.0))
    )
    return top_n(scored, cls, [F.desc(F.round("similarity", 9)), F.col(doc_id)], n).select(cls, doc_id, "similarity", "rank")


def class_similarity(counted: ClassTerms) -> DataFrame:
    """Cosine of every two classes' weights from counted terms, which hold all classes of a term in one row: terms are not shuffled again.

    Class totals scale out of the cosine.
    """
    terms = counted.rows()
    mean = terms.groupBy(counted.cls).agg(F.sum("n").alias("n")).agg(F.floor(F.avg("n"))).first()[0] or 0
    idf = F.ln(F.lit(float(mean)) / F.col("f") + F.lit(1.0))
    known = F.filter(F.arrays_zip("classes", "ns"), lambda x: x["classes"].isNotNull())
    lists = counted.by_term().select(F.transform(known, lambda x: F.struct(x["classes"].alias("topic"), (x["ns"] * idf).alias("w"))).alias("x"))
    own = F.col("n") * idf
    sizes = terms.where(F.col(counted.cls).isNotNull()).groupBy(F.col(counted.cls).alias("topic")).agg(F.sqrt(F.sum(own * own)).alias("size"))
    return similarity_of_lists(lists, sizes)


def nearest_in_classes(counted: ClassTerms, n: int = 3, doc_id: str = "doc_id") -> DataFrame:
    """:func:`nearest_documents` of documents in chunks, whose ``counted`` terms were asked for with answers: terms meet their weights in the chunk.

    A class's total scales out of the cosine like a document's length.
    """
    cls, terms = counted.cls, counted.rows()
    mean = terms.groupBy(cls).agg(F.sum("n").alias("n")).agg(F.floor(F.avg("n"))).first()[0] or 0
    own = F.col("n") * F.ln(F.lit(float(mean)) / F.col("f") + F.lit(1.0))
    sizes = terms.groupBy(cls).agg(F.sqrt(F.sum(own * own)).alias("_class_len"))  # a row per class
    scored = counted.cosines(float(mean)).join(F.broadcast(sizes), cls).withColumn(
        "similarity", F.when(F.col("len") * F.col("_class_len") > 0, F.col("dot") / (F.col("len") * F.col("_class_len"))).otherwise(F.lit(0.0))
    )
    return top_n(scored, cls, [F.desc(F.round("similarity", 9)), F.col(doc_id)], n).select(cls, doc_id, "similarity", "rank")
