"""N-gram counts, vocabulary, bag of words and TF-IDF.

The long form ``(doc, term, tf)`` is the working table. Its rows are counted document by document, without a shuffle of terms; who
reads it more than once writes it first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.functions.text import ngrams
from topicloom.operators.heavy import heavy_join
from topicloom.session import cut_lineage

_CHUNK_TERMS = 1 << 19  # terms of about so many are counted at once


def count_rows(df: DataFrame) -> Column:
    """The row count as a scalar subquery: no cross join and no driver round trip."""
    return df.agg(F.count(F.lit(1)).alias("n")).scalar()


def term_counts(
    docs: DataFrame, tokens: Column, doc_id: str = "doc_id", ngram_range: tuple[int, int] = (1, 2)
) -> DataFrame:
    """``(doc_id, term, tf)``: how often a document holds a term; rows of the same id are one document."""
    return count_terms(docs, [doc_id], tokens, lambda t: ngrams(t, ngram_range))


def count_terms(docs: DataFrame, keys: list[str], tokens: Column, terms: Callable[[Column], Column], n: str = "tf") -> DataFrame:
    """``(*keys, term, n)``: how often rows of the same keys hold a term, where ``terms`` makes terms of token lists.

    Keys are looked at first. If none come twice, nothing is shuffled; else token lists are brought together by their keys. A task counts
    the terms of some documents at a time and holds no table of all pairs.
    """
    lists = docs.select(*keys, tokens.alias("_tokens"))
    if not docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        lists = lists.repartition(*keys).sortWithinPartitions(*keys)
    kinds = T.StructType([*[docs.schema[k] for k in keys], T.StructField("term", T.StringType()), T.StructField(n, T.LongType())])
    return lists.select(*keys, terms(F.col("_tokens")).alias("_terms")).mapInArrow(_counted(kinds.names), kinds)


def _counted(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Count the terms of rows that come in order of their keys; the last document waits for more rows of its keys."""
    term, n = names[-2:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for keys, sizes, terms in _chunks(batches):
            same = np.ones(len(sizes) - 1, bool)
            for k in keys:
                equal = pc.if_else(pc.is_null(k[1:]), pc.is_null(k[:-1]), pc.fill_null(pc.equal(k[1:], k[:-1]), False))
                same &= equal.to_numpy(zero_copy_only=False).astype(bool)
            document = np.append(0, np.cumsum(~same))
            starts = pa.array(np.flatnonzero(np.append(True, ~same)))
            first = [k.take(starts) for k in keys]
            coded = terms.dictionary_encode()
            codes = coded.indices.fill_null(-1).to_numpy()
            pairs, times = np.unique(np.repeat(document, sizes)[codes >= 0] << 32 | codes[codes >= 0], return_counts=True)
            owner = pa.array(pairs >> 32)
            found = pa.Table.from_arrays([*[f.take(owner) for f in first], coded.dictionary.take(pa.array(pairs & 0xFFFFFFFF)), pa.array(times, pa.int64())], names)
            mine = [f[0] for f in first]
            if held is not None and all(a.equals(b) for a, b in zip(held[0], mine, strict=True)):
                ends = int(np.searchsorted(pairs, 1 << 32))
                more = pa.concat_tables([held[1], found.slice(0, ends)]).group_by(term).aggregate([(n, "sum")])
                zeros = pa.array(np.zeros(more.num_rows, np.int64))
                held = mine, pa.Table.from_arrays([*[f.take(zeros) for f in first], more.column(term), more.column(f"{n}_sum")], names)
                found, pairs = found.slice(ends), pairs[ends:]
                if document[-1] == 0:
                    continue
            if held is not None:
                yield from held[1].to_batches()
            last = int(np.searchsorted(pairs, int(document[-1]) << 32))
            yield from found.slice(0, last).to_batches()
            held = [f[-1] for f in first], found.slice(last)
        if held is not None:
            yield from held[1].to_batches()

    return run


def count_terms_of_classes(docs: DataFrame, cls: str, terms: Column, n: str = "n", pairs: bool = False) -> DataFrame:
    """``(cls, term, n)`` of classes of many documents: added up in pieces of text first, then by term, where a term's rows of all classes stay together.

    With ``pairs``, neighbours in a list of terms count as a term of their own, with a space between. They are counted as pairs of numbers, and only
    different ones become texts. Lists must not hold nulls then.
    """
    kinds = T.StructType([docs.schema[cls], T.StructField("term", T.StringType()), T.StructField(n, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (classes,), sizes, found in _chunks(batches, 4 * _CHUNK_TERMS):
            named, coded = classes.dictionary_encode(), found.dictionary_encode()
            values = pa.concat_arrays([named.dictionary, pa.nulls(1, named.dictionary.type)])
            owner = np.repeat(named.indices.fill_null(len(named.dictionary)).to_numpy().astype(np.int64), sizes)
            codes = coded.indices.fill_null(-1).to_numpy().astype(np.int64)
            yield counted(values, owner[codes >= 0], codes[codes >= 0], coded.dictionary)
            if pairs:
                if found.null_count:
                    raise ValueError("a list of terms holds a null")
                ends, words = np.cumsum(sizes), len(coded.dictionary)
                inner = np.ones(len(codes), bool)
                inner[ends[ends > 0] - 1] = False  # the last of a list has no neighbour
                at = np.flatnonzero(inner)
                both, number = np.unique(codes[at] * words + codes[at + 1], return_inverse=True)
                left, right = (coded.dictionary.take(pa.array(c)) for c in np.divmod(both, max(words, 1)))
                yield counted(values, owner[at], number, pc.binary_join_element_wise(left, right, " "))

    def counted(values: pa.Array, owner: np.ndarray, codes: np.ndarray, names: pa.Array) -> pa.RecordBatch:
        found, times = np.unique(owner << 32 | codes, return_counts=True)
        columns = [values.take(pa.array(found >> 32)), names.take(pa.array(found & 0xFFFFFFFF)), pa.array(times, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, kinds.names)

    return docs.select(cls, terms.alias("_terms")).mapInArrow(run, kinds).repartition("term").groupBy(cls, "term").agg(F.sum(n).alias(n))


def _chunks(batches: Iterator[pa.RecordBatch], most: int | None = None) -> Iterator[tuple[list[pa.Array], np.ndarray, pa.Array]]:
    """Keys, numbers of terms and terms (the last column) of rows, about ``most`` terms at a time."""
    most = most or _CHUNK_TERMS
    for batch in batches:
        *keys, lists = batch.columns
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
            yield [k[at:end] for k in keys], sizes[at:end], lists[at:end].flatten()
            at = end


def fit_vocabulary(
    counts: DataFrame, n_docs: Column, min_df: int = 2, max_df: float = 0.85
) -> DataFrame:
    """``(term, df, cf)`` of the terms in at least ``min_df`` documents and at most that share of them."""
    return (
        counts.groupBy("term")
        .agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))
        .where((F.col("df") >= min_df) & (F.col("df") <= F.lit(float(max_df)) * n_docs))
    )


def bag_of_words(counts: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Counts of the kept terms; the rows of a term of many documents are dealt over tasks by its document frequency."""
    return heavy_join(counts, vocabulary.select("term", "df"), ["term"], "df", "left_semi", hashed=True)


def tf_idf(counts: DataFrame, vocabulary: DataFrame, n_docs: Column, doc_id: str = "doc_id") -> DataFrame:
    """``tf * (ln((1+n)/(1+df)) + 1)``, scaled to unit length per document.

    The window covers one document's distinct terms, which its own text bounds.
    """
    idf = F.ln((n_docs + F.lit(1)) / (F.col("df") + F.lit(1))) + F.lit(1.0)
    weighted = heavy_join(counts, vocabulary.select("term", "df"), ["term"], "df", hashed=True).withColumn("w", F.col("tf") * idf)
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(doc_id)))
    return weighted.select(doc_id, "term", "tf", (F.col("w") / norm).alias("tfidf"))


def drop_empty_vectors(docs: DataFrame, features: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Documents that still hold a kept term; ids and texts follow the same test."""
    return docs.join(features.select(doc_id).distinct(), doc_id, "left_semi")


def dense_ids(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """0-based row numbers in sorted order without a one-task sort.

    Rows are range-partitioned and materialised, numbered inside each partition, and shifted
    by the sizes of the partitions before it (a table with one row per partition).
    """
    part = cut_lineage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = part.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return (
        part.withColumn("_row", F.row_number().over(inside))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + F.col("_row") - 1).cast("long"))
        .drop("_part", "_row", "_offset")
    )


def numbered_vocabulary(vocabulary: DataFrame) -> DataFrame:
    """``(term_id, term, df)``, numbered from 0 in term order, as a written table of any size."""
    return cut_lineage(dense_ids(vocabulary.select("term", "df"), ["term"], "term_id"))


def sparse_rows(features: DataFrame, numbered: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, terms, bow, tfidf)``: each document's term numbers in order, with its counts and weights beside them."""
    placed = heavy_join(features, numbered.select("term", "term_id", "df"), ["term"], "df", hashed=True).drop("df")
    row = F.array_sort(F.collect_list(F.struct(F.col("term_id").cast("int").alias("i"), F.col("tf").cast("double").alias("tf"), "tfidf")))
    rows = placed.groupBy(doc_id).agg(row.alias("_row"))
    return rows.select(doc_id, F.col("_row")["i"].alias("terms"), F.col("_row")["tf"].alias("bow"), F.col("_row")["tfidf"].alias("tfidf"))


def vectors(features: DataFrame, numbered: DataFrame, size: int, doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, bow, tfidf)``: the long features as sparse vectors of length ``size``.

    Rows are built from arrays and written in the form in which Spark stores vectors, so that they are read as vectors: neither
    Python nor the driver sees a term.
    """
    stored = lambda value: F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.col("terms").alias("indices"), F.col(value).alias("values")
    )
    table = sparse_rows(features, numbered, doc_id).select(doc_id, stored("bow").alias("bow"), stored("tfidf").alias("tfidf"))
    kinds = T.StructType([table.schema[doc_id], T.StructField("bow", VectorUDT()), T.StructField("tfidf", VectorUDT())])
    # In one order, so that repeated fits are identical.
    return cut_lineage(table.sortWithinPartitions(doc_id), kinds)
