"""Terms of documents looked up in the counts of all documents, where no pair of document and term is ever shuffled.

Documents are packed into chunks: a sorted list of words, and numbers for their texts. A chunk asks once for each of its terms, whatever
the documents that hold it. Questions go to ranges of terms in text order, cut at a sample, where neighbours share their first word and take a
few bytes each. A range adds up what all chunks say, and answers each chunk with numbers in the order it asked. Chunk and answers meet by
the chunk's number, so a document's terms, weights and sequences are made where all of its text is.

A term is a word or, with ``pairs``, two words in a row with a space between. A chunk has about ``CHUNK_WORDS`` words, a range of terms about
as many questions as a chunk asks (there are as many ranges as chunks), so tasks stay the same size whatever the input. Rows of equal keys
are one document; nulls are equal. Lists of words must not hold nulls.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.session import cut_lineage

CHUNK_WORDS = 1 << 20
_SAMPLE = 64  # terms a chunk names for the borders of ranges
_SAMPLES = 200_000  # of all of them, so many meet the driver at most
_ROWS = 1 << 17  # rows of one batch


# --- bytes ------------------------------------------------------------------------------------------------------------


def _ints(x: np.ndarray) -> bytes:
    """Whole numbers from 0 as planes of bytes, as many as the largest one needs."""
    x = np.ascontiguousarray(x, "<i8")
    width = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _to_ints(data: bytes) -> np.ndarray:
    width = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return out.view("<i8").ravel()


def _texts(x: pa.Array) -> tuple[bytes, bytes]:
    """Lengths and letters."""
    if not len(x):
        return _ints(np.zeros(0, np.int64)), b""
    _, at, letters = x.buffers()
    at = np.frombuffer(at, np.int32)[x.offset : x.offset + len(x) + 1]
    return _ints(np.diff(at)), (letters.to_pybytes() if letters else b"")[at[0] : at[-1]]


def _to_texts(lengths: bytes, letters: bytes) -> pa.Array:
    at = np.append(0, np.cumsum(_to_ints(lengths))).astype(np.int32)
    return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at), pa.py_buffer(letters))


def _squeeze(*parts: bytes) -> bytes:
    whole = np.array([len(parts), *map(len, parts)], "<i8").tobytes() + b"".join(parts)
    return len(whole).to_bytes(8, "little") + pa.compress(whole, "zstd", asbytes=True)


def _unsqueeze(data: bytes) -> list[bytes]:
    whole = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)
    n = int.from_bytes(whole[:8], "little")
    ends = 8 * (n + 1) + np.append(0, np.cumsum(np.frombuffer(whole, "<i8", n, 8)))
    return [whole[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


# --- chunks -----------------------------------------------------------------------------------------------------------


@dataclass
class Chunk:
    """Documents as numbers of sorted words. ``doc`` is the document of each row, ``keys`` has one value per document."""

    keys: list[pa.Array]
    doc: np.ndarray
    sizes: np.ndarray
    words: pa.Array
    codes: np.ndarray

    @classmethod
    def of(cls, keys: list[pa.Array], lists: pa.Array) -> Chunk:
        found = lists.flatten().cast(pa.string())
        if found.null_count:
            raise ValueError("a list of terms holds a null")
        coded = found.dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        fresh = _fresh(keys)
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        first = pa.array(np.flatnonzero(fresh))
        return cls([k.take(first) for k in keys], np.cumsum(fresh) - 1, sizes, coded.dictionary.take(order), rank[coded.indices.to_numpy()])

    def body(self) -> bytes:
        return _squeeze(_ints(self.doc), _ints(self.sizes), *_texts(self.words), _ints(self.codes))

    @classmethod
    def read(cls, keys: list[pa.Array], body: bytes) -> Chunk:
        doc, sizes, lengths, letters, codes = _unsqueeze(body)
        return cls(keys, _to_ints(doc), _to_ints(sizes), _to_texts(lengths, letters), _to_ints(codes))

    def inner(self) -> np.ndarray:
        """The places of words that have a next one in their row."""
        keep = np.ones(len(self.codes), bool)
        ends = np.cumsum(self.sizes)[self.sizes > 0]
        keep[ends - 1] = False
        return np.flatnonzero(keep)

    def sample(self, pairs: bool) -> tuple[list[str], list[str | None]]:
        """Some terms in no order; the second word is null where the term is one word."""
        places = np.unique(np.linspace(0, len(self.codes) - 1, _SAMPLE).astype(np.int64)) if len(self.codes) else np.zeros(0, np.int64)
        places = np.random.Generator(np.random.PCG64(len(self.codes))).permutation(places)
        inner = np.isin(places, self.inner()) & pairs
        after = self.codes[np.minimum(places + 1, max(len(self.codes) - 1, 0))]
        seconds = self.words.take(pa.array(after, mask=~inner))
        return self.words.take(pa.array(self.codes[places])).to_pylist(), seconds.to_pylist()


class Terms:
    """The terms of a chunk: ``keys`` are the distinct ones in order, ``term`` and ``doc`` belong to each occurrence."""

    def __init__(self, chunk: Chunk, pairs: bool):
        self.chunk, self.base = chunk, len(chunk.words) + 1
        owner = np.repeat(chunk.doc, chunk.sizes)
        every, self.doc = chunk.codes * self.base, owner
        if pairs:
            at = chunk.inner()
            every = np.concatenate([every, chunk.codes[at] * self.base + chunk.codes[at + 1] + 1])
            self.doc = np.concatenate([owner, owner[at]])
        self.keys, self.term = np.unique(every, return_inverse=True)

    def by_document(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Document, term and count of each pair, in this order."""
        size = max(len(self.keys), 1)
        pairs, n = np.unique(self.doc * size + self.term, return_counts=True)
        return pairs // size, pairs % size, n

    def places(self) -> np.ndarray:
        """The place of each occurrence in its row: first the words, then the pairs."""
        sizes = self.chunk.sizes
        inside = np.arange(len(self.chunk.codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        if len(self.term) == len(inside):
            return inside
        at = self.chunk.inner()
        return np.concatenate([inside, inside[at] + np.repeat(sizes, sizes)[at]])

    def texts(self, which: np.ndarray) -> pa.Array:
        first, second = np.divmod(self.keys[which], self.base)
        left, words = pa.array(first), self.chunk.words
        one = words.take(left)
        if not second.any():
            return one
        both = pc.binary_join_element_wise(one, words.take(pa.array(second - 1, mask=second == 0)), " ")
        return pc.coalesce(both, one)

    def cuts(self, borders: list[tuple[str, str | None]]) -> np.ndarray:
        """Where each range of terms begins among ``keys``, and their end."""
        words, at = self.chunk.words.to_pylist(), []
        for a, b in borders:
            first = bisect_left(words, a)
            here = first < len(words) and words[first] == a and b is not None
            at.append(first * self.base + (bisect_left(words, b) + 1 if here else 0))
        return np.concatenate([[0], np.searchsorted(self.keys, np.array(at, np.int64)), [len(self.keys)]])


def _fresh(keys: list[pa.Array]) -> np.ndarray:
    """Which rows are the first of their keys."""
    same = np.ones(max(len(keys[0]) - 1, 0), bool)
    for k in keys:
        equal = pc.if_else(pc.is_null(k[1:]), pc.is_null(k[:-1]), pc.fill_null(pc.equal(k[1:], k[:-1]), False))
        same &= equal.to_numpy(zero_copy_only=False).astype(bool)
    return np.append(True, ~same)[: len(keys[0])]


def _documents(batches: Iterator[pa.RecordBatch], whole: bool, most: int) -> Iterator[tuple[list[pa.Array], pa.Array]]:
    """Rows of about ``most`` words at a time; with ``whole``, rows of one document in a row stay together."""
    held, size, limit = [], 0, most
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.columns[-1]), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(ends, before + limit - size, "right")))
            held.append(batch.slice(at, end - at))
            size += int(ends[end - 1] - before)
            at = end
            if size < limit:
                continue
            *keys, lists = pa.Table.from_batches(held).combine_chunks().to_batches()[0].columns
            last = int(np.flatnonzero(_fresh(keys))[-1]) if whole else len(lists)
            held, size, limit = [], 0, most
            if last:
                yield [k[:last] for k in keys], lists[:last]
            if last < len(lists):
                held = [pa.RecordBatch.from_arrays([*(k[last:] for k in keys), lists[last:]], schema=batch.schema)]
                size = len(lists[last:].flatten())
                limit = max(most, 2 * size)
    if held:
        *keys, lists = pa.Table.from_batches(held).combine_chunks().to_batches()[0].columns
        yield keys, lists


@dataclass
class Packed:
    """``n`` chunks as a written table, and the borders of the ranges that their terms fall into. Tasks are as many as chunks and ranges."""

    table: DataFrame
    n: int
    keys: list[T.StructField]
    pairs: bool
    borders: list[tuple[str, str | None]]


def pack(docs: DataFrame, keys: list[str], tokens: Column, pairs: bool = True, whole: bool = True) -> Packed:
    """Write the documents as chunks. ``whole``: rows of equal keys are one document (they are looked for, and brought together if there are any)."""
    lists = docs.select(*keys, tokens.alias("_tokens"))
    if whole and not docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        lists = lists.repartition(*keys).sortWithinPartitions(*keys)
    kinds = [docs.schema[k] for k in keys]
    fields = [T.StructField(f"k{i}", T.ArrayType(k.dataType)) for i, k in enumerate(kinds)]
    texts = T.ArrayType(T.StringType())
    schema = T.StructType([T.StructField("chunk", T.LongType()), *fields, T.StructField("body", T.BinaryType()), T.StructField("first", texts), T.StructField("second", texts)])
    most = CHUNK_WORDS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for given, found in _documents(batches, whole, most):
            chunk = Chunk.of(given, found)
            first, second = chunk.sample(pairs)
            whole_lists = [pa.ListArray.from_arrays(pa.array([0, len(k)], pa.int32()), k) for k in chunk.keys]
            named = [pa.array([x], pa.list_(pa.string())) for x in (first, second)]
            yield pa.RecordBatch.from_arrays([pa.array([number]), *whole_lists, pa.array([chunk.body()], pa.binary()), *named], schema.names)
            number += 1

    table = cut_lineage(lists.mapInArrow(run, schema))
    n = table.count()
    share = max(1, min(_SAMPLE, _SAMPLES // max(n, 1)))
    rows = table.select(F.slice("first", 1, share).alias("a"), F.slice("second", 1, share).alias("b")).collect()
    known = sorted({(a, b or "") for r in rows for a, b in zip(r["a"], r["b"], strict=True)})
    ranges = max(n, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    at = sorted({i * len(known) // ranges for i in range(1, ranges)}) if known else []
    return Packed(table, n, kinds, pairs, [(known[i][0], known[i][1] or None) for i in at if i])


def _read(batch: pa.RecordBatch, n_keys: int) -> Iterator[tuple[int, Chunk]]:
    for i in range(batch.num_rows):
        yield batch.column("chunk")[i].as_py(), Chunk.read([batch.column(f"k{k}")[i].values for k in range(n_keys)], batch.column("body")[i].as_py())


# --- questions --------------------------------------------------------------------------------------------------------


def _asked(terms: Terms, part: slice, owner: np.ndarray, *counts: np.ndarray) -> bytes:
    """The terms ``part`` of a chunk with the classes that hold them and their counts; ``owner`` is the term of each of these, in order."""
    first, second = np.divmod(terms.keys[part], terms.base)
    starts = np.flatnonzero(np.append(True, first[1:] != first[:-1]))
    words = terms.chunk.words
    here = slice(*np.searchsorted(owner, [part.start, part.stop]))
    per_term = np.bincount(owner[here] - part.start, minlength=len(first))
    return _squeeze(
        *_texts(words.take(pa.array(first[starts]))), _ints(np.diff(np.append(starts, len(first)))), _ints(second > 0),
        *_texts(words.take(pa.array(second[second > 0] - 1))), _ints(per_term), *(_ints(c[here]) for c in counts),
    )


def _understood(body: bytes) -> tuple[pa.Array, np.ndarray, list[np.ndarray]]:
    """The texts of the terms, how many classes hold each, and classes and counts."""
    lengths, letters, runs, paired, lengths2, letters2, per_term, *counts = _unsqueeze(body)
    runs, paired = _to_ints(runs), _to_ints(paired) > 0
    one = _to_texts(lengths, letters).take(pa.array(np.repeat(np.arange(len(runs)), runs)))
    if paired.any():
        place = np.cumsum(paired) - 1
        two = _to_texts(lengths2, letters2).take(pa.array(np.maximum(place, 0), mask=~paired))
        one = pc.coalesce(pc.binary_join_element_wise(one, two, " "), one)
    return one, _to_ints(per_term), [_to_ints(c) for c in counts]


def _questions(packed: Packed, cls: int | None) -> DataFrame:
    """``(bucket, chunk, body, classes)``: what each chunk asks each range of terms, with its documents and occurrences of a term, or occurrences by class."""
    kind = packed.keys[cls].dataType if cls is not None else T.IntegerType()
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("chunk", T.LongType()), T.StructField("body", T.BinaryType()), T.StructField("classes", T.ArrayType(kind))])
    n_keys, pairs, borders = len(packed.keys), packed.pairs, packed.borders

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, chunk in _read(batch, n_keys):
                terms = Terms(chunk, pairs)
                if cls is None:
                    _, held, n = terms.by_document()
                    owner, classes = np.arange(len(terms.keys)), pa.array([0], pa.int32())
                    counts = [np.zeros(len(owner), np.int64), np.bincount(held, minlength=len(owner)), np.bincount(held, n, len(owner)).astype(np.int64)]
                else:
                    owner, code, n, classes = _by_class(terms, chunk.keys[cls])
                    counts = [code, n]
                rows = []
                cuts = terms.cuts(borders)
                for bucket in np.flatnonzero(np.diff(cuts)).tolist():
                    rows.append((bucket, _asked(terms, slice(int(cuts[bucket]), int(cuts[bucket + 1])), owner, *counts)))
                if rows:
                    every = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * len(classes), pa.int32()), pa.concat_arrays([classes] * len(rows)))
                    arrays = [pa.array([b for b, _ in rows], pa.int32()), pa.array([number] * len(rows)), pa.array([x for _, x in rows], pa.binary()), every]
                    yield pa.RecordBatch.from_arrays(arrays, schema.names)

    return packed.table.drop("first", "second").mapInArrow(run, schema)


def _by_class(terms: Terms, classes: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Term, class and count of each pair in this order, and the classes; null is one of them."""
    named = classes.dictionary_encode()
    values = pa.concat_arrays([named.dictionary, pa.nulls(1, named.dictionary.type)])
    code = named.indices.fill_null(len(named.dictionary)).to_numpy().astype(np.int64)
    pairs, n = np.unique(terms.term * len(values) + code[terms.doc], return_counts=True)
    return pairs // len(values), pairs % len(values), n, values


def _by_range(batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[tuple]:
    """Of each range: its number, the chunks that ask, the terms each asks for, all terms in order of their texts, term and class of each count, the classes, the counts, and
    where the counts of each chunk end."""

    def told(bucket: int, held: list[tuple[int, bytes, pa.Array]]):
        parts = [_understood(body) for _, body, _ in held]
        coded = pa.concat_arrays([p[0] for p in parts]).dictionary_encode()
        order = pc.sort_indices(coded.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        asked = rank[coded.indices.to_numpy()]
        named = pa.concat_arrays([c for *_, c in held]).dictionary_encode()
        code = named.indices.fill_null(len(named.dictionary)).to_numpy().astype(np.int64)
        shift = np.cumsum([0, *(len(c) for *_, c in held)])[:-1]
        cls = code[np.concatenate([p[2][0] + s for p, s in zip(parts, shift, strict=True)])]
        values = pa.concat_arrays([named.dictionary, pa.nulls(1, named.dictionary.type)])
        term = np.repeat(asked, np.concatenate([p[1] for p in parts]))
        counts = [np.concatenate(x) for x in zip(*(p[2][1:] for p in parts), strict=True)]
        each = np.split(asked, np.cumsum([len(p[0]) for p in parts])[:-1])
        return bucket, [c for c, *_ in held], each, coded.dictionary.take(order), term, cls, values, counts, np.cumsum([len(p[2][0]) for p in parts])

    now, held = None, []
    for batch in batches:
        classes = batch.column("classes")
        for i in range(batch.num_rows):
            bucket = batch.column("bucket")[i].as_py()
            if bucket != now and held:
                yield told(now, held)
                held = []
            now = bucket
            held.append((batch.column("chunk")[i].as_py(), batch.column("body")[i].as_py(), classes[i].values.cast(kind)))
    if held:
        yield told(now, held)


def _answered(packed: Packed, cls: int | None, schema: T.StructType, tell: Callable) -> DataFrame:
    """A written table: ``tell`` makes batches of each range."""
    asked = _questions(packed, cls)
    kind = pa.int32() if cls is None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        first = next(batches, None)
        if first is None:
            return
        wide = kind or first.column("classes").type.value_type

        def all_of() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        for found in _by_range(all_of(), wide):
            yield from tell(*found)

    return cut_lineage(asked.repartition(len(packed.borders) + 1, "bucket").sortWithinPartitions("bucket", "chunk").mapInArrow(run, schema))


# --- vocabulary and weights -------------------------------------------------------------------------------------------


@dataclass
class Vocabulary:
    """What the ranges answered: the vocabulary as rows, and an answer per chunk and range."""

    packed: Packed
    table: DataFrame
    n_docs: int

    def rows(self) -> DataFrame:
        """``(term, df, cf)``"""
        return self.table.where("term is not null").select("term", "df", "cf")

    def numbered(self) -> DataFrame:
        """``(term_id, term, df)``, numbered from 0 in the order of terms."""
        before = F.element_at(F.lit(self.offsets()), F.col("bucket") + 1)
        return self.table.where("term is not null").select((before + F.col("at")).cast("long").alias("term_id"), "term", "df")

    def offsets(self) -> list[int]:
        """How many terms the ranges before each one have; as many numbers as there are ranges."""
        sizes = {r["bucket"]: r["count"] for r in self.table.where("term is not null").groupBy("bucket").count().collect()}
        return np.append(0, np.cumsum([sizes.get(b, 0) for b in range(len(self.packed.borders) + 1)]))[:-1].tolist()

    def features(self, term: bool = True) -> DataFrame:
        """``(*keys, term, tf, tfidf)``: ``tf * (ln((1+n)/(1+df)) + 1)``, scaled to unit length per document; without ``term`` only the numbers."""
        kinds = T.StructType([*self.packed.keys, *[T.StructField("term", T.StringType())] * term, T.StructField("tf", T.LongType()), T.StructField("tfidf", T.DoubleType())])

        def emit(terms: Terms, answer: Answer) -> Iterator[list[pa.Array]]:
            doc, held, n, weight = answer.weighted(terms)
            kept = np.unique(held)
            texts = terms.texts(kept) if term else None
            for at in range(0, len(doc), _ROWS):
                here = slice(at, at + _ROWS)
                named = [texts.take(pa.array(np.searchsorted(kept, held[here])))] if term else []
                yield [*(k.take(pa.array(doc[here])) for k in terms.chunk.keys), *named, pa.array(n[here]), pa.array(weight[here])]

        return self._meet(kinds, emit)

    def weight_sums(self, least_df: int) -> DataFrame:
        """``(term, weight)``: sums of a chunk's weights of a term, for terms of ``least_df`` documents or more."""
        kinds = T.StructType([T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])

        def emit(terms: Terms, answer: Answer) -> Iterator[list[pa.Array]]:
            _, held, _, weight = answer.weighted(terms)
            sums = np.bincount(held, weight, len(terms.keys))
            kept = np.flatnonzero((answer.df >= least_df) & (answer.df > 0))
            for at in range(0, len(kept), _ROWS):
                yield [terms.texts(kept[at : at + _ROWS]), pa.array(sums[kept[at : at + _ROWS]])]

        return self._meet(kinds, emit)

    def mean_weight(self, k: int = 20) -> DataFrame:
        """``(term, mean_tfidf)`` of the ``k`` terms with the largest weights on average over all documents, zero cells included.

        A weight is at most 1, so a term's sum is at most the number of its documents. The terms of most documents are added up first; if the
        ``k``-th sum is no less than the documents that other terms can have, they cannot be among the first, else all terms that can are added up.
        """
        mean = F.sum("weight") / F.lit(self.n_docs)
        best = lambda least: cut_lineage(self.weight_sums(least).groupBy("term").agg(mean.alias("mean_tfidf")).orderBy(F.desc("mean_tfidf"), "term").limit(k))
        frequent = self.rows().orderBy(F.desc("df")).limit(64 * k)  # some hundreds of rows
        least = frequent.agg(F.min("df")).first()[0] or 1
        found = best(least)
        last = found.agg(F.min("mean_tfidf").alias("x"), F.count(F.lit(1)).alias("n")).first()
        bound = int(last["x"] * self.n_docs * (1 - 1e-9)) if last["n"] == k else 1
        if least > max(bound, 1):
            found = best(max(bound, 1))
        return found.orderBy(F.desc("mean_tfidf"), "term")

    def sequences(self) -> DataFrame:
        """``(*keys, tokens)``: the terms of the vocabulary in the order of the text, first words and then pairs; documents without any are left out."""
        kinds = T.StructType([*self.packed.keys, T.StructField("tokens", T.ArrayType(T.StringType()))])

        def emit(terms: Terms, answer: Answer) -> Iterator[list[pa.Array]]:
            at = np.flatnonzero(answer.df[terms.term] > 0)
            at = at[np.lexsort((terms.places()[at], terms.doc[at]))]
            kept = np.flatnonzero(answer.df > 0)
            texts = terms.texts(kept)
            for docs, here in _by_documents(terms.doc[at]):
                place = np.searchsorted(kept, terms.term[at[here]])
                lists = pa.ListArray.from_arrays(pa.array(docs[1], pa.int32()), texts.take(pa.array(place)))
                yield [*(k.take(pa.array(docs[0])) for k in terms.chunk.keys), lists]

        return self._meet(kinds, emit)

    def sparse_rows(self) -> DataFrame:
        """``(*keys, terms, bow, tfidf)``: each document's term numbers in order, with its counts and weights beside them."""
        numbers = [T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("bow", T.ArrayType(T.DoubleType())), T.StructField("tfidf", T.ArrayType(T.DoubleType()))]
        offsets, borders = np.array(self.offsets()), self.packed.borders

        def emit(terms: Terms, answer: Answer) -> Iterator[list[pa.Array]]:
            doc, held, n, weight = answer.weighted(terms)
            number = answer.at + np.repeat(offsets, np.diff(terms.cuts(borders)))
            for docs, here in _by_documents(doc):
                order = np.lexsort((number[held[here]], doc[here]))
                values = [number[held[here]][order].astype(np.int32), n[here][order].astype(float), weight[here][order]]
                yield [*(k.take(pa.array(docs[0])) for k in terms.chunk.keys), *(pa.ListArray.from_arrays(pa.array(docs[1], pa.int32()), pa.array(v)) for v in values)]

        return self._meet(T.StructType([*self.packed.keys, *numbers]), emit)

    def _meet(self, kinds: T.StructType, emit: Callable) -> DataFrame:
        n_docs = self.n_docs

        def run(terms: Terms, answers: list[bytes]) -> Iterator[list[pa.Array]]:
            parts = [_unsqueeze(a) for a in answers]
            df, at = ([np.concatenate([_to_ints(p[i]) for p in parts]) if parts else np.zeros(0, np.int64)] for i in range(2))
            yield from emit(terms, Answer(n_docs, df[0], at[0]))

        return _meet(self.packed, self.table, kinds, run)


@dataclass
class Answer:
    """For each term of a chunk how many of all documents hold it, 0 if it is not kept, and its place in its range."""

    n_docs: int
    df: np.ndarray
    at: np.ndarray

    def weighted(self, terms: Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Document, term, count and weight of each pair that is kept, in order of documents."""
        doc, held, n = terms.by_document()
        keep = self.df[held] > 0
        doc, held, n = doc[keep], held[keep], n[keep]
        w = n * (np.log((self.n_docs + 1) / (self.df[held] + 1)) + 1.0)
        return doc, held, n, w / np.sqrt(np.bincount(doc, w * w))[doc] if len(doc) else w


def _by_documents(doc: np.ndarray) -> Iterator[tuple[tuple[np.ndarray, np.ndarray], slice]]:
    """Runs of whole documents of about ``_ROWS`` entries: the documents, where their lists begin and end, and the entries."""
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))[: len(doc)]
    ends = np.append(starts[1:], len(doc))
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + _ROWS, "right")))
        yield (doc[starts[at:end]], np.append(starts[at:end], ends[end - 1]) - starts[at]), slice(int(starts[at]), int(ends[end - 1]))
        at = end


def _meet(packed: Packed, table: DataFrame, kinds: T.StructType, emit: Callable) -> DataFrame:
    """Bring each chunk and its answers together; ``emit`` makes columns of them."""
    n_keys, pairs = len(packed.keys), packed.pairs
    held = [f"k{i}" for i in range(n_keys)]
    chunks = packed.table.select("chunk", F.lit(-1).alias("bucket"), *held, "body")
    answers = table.where("chunk is not null").select("chunk", "bucket", *[F.lit(None).cast(packed.table.schema[k].dataType).alias(k) for k in held], F.col("reply").alias("body"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, told = None, []

        def made() -> Iterator[pa.RecordBatch]:
            for columns in emit(Terms(chunk, pairs), told):
                yield pa.RecordBatch.from_arrays(columns, kinds.names)

        for batch in batches:
            for i in range(batch.num_rows):
                if batch.column("bucket")[i].as_py() < 0:
                    if chunk is not None:
                        yield from made()
                    (_, chunk), told = next(_read(batch.slice(i, 1), n_keys)), []
                else:
                    told.append(batch.column("body")[i].as_py())
        if chunk is not None:
            yield from made()

    return chunks.unionByName(answers).repartition(max(packed.n, 1), "chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(run, kinds)


def vocabulary(packed: Packed, n_docs: int, min_df: int = 2, max_df: float = 0.85) -> Vocabulary:
    """The terms in at least ``min_df`` documents and at most that share of ``n_docs``, counted and written."""
    most = float(max_df) * n_docs
    schema = T.StructType.fromDDL("chunk long, bucket int, reply binary, term string, at int, df long, cf long")

    def tell(bucket, chunks, asked, texts, term, _, __, counts, ___) -> Iterator[pa.RecordBatch]:
        df, cf = (np.bincount(term, c, len(texts)).astype(np.int64) for c in counts)
        keep = (df >= min_df) & (df <= most)
        place, df = np.where(keep, np.cumsum(keep) - 1, 0), np.where(keep, df, 0)
        replies = [_squeeze(_ints(df[a]), _ints(place[a])) for a in asked]
        none = lambda kind, n: pa.nulls(n, kind)
        k = len(chunks)
        yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([bucket] * k, pa.int32()), pa.array(replies, pa.binary()), none(pa.string(), k), none(pa.int32(), k), none(pa.int64(), k), none(pa.int64(), k)], schema.names)
        at = np.flatnonzero(keep)
        n = len(at)
        yield pa.RecordBatch.from_arrays([none(pa.int64(), n), pa.array([bucket] * n, pa.int32()), none(pa.binary(), n), texts.take(pa.array(at)), pa.array(place[at], pa.int32()), pa.array(df[at]), pa.array(cf[at])], schema.names)

    return Vocabulary(packed, _answered(packed, None, schema, tell), n_docs)


# --- classes ----------------------------------------------------------------------------------------------------------


@dataclass
class ClassTerms:
    """Counts of terms by class: one row a term, and an answer per chunk and range."""

    packed: Packed
    table: DataFrame
    cls: str

    def by_term(self) -> DataFrame:
        """``(term, f, classes, ns)``: the term's count over all classes, the classes that hold it, their counts."""
        return self.table.where("term is not null").select("term", "f", "classes", "ns")

    def rows(self) -> DataFrame:
        """``(class, term, n, f)``, as ``ctfidf.shared_terms`` has them."""
        pairs = F.explode(F.arrays_zip("classes", "ns")).alias("x")
        return self.by_term().select("term", "f", pairs).select(F.col("x.classes").alias(self.cls), "term", F.col("x.ns").alias("n"), "f")

    def cosines(self, mean: float) -> DataFrame:
        """``(*keys, dot, len)`` of documents whose class is known: with ``idf = ln(1 + mean / f)``, the sum of ``tf idf n idf`` and the root of that of ``(tf idf)^2``."""
        at = [k.name for k in self.packed.keys].index(self.cls)
        kinds = T.StructType([*self.packed.keys, T.StructField("dot", T.DoubleType()), T.StructField("len", T.DoubleType())])

        def emit(terms: Terms, answers: list[bytes]) -> Iterator[list[pa.Array]]:
            if not answers:
                return
            owner, code, _, values = _by_class(terms, terms.chunk.keys[at])
            parts = [_unsqueeze(a) for a in answers]
            f, n = (np.concatenate([_to_ints(p[i]) for p in parts]) for i in range(2))
            named = terms.chunk.keys[at].dictionary_encode().indices.fill_null(len(values) - 1).to_numpy().astype(np.int64)
            doc, held, tf = terms.by_document()
            entry = np.searchsorted(owner * len(values) + code, held * len(values) + named[doc])
            keep = (f[entry] > 0) & (named[doc] < len(values) - 1)
            doc, entry, tf = doc[keep], entry[keep], tf[keep]
            idf = np.log(mean / f[entry] + 1.0)
            own, docs = tf * idf, np.unique(doc)
            dot, size = np.bincount(doc, own * n[entry] * idf), np.sqrt(np.bincount(doc, own * own))
            for i in range(0, len(docs), _ROWS):
                here = docs[i : i + _ROWS]
                yield [*(k.take(pa.array(here)) for k in terms.chunk.keys), pa.array(dot[here]), pa.array(size[here])]

        return _meet(self.packed, self.table, kinds, emit)


def class_terms(packed: Packed, cls: str, min_classes: int = 1, answers: bool = False) -> ClassTerms:
    """The terms of ``min_classes`` classes or more, counted by class and written; with ``answers``, what chunks need of them as well."""
    at = [k.name for k in packed.keys].index(cls)
    kind = packed.keys[at].dataType
    extra = [T.StructField("term", T.StringType()), T.StructField("f", T.LongType()), T.StructField("classes", T.ArrayType(kind)), T.StructField("ns", T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("reply", T.BinaryType()), *extra])

    def tell(bucket, chunks, _, texts, term, code, values, counts, ends) -> Iterator[pa.RecordBatch]:
        (n,) = counts
        pairs, place = np.unique(term * len(values) + code, return_inverse=True)
        sums = np.bincount(place, n).astype(np.int64)
        owner = pairs // len(values)
        held, f = np.bincount(owner, minlength=len(texts)), np.bincount(owner, sums, len(texts)).astype(np.int64)
        keep = held >= min_classes
        kinds = [pa.list_(values.type), pa.list_(pa.int64())]
        if answers:
            told = np.where(keep, f, 0)[term], sums[place]
            replies = [_squeeze(*(_ints(x[a:b]) for x in told)) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            k = len(chunks)
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array([bucket] * k, pa.int32()), pa.array(replies, pa.binary()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()), *(pa.nulls(k, x) for x in kinds)], schema.names)
        there = np.flatnonzero(keep)
        inside = np.flatnonzero(keep[owner])
        starts = pa.array(np.append(0, np.cumsum(held[there])), pa.int32())
        lists = [pa.ListArray.from_arrays(starts, x) for x in (values.take(pa.array(pairs[inside] % len(values))), pa.array(sums[inside]))]
        m = len(there)
        yield pa.RecordBatch.from_arrays([pa.nulls(m, pa.int64()), pa.array([bucket] * m, pa.int32()), pa.nulls(m, pa.binary()), texts.take(pa.array(there)), pa.array(f[there]), *lists], schema.names)

    return ClassTerms(packed, _answered(packed, at, schema, tell), cls)
