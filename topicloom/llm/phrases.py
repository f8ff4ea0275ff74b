"""Phrase collocations from a weighted de Bruijn graph of word windows.

Texts are cut into pieces at punctuation and line breaks, pieces into words. Every word of a piece starts one window: the five words
from there on, or fewer where the piece ends. Counted over all documents, a window of five words is an edge between the overlapping nodes
of its first and its last four words, and its count is the edge's weight; a shorter window corrects for a piece's end.

A node's own count is its outgoing flow plus the pieces that end with it, and the same rule leads from four words to three, two
and one: ``f(g) = sum of f(g w) over the next words w + windows that are just g``. So five counts come from one table in which each word of
the corpus is counted once.

Pairs of words seen fewer than ``min_count`` times cannot lie inside a candidate, so windows also end between them: a first pass adds up
pairs in hashed buckets, and only buckets that reach ``min_count`` stay open. A bucket's sum is never below a pair's count, so no candidate and no count
of a candidate is lost, whatever the number of buckets (``buckets_for`` grows with the corpus up to 2^27, which is a bitmap of 16 MB); with
all buckets open the result is the same and more windows are counted.

Where all flow into a node comes by one edge and leaves by one edge, and both weigh what the node weighs, the path is unary: such
edges are joined to whole paths by pointer doubling, one row a path (a passage of sixty words that is copied everywhere is one row). Five-word
candidates are read off the paths; nodes inside a path lie in a longer candidate of the same count and are none. Other nodes and
shorter phrases are dropped where an extension by one word has their count, which covers longer extensions, because counts never grow with length.

Defined cases: a null text is empty and has no words; a null language is ``und``. Only ``text`` and ``lang`` are read, so ids, repeated rows
(each counts) and extra columns do not matter. An empty table has no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicloom.llm.common import require, runs
from topicloom.operators.heavy import heavy_join
from topicloom.session import cut_lineage

LONGEST = 5
UNKNOWN_LANG = "und"
SEGMENT_BITS = 16
_MAX_BUCKET_BITS = 27
_FLUSH = 1_500_000  # pairs or windows held by a task before they are added up
_MAX_WORDS = 500_000  # numbered by a task before it starts anew
# Piece ends become line breaks, tabs blanks, and A-Z lower case.
_PLAIN = bytes.maketrans(b".,;:!?\x0b\x0c\r\tABCDEFGHIJKLMNOPQRSTUVWXYZ", b"\n" * 9 + b" abcdefghijklmnopqrstuvwxyz")


class Words:
    """Numbers for the words of each language: 0 is the end of a piece, -1 no word."""

    def __init__(self):
        self.names: list[bytes] = [b""]
        self.langs: list[str] = [""]
        self._hashes = np.zeros(1 << 12, np.uint64)
        self._by_lang: dict[str, _Numbers] = {}

    def number(self, lang: str, texts: list[str]) -> np.ndarray:
        numbers = self._by_lang.get(lang)
        if numbers is None:
            numbers = self._by_lang[lang] = _Numbers(self, lang)
        tokens = "\n".join(texts).encode().translate(_PLAIN).replace(b"\n", b" \n ").split(b" ")
        found = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
        return np.append(found[found >= 0], 0)

    def add(self, lang: str, word: bytes) -> int:
        at = len(self.names)
        self.names.append(word)
        self.langs.append(lang)
        if at >= len(self._hashes):
            self._hashes = np.append(self._hashes, np.zeros(len(self._hashes), np.uint64))
        self._hashes[at] = xxhash.xxh3_64_intdigest(word, xxhash.xxh32_intdigest(lang))
        return at

    def buckets(self, ids: np.ndarray, bits: int) -> np.ndarray:
        """The bucket of each word with the next one."""
        h = self._hashes[ids]
        mixed = (h[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ h[1:]
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (mixed >> np.uint64(64 - bits)).astype(np.int64)


class _Numbers(dict):
    def __init__(self, words: Words, lang: str):
        super().__init__({b"\n": 0, b"": -1})
        self.words, self.lang = words, lang

    def __missing__(self, word: bytes) -> int:
        self[word] = at = self.words.add(self.lang, word)
        return at


def _numbered(words: Words, batch: pa.RecordBatch) -> np.ndarray:
    """All words of a batch in order, with 0 after each piece; texts of one language go together."""
    by_lang: dict[str, list[str]] = {}
    for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
        if text:
            by_lang.setdefault(UNKNOWN_LANG if lang is None else lang, []).append(text)
    return np.concatenate([np.zeros(1, np.int64), *(words.number(lang, texts) for lang, texts in by_lang.items())])


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    return (whole.slice(at, rows) for whole in batches for at in range(0, whole.num_rows, rows))


def buckets_for(docs: DataFrame, min_count: int) -> int:
    """Bits of the bucket number: eight buckets for every ``min_count`` words, by a bound of the words from the bytes."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return int(min(_MAX_BUCKET_BITS, max(SEGMENT_BITS, np.ceil(np.log2(max(1, 2 * size / min_count))))))


def open_buckets(docs: DataFrame, bits: int, min_count: int) -> np.ndarray:
    """One bit a bucket: whether the pairs in it reach ``min_count`` together; ``2**bits / 8`` bytes."""
    kind = np.dtype("u1" if min_count < 256 else "<u4")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = Words(), [], 0

        def summed() -> tuple[np.ndarray, np.ndarray]:
            buckets, counts = np.concatenate([b for b, _ in held]), np.concatenate([n for _, n in held])
            order = np.argsort(buckets, kind="stable")
            buckets, cut = buckets[order], runs(buckets[order])
            return buckets[cut[:-1]], np.add.reduceat(counts[order], cut[:-1]) if len(cut) > 1 else counts

        def made(buckets: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            segment = buckets >> SEGMENT_BITS
            cut = runs(segment)
            low = (buckets & ((1 << SEGMENT_BITS) - 1)).astype("<u2")
            counts = np.minimum(counts, min_count).astype(kind)
            ends = list(zip(cut[:-1].tolist(), cut[1:].tolist()))
            columns = [pa.array(segment[cut[:-1]].astype(np.int32)), pa.array([low[a:b].tobytes() for a, b in ends], pa.binary())]
            return pa.RecordBatch.from_arrays([*columns, pa.array([counts[a:b].tobytes() for a, b in ends], pa.binary())], ["segment", "low", "n"])

        for batch in _slices(batches):
            ids = _numbered(words, batch)
            pairs = words.buckets(ids, bits)[(ids[:-1] > 0) & (ids[1:] > 0)]
            held.append((pairs.astype(np.int32), np.ones(len(pairs), np.int32)))
            size += len(pairs)
            if size > _FLUSH:
                held = [summed()]
                size = len(held[0][0])
                if size > _FLUSH // 2:
                    yield made(*held[0])
                    held, size = [], 0
            if len(words.names) > _MAX_WORDS:
                words = Words()
        if size:
            yield made(*summed())

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(1 << SEGMENT_BITS, np.int64)
        packed = lambda: pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(total >= min_count).tobytes()], pa.binary())], ["segment", "bits"])
        for batch in batches:
            for segment, low, n in zip(*(batch.column(c).to_pylist() for c in ("segment", "low", "n")), strict=True):
                if segment != at:
                    if at is not None:
                        yield packed()
                    at = segment
                    total[:] = 0
                total[np.frombuffer(low, "<u2")] += np.frombuffer(n, kind)
        if at is not None:
            yield packed()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    counted = docs.mapInArrow(count, "segment int, low binary, n binary").repartition(parts, "segment").sortWithinPartitions("segment")
    out = np.zeros((1 << (bits - SEGMENT_BITS), 1 << (SEGMENT_BITS - 3)), np.uint8)
    for row in counted.mapInArrow(add_up, "segment int, bits binary").collect():  # at most 16 MB together
        out[row["segment"]] = np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def windows(docs: DataFrame, opened: np.ndarray, bits: int) -> DataFrame:
    """``(lang, gram, k, n)``: the window of each word, counted; ``k`` words, which no closed pair parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, alone, held, size = Words(), np.zeros(1, np.int64), [], 0

        def made() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held, axis=1)
            rows = rows[:, np.lexsort(rows[::-1])]
            cut = runs(*rows)
            ones = np.flatnonzero(alone)
            single = np.zeros((LONGEST, len(ones)), np.int32)
            single[0] = ones
            grams, counts = np.append(single, rows[:, cut[:-1]], axis=1), np.append(alone[ones], np.diff(cut))
            names, langs = words.names, words.langs
            for at in range(0, len(counts), 20_000):
                part = [[i for i in row if i] for row in grams[:, at : at + 20_000].T.tolist()]
                columns = [
                    pa.array([langs[g[0]] for g in part], pa.string()), pa.array([b" ".join([names[i] for i in g]).decode() for g in part], pa.string()),
                    pa.array([len(g) for g in part], pa.int32()), pa.array(counts[at : at + 20_000]),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "gram", "k", "n"])

        for batch in _slices(batches):
            ids = _numbered(words, batch)
            pairs = words.buckets(ids, bits)
            goes_on = (ids[:-1] > 0) & (ids[1:] > 0) & (opened[pairs >> 3] >> (7 - (pairs & 7)).astype(np.uint8) & 1).astype(bool)
            goes_on = np.append(goes_on, False)
            padded = np.append(ids, np.zeros(LONGEST, np.int64))
            ends = np.bincount(ids[(ids > 0) & ~goes_on], minlength=len(words.names))
            ends[: len(alone)] += alone
            alone = ends
            at = np.flatnonzero(goes_on)
            rows, alive = np.zeros((LONGEST, len(at)), np.int32), np.ones(len(at), bool)
            rows[0] = ids[at]
            edge = np.append(goes_on, np.zeros(LONGEST, bool))
            for step in range(1, LONGEST):
                alive &= edge[at + step - 1]
                rows[step] = np.where(alive, padded[at + step], 0)
            held.append(rows)
            size += len(at)
            if size > _FLUSH or len(words.names) > _MAX_WORDS:
                yield from made()
                words, alone, held, size = Words(), np.zeros(1, np.int64), [], 0
        if held:
            yield from made()

    parts = docs.mapInArrow(run, "lang string, gram string, k int, n long")
    return parts.groupBy("lang", "gram", "k").agg(F.sum("n").alias("n"))


def _first(k: int) -> Column:
    return F.substring_index("gram", " ", k)


def gram_counts(table: DataFrame, min_count: int) -> DataFrame:
    """``(lang, gram, k, n)`` of all phrases of 1 to 5 words with ``n >= min_count``, by flow from the longest windows down."""
    of = lambda k: table.where(F.col("k") == k).select("lang", "gram", "n")
    level = of(LONGEST)
    out = level.withColumn("k", F.lit(LONGEST))
    for k in range(LONGEST - 1, 0, -1):
        flow = level.select("lang", _first(k).alias("gram"), "n")
        level = flow.unionByName(of(k)).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
        out = out.unionByName(level.withColumn("k", F.lit(k)))
    return out.where(F.col("n") >= min_count).select("lang", "gram", "k", "n")


def _last(k: int) -> Column:
    return F.substring_index("gram", " ", -k)


def unary_paths(grams: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges joined over unary nodes: ``(lang, path, words, n)``; and those nodes: ``(lang, gram)``.

    A unary node weighs what its heaviest edge in and its heaviest edge out weigh, so it has no other flow. It has one edge before and one
    after it; each edge points to the one before it, and doubling the pointers finds the first edge of its path in about log2 of the
    path's length rounds. Paths cannot be closed, because every piece starts somewhere.
    """
    edges = grams.where(F.col("k") == LONGEST).select("lang", "gram", "n")
    nodes = grams.where(F.col("k") == LONGEST - 1).select("lang", "gram", "n")
    into = edges.groupBy("lang", _last(LONGEST - 1).alias("gram")).agg(F.max_by("gram", "n").alias("before"), F.max("n").alias("n"))
    out = edges.groupBy("lang", _first(LONGEST - 1).alias("gram")).agg(F.max_by("gram", "n").alias("after"), F.max("n").alias("n"))
    unary = cut_lineage(nodes.join(into, ["lang", "gram", "n"]).join(out, ["lang", "gram", "n"]).select("lang", "gram", "before", "after"))
    links = unary.select("lang", F.col("after").alias("gram"), F.col("before").alias("head"))
    state = edges.join(links, ["lang", "gram"], "left")
    state = cut_lineage(state.select("lang", "gram", "n", F.coalesce("head", "gram").alias("head"), F.col("head").isNotNull().cast("long").alias("place")))
    while True:
        step = state.where("place > 0").select("lang", F.col("gram").alias("head"), F.col("head").alias("further"), F.col("place").alias("more"))
        if step.isEmpty():
            break
        moved = state.join(step, ["lang", "head"], "left")
        moved = moved.select("lang", "gram", "n", F.coalesce("further", "head").alias("head"), (F.col("place") + F.coalesce("more", F.lit(0))).alias("place"))
        before, state = state, cut_lineage(moved)
        if state.agg(F.sum("place")).first()[0] == before.agg(F.sum("place")).first()[0]:
            break
    tail = F.array_sort(F.collect_list(F.when(F.col("place") > 0, F.struct("place", _last(1).alias("word")))))
    paths = state.groupBy("lang", "head").agg(F.max("n").alias("n"), tail.alias("tail"))
    words = F.concat(F.split("head", " "), F.col("tail")["word"])
    return paths.select("lang", F.array_join(words, " ").alias("path"), F.size(words).alias("words"), "n"), unary.select("lang", "gram")


def candidates(grams: DataFrame) -> DataFrame:
    """``(lang, gram, k, n)`` of the phrases of 2 to 5 words that no longer phrase of the same count holds."""
    paths, inside = unary_paths(grams)
    split = F.split("path", " ")
    starts = F.sequence(F.lit(1), F.col("words") - (LONGEST - 1))
    longest = paths.select("lang", F.explode(F.transform(starts, lambda i: F.array_join(F.slice(split, i, LONGEST), " "))).alias("gram"), "n")
    shorter = grams.where((F.col("k") > 1) & (F.col("k") < LONGEST)).join(inside, ["lang", "gram"], "left_anti")
    longer = grams.where(F.col("k") > 2)
    ends = F.explode(F.expr("array(substring_index(gram, ' ', k - 1), substring_index(gram, ' ', 1 - k))"))
    held = longer.select("lang", ends.alias("gram"), "n").groupBy("lang", "gram").agg(F.max("n").alias("longest"))
    open_ = shorter.join(held, ["lang", "gram"], "left").where("longest is null or longest < n").select("lang", "gram", "k", "n")
    return longest.select("lang", "gram", F.lit(LONGEST).alias("k"), "n").unionByName(open_)


def scored(phrases: DataFrame, grams: DataFrame, totals: DataFrame) -> DataFrame:
    """``(lang, phrase, a, l, r, n, score)`` by the lowest cut; arithmetic in 38 digits."""
    part = lambda name, text: grams.select("lang", F.col("gram").alias(text), F.col("n").alias(name))
    cuts = phrases.select("lang", F.col("gram").alias("phrase"), F.col("n").alias("a"), "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select(
        "lang", "phrase", "a", "cut", F.expr("substring_index(phrase, ' ', cut)").alias("head"), F.expr("substring_index(phrase, ' ', cut - k)").alias("rest"),
    )
    cuts = cut_lineage(cuts)
    # A frequent word starts or ends many phrases, and a language holds most of them.
    met = heavy_join(cuts, part("l", "head"), ["lang", "head"])
    met = heavy_join(met, part("r", "rest"), ["lang", "rest"], like=cuts)
    met = heavy_join(met, totals, ["lang"], like=cuts)
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    met = met.withColumn("_over", F.lit(1000).cast("decimal(38,0)") * wide("a") * wide("n")).withColumn("_under", wide("l") * wide("r"))
    met = met.withColumn("score", F.expr("_over div _under"))
    best = F.min(F.struct("score", "cut", "l", "r"))
    rows = met.groupBy("lang", "phrase").agg(F.max("a").alias("a"), F.max("n").alias("n"), best.alias("best"))
    return rows.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), "n", F.col("best.score").alias("score"))


def mine(docs: DataFrame, min_count: int = 100, limit: int | None = 2000, bits: int | None = None) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: the ``limit`` first phrases of each language (None: all)."""
    rows = require(docs, "lang", "text").select("lang", "text")
    bits = buckets_for(rows, min_count) if bits is None else bits
    table = cut_lineage(windows(rows, open_buckets(rows, bits, min_count), bits))
    grams = cut_lineage(gram_counts(table, min_count))
    totals = table.groupBy("lang").agg(F.sum("n").alias("n"))
    found = scored(candidates(grams), grams, totals)
    order = W.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = found.withColumn("rank", F.row_number().over(order).cast("long"))
    if limit is not None:
        ranked = ranked.where(F.col("rank") <= limit)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
