"""Line deduplication by a range-partitioned, sorted stream of line hashes.

A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Keys that
occur in at least ``min_documents`` documents lose all their lines.

Only hashes and positions travel: rows ``(hash, document, position)`` are range-partitioned and
sorted, so that a task streams the first occurrences of a key and knows after ``min_documents`` of
them that the key goes. The ranges hold the document too, so a key of a third of all lines is cut
over many tasks; what a task cannot decide about the keys at its two ends is settled from a few rows per
task. The result is one compressed keep bitmap per document that loses a line. The texts are shuffled
once, to meet their bitmaps.

``keep_first`` leaves a dropped key's lines in the first document that holds the key (smallest id, null before all).
A task knows that document for all keys that start in it; for the key it may share with the task before it, the few
rows at the ends of tasks tell.

Defined cases: a null or empty text is one empty line, whose key is empty and never dropped. Rows that
agree in id and text count as one document; rows with one id (or a null id) and different texts are
different documents. Extra columns stay; ``_line_doc``, ``_line_same``, ``_line_keep``, ``n_lines`` and
``n_dropped`` are refused as names of input columns.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.common import refuse, require, runs, sliced, text_or_empty, with_fields
from topicloom.session import cut_lineage

# ASCII white space.
BLANK = b" \t\n\x0b\x0c\r"
_LINES = "h1 long, h2 long, doc long, same long, pos int"
_LINE_NAMES = ("h1", "h2", "doc", "same", "pos")
_OUT = f"kind string, {_LINES}, docs int"
_NO_DOC = -(2**63)


def line_key(line: bytes) -> bytes:
    return line.strip(BLANK).lower()


def _split(min_chars: int):
    """Turn documents into the rows of their lines, few documents at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in sliced(batches):
            digests, counts, positions = [], [], []
            for text in batch.column("text").to_pylist():
                before = len(digests)
                for at, line in enumerate(text.encode().split(b"\n")):
                    key = line.strip(BLANK).lower()
                    if len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars):
                        digests.append(digest(key))
                        positions.append(at)
                counts.append(len(digests) - before)
            halves = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            ids = [np.repeat(batch.column(c).to_numpy(zero_copy_only=False), counts) for c in ("doc", "same")]
            arrays = [halves[:, 0].copy(), halves[:, 1].copy(), *ids, np.array(positions, np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], _LINE_NAMES)

    return run


def line_rows(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row per line that may be dropped: two independent hashes of its key, the document and the position."""
    return docs.mapInArrow(_split(min_chars), _LINES)


def _decide(min_documents: int, keep_first: bool = False):
    """Stream sorted line rows; tell dropped lines, and what is left open at both ends of the task.

    With ``keep_first`` the lines of a key's first document are not told, unless the key is the task's first one: an
    earlier task may hold it too, so those lines are told as ``lead``.
    """

    def batch_of(kind: str, rows: dict[str, np.ndarray], docs: np.ndarray) -> pa.RecordBatch:
        n = len(rows["pos"])
        arrays = [pa.array([kind] * n, pa.string()), *(pa.array(rows[c]) for c in _LINE_NAMES), pa.array(docs, pa.int32())]
        return pa.RecordBatch.from_arrays(arrays, ["kind", *_LINE_NAMES, "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None  # rows of an undecided key at the end of what was read
        state = None  # (h1, h2, documents so far, last document) of a decided key at the end of what was read
        first = True

        def closed(rows, last: bool) -> Iterator[pa.RecordBatch]:
            """Decide all keys in ``rows``; unless ``last``, the final key stays open."""
            nonlocal first, held, state
            cut = runs(rows["h1"], rows["h2"])
            new_doc = np.ones(len(rows["pos"]), bool)
            new_doc[1:] = False
            for c in ("h1", "h2", "doc", "same"):
                new_doc[1:] |= rows[c][1:] != rows[c][:-1]
            known = 0
            if state is not None and len(new_doc) and (rows["h1"][0], rows["h2"][0]) == state[:2]:
                known = state[2]
                new_doc[0] = (rows["doc"][0], rows["same"][0]) != state[3]
            total = np.append(0, np.cumsum(new_doc))
            docs = total[cut[1:]] - total[cut[:-1]]
            if len(docs):
                docs[0] += known
            full = docs >= min_documents
            spread = np.repeat(np.arange(len(docs)), np.diff(cut))
            take = lambda mask: {c: rows[c][mask] for c in _LINE_NAMES}
            gone = full[spread]
            if keep_first:
                # A key is only decided after its second document, so the rows of its first one are all here.
                leads = gone & (total[1:] - total[cut[:-1]][spread] == 1)
                if known:
                    leads &= spread > 0
                gone &= ~leads
                leads &= (spread == 0) & first
                if leads.any():
                    yield batch_of("lead", take(leads), np.zeros(leads.sum(), np.int32))
            if gone.any():
                yield batch_of("drop", take(gone), np.zeros(gone.sum(), np.int32))
            ends = {0} if first else set()
            if last and len(docs):
                ends.add(len(docs) - 1)
            open_end = None if last or not len(docs) else len(docs) - 1
            for k in ends - {open_end}:
                mask = spread == k
                if full[k]:
                    one = np.flatnonzero(mask)[:1]
                    yield batch_of("sum", take(one), docs[[k]].astype(np.int32))
                else:
                    part = take(mask)
                    starts = new_doc[mask].astype(np.int32)
                    yield batch_of("open", part, starts)
            if open_end is None:
                held, state = None, None
                first = first and not len(docs)
                return
            mask = spread == open_end
            if full[open_end]:
                at = np.flatnonzero(mask)[-1]
                state = (rows["h1"][at], rows["h2"][at], int(docs[open_end]), (rows["doc"][at], rows["same"][at]))
                held = None
            else:
                held, state = take(mask), None
            if len(docs) > 1:
                first = False

        for batch in batches:
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in _LINE_NAMES}
            if not batch.num_rows:
                continue
            if state is not None and (rows["h1"][0], rows["h2"][0]) != state[:2]:
                one = {"h1": state[0], "h2": state[1], "doc": state[3][0], "same": state[3][1], "pos": np.int32(0)}
                if first:
                    yield batch_of("sum", {c: np.array([v]) for c, v in one.items()}, np.array([state[2]], np.int32))
                first, state = False, None
            if held is not None:
                rows = {c: np.concatenate([held[c], rows[c]]) for c in _LINE_NAMES}
            yield from closed(rows, last=False)
        if held is not None:
            yield from closed(held, last=True)
        elif state is not None:
            one = {"h1": state[0], "h2": state[1], "doc": state[3][0], "same": state[3][1], "pos": np.int32(0)}
            yield batch_of("sum", {c: np.array([v]) for c, v in one.items()}, np.array([state[2]], np.int32))

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """What identifies a document: its id, and a hash of its text for repeated or missing ids."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_DOC)).alias("doc"),
        F.xxhash64("doc_id", text_or_empty()).alias("same"),
        text_or_empty().alias("text"),
    )


def keep_bitmaps(docs: DataFrame, min_documents: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """``(doc, same, keep)`` for each document that loses a line.

    ``keep`` is a zlib-compressed bitmap, one bit per line in order; lines past its end stay.
    """
    if keep_first and min_documents < 2:
        raise ValueError("keep_first needs min_documents of 2 or more")
    lines = cut_lineage(line_rows(_keyed(require(docs, "doc_id", "text")), min_chars))
    key = ["h1", "h2", "doc", "same"]
    parts = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stream = lines.repartitionByRange(parts, *key).sortWithinPartitions(*key, "pos")
    found = cut_lineage(stream.mapInArrow(_decide(min_documents, keep_first), _OUT))
    # A document's rows of a key never part, so the documents of a cut key add up over the tasks.
    ends = found.where("kind in ('open', 'sum')")
    full = ends.groupBy("h1", "h2").agg(F.sum("docs").alias("docs")).where(F.col("docs") >= min_documents)
    late = ends.where("kind = 'open'").join(full.select("h1", "h2"), ["h1", "h2"], "left_semi")
    if keep_first:
        edge = found.where("kind in ('open', 'sum', 'lead')")
        leads = edge.groupBy("h1", "h2").agg(F.min(F.struct("doc", "same")).alias("lead"))
        late = late.unionByName(found.where("kind = 'lead'")).join(leads, ["h1", "h2"]).where(F.struct("doc", "same") != F.col("lead"))
    dropped = found.where("kind = 'drop'").select("doc", "same", "pos").unionByName(late.select("doc", "same", "pos"))
    places = dropped.groupBy("doc", "same").agg(F.collect_set("pos").alias("places"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for places in batch.column("places"):
                at = np.asarray(places.values)
                keep = np.ones(at.max() + 1, bool)
                keep[at] = False
                made.append(zlib.compress(len(keep).to_bytes(4, "little") + np.packbits(keep).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("same"), pa.array(made, pa.binary())], ["doc", "same", "keep"])

    return places.mapInArrow(pack, "doc long, same long, keep binary")


def unpack(keep: bytes) -> np.ndarray:
    raw = zlib.decompress(keep)
    return np.unpackbits(np.frombuffer(raw, np.uint8, offset=4))[: int.from_bytes(raw[:4], "little")].astype(bool)


def drop_repeated_lines(docs: DataFrame, min_documents: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """The documents with ``text`` shortened to the lines that stay, ``n_lines`` (before) and ``n_dropped`` added."""
    doc, same = "_line_doc", "_line_same"
    refuse(docs, doc, same, "_line_keep", "n_lines", "n_dropped")
    bitmaps = keep_bitmaps(docs, min_documents, min_chars, keep_first)
    keyed = docs.withColumns(
        {doc: F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_DOC)), same: F.xxhash64("doc_id", text_or_empty()), "text": text_or_empty()}
    )
    bitmaps = bitmaps.select(F.col("doc").alias(doc), F.col("same").alias(same), F.col("keep").alias("_line_keep"))
    met = keyed.join(bitmaps.hint("shuffle_hash"), [doc, same], "left").select(*docs.columns, "_line_keep")
    schema = with_fields(docs, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()))
    return met.mapInArrow(_shorten(docs.columns), schema)


def _shorten(names: list[str]):
    """Cut texts by their bitmaps, few documents at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            texts, keeps = batch.column("text").to_pylist(), batch.column("_line_keep").to_pylist()
            n_lines, n_dropped = [], []
            for i, (text, keep) in enumerate(zip(texts, keeps, strict=True)):
                if keep is None:
                    n_lines.append(text.count("\n") + 1)
                    n_dropped.append(0)
                    continue
                lines, bits = text.split("\n"), unpack(keep)
                n_lines.append(len(lines))
                n_dropped.append(int(len(bits) - bits.sum()))
                texts[i] = "\n".join([x for x, k in zip(lines, bits, strict=False) if k] + lines[len(bits) :])
            columns = {c: batch.column(c) for c in names} | {"text": pa.array(texts, pa.string())}
            columns |= {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
            yield pa.RecordBatch.from_pydict(columns)

    return run
