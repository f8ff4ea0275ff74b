"""Token ids as range-asymmetric-numeral-system (rANS) frames, in ascending order of document id.

One static frequency table over all documents' ids is shared by all frames. A frame holds whole documents; its ids are cut into
blocks that are coded independently, each by ``LANES`` interleaved coders. A block stores the states of its coders at
regular steps (checkpoints) with the place in its words, so that decoding can start at any of them, and a checksum of its
ids. numpy codes many blocks at once: one step handles one id of every lane of every block.

Steps on Spark: encode texts to ids once (compressed rows, written), add up the frequencies (a table as large as the vocabulary,
which is the only thing that meets the driver), deal documents by ranges of the id and sort them, code frames and write them. Reading
decodes each frame by itself. The rows before a document are counted from frame totals.

The frames are rows of a Parquet table, which Spark commits task by task, so a lost executor leaves no broken file. All that is
needed to decode lies in the frame and in the frequency table beside it.

Frame, little-endian: magic ``RANF``, u32 crc32 of the rest, u32 documents, u64 ids, u32 blocks; compressed rows of u64 (id lengths) and
i64 (document ids, with u8 null flags); per block its size and the block. Block: u32 ids, u32 crc32 of the ids, u32 words, u32 checkpoints; per
checkpoint u32 place and ``LANES`` u64 states; u32 words.

Defined cases: a null or empty text has no ids but its end id. Null ids come first; documents of one id are ordered by their ids'
checksum and length. Empty tables give no frames.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from topicloom.llm.common import Remembered, require, text_or_empty
from topicloom.session import cut_lineage, shared_folder

MAGIC = b"RANF"
LANES = 32
BLOCK_STEPS = 1024
CHECKPOINT_STEPS = 256
FRAME_IDS = 1 << 21
TOGETHER = 64  # blocks coded at once
CACHE = 200_000
CHUNK = 4 << 20
_LOW = np.uint64(1 << 31)
_32 = np.uint64(32)
_WORD = np.uint64(0xFFFFFFFF)


# --- texts to ids ---------------------------------------------------------------------------------------------------


class _WordIds:
    """Ids of words seen before, as bytes; the library encodes new words.

    The tokenizer drops white space and never joins characters over it, so words encode on their own. A word of plain letters ends
    with the one id that carries the end of a word, so many go to the library in one text and are told apart afterwards; punctuation marks
    after it are looked up by themselves. Texts are split and equal words found by Arrow, so Python sees each distinct word of a
    batch once. Longer words than ``LONG`` hardly come again and are not remembered.
    """

    MARKS = ".,;:!?"
    # Letters below U+0130, where lower-casing and composing map one letter to one letter.
    LETTERS = "^[A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f]+$"
    END = "</w>"
    JOINED = 64
    LONG = 64

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.kind = np.dtype("<u2" if len(vocabulary) <= 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(self.END)]] = True
        self.letters, self.others = Remembered(CACHE), Remembered(CACHE)

    def known(self, words: list[str], memory: Remembered, encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        """The ids of distinct words, from the memory or else from the library."""
        made = list(map(memory.get, words))
        missing = [i for i, ids in enumerate(made) if ids is None]
        older = list(map(memory.old.get, (words[i] for i in missing)))
        new = [i for i, ids in zip(missing, older, strict=True) if ids is None]
        coded = iter(encode([words[i] for i in new]))
        for i, ids in zip(missing, older, strict=True):
            made[i] = ids = next(coded) if ids is None else ids
            if len(words[i]) <= self.LONG:
                memory[words[i]] = ids
        return made

    def spell(self, words: list[str]) -> list[bytes]:
        """Encode words of plain letters, many in one text."""
        rows = [words[at : at + self.JOINED] for at in range(0, len(words), self.JOINED)]
        out = []
        for row, code in zip(rows, self.library.encode_batch_fast([" ".join(row) for row in rows], add_special_tokens=False), strict=True):
            ids = np.array(code.ids, self.kind)
            cuts = np.append(0, np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize
            raw = ids.tobytes()
            out += [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        return out

    def plain(self, words: list[str]) -> list[bytes]:
        return [np.array(code.ids, self.kind).tobytes() for code in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def parts(self, words: pa.Array) -> tuple[np.ndarray, list[bytes]]:
        """Two numbers for each of some distinct words, of its letters and of the marks after them, and the ids that the numbers stand for."""
        cores = pc.utf8_rtrim(words, characters=self.MARKS)
        plain = pc.match_substring_regex(cores, self.LETTERS)
        marks = pc.extract_regex(words, "(?P<m>[" + self.MARKS + "]*)$").field("m")
        groups = (
            (pc.utf8_lower(cores.filter(plain)), self.letters, self.spell),
            (words.filter(pc.invert(plain)), self.others, self.plain),
            (pc.if_else(plain, marks, ""), self.others, self.plain),
        )
        made, at = [], []
        for texts, memory, encode in groups:
            coded = texts.dictionary_encode()
            at.append(coded.indices.to_numpy() + np.int64(len(made)))
            made += self.known(coded.dictionary.to_pylist(), memory, encode)
        mask = plain.to_numpy(zero_copy_only=False)
        both = np.zeros((len(words), 2), np.int32)
        both[mask, 0], both[~mask, 0], both[:, 1] = at
        return both, made

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and all ids one after the other."""
        if not len(texts):
            return np.zeros(0, np.int64), np.zeros(0, self.kind)
        lists = pc.split_pattern(pc.replace_substring(texts.cast(pa.large_string()), "\n", " "), " ")
        words = lists.flatten().dictionary_encode()
        both, made = self.parts(words.dictionary.cast(pa.string()))
        # A slice holds about CHUNK bytes or one text, and Spark's rows end at 2 GB, so 32 bits number its ids.
        sizes = np.fromiter(map(len, made), np.int32, len(made)) // self.kind.itemsize
        starts = np.append(0, np.cumsum(sizes, dtype=np.int32))
        flat = np.frombuffer(b"".join(made), self.kind)
        which = both[words.indices.to_numpy()].ravel()
        n = sizes[which]
        ends = np.cumsum(n, dtype=np.int32)
        ids = flat[np.repeat(starts[which] - (ends - n), n) + np.arange(ends[-1], dtype=np.int32)]
        offsets = lists.offsets.to_numpy()
        return np.diff(np.append(0, ends)[2 * (offsets - offsets[0])]), ids


@cache
def _word_ids(path: str) -> _WordIds:
    return _WordIds(path)


def token_rows(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """``(doc_id, n, crc, packed)`` per document: its ids with the end id, compressed."""
    keyed = require(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        words = _word_ids(tokenizer_path)
        pack = zstandard.ZstdCompressor(level=1, write_checksum=False, write_content_size=True).compress
        for whole in batches:
            for batch in _by_bytes(whole, whole.column("text")):
                counts, ids = words.ids(batch.column("text"))
                counts, ends = counts + 1, np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                sums, packed = [], []
                for end, n in zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True):
                    own = ids[end - n : end]
                    sums.append(zlib.crc32(own.astype("<u4")))
                    packed.append(pack(own.tobytes()))
                made = [pa.array(counts, pa.int64()), pa.array(sums, pa.int64()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made], ["doc_id", "n", "crc", "packed"])

    return keyed.mapInArrow(run, "doc_id long, n long, crc long, packed binary")


def _by_bytes(batch: pa.RecordBatch, texts: pa.Array, size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of about ``size`` bytes of text, of a row at least."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def unpack_ids(packed: bytes, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(packed), kind)


def frequencies(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all documents; ``size`` (the vocabulary) bounds the rows that reach the driver."""
    kind = _kind(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            rows = batch.column("packed")
            for at in range(0, len(rows), 256):
                # One count for many documents: each count walks the whole vocabulary.
                raw = b"".join(unpack_ids(p, kind).data for p in rows.slice(at, 256).to_pylist())
                total += np.bincount(np.frombuffer(raw, kind), minlength=size)
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[ids])], ["id", "n"])

    counts = tokens.select("packed").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    out = np.zeros(size, np.int64)
    for row in counts.collect():
        out[row["id"]] = row["n"]
    return out


def _kind(size: int) -> np.dtype:
    return np.dtype("<u2" if size <= 1 << 16 else "<u4")


# --- rANS -----------------------------------------------------------------------------------------------------------


class Table:
    """A static frequency table scaled to a power of two; every id that occurs has at least one slot."""

    def __init__(self, counts: np.ndarray):
        used = np.flatnonzero(counts)
        self.bits = max(14, int(len(used)).bit_length() + 3)
        slots = 1 << self.bits
        freq = np.zeros(len(counts), np.int64)
        if len(used):
            n = counts[used].astype(np.float64)
            freq[used] = np.maximum(1, np.floor(n / n.sum() * (slots - len(used)))).astype(np.int64)
            freq[used[np.argmax(counts[used])]] += slots - freq.sum()
        self.freq = freq
        self.start = np.append(0, np.cumsum(freq))[:-1]
        self.fill = int(np.argmax(freq))  # pads the last step of a block
        self.slot = np.repeat(np.arange(len(freq), dtype=np.uint32), freq)
        self._f, self._c = freq.astype(np.uint64), self.start.astype(np.uint64)

    def encode(self, ids: np.ndarray, steps: int) -> list[bytes]:
        """Code rows of ``ids`` (blocks x up to ``steps * LANES`` ids, all rows of the same length) at once."""
        blocks, n = ids.shape
        padded = np.full((blocks, steps * LANES), self.fill, np.int64)
        padded[:, :n] = ids
        lanes = np.ascontiguousarray(padded.reshape(blocks, steps, LANES).transpose(1, 0, 2))
        state = np.full((blocks, LANES), _LOW)
        bits, top = np.uint64(self.bits), np.uint64(63 - self.bits)
        out, sent = np.zeros((steps, blocks, LANES), np.uint32), np.zeros((steps, blocks, LANES), bool)
        saved = []
        for s in range(steps - 1, -1, -1):
            f, c = self._f[lanes[s]], self._c[lanes[s]]
            over = state >= (f << top)
            out[s] = (state & _WORD).astype(np.uint32)
            sent[s] = over
            state = np.where(over, state >> _32, state)
            whole = state // f
            state = (whole << bits) + (state - whole * f) + c
            if s % CHECKPOINT_STEPS == 0:
                saved.append((s, state.copy()))
        saved.reverse()
        made = []
        for b in range(blocks):
            words = out[:, b][sent[:, b]]
            ends = np.append(0, np.cumsum(sent[:, b].sum(axis=1)))
            head = struct.pack("<4I", n, zlib.crc32(ids[b].astype("<u4").tobytes()), len(words), len(saved))
            marks = b"".join(struct.pack("<I", ends[s]) + x[b].astype("<u8").tobytes() for s, x in saved)
            made.append(head + marks + words.astype("<u4").tobytes())
        return made

    def decode(self, blocks: list[bytes], checkpoint: int = 0) -> list[np.ndarray]:
        """The ids of blocks of equal length, from a checkpoint on; raises if a block from its start fails its checksum."""
        heads = [struct.unpack_from("<4I", b) for b in blocks]
        n, _, _, marks = heads[0]
        if any((h[0], h[3]) != (n, marks) for h in heads):
            raise ValueError("blocks of one call must have one length")
        steps = -(-n // LANES)
        first = checkpoint * CHECKPOINT_STEPS
        at_mark, size = 16 + checkpoint * (4 + 8 * LANES), 4 + 8 * LANES
        place = np.array([struct.unpack_from("<I", b, at_mark)[0] for b in blocks], np.int64)
        state = np.stack([np.frombuffer(b, "<u8", LANES, at_mark + 4) for b in blocks]).astype(np.uint64)
        words = [np.frombuffer(b, "<u4", h[2], 16 + h[3] * size) for b, h in zip(blocks, heads, strict=True)]
        base = np.append(0, np.cumsum([len(w) for w in words]))[:-1]
        flat = np.append(np.concatenate(words), np.uint32(0)).astype(np.uint64)
        place = (place + base)[:, None]
        bits, mask = np.uint64(self.bits), np.uint64((1 << self.bits) - 1)
        out = np.zeros((steps - first, len(blocks), LANES), np.int64)
        for s in range(steps - first):
            low = state & mask
            ids = self.slot[low]
            out[s] = ids
            state = self._f[ids] * (state >> bits) + low - self._c[ids]
            need = state < _LOW
            ahead = np.cumsum(need, axis=1)
            word = flat[np.where(need, place + ahead - 1, len(flat) - 1)]
            state = np.where(need, (state << _32) | word, state)
            place = place + ahead[:, -1:]
        rows = out.transpose(1, 0, 2).reshape(len(blocks), -1)[:, : n - first * LANES]
        if not checkpoint:
            for row, head in zip(rows, heads, strict=True):
                if zlib.crc32(row.astype("<u4").tobytes()) != head[1]:
                    raise ValueError("a block's checksum differs")
        return list(rows)


def encode_frame(table: Table, doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray) -> bytes:
    size = BLOCK_STEPS * LANES
    whole = len(ids) // size
    blocks = []
    for at in range(0, whole, TOGETHER):
        blocks += table.encode(ids[at * size : min(at + TOGETHER, whole) * size].reshape(-1, size), BLOCK_STEPS)
    rest = ids[whole * size :]
    if len(rest):
        blocks += table.encode(rest[None], -(-len(rest) // LANES))
    nulls = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    index = zlib.compress(lengths.astype("<u8").tobytes() + keys.tobytes() + nulls.tobytes(), 1)
    body = struct.pack("<IQII", len(doc_ids), len(ids), len(blocks), len(index)) + index
    body += b"".join(struct.pack("<I", len(b)) + b for b in blocks)
    return MAGIC + struct.pack("<I", zlib.crc32(body)) + body


def decode_frame(table: Table, frame: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, lengths and all ids of a frame."""
    if frame[:4] != MAGIC or zlib.crc32(memoryview(frame)[8:]) != struct.unpack_from("<I", frame, 4)[0]:
        raise ValueError("not a whole frame")
    n_docs, n_ids, n_blocks, index_size = struct.unpack_from("<IQII", frame, 8)
    at = 28
    index = zlib.decompress(frame[at : at + index_size])
    at += index_size
    lengths = np.frombuffer(index, "<u8", n_docs).astype(np.int64)
    keys, nulls = np.frombuffer(index, "<i8", n_docs, 8 * n_docs), np.frombuffer(index, np.uint8, n_docs, 16 * n_docs)
    blocks = []
    for _ in range(n_blocks):
        size = struct.unpack_from("<I", frame, at)[0]
        blocks.append(frame[at + 4 : at + 4 + size])
        at += 4 + size
    parts: list[np.ndarray] = []
    full = n_blocks - (n_ids % (BLOCK_STEPS * LANES) > 0)
    for i in range(0, full, TOGETHER):
        parts += table.decode(blocks[i : min(i + TOGETHER, full)])
    if full < n_blocks:
        parts += table.decode(blocks[full:])
    ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return [None if z else int(k) for k, z in zip(keys, nulls, strict=True)], lengths, ids


# --- Spark ----------------------------------------------------------------------------------------------------------


def write_store(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> str:
    """Encode and write all documents; returns the folder of the store (in the shared folder unless given)."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/rans-{uuid.uuid4().hex}"
    size = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)
    tokens = cut_lineage(token_rows(docs, tokenizer_path, end_id))
    counts = frequencies(tokens, size)
    kept = [(i, int(counts[i])) for i in np.flatnonzero(counts).tolist()]
    spark.createDataFrame(kept, "id long, n long").coalesce(1).write.parquet(f"{folder}/table")
    # In order of the id: an int column keeps nulls first.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), "crc", "n"]
    dealt = tokens.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    frames = dealt.mapInArrow(_frames(counts), "part int, seq int, n_ids long, frame binary")
    frames.write.option("compression", "uncompressed").parquet(f"{folder}/frames")
    return folder


def _frames(counts: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kind = _kind(len(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, seq = Table(counts), TaskContext.get().partitionId(), 0
        docs, ids, total = [], [], 0

        def made() -> pa.RecordBatch:
            frame = encode_frame(table, docs, np.array([len(i) for i in ids]), np.concatenate(ids))
            columns = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([total], pa.int64()), pa.array([frame], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "seq", "n_ids", "frame"])

        for batch in batches:
            for doc, packed in zip(batch.column("doc_id").to_pylist(), batch.column("packed").to_pylist(), strict=True):
                docs.append(doc)
                ids.append(unpack_ids(packed, kind))
                total += len(ids[-1])
                if total >= FRAME_IDS:
                    yield made()
                    docs, ids, total, seq = [], [], 0, seq + 1
        if docs:
            yield made()

    return run


def read_store(spark: SparkSession, folder: str, checksums: bool = False) -> DataFrame:
    """``(doc_id, start, ids)`` of every document, decoded from the frames; ``start`` counts the ids before it.

    With ``checksums``, ``(doc_id, start, n_tokens, ids_crc32)``: the number of the decoded ids and their checksum as little-endian
    unsigned 32-bit integers, taken in the task that decodes, so that the ids themselves need not leave it.
    """
    rows = spark.read.parquet(f"{folder}/table").collect()  # one row per id of the vocabulary
    counts = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        counts[r["id"]] = r["n"]
    frames = spark.read.parquet(f"{folder}/frames")
    # Totals before a frame: over the tasks (one row each), then within its task.
    parts = frames.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    places = frames.select("part", "seq", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("skip"))
    places = places.join(parts, "part").select("part", "seq", (F.col("base") + F.col("skip")).alias("start"))
    placed = frames.select("part", "seq", "frame").join(places.hint("shuffle_hash"), ["part", "seq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(counts)
        for batch in batches:
            for start, frame in zip(batch.column("start").to_pylist(), batch.column("frame"), strict=True):
                docs, lengths, ids = decode_frame(table, frame.as_py())
                ends = np.append(0, np.cumsum(lengths))
                ids = ids.astype("<u4")
                raw = memoryview(ids).cast("B")
                for a in range(0, len(docs), 2048):
                    b = min(a + 2048, len(docs))
                    columns = [pa.array(docs[a:b], pa.int64()), pa.array(start + ends[a:b])]
                    if checksums:
                        sums = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(ends[a:b].tolist(), ends[a + 1 : b + 1].tolist(), strict=True)]
                        columns += [pa.array(lengths[a:b]), pa.array(sums, pa.int64())]
                    else:
                        values = pa.array(ids[ends[a] : ends[b]].view("<i4"))
                        columns.append(pa.ListArray.from_arrays(pa.array(ends[a : b + 1] - ends[a], pa.int32()), values))
                    yield pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] if checksums else ["doc_id", "start", "ids"]
    kinds = "n_tokens long, ids_crc32 long" if checksums else "ids array<int>"
    return placed.select("start", "frame").mapInArrow(run, f"doc_id long, start long, {kinds}")
