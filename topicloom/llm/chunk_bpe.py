"""BPE encoding by reuse of content-defined chunks, and decoding.

A rolling hash over a text's bytes cuts it where the hash of the last ``WINDOW`` bytes has ``CUT_BITS`` leading zeros, so equal passages
are cut alike wherever they stand. A chunk is encoded as a whole when a worker first meets it and remembered; later documents take its ids
from the memory. Chunks end in the middle of words, where their ids differ from those of the whole text. Each join is therefore
repaired: a window around it grows, on each side to the next place at which the tokenizer always cuts, over further chunks
if one has no such place, and is encoded again; its ids replace those of the chunks' ends. The tokenizer drops white space and
never joins characters over it, and NFC does not compose a blank, tab or line break with what stands before or after, so ids
outside the window are those of the whole text and the result is exact.

Within a chunk, words are encoded once too. Both memories are bounded by bytes, in two generations, so a worker holds at most a fixed
amount however long the words or texts are; a chunk is never longer than ``MAX_CHUNK`` bytes. Nothing is shuffled, and a lost worker costs its memory only.

Decoding joins the tokens of the ids as the library does for a tokenizer without a decoder: with a blank between them.

Defined cases: a null or empty text has no ids and decodes to an empty text. Strings of special tokens inside a text are those tokens, as in
the library. Texts without white space are one window, encoded whole. Extra columns stay; ``ids`` is refused as a name of an input
column, and ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` are by the digests.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer

from topicloom.llm.common import add_columns, require, text_or_empty

WINDOW = 32
CUT_BITS = 9  # a chunk of 512 bytes on average
MIN_CHUNK, MAX_CHUNK = 64, 8192
MEMORY_BYTES = 64 << 20
# Characters at which any text may be cut before it is encoded.
SAFE = b" \t\n\r"
_OVERHEAD = 300  # bytes of a remembered entry beside its key and value, about

# One random 32-bit number a byte, from a fixed rule.
_GEAR = (np.random.Generator(np.random.PCG64(12)).integers(0, 1 << 32, 256)).astype(np.uint32)


class ByteMemory:
    """Bytes under bytes; two generations of at most ``size`` bytes each, entries included. What is asked for again stays."""

    def __init__(self, size: int):
        self.size, self.used = size, 0
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        value = self.young.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key, value, cost: int = 0) -> None:
        cost = cost or len(key) + len(value[0] if isinstance(value, tuple) else value) + _OVERHEAD
        if cost > self.size // 8:
            return
        if self.used + cost > self.size:
            self.old, self.young, self.used = self.young, {}, 0
        self.young[key] = value
        self.used += cost


def rolling_hash(data: np.ndarray) -> np.ndarray:
    """At each byte the hash of the ``WINDOW`` bytes that end there, by doubling: each byte's number shifted by its distance."""
    hashes = _GEAR[data]
    width = 1
    while width < WINDOW:
        hashes[width:] += hashes[:-width] << np.uint32(width)
        width *= 2
    return hashes


def cuts(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """Where chunks end in each of the texts ``data[starts[i]:starts[i + 1]]`` (UTF-8), the text's end included.

    Only the bytes of the text itself decide, and no character is cut.
    """
    hashes = rolling_hash(data)
    whole = np.ones(len(data), bool)  # the next byte starts a character
    whole[:-1] = (data[1:] & 0xC0) != 0x80
    marks = np.flatnonzero((hashes >> np.uint32(32 - CUT_BITS) == 0) & whole) + 1
    out = []
    for a, b in zip(starts[:-1].tolist(), starts[1:].tolist()):
        here = marks[np.searchsorted(marks, a + WINDOW) : np.searchsorted(marks, b)].tolist()
        ends, at = [], a
        for end in (*here, b):
            if end < b and end - at < MIN_CHUNK:
                continue
            while end - at > MAX_CHUNK:
                at += MAX_CHUNK
                while not whole[at - 1]:
                    at -= 1
                ends.append(at)
            if end > at:
                ends.append(end)
                at = end
        out.append(np.array(ends, np.int64))
    return out


class ChunkCoder:
    """Encodes texts by chunks; the library encodes words that the memory does not hold."""

    def __init__(self, path: str, memory_bytes: int = MEMORY_BYTES):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab()
        self.kind = np.dtype("<u2" if max(vocabulary.values()) < 1 << 16 else "<u4")
        self.tokens = [self.library.id_to_token(i) or "" for i in range(max(vocabulary.values()) + 1)]
        self.chunks, self.words = ByteMemory(memory_bytes), ByteMemory(memory_bytes)
        self.encoded = self.reused = self.repaired = 0

    def learn(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        """The ids of pieces (no blank, tab or line break inside), as bytes; the library gets the unknown ones in one call."""
        known, new = {}, []
        for piece in set(pieces):
            ids = self.words.get(piece)
            if ids is None:
                new.append(piece)
            else:
                known[piece] = ids
        coded = self.library.encode_batch_fast([p.decode() for p in new], add_special_tokens=False)
        for piece, code in zip(new, coded, strict=True):
            known[piece] = ids = np.array(code.ids, self.kind).tobytes()
            self.words.put(piece, ids)
        return known

    def encode(self, data: np.ndarray, starts: np.ndarray) -> list[bytes]:
        """The ids of the texts ``data[starts[i]:starts[i + 1]]``, as bytes."""
        raw = data.tobytes()
        texts, unknown = [], {}
        for a, ends in zip(starts[:-1].tolist(), cuts(data, starts)):
            bounds = [a, *ends.tolist()]
            texts.append([raw[x:y] for x, y in zip(bounds, bounds[1:])])
            for chunk in texts[-1]:
                if chunk not in unknown:
                    unknown[chunk] = self.chunks.get(chunk)
        # All pieces of new chunks, and all windows over joins, in one call each.
        new = {chunk: split(chunk) for chunk, found in unknown.items() if found is None}
        ids = self.learn([p for pieces in new.values() for p in pieces if p])
        for chunk, pieces in new.items():
            parts = [ids[p] if p else b"" for p in pieces]
            # The whole chunk's ids, and how many bytes of them belong to its first and last piece.
            unknown[chunk] = value = (b"".join(parts), len(parts[0]), len(parts[-1]), len(pieces))
            self.chunks.put(chunk, value)
        self.encoded += len(new)
        self.reused += sum(map(len, texts)) - len(new)
        windows = [self._windows(chunks, unknown) for chunks in texts]
        repaired = self.learn([w for ws in windows for w in ws if w])
        return [self._join(chunks, unknown, ws, repaired) for chunks, ws in zip(texts, windows)]

    @staticmethod
    def _windows(chunks: list[bytes], known: dict) -> list[bytes]:
        """The piece over each join between chunks that hold a safe place; chunks without one lie in a window whole."""
        out: list[bytes] = []
        window: bytes | None = None
        for chunk in chunks:
            if known[chunk][3] == 1:
                window = chunk if window is None else window + chunk
                continue
            out.append((window or b"") + head(chunk))
            window = tail(chunk)
        if window is not None:
            out.append(window)
        return out

    def _join(self, chunks: list[bytes], known: dict, windows: list[bytes], repaired: dict[bytes, bytes]) -> bytes:
        parts, at = [], 0
        for chunk in chunks:
            ids, first, last, pieces = known[chunk]
            if pieces == 1:
                continue
            window = windows[at]
            at += 1
            parts.append(repaired[window] if window else b"")
            parts.append(ids[first : len(ids) - last])
        if at < len(windows) and windows[at]:
            parts.append(repaired[windows[at]])
        self.repaired += len(windows)
        return b"".join(parts)

    def decode(self, ids: np.ndarray) -> str:
        return " ".join(map(self.tokens.__getitem__, ids.tolist()))


_TO_BLANK = bytes.maketrans(SAFE, b" " * len(SAFE))


def split(chunk: bytes) -> list[bytes]:
    """The pieces between safe places; empty ones stand for places side by side or at an end."""
    return chunk.translate(_TO_BLANK).split(b" ")


def head(chunk: bytes) -> bytes:
    return chunk.translate(_TO_BLANK).split(b" ", 1)[0]


def tail(chunk: bytes) -> bytes:
    return chunk.translate(_TO_BLANK).rsplit(b" ", 1)[-1]


@cache
def _coder(path: str, memory_bytes: int) -> ChunkCoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return ChunkCoder(path, memory_bytes)


def _encode_column(texts: pa.Array, coder: ChunkCoder) -> list[bytes]:
    rows = [t.encode() if t else b"" for t in texts.to_pylist()]
    starts = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int64)
    return coder.encode(np.frombuffer(b"".join(rows), np.uint8), starts)


def encode(docs: DataFrame, tokenizer_path: str, memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """``docs`` with ``ids``, the token ids of the whole ``text``."""

    def compute(texts: pa.Array) -> list[pa.Array]:
        coder = _coder(tokenizer_path, memory_bytes)
        rows = _encode_column(texts, coder)
        offsets = np.append(0, np.cumsum([len(r) // coder.kind.itemsize for r in rows])).astype(np.int32)
        values = np.frombuffer(b"".join(rows), coder.kind).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]

    return add_columns(require(docs, "text"), "text", [T.StructField("ids", T.ArrayType(T.IntegerType()))], compute, rows=256)


def decode(coded: DataFrame, tokenizer_path: str, ids: str = "ids") -> DataFrame:
    """``coded`` with ``decoded``, the text of its ids."""

    def compute(lists: pa.Array) -> list[pa.Array]:
        coder = _coder(tokenizer_path, MEMORY_BYTES)
        return [pa.array([coder.decode(np.asarray(x or [], np.int64)) for x in lists.to_pylist()], pa.string())]

    return add_columns(require(coded, ids), ids, [T.StructField("decoded", T.StringType())], compute, rows=256)


def digests(docs: DataFrame, tokenizer_path: str, memory_bytes: int = MEMORY_BYTES) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: ids and decoded texts are made and hashed batch by batch, in one pass."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def compute(texts: pa.Array) -> list[pa.Array]:
        coder = _coder(tokenizer_path, memory_bytes)
        counts, ids_sums, text_sums = [], [], []
        for raw in _encode_column(texts, coder):
            ids = np.frombuffer(raw, coder.kind)
            counts.append(len(ids))
            ids_sums.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            text_sums.append(hashlib.sha256(coder.decode(ids).encode()).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(ids_sums, pa.string()), pa.array(text_sums, pa.string())]

    rows = require(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text"))
    return add_columns(rows, "text", fields, compute, rows=256).drop("text")
