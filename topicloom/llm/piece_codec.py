"""SentencePiece merge-type encoding by a prefix table, and decoding.

A merge-type encoding has the property that a row of tokens is the encoding of its text exactly if each
neighbouring pair of tokens is the encoding of the pair's text. So every prefix of a text has one last token: of the tokens
that end there, the one that fits the last token of the prefix before it. The table of last tokens is filled from left to right from
the matches of an Aho-Corasick automaton over all pieces and a test of pairs; the ids are recovered backwards from its end.

No piece holds a word mark (U+2581) after another character, and none a character outside the pieces' alphabet: so the
text falls into words that encode on their own, and the table is filled once per distinct word and worker, as far as a
bounded memory of words (two generations of ``CACHE``) reaches. Ids are decoded many rows at a time: their pieces are taken from an Arrow
table, where they lie one behind the other, so rows only need their borders.

The model file's path is a parameter, and each worker reads the file. Only models with the identity normaliser and a
leading word mark are taken (checked when the file is read).

Defined cases: a null or empty text has no ids and decodes to the empty text. A character that no piece holds becomes its bytes. A word
mark in the text counts as a space, as in the library. Repeated rows and null ids stay as they are; extra columns stay.
"""

from __future__ import annotations

import struct
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pac
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.common import Remembered, add_columns, require, text_or_empty

MARK = "▁"  # Fixed value: stands for a space inside pieces.
CACHE = 200_000
AT_ONCE = 1 << 20  # ids of about so many are decoded at once
_FOREIGN = -1


class Pieces:
    """The pieces of one model: encoding and decoding of single texts."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.get_piece_size())
        self.pieces = [model.id_to_piece(i) for i in ids]
        self.byte_ids = {int(self.pieces[i][3:-1], 16): i for i in ids if model.is_byte(i)}
        special = {i for i in ids if model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)}
        normal = [i for i in ids if i not in special]
        if model.normalize(" ﬁ  x") != f"{MARK}{MARK}ﬁ{MARK}{MARK}x" or len(self.byte_ids) != 256:
            raise ValueError("the model needs the identity normaliser, a leading word mark and byte pieces")
        if any(MARK in self.pieces[i].lstrip(MARK) for i in normal):
            raise ValueError("a piece holds a word mark after another character")
        self.sizes = [len(p) for p in self.pieces]
        self.ids = {self.pieces[i]: i for i in normal}
        self.scores = {self.pieces[i]: model.get_score(i) for i in normal}
        self.automaton = ahocorasick.Automaton()
        for i in normal:
            self.automaton.add_word(self.pieces[i], (i, len(self.pieces[i])))
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}  # by left token * number of pieces + right token
        self.bytes = [self.pieces[i].replace(MARK, " ").encode() if i not in special else b"" for i in ids]
        for value, i in self.byte_ids.items():
            self.bytes[i] = bytes([value])
        unknown = next(i for i in ids if model.is_unknown(i))
        self.bytes[unknown] = model.decode([unknown]).encode()
        # A second time as they are at the start of a text, without their word mark.
        starts = [b[1:] if b[:1] == b" " and p.startswith(MARK) else b for p, b in zip(self.pieces, self.bytes)]
        self.taken = pa.array([*self.bytes, *starts], pa.binary())
        self.kind = np.dtype("<u2" if len(self.pieces) <= 1 << 16 else "<u4")
        self.marked, self.plain = _Words(self, MARK), _Words(self, "")

    def merged(self, text: str) -> list[str]:
        """The encoding of a short text by its definition: merge the best pair, leftmost first, as long as there is one."""
        parts, score, none = list(text), self.scores.get, -np.inf
        scores = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while scores and (best := max(scores)) != none:
            at = scores.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del scores[at]
            # Only the pairs that hold the new part have changed.
            if at:
                scores[at - 1] = score(parts[at - 1] + parts[at], none)
            if at < len(scores):
                scores[at] = score(parts[at] + parts[at + 1], none)
        return parts

    def fit(self, left: int, right: int) -> bool:
        """True if the two tokens in a row are the encoding of their text (``_FOREIGN`` on the left: ``right`` alone)."""
        last = self.pieces[right]
        if left == _FOREIGN:
            return self.merged(last) == [last]
        text = self.pieces[left] + last
        # Two parts that make a piece would merge in the end.
        return text not in self.ids and self.merged(text) == [self.pieces[left], last]

    def word_ids(self, word: str) -> list[int]:
        """The ids of one word by the table of last tokens."""
        last: list[int] = [_FOREIGN] * (len(word) + 1)
        done = -1
        fits, width = self.fits, len(self.pieces)
        if len(fits) >= 4 * CACHE:
            fits.clear()
        for end, (token, size) in self.automaton.iter(word):
            if end == done:
                continue
            before = last[end + 1 - size]
            pair = before * width + token
            good = fits.get(pair)
            if good is None:
                good = fits[pair] = self.fit(before, token)
            if good:
                last[end + 1] = token
                done = end
        out, at = [], len(word)
        while at:
            token = last[at]
            if token == _FOREIGN:
                out += [self.byte_ids[b] for b in reversed(word[at - 1].encode())]
                at -= 1
            else:
                out.append(token)
                at -= self.sizes[token]
        out.reverse()
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned integers of ``kind``."""
        if not text:
            return b""
        marked, plain = self.marked.__getitem__, self.plain.__getitem__
        lines, out, first = text.replace(MARK, " ").split("\n"), [], True
        for line in lines:
            words = line.split(" ")
            if not first:
                out.append(plain("\n"))
            if not first:
                out.append(plain(words.pop(0)))
            if "" in words:
                words = _runs(words)
            out += map(marked, words)
            first = False
        return b"".join(out)

    def decode(self, ids) -> str:
        """The text of ids; a leading word mark is dropped, ids of broken byte rows give replacement characters."""
        table = self.bytes
        raw = b"".join([table[i] for i in ids])
        return (raw[1:] if raw[:1] == b" " and len(ids) and self.pieces[ids[0]].startswith(MARK) else raw).decode("utf-8", "replace")

    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """The texts of lists of ids, the same as :meth:`decode` gives one by one; a null list gives the empty text."""
        sizes = pac.fill_null(pac.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        ends, flat, out, at = np.append(0, np.cumsum(sizes, dtype=np.int64)), lists.flatten(), [], 0
        while at < len(lists):
            end = max(at + 1, int(np.searchsorted(ends, ends[at] + AT_ONCE, "right")) - 1)
            out.append(self._joined(flat[ends[at] : ends[end]], ends[at : end + 1] - ends[at]))
            at = end
        return pa.concat_arrays(out) if out else pa.array([], pa.string())

    def _joined(self, ids: pa.Array, ends: np.ndarray) -> pa.Array:
        """The texts of ids that end at ``ends``."""
        size, bounds = len(self.pieces), pac.min_max(ids).as_py()
        if ids.null_count or len(ids) and not 0 <= bounds["min"] <= bounds["max"] < size:
            return pa.array([self.decode(ids[a:b].to_pylist()) for a, b in zip(ends, ends[1:])], pa.string())
        if not len(ids):
            return pa.array([""] * (len(ends) - 1), pa.string())
        places = ids.to_numpy().astype(np.int64)
        places[ends[:-1][ends[1:] > ends[:-1]]] += size
        _, borders, data = self.taken.take(pa.array(places)).buffers()
        borders = np.frombuffer(borders, np.int32, len(places) + 1)[ends]
        texts = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(borders), data or pa.py_buffer(b"")])
        try:
            return texts.cast(pa.string())
        except pa.ArrowInvalid:  # broken byte rows
            return pa.array([t.decode("utf-8", "replace") for t in texts.to_pylist()], pa.string())


def _runs(words: list[str]) -> list[str]:
    """Words between spaces, where an empty one (two spaces in a row) becomes a mark before the word that follows."""
    out, marks = [], 0
    for w in words[:-1]:
        if w:
            out.append(MARK * marks + w)
            marks = 0
        else:
            marks += 1
    return [*out, MARK * marks + words[-1]]


class _Words(Remembered):
    """Ids of words seen before, as bytes; a new word is encoded on demand."""

    def __init__(self, pieces: Pieces, mark: str):
        super().__init__(CACHE)
        self.pieces_, self.mark = pieces, mark

    def __missing__(self, word: str) -> bytes:
        made = self.old.get(word)
        if made is None:
            ids = self.pieces_.word_ids(self.mark + word)
            made = struct.pack(f"<{len(ids)}{self.pieces_.kind.char}", *ids)
        self[word] = made
        return made


@cache
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _id_lists(model: Pieces, texts: list[str]) -> pa.Array:
    coded = [model.encode(t) for t in texts]
    ends = np.append(0, np.cumsum([len(c) for c in coded])) // model.kind.itemsize
    flat = np.frombuffer(b"".join(coded), model.kind).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


_IDS = T.StructField("ids", T.ArrayType(T.IntegerType(), False))


def encode(docs: DataFrame, model_path: str, verify: bool = False) -> DataFrame:
    """``docs`` with the ``ids`` (array of int) of ``text`` added; a null text becomes empty.

    With ``verify`` the ids are decoded again and the job fails if that gives another text.
    """
    full = require(docs, "text").withColumn("text", text_or_empty())

    def compute(column: pa.Array) -> list[pa.Array]:
        model, texts = pieces(model_path), column.to_pylist()
        ids = _id_lists(model, texts)
        if verify:
            for text, back in zip(texts, model.decode_lists(ids).to_pylist(), strict=True):
                if back != text.replace(MARK, " "):
                    raise ValueError(f"ids do not decode to their text: {text[:80]!r}")
        return [ids]

    return add_columns(full, "text", [_IDS], compute)


def encode_and_decode(docs: DataFrame, model_path: str) -> DataFrame:
    """:func:`encode` and :func:`decode` in one pass: ``ids`` and ``decoded`` added."""
    full = require(docs, "text").withColumn("text", text_or_empty())

    def compute(texts: pa.Array) -> list[pa.Array]:
        model = pieces(model_path)
        ids = _id_lists(model, texts.to_pylist())
        return [ids, model.decode_lists(ids)]

    return add_columns(full, "text", [_IDS, T.StructField("decoded", T.StringType())], compute)


def decode(coded: DataFrame, model_path: str, column: str = "decoded") -> DataFrame:
    """``coded`` with the text of its ``ids`` added; null ids give the empty text."""

    def compute(ids: pa.Array) -> list[pa.Array]:
        return [pieces(model_path).decode_lists(ids)]

    return add_columns(require(coded, "ids"), "ids", [T.StructField(column, T.StringType())], compute)


def digests(coded: DataFrame) -> DataFrame:
    """Counts and digests of the ids and of the decoded text."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
