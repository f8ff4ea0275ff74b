"""Benchmark decontamination: edit matching by the pigeonhole principle.

A test item is found in a document if some substring of the document is within ``floor(rate * length)`` edits of the
item; both are lower-cased and their white space is collapsed. With ``k`` edits allowed, an item is cut into ``k + 1``
pieces, one of which must occur unchanged. All pieces of all items are looked up in one pass by an Aho-Corasick
automaton. A hit must pass the ring form of the pigeonhole principle: some unchanged piece is followed by pieces with at most one
edit in the next, two in the next two, and so on (three are tested). What is left is verified with Myers'
bit-parallel edit distance, over the joined windows of all hits of the item in the document.

The items are the fixed side. They go to the tasks in blocks of at most ``block_chars`` characters, so what a task holds is
bounded however many items there are; each block is one pass over the documents. Documents are never shuffled.

Defined cases: null and empty texts and items match nothing. An item so short that no edit is allowed must occur as it
is. Repeated items and documents each give their own rows; null ids stay.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import require, text_or_empty

_CHAIN = 3


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces_of(size: int, edits: int) -> list[int]:
    """Where the ``edits + 1`` pieces begin, and the end."""
    return [size * j // (edits + 1) for j in range(edits + 2)]


def letter_bits(pattern: str) -> dict[str, int]:
    bits: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        bits[c] |= 1 << i
    return dict(bits)


def best_match(bits: dict[str, int], size: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """The least edit distance of a pattern to a substring (if ``anchored``, a prefix) of ``text``, and where it ends first.

    Myers' algorithm: the differences of a column of the distance table are bits of two integers.
    """
    if not size:
        return 0, 0
    mask, top = (1 << size) - 1, 1 << (size - 1)
    plus, minus, score = mask, 0, size
    best, at, carry = size, 0, int(anchored)
    get = bits.get
    for i, c in enumerate(text):
        eq = get(c, 0)
        x_v = eq | minus
        x_h = (((eq & plus) + plus) ^ plus) | eq
        up = minus | (~(x_h | plus) & mask)
        down = plus & x_h
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            if score < best:
                best, at = score, i + 1
        up = (up << 1) | carry
        plus = ((down << 1) | ~(x_v | up)) & mask
        minus = up & x_v & mask
    return best, at


class Items:
    """A block of test items, ready to be searched for."""

    def __init__(self, items: list[tuple[int | None, str | None]], rate: float):
        self.ids, self.texts, self.edits, self.bits = [], [], [], []
        pieces: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.chains: dict[tuple[int, int], tuple[dict[str, int], int, int] | None] = {}
        self.starts = []
        for item, raw in items:
            text = normal(raw)
            if not text:
                continue
            k, n = math.floor(rate * len(text)), len(self.ids)
            cuts = pieces_of(len(text), k)
            self.ids.append(item)
            self.texts.append(text)
            self.edits.append(k)
            self.bits.append(letter_bits(text))
            self.starts.append(cuts)
            for j in range(k + 1):
                pieces[text[cuts[j] : cuts[j + 1]]].append((n, j))
                follow = text[cuts[j + 1] : cuts[min(j + 1 + _CHAIN, k + 1)]]
                self.chains[n, j] = (letter_bits(follow), len(follow), min(_CHAIN, k - j))
        self.automaton = ahocorasick.Automaton()
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        self.automaton.make_automaton()

    def find(self, raw: str | None) -> Iterator[tuple[int, int, int]]:
        """``(item number, edits, end of the match in the normalised text)`` of each item found in a text."""
        text = normal(raw)
        if not text or not self.ids:
            return
        windows: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for end, (size, places) in self.automaton.iter(text):
            for n, j in places:
                bits, length, budget = self.chains[n, j]
                if length and not text.startswith(self.texts[n][self.starts[n][j + 1] :][:length], end + 1):
                    if best_match(bits, length, text[end + 1 : end + 1 + length + budget], anchored=True)[0] > budget:
                        continue
                k = self.edits[n]
                start = end + 1 - size - self.starts[n][j]
                windows[n].append((max(0, start - k), start + len(self.texts[n]) + k))
        for n, spans in windows.items():
            best = None
            for a, b in _joined(spans):
                edits, at = best_match(self.bits[n], len(self.texts[n]), text[a:b])
                if edits <= self.edits[n] and (best is None or edits < best[0]):
                    best = (edits, a + at)
            if best:
                yield n, *best


def _joined(spans: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    spans = sorted(spans)
    a, b = spans[0]
    for c, d in spans[1:]:
        if c > b:
            yield a, b
            a, b = c, d
        else:
            b = max(b, d)
    yield a, b


def find_items(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block_chars: int = 4_000_000) -> DataFrame:
    """``(doc_id, item_id, edits, end)``: each item found in each document, with its least edit distance."""
    items = require(benchmark, "item_id", "text").select(F.col("item_id").cast("long"), text_or_empty().alias("text"))
    keyed = require(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    found = None
    for rows in _item_blocks(items, block_chars):
        made = keyed.mapInArrow(_search(rows, rate), "doc_id long, item_id long, edits int, end int")
        found = made if found is None else found.unionByName(made)
    return found


def _item_blocks(items: DataFrame, block_chars: int) -> Iterator[list[tuple]]:
    """The items in blocks; an even deal fills half of a block's bound on average, and one long item may come on top."""
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = 1 + 2 * chars // block_chars
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    for b in range(blocks):
        yield [tuple(r) for r in (items if blocks == 1 else items.where(block == b)).collect()]


def _search(rows: list[tuple], rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(rows, rate)
        for batch in batches:
            out = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                out += [(doc, items.ids[n], edits, end) for n, edits, end in items.find(text.as_py())]
            columns = [list(c) for c in zip(*out)] if out else [[], [], [], []]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "item_id", "edits", "end"])

    return run


def without_items(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block_chars: int = 4_000_000) -> DataFrame:
    """The documents in which no item is found. The search runs in place: no text is shuffled."""
    require(docs, "doc_id", "text")
    items = require(benchmark, "item_id", "text").select("item_id", text_or_empty().alias("text"))
    kept = docs
    for rows in _item_blocks(items, block_chars):

        def run(batches: Iterator[pa.RecordBatch], rows=rows) -> Iterator[pa.RecordBatch]:
            search = Items(rows, rate)
            for batch in batches:
                clean = [next(search.find(t.as_py()), None) is None for t in batch.column("text")]
                yield batch.filter(pa.array(clean, pa.bool_()))

        kept = kept.mapInArrow(run, docs.schema)
    return kept
