"""Personal data: patterns, and a skip-chain conditional random field that adds spans.

Patterns give the base spans (e-mail, IP, card, phone). The field's nodes are words that hold a digit or ``@``; its labels are the four
kinds and none. A node has features of its shape and of its neighbouring words. Chain edges join nodes that are neighbouring
words; skip edges join a node with the last one of the same text or shape, however distant, so that repeated and similar
tokens share potentials and tend to one label in the whole document. Occurrences are linked one to the next, never all to all.
Beliefs come from loopy sum-product message passing with damping; the nodes of a whole batch of documents are one graph to numpy.
A node that the field gives a kind with probability ``threshold`` or more, and that no base span touches, becomes a span; neighbours of one kind are one span.

Training: labels are those of the base spans, on a documented sample, the ``max_docs`` documents with the smallest hash among those that
hold a digit or ``@``. The weights of features, chain and skip edges maximise the pseudo-likelihood (each node given its
neighbours' labels) with a pull to zero. Weights and features are bounded by ``max_features`` and go to the tasks.

Positions count code points, with an exclusive end. Defined cases: a null or empty text has no spans. Repeated rows and null ids are scanned like others. Without
a document to learn from, only base spans are found. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.common import add_columns, require, sample_by_hash, text_or_empty
from topicloom.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")
_LABELS = len(KINDS) + 1  # the last one is none
_NONE = len(KINDS)

# What each kind looks like. A match never begins inside a run of digits, as an earlier start would have the same rest.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HAS_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_EDGES = ".,;:!?\"'()[]{}<>|"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the pattern matches, in order."""
    spans = []
    at, done = text.find("@"), 0
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            spans.append((start, 0, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    if _HAS_DIGIT.search(text):
        spans += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    spans.append((m.start(), 2, m.end()))
        spans += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(spans)


def shape(word: str) -> str:
    """Letters as ``a``, digits as ``9``; long runs are told by their length class."""
    out = []
    for part in re.findall(r"[^\W\d_]+|[0-9]+|.", word[:80]):
        if part[0].isdigit() and part.isascii():
            out.append("9" * len(part) if len(part) < 5 else f"9<{min(len(part), 20)}>")
        else:
            out.append("a" if part[0].isalpha() else part)
    return "".join(out) if len(out) <= 14 else f"mixed<{min(len(word) // 8, 8)}>"


@dataclass
class Nodes:
    """The nodes of one text: their places, features and edges (a node and a later one)."""

    places: list[tuple[int, int]]
    features: list[list[str]]
    chain: list[tuple[int, int]]
    skip: list[tuple[int, int]]


def nodes_of(text: str) -> Nodes:
    made = Nodes([], [], [], [])
    if "@" not in text and not _HAS_DIGIT.search(text):
        return made
    before, last_node, seen_text, seen_shape = "", -2, {}, {}
    words = [(m.start(), m[0]) for m in _WORD.finditer(text)]
    for i, (start, word) in enumerate(words):
        if "@" in word or _HAS_DIGIT.search(word):
            bare = word.strip(_EDGES) or word
            at = start + word.find(bare)
            n, form = len(made.places), shape(bare)
            after = words[i + 1][1] if i + 1 < len(words) else ""
            digits = sum(c.isdigit() for c in bare)
            made.features.append(
                ["bias", f"shape={form}", f"digits={min(digits, 20)}", f"long={min(len(bare) // 8, 8)}", f"all={digits == len(bare)}", f"at={'@' in bare}",
                 f"dots={min(bare.count('.'), 4)}", f"plus={bare[:1] == '+'}", f"before={before.lower()[-20:]}", f"after={shape(after)}", f"ahead={shape(before)}"]
            )
            made.places.append((at, at + len(bare)))
            if last_node == i - 1:
                made.chain.append((n - 1, n))
            same = seen_text.get(bare)
            alike = seen_shape.get(form) if same is None else None
            if same is not None or (alike is not None and len(bare) >= 6):
                made.skip.append((same if same is not None else alike, n))
            seen_text[bare] = seen_shape[form] = n
            last_node = i
        before = word
    return made


def labels_of(nodes: Nodes, spans: list[tuple[int, int, int]]) -> list[int]:
    """The kind of the base span that touches each node; both come in order."""
    out, at = [], 0
    for start, end in nodes.places:
        while at < len(spans) and spans[at][2] <= start:
            at += 1
        out.append(spans[at][1] if at < len(spans) and spans[at][0] < end else _NONE)
    return out


@dataclass
class Field:
    """Trained weights: of features by label, and of the labels on both ends of chain and skip edges."""

    index: dict[str, int]
    weights: np.ndarray
    chain: np.ndarray
    skip: np.ndarray

    def potentials(self, nodes: list[Nodes]) -> np.ndarray:
        out = np.zeros((sum(len(x.places) for x in nodes), _LABELS))
        n = 0
        for x in nodes:
            for features in x.features:
                known = [self.index[f] for f in features if f in self.index]
                out[n] = self.weights[known].sum(axis=0)
                n += 1
        return out

    def beliefs(self, nodes: list[Nodes], rounds: int = 10, damping: float = 0.5) -> np.ndarray:
        """The probability of each label of each node, by loopy message passing."""
        local = self.potentials(nodes)
        first, second, table = _edges(nodes, (self.chain, self.skip))
        if not len(first):
            return _softmax(local)
        source, target = np.concatenate([first, second]), np.concatenate([second, first])
        tables = np.concatenate([table, table.transpose(0, 2, 1)])  # by label of the source, then of the target
        back = np.concatenate([np.arange(len(first)) + len(first), np.arange(len(first))])
        messages = np.zeros((len(source), _LABELS))
        for _ in range(rounds):
            belief = local.copy()
            np.add.at(belief, target, messages)
            out = (belief[source] - messages[back])[:, :, None] + tables
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            messages = damping * messages + (1 - damping) * new
        belief = local.copy()
        np.add.at(belief, target, messages)
        return _softmax(belief)


def _edges(nodes: list[Nodes], tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pairs, kinds, base = [], [], 0
    for x in nodes:
        for kind, edges in enumerate((x.chain, x.skip)):
            pairs += [(a + base, b + base) for a, b in edges]
            kinds += [kind] * len(edges)
        base += len(x.places)
    if not pairs:
        return np.zeros(0, int), np.zeros(0, int), np.zeros((0, _LABELS, _LABELS))
    pairs = np.array(pairs)
    return pairs[:, 0], pairs[:, 1], np.stack(tables)[np.array(kinds)]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(nodes: list[Nodes], labels: list[list[int]], max_features: int = 5_000, steps: int = 250, pull: float = 0.02) -> Field | None:
    """Maximise the pseudo-likelihood by gradient steps (Adam) over all nodes of the sample."""
    counts = Counter(f for x in nodes for fs in x.features for f in fs)
    if not counts:
        return None
    index = {f: i for i, (f, _) in enumerate(sorted(((f, n) for f, n in counts.items() if n >= 3), key=lambda x: (-x[1], x[0]))[:max_features])}
    y = np.array([v for x in labels for v in x])
    n = len(y)
    rows, cols = [], []
    i = 0
    for x in nodes:
        for fs in x.features:
            for f in fs:
                if f in index:
                    rows.append(i)
                    cols.append(index[f])
            i += 1
    rows, cols = np.array(rows, int), np.array(cols, int)
    zero = np.zeros((_LABELS, _LABELS))
    parts = []
    for kind in range(2):
        only = [Nodes(x.places, x.features, x.chain if kind == 0 else [], x.skip if kind == 1 else []) for x in nodes]
        parts.append(_edges(only, (zero, zero))[:2])
    one_hot = np.eye(_LABELS)[y]
    theta = [np.zeros((len(index), _LABELS)), zero.copy(), zero.copy()]
    moments = [[np.zeros_like(t), np.zeros_like(t)] for t in theta]
    for step in range(1, steps + 1):
        logits = np.zeros((n, _LABELS))
        np.add.at(logits, rows, theta[0][cols])
        for (a, b), table in zip(parts, theta[1:], strict=True):
            np.add.at(logits, a, table[:, y[b]].T)
            np.add.at(logits, b, table[y[a]])
        off = one_hot - _softmax(logits)
        slopes = [np.zeros_like(theta[0]), zero.copy(), zero.copy()]
        np.add.at(slopes[0], cols, off[rows])
        for k, (a, b) in enumerate(parts, 1):
            np.add.at(slopes[k].T, y[b], off[a])
            np.add.at(slopes[k], y[a], off[b])
        for t, g, (m, v) in zip(theta, slopes, moments, strict=True):
            g = g / n - pull * t / n**0.5 / 10
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            t += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    theta[2] = (theta[2] + theta[2].T) / 2  # skip edges have no direction
    return Field(index, *theta)


def train_field(docs: DataFrame, max_docs: int = 1_000, max_features: int = 5_000) -> Field | None:
    """Train on a bounded sample of ``docs``; texts are labelled in the tasks, only features and edges are collected."""
    texts = require(docs, "doc_id", "text").select("doc_id", text_or_empty().alias("text")).where("text rlike '[0-9@]'")
    picked = sample_by_hash(texts.select("doc_id", F.xxhash64("text").alias("same"), "text"), max_docs, "doc_id", "same")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = pa.list_(pa.list_(pa.int32()))
        for batch in batches:
            nodes, labels = [], []
            for text in batch.column("text"):
                nodes.append(nodes_of(text.as_py()))
                labels.append(labels_of(nodes[-1], base_spans(text.as_py())))
            columns = [
                pa.array([x.features for x in nodes], pa.list_(pa.list_(pa.string()))), pa.array([[list(e) for e in x.chain] for x in nodes], edge),
                pa.array([[list(e) for e in x.skip] for x in nodes], edge), pa.array(labels, pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["features", "chain", "skip", "labels"])

    # Written first, so that the sample's texts are spread over tasks again.
    sample = cut_lineage(picked).mapInArrow(describe, "features array<array<string>>, chain array<array<int>>, skip array<array<int>>, labels array<int>")
    rows = sorted(sample.collect(), key=str)
    nodes = [Nodes([(0, 0)] * len(r["labels"]), r["features"], [tuple(e) for e in r["chain"]], [tuple(e) for e in r["skip"]]) for r in rows]
    return train(nodes, [r["labels"] for r in rows], max_features)


def added_spans(field: Field, texts: list[str], bases: list[list[tuple[int, int, int]]], threshold: float) -> list[list[tuple[int, int, int]]]:
    """Spans of nodes that the field labels and no base span touches."""
    nodes = [nodes_of(t) for t in texts]
    if not any(x.places for x in nodes):
        return [[] for _ in texts]
    belief = field.beliefs(nodes)
    out, at = [], 0
    for x, base in zip(nodes, bases, strict=True):
        own = belief[at : at + len(x.places)]
        at += len(x.places)
        free = [v == _NONE for v in labels_of(x, sorted(base))]
        joined = {b for _, b in x.chain}
        spans: list[tuple[int, int, int]] = []
        last = -2
        for i, (start, end) in enumerate(x.places):
            kind = int(own[i].argmax())
            if kind == _NONE or own[i, kind] < threshold or not free[i]:
                continue
            if spans and i in joined and last == i - 1 and spans[-1][1] == kind:
                spans[-1] = (spans[-1][0], kind, end)
            else:
                spans.append((start, kind, end))
            last = i
        out.append(spans)
    return out


def find(docs: DataFrame, field: Field | None, threshold: float = 0.9) -> DataFrame:
    """``docs`` with ``base`` and ``added``: arrays of ``(start, kind, end)``, kinds numbered as listed."""
    span = T.StructType([T.StructField(c, T.IntegerType()) for c in ("start", "kind", "end")])
    fields = [T.StructField(c, T.ArrayType(span)) for c in ("base", "added")]
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())]))
    named = lambda rows: pa.array([[dict(zip(("start", "kind", "end"), s)) for s in spans] for spans in rows], arrow)

    def compute(column: pa.Array) -> list[pa.Array]:
        texts = [t or "" for t in column.to_pylist()]
        base = [base_spans(t) for t in texts]
        added = added_spans(field, texts, base, threshold) if field else [[] for _ in texts]
        return [named(base), named(added)]

    return add_columns(require(docs, "text"), "text", fields, compute)


def digests(found: DataFrame) -> DataFrame:
    names = F.array(*map(F.lit, KINDS))
    told = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)), F.sha2(told(F.col("base")), 256).alias("base_sha256"),
        told(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"),
    )
