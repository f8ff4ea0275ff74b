"""SimHash near-duplicates: a self-join of binary tries of fingerprints, walked over pairs of nodes.

A fingerprint has a bit set where more than half of the hashes of the text's word shingles have it.
Two fingerprints link at ``budget`` (2) or fewer differing bits.

The join walks pairs of trie nodes from the top, adds up the differing bits of their paths and drops a
pair as soon as they exceed the budget. It is dealt over tasks like this: cut into ``budget + 1`` blocks, two linked
fingerprints agree on one block. So there is one trie per block, in which that block comes first
(the bits rotated); the walk allows no differing bit on its first block and ``budget`` in
all. Hence the nodes below the first block are independent, and a task walks all of its nodes at once, level by level, on
sorted arrays. Node pairs with more than ``crowded`` rows are walked on by Spark, eight bits at a time,
until they are small: so no task holds a large group, whatever the fingerprints are.

Copies are joined once: only distinct fingerprints enter the tries. Of the links of a node pair only a spanning forest is
returned, so groups of thousands of near copies never become all their pairs.

Defined cases: a null or empty text, or one without words, has fingerprint zero, which links like any other. Fewer words than a shingle holds:
the whole sequence is the shingle. A null id gets a fingerprint and is never the smallest id; a component of null ids only
has a null id. Repeated rows stay repeated. Extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.llm.common import add_columns, refuse, require, runs, text_or_empty
from topicloom.operators.components import connected_components
from topicloom.session import cut_lineage

BITS = 64
SEED = 42  # Fixed value: the seed of a shingle's hash.
_STEP = 8
_CHUNK = 1 << 18
_ONE = np.uint64(1)


def fingerprint(text: str, shingle: int = 3) -> int:
    """The fingerprint of one text, as a signed 64-bit integer."""
    words = text.encode().lower().split()  # bytes: lower() and split() know ASCII only
    if not words:
        return 0
    if len(words) < shingle:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
        n = len(words) - shingle + 1
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, 1 << 14):
        part = hashes[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, same, fp)``: the fingerprint of each text, and a hash of it that tells texts of one id apart."""
    keyed = require(docs, "doc_id", "text").select("doc_id", F.xxhash64("text").alias("same"), text_or_empty().alias("text"))

    def compute(texts: pa.Array) -> list[pa.Array]:
        return [pa.array([fingerprint(t, shingle) for t in texts.to_pylist()], pa.int64())]

    return add_columns(keyed, "text", [T.StructField("fp", T.LongType())], compute).drop("text")


def _blocks(budget: int) -> list[tuple[int, int]]:
    """First bit (from the top) and width of each block."""
    cuts = [BITS * i // (budget + 1) for i in range(budget + 2)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _tries(reps: DataFrame, budget: int) -> DataFrame:
    """Each fingerprint in each trie: the node below the first block (``pair``), and the rotated bits."""
    nodes = []
    for i, (start, width) in enumerate(_blocks(budget)):
        bits = F.col("fp") if not start else F.shiftleft("fp", start).bitwiseOR(F.shiftrightunsigned("fp", BITS - start))
        pair = F.xxhash64(F.lit(i), F.shiftrightunsigned(bits, BITS - width))
        nodes.append(F.struct(pair.alias("pair"), F.lit(0).alias("side"), F.lit(width).alias("depth"), F.lit(0).alias("err"), bits.alias("bits"), F.lit(start).alias("turn")))
    return reps.select(F.explode(F.array(*nodes)).alias("n")).select("n.*")


def _descend(rows: DataFrame, budget: int) -> DataFrame:
    """Walk node pairs on by eight bits: a row joins each pair of child nodes that stays in the budget.

    Both nodes of a pair are one at ``side`` 0; else the sides are 1 and 2.
    """
    step = F.least(F.lit(_STEP), F.lit(BITS) - F.col("depth"))
    own = F.shiftrightunsigned(F.expr("shiftleft(bits, depth)"), BITS - _STEP).cast("int")
    masks = sorted((m for m in range(1 << _STEP) if m.bit_count() <= budget), key=lambda m: (m.bit_count(), m))
    flips = F.array(*[F.struct(F.lit(m).alias("mask"), F.lit(m.bit_count()).alias("more")) for m in masks])
    moved = rows.withColumn("own", own).withColumn("step", step).withColumn("flip", F.explode(flips))
    # Past the last bit nothing can differ: such masks are dropped.
    inside = F.expr(f"(flip.mask & (shiftleft(1, {_STEP} - step) - 1)) = 0")
    moved = moved.where((F.col("err") + F.col("flip.more") <= budget) & inside)
    other = F.col("own").bitwiseXOR(F.col("flip.mask"))
    one, two = F.least("own", other), F.greatest("own", other)
    split = F.col("flip.mask") != 0
    side = F.when(F.col("side") != 0, F.col("side")).when(~split, F.lit(0)).when(F.col("own") == one, 1).otherwise(2)
    # Below a pair of two nodes the left child is that of side 1; below one node it is the smaller.
    left = F.when(F.col("side") == 0, one).when(F.col("side") == 1, F.col("own")).otherwise(other)
    right = F.when(F.col("side") == 0, two).when(F.col("side") == 1, other).otherwise(F.col("own"))
    return moved.select(
        F.xxhash64("pair", left, right).alias("pair"), side.cast("int").alias("side"), (F.col("depth") + F.col("step")).alias("depth"),
        (F.col("err") + F.col("flip.more")).alias("err"), "bits", "turn",
    )


class _Forest:
    """Links between positions, kept as a forest."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self, at: np.ndarray) -> np.ndarray:
        while True:
            up = self.up[at]
            if (up == at).all():
                return at
            self.up[at] = self.up[up]
            at = self.up[up]

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            a, b = self.roots(a), self.roots(b)
            apart = a != b
            if not apart.any():
                return
            a, b = a[apart], b[apart]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def _walk(bits: np.ndarray, nodes: list[np.ndarray], budget: int, forest: _Forest) -> None:
    """Walk node pairs down to leaves; ``bits`` is sorted within each node.

    A pair is two ranges ``[a, a_end)`` and ``[b, b_end)`` of ``bits``, a depth and the differing bits so far. Pairs wait on a stack in
    chunks, so memory is bounded however many there are.
    """
    stack = [np.stack(nodes)]
    while stack:
        work = stack.pop()
        if work.shape[1] > _CHUNK:
            half = work.shape[1] // 2
            stack += [work[:, half:], work[:, :half]]
            continue
        a, a_end, b, b_end, depth, err = work
        same = a == b
        size = (a_end - a) * (b_end - b)
        # Small node pairs are compared leaf by leaf.
        small = size <= 16
        if small.any():
            x, x_end, y, y_end, eq = (v[small] for v in (a, a_end, b, b_end, same))
            count = (x_end - x) * (y_end - y)
            which = np.repeat(np.arange(len(x)), count)
            k = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
            wide = (y_end - y)[which]
            left, right = x[which] + k // wide, y[which] + k % wide
            use = ~eq[which] | (left < right)
            left, right = left[use], right[use]
            near = np.bitwise_count(bits[left] ^ bits[right]) <= budget
            forest.link(left[near], right[near])
        rest = ~small
        if not rest.any():
            continue
        a, a_end, b, b_end, depth, err, same = (v[rest] for v in (a, a_end, b, b_end, depth, err, same))
        a_cut, b_cut = _split(bits, a, a_end, depth), _split(bits, b, b_end, depth)
        pairs = [(a, a_cut, b, b_cut, 0), (a_cut, a_end, b_cut, b_end, 0), (a, a_cut, b_cut, b_end, 1), (a_cut, a_end, b, b_cut, 1)]
        made = []
        for i, (p, p_end, q, q_end, more) in enumerate(pairs):
            live = (p < p_end) & (q < q_end) & (err + more <= budget)
            if i == 3:
                live &= ~same  # the mirror of the pair before
            made.append(np.stack([p, p_end, q, q_end, depth + 1, err + more])[:, live])
        made = np.concatenate(made, axis=1)
        if made.shape[1]:
            stack.append(made)


def _split(bits: np.ndarray, start: np.ndarray, end: np.ndarray, depth: np.ndarray) -> np.ndarray:
    """For each range the place of the first leaf whose bit at ``depth`` is one, by bisection."""
    lo, hi = start.copy(), end.copy()
    shift = (BITS - 1 - depth).astype(np.uint64)
    while True:
        open_ = lo < hi
        if not open_.any():
            return lo
        mid = (lo + hi) >> 1
        one = ((bits[np.minimum(mid, len(bits) - 1)] >> shift) & _ONE).astype(bool)
        hi = np.where(open_ & one, mid, hi)
        lo = np.where(open_ & ~one, mid + 1, lo)


def _join_nodes(budget: int):
    """Walk all node pairs of a task whose rows come sorted by pair and side; give a forest of links."""
    names = ["pair", "side", "depth", "err", "bits", "turn"]

    def links(rows: dict[str, np.ndarray]) -> pa.RecordBatch:
        bits = rows["bits"].view(np.uint64)
        cut = runs(rows["pair"], rows["side"])
        start, end = cut[:-1], cut[1:]
        pair, side = rows["pair"][start], rows["side"][start]
        self_ = side == 0
        first = np.flatnonzero((side[:-1] == 1) & (side[1:] == 2) & (pair[:-1] == pair[1:])) if len(side) > 1 else np.zeros(0, int)
        left = np.concatenate([np.flatnonzero(self_ & (end - start > 1)), first])
        right = np.concatenate([left[: len(left) - len(first)], first + 1])
        depth, err = rows["depth"][start[left]].astype(np.int64), rows["err"][start[left]].astype(np.int64)
        forest = _Forest(len(bits))
        if len(left):
            _walk(bits, [start[left], end[left], start[right], end[right], depth, err], budget, forest)
        at = np.flatnonzero(forest.up != np.arange(len(bits)))
        turn = rows["turn"].astype(np.uint64)
        plain = np.where(turn == 0, bits, (bits >> turn) | (bits << ((np.uint64(BITS) - turn) % np.uint64(BITS)))).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(plain[forest.roots(at)]), pa.array(plain[at])], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        for batch in batches:
            rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            if not batch.num_rows:
                continue
            if held and rows["pair"][0] == rows["pair"][-1] == held[-1]["pair"][-1]:
                held.append(rows)
                continue
            rows = {c: np.concatenate([h[c] for h in held] + [rows[c]]) for c in names}
            cut = np.searchsorted(rows["pair"], rows["pair"][-1])  # pairs come in order
            held = [{c: v[cut:] for c, v in rows.items()}]
            if cut:
                yield links({c: v[:cut] for c, v in rows.items()})
        if held:
            yield links({c: np.concatenate([h[c] for h in held]) for c in names})

    return run


def fingerprint_links(reps: DataFrame, budget: int = 2, crowded: int = 16_384) -> DataFrame:
    """Links ``(src, dst)`` between distinct fingerprints ``fp``: enough to connect all that are within the budget."""
    rows = _tries(reps, budget)
    found = None
    while True:
        rows = cut_lineage(rows)
        # A pair whose other side is empty is pruned along with those of one row.
        sizes = rows.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.min("side").alias("least"), F.max("side").alias("most"))
        live = cut_lineage(sizes.where("n > 1 and (least = 0 or least < most)").select("pair", (F.col("n") > crowded).alias("large")))
        rows = rows.join(live, "pair")
        ready = rows.where("not large").drop("large")
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = ready.repartition(parts, "pair").sortWithinPartitions("pair", "side", F.expr("shiftrightunsigned(bits, 1)"), "bits")
        made = cut_lineage(dealt.mapInArrow(_join_nodes(budget), "src long, dst long"))
        found = made if found is None else found.unionByName(made)
        if live.where("large").isEmpty():
            return found
        rows = _descend(rows.where("large").drop("large"), budget)


def name_groups(prints: DataFrame, links: DataFrame, reps: DataFrame | None = None) -> DataFrame:
    """``(doc_id, same, fp, root, component_id)`` per row; ``root`` is a fingerprint that names the component."""
    if reps is None:
        reps = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    groups = connected_components(links).select(F.col("node").alias("fp"), F.col("component").alias("root"))
    rooted = reps.join(groups, "fp", "left")
    linked = rooted.where("root is not null")
    smallest = linked.groupBy("root").agg(F.min("rep").alias("component_id"))
    settled = linked.join(smallest, "root").select("fp", "root", "component_id")
    alone = rooted.where("root is null").select("fp", F.col("fp").alias("root"), F.col("rep").alias("component_id"))
    named = cut_lineage(settled.unionByName(alone))
    return prints.join(named, "fp")


def _grouped(docs: DataFrame, shingle: int, budget: int, crowded: int) -> DataFrame:
    """The groups of :func:`name_groups` by fingerprints within the budget."""
    prints = cut_lineage(fingerprints(docs, shingle))
    reps = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    return name_groups(prints, fingerprint_links(reps.select("fp"), budget, crowded), reps)


def near_duplicates(docs: DataFrame, shingle: int = 3, budget: int = 2, crowded: int = 16_384) -> DataFrame:
    """``(doc_id, fp, component_id)`` for each row; the component is its smallest reachable ``doc_id``."""
    return _grouped(docs, shingle, budget, crowded).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, budget: int = 2, crowded: int = 16_384) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest id (rows without an id are kept).

    If the smallest id stands for several rows of its group, one of them stays. One id with different texts may stand for several groups.
    """
    return keep_smallest(docs, _grouped(docs, shingle, budget, crowded))


def keep_smallest(docs: DataFrame, grouped: DataFrame) -> DataFrame:
    """The documents that :func:`keep_one` keeps of the groups; a column ``_same`` is refused."""
    refuse(docs, "_same")
    groups = cut_lineage(grouped.where("doc_id = component_id").select("doc_id", "same", "root"))
    kept = cut_lineage(groups.groupBy("root", "doc_id").agg(F.min("same").alias("_same"), F.count(F.lit(1)).alias("_n")))
    keyed = docs.where("doc_id is not null").withColumn("_same", F.xxhash64("text"))
    of = lambda rows: keyed.join(rows.select("doc_id", "_same").distinct(), ["doc_id", "_same"], "left_semi")
    # Only ids that repeat can leave two rows of one text.
    once = of(kept.where("_n = 1")).unionByName(of(kept.where("_n > 1")).dropDuplicates(["doc_id", "_same"]))
    return once.select(docs.columns).unionByName(docs.where("doc_id is null"))
