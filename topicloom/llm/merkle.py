"""Merkle trees over documents, stored as blocks in van Emde Boas order.

Each group of documents (a source) has a tree of its own, whose nodes hash runs of three; the groups' roots, in order of the
group, are the leaves of one more tree. A node is the SHA-256 (lowercase hex) of its children's hex digests.

A tree is cut into aligned blocks of ``HEIGHT`` levels: block ``b`` of a tier covers the nodes ``b * 3**HEIGHT`` and following at its
base. A block's nodes are one byte string in van Emde Boas order: a subtree is split at half its height, the upper part is stored first,
then each lower part, all by the same rule. ``addresses`` gives a node's place by arithmetic alone, for building a block and for reading
the siblings of a path. The roots of the blocks are the base of the next tier, so a tier is a Spark table with one row per block
and there are about ``log(rows) / log(3**HEIGHT)`` tiers. Paths come from the top tier downwards: a block hands each node at its base the
siblings above it, and the table below joins them by block.

Only digests and ids are shuffled, never texts. A group of a third of all rows is many blocks like any other. Nothing but the number of
open trees reaches the driver.

Defined cases: a null value hashes as ``-``, any other as its byte count, ``:`` and the value. A null source is a group of its own and the
first one. Documents ascend by id, null ids first; rows of one id by their hash, so repeated rows are leaves next to each other. An
empty table has no rows, no blocks and no root. Only the hashed columns are read; extra columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from topicloom.llm.common import require
from topicloom.session import cut_lineage

ARITY = 3
HEIGHT = 6
BASE = ARITY**HEIGHT
DIGEST = 32
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# What lies above a node: the siblings to its left and right, level by level, and the roots of its tree and of all trees.
_ABOVE = "lefts array<string>, rights array<string>, subroot string, root string"
_ABOVE_NAMES = ("lefts", "rights", "subroot", "root")


def leaf_hash(**values: Column) -> Column:
    """The hash of a row; ``values`` replaces columns."""
    fields = []
    for name in FIELDS:
        value = values.get(name, F.col(name)).cast("string")
        fields.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.sha2(F.concat(*fields), 256)


def without_newlines() -> Column:
    """The hash of a row whose text has lost its line feeds, for every second document by the checksum of its id; else null."""
    even = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 2 == 0
    return F.when(even, leaf_hash(text=F.replace("text", F.lit("\n"), F.lit(""))))


# --- layout ---------------------------------------------------------------------------------------------------------


def slots(levels: int) -> int:
    """The number of nodes of a full subtree."""
    return (ARITY**levels - 1) // (ARITY - 1)


@cache
def addresses(levels: int) -> list[np.ndarray]:
    """For each depth from the root, the places of its nodes in van Emde Boas order."""
    if levels == 1:
        return [np.zeros(1, np.int64)]
    top = levels // 2
    upper, lower = addresses(top), addresses(levels - top)
    starts = slots(top) + np.arange(ARITY**top) * slots(levels - top)
    return upper + [(starts[:, None] + places[None, :]).ravel() for places in lower]


def climb(width: int) -> int:
    """How many levels lie above ``width`` nodes until one is left."""
    height = 0
    while width > 1:
        width, height = -(-width // ARITY), height + 1
    return height


def build_block(digests: list[bytes], height: int) -> tuple[bytes, bytes]:
    """The block over a base of raw digests, and its root."""
    places = addresses(height + 1)
    store = np.zeros((slots(height + 1), DIGEST), np.uint8)
    row = digests
    store[places[height][: len(row)]] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, DIGEST)
    for depth in range(height - 1, -1, -1):
        texts = [d.hex().encode() for d in row]
        row = [hashlib.sha256(b"".join(texts[at : at + ARITY])).digest() for at in range(0, len(texts), ARITY)]
        store[places[depth][: len(row)]] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, DIGEST)
    return store.tobytes(), row[0]


def sibling_lists(store: bytes, width: int, height: int) -> list[tuple[list[str], list[str]]]:
    """Of each node at the base: the hex digests to its left and right in its run, level by level up to the block's root."""
    places = addresses(height + 1)
    out: list[tuple[list[str], list[str]]] = [([], []) for _ in range(width)]
    row_width = width
    for depth in range(height, 0, -1):
        row = [store[DIGEST * a : DIGEST * (a + 1)].hex() for a in places[depth][:row_width].tolist()]
        step = ARITY ** (height - depth)
        for node in range(row_width):
            first = node - node % ARITY
            left, right = "".join(row[first:node]), "".join(row[node + 1 : first + ARITY])
            for base in range(node * step, min((node + 1) * step, width)):
                out[base][0].append(left)
                out[base][1].append(right)
        row_width = -(-row_width // ARITY)
    return out


# --- Spark ----------------------------------------------------------------------------------------------------------


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def numbered(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """``rows`` with ``idx``, from 0 by ``order`` within each group, and ``width``, the group's number of rows.

    Rows are dealt by ranges of group and order, counted in a stream within each task, and shifted by the counts of the tasks before.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(group), *order]
    dealt = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count = None, 0
        for batch in batches:
            seq = np.empty(batch.num_rows, np.int64)
            for i, key in enumerate(batch.column(group).to_pylist()):
                count = count + 1 if key == last else 0
                last, seq[i] = key, count
            yield batch.append_column("seq", pa.array(seq))

    placed = cut_lineage(dealt.mapInArrow(run, _ddl(dealt) + ", seq bigint"))
    sizes = placed.groupBy("part", group).agg((F.max("seq") + 1).alias("n"))
    before = W.partitionBy(group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    sizes = sizes.select("part", group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"), F.sum("n").over(W.partitionBy(group)).alias("width"))
    return placed.join(sizes, ["part", group]).withColumn("idx", F.col("_base") + F.col("seq")).drop("part", "seq", "_base")


def _tier(nodes: DataFrame) -> DataFrame:
    """The blocks over ``nodes (grp, idx, width, digest, …)``: ``(grp, block, width, height, store, root, members)``; ``width`` is the tree's."""
    extra = [c for c in nodes.columns if c not in ("grp", "idx", "width", "digest")]
    member = F.struct("idx", "digest", *extra)
    block = F.floor(F.col("idx") / BASE).cast("long")
    rows = nodes.groupBy("grp", block.alias("block")).agg(F.max("width").alias("width"), F.array_sort(F.collect_list(member)).alias("members"))
    fields = _ddl(rows) + ", height int, store binary, root binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heights, stores, roots = [], [], []
            for width, members in zip(batch.column("width").to_pylist(), batch.column("members"), strict=True):
                digests = members.values.field("digest").to_pylist()
                heights.append(climb(width) if width <= BASE else HEIGHT)
                store, root = build_block(digests, heights[-1])
                stores.append(store)
                roots.append(root)
            made = [pa.array(heights, pa.int32()), pa.array(stores, pa.binary()), pa.array(roots, pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, "height", "store", "root"])

    return rows.mapInArrow(run, fields)


@dataclass
class Forest:
    """The tiers of all trees, from the leaves upwards, and the root of each tree: ``(grp, digest)``."""

    tiers: list[DataFrame]
    roots: DataFrame


def grow(nodes: DataFrame) -> Forest:
    """Build the trees over ``nodes (grp, idx, width, digest, …)``, one written table a tier."""
    tiers, roots = [], []
    while True:
        tier = cut_lineage(_tier(nodes))
        tiers.append(tier)
        roots.append(tier.where(F.col("width") <= BASE).select("grp", F.col("root").alias("digest")))
        above = tier.where(F.col("width") > BASE)
        if above.isEmpty():
            return Forest(tiers, reduce(DataFrame.unionByName, roots))
        nodes = above.select("grp", F.col("block").alias("idx"), F.ceil(F.col("width") / BASE).cast("long").alias("width"), F.col("root").alias("digest"))


def _descend(tier: DataFrame, above: DataFrame) -> DataFrame:
    """``(grp, node, …above)`` of every node at the base of the tier's blocks; ``above (grp, block, …)`` lies over each block."""
    met = tier.select("grp", "block", "width", "height", "store").join(above, ["grp", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for row in batch.to_pylist():
                width = min(BASE, row["width"] - row["block"] * BASE)
                for i, (left, right) in enumerate(sibling_lists(row["store"], width, row["height"])):
                    values = (row["grp"], row["block"] * BASE + i, left + row["lefts"], right + row["rights"], row["subroot"], row["root"])
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
            kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string()), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["grp", "block", *_ABOVE_NAMES])

    return met.mapInArrow(run, f"grp string, block long, {_ABOVE}")


def over_blocks(forest: Forest, over_roots: DataFrame) -> DataFrame:
    """What lies above each block of the lowest tier, from what lies over the root of each tree (``grp, …``)."""
    above = None
    for tier, below in zip(reversed(forest.tiers), [*reversed(forest.tiers[:-1]), None]):
        ends = tier.where(F.col("width") <= BASE).select("grp", "block").join(over_roots, "grp")
        above = ends if above is None else ends.unionByName(above)
        if below is not None:
            above = cut_lineage(_descend(tier, above))
    return above


@dataclass
class Manifest:
    """The trees of the groups, the tree over their roots, and what lies over each group's root (``grp, …``)."""

    groups: Forest
    top: Forest
    over_roots: DataFrame

    def root(self) -> str | None:
        row = self.top.roots.first()
        return None if row is None else row["digest"].hex()


def build(docs: DataFrame, claimed: Column | None = None) -> Manifest:
    """The manifest of ``docs``. ``claimed`` is a hash per row that :func:`verify` folds instead of the leaf (null: the leaf)."""
    doc = F.col("doc_id").cast("long")
    rows = require(docs, *FIELDS).select(
        F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("")).alias("grp"),  # null first, then by bytes
        doc.alias("doc_id"), F.unhex(leaf_hash(doc_id=doc)).alias("digest"),
        F.unhex(claimed if claimed is not None else F.lit(None).cast("string")).alias("claimed"),
    )
    groups = grow(numbered(cut_lineage(rows), "grp", [F.col("doc_id").asc_nulls_first(), F.col("digest")]))
    heads = groups.roots.select(F.lit("").alias("all"), F.col("grp").alias("name"), "digest")
    top = grow(numbered(heads, "all", [F.col("name")]).withColumnRenamed("all", "grp"))
    nothing, digest = F.array().cast("array<string>"), F.lower(F.hex("digest"))
    over_all = top.roots.select("grp", nothing.alias("lefts"), nothing.alias("rights"), digest.alias("subroot"), digest.alias("root"))
    # The lowest tier of the top tree knows each group's name and digest beside its node.
    named = top.tiers[0].select(F.explode("members").alias("m")).select(F.col("m.idx").alias("block"), F.col("m.name").alias("name"), F.col("m.digest").alias("own"))
    paths = _descend(top.tiers[0], over_blocks(top, over_all)).drop("grp", "subroot").join(named, "block")
    return Manifest(groups, top, cut_lineage(paths.select(F.col("name").alias("grp"), "lefts", "rights", F.lower(F.hex("own")).alias("subroot"), "root")))


def verify(manifest: Manifest) -> DataFrame:
    """``(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)`` of every leaf.

    The proof is the siblings of the path in order. ``folded_root`` is computed from the claimed hash and those siblings only.
    """
    tier = manifest.groups.tiers[0]
    met = tier.join(over_blocks(manifest.groups, manifest.over_roots).withColumnRenamed("root", "whole"), ["grp", "block"])
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = hashlib.sha256
        for batch in (b.slice(i, 1) for b in batches for i in range(b.num_rows)):
            row = batch.to_pylist()[0]
            out: list[list] = [[] for _ in names]
            above = list(zip(row["lefts"], row["rights"], strict=True))
            above = [(left.encode(), right.encode()) for left, right in above]
            tail = b"".join(left + right for left, right in above)
            for member, (lefts, rights) in zip(row["members"], sibling_lists(row["store"], len(row["members"]), row["height"]), strict=True):
                path = [(left.encode(), right.encode()) for left, right in zip(lefts, rights, strict=True)]
                proof = sha(b"".join(left + right for left, right in path) + tail).hexdigest()
                digest = (member["claimed"] or member["digest"]).hex()
                for left, right in (*path, *above):
                    digest = sha(left + digest.encode() + right).hexdigest()
                values = (member["doc_id"], member["digest"].hex(), row["subroot"], row["whole"], proof, digest, digest == row["whole"])
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            kinds = [pa.int64(), *[pa.string()] * 5, pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return met.mapInArrow(run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
