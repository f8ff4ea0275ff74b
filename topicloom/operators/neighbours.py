"""The graph of nearest rows by cells that are searched whole, and the exact search that measures it.

Rows are dealt into cells by the nearest of a few centres, fitted on a sample of at most 64 rows a cell. Every row is stored in its own
cell and looked for in several: in so many that of 256 sampled rows, whose nearest rows are found by the exact search, 98 % of the
``degree`` nearest are met, and in more where those cells hold too few rows. A cell is compared with the rows that look into it by
matrix products, and only a row's ``k`` nearest of each cell travel on. So the cells searched follow the data: few if it has groups, nearly all
(an exact search) if it has none.

Up to two million rows there are 32 cells, so a row travels at most 32 times however many rows there are. Beyond, a task holds at most
``512 * block`` stored rows; larger cells are cut into chunks. Rows that look into a cell stream by, and a much-visited cell is dealt over several tasks.

Equal directions are one node, named by the smallest id, so that thousands of copies cannot fill each other's lists. Rows whose vector is
null, empty, zero or not finite have no direction and are left out. Vectors must have one length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicloom.operators.heavy import heavy_join
from topicloom.session import cut_lineage

_FOUND = "id long, nb long, sim double"
_CELLS, _MOST_CELLS = 32, 256
_SAMPLED, _COVERED = 256, 0.98  # rows whose neighbours the probes must meet, and what share of them
_TASKS = 128  # of one search, about
_PIECE, _STORED = 512, 4096  # rows of one matrix product


def directions(vectors: DataFrame, doc_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(id, vec ARRAY<DOUBLE>)``: unit vectors of the rows that have a direction."""
    raw = F.col(embedding).cast("array<double>")
    length = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    sound = (F.col("_z") > 0) & (F.col("_z") < float("inf"))
    unit = vectors.select(F.col(doc_id).alias("id"), raw.alias("vec")).withColumn("_z", length).where(sound & F.col("id").isNotNull())
    return unit.select("id", F.transform("vec", lambda x: x / F.col("_z")).alias("vec"))


def copies(points: DataFrame) -> DataFrame:
    """``(id, representative)`` of every row: the smallest id with an equal vector."""
    first = points.groupBy("vec").agg(F.min("id").alias("representative"))
    return heavy_join(points, first, ["vec"]).select("id", "representative")


def neighbour_graph(
    vectors: DataFrame, k: int = 10, doc_id: str = "vec_id", embedding: str = "embedding", degree: int = 40, sorts: int = 6, block: int = 128,
    rounds: int = 15, tolerance: float = 0.001, seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """``(graph, members)``: ``(id, rank, neighbour, similarity)`` of the ``k`` nearest of each node by cosine, and ``(id, representative)``.

    A row looks into ``sorts`` cells at least, and into so many that they meet the ``degree`` nearest of sampled rows. A cell has ``2 * block``
    rows or more on average. Centres are fitted in at most ``rounds`` rounds, until less than ``tolerance`` of the sample changes its cell.
    """
    if not 0 < k <= degree < block:
        raise ValueError("0 < k <= degree < block must hold")
    rows = cut_lineage(directions(vectors, doc_id, embedding))
    members = copies(rows)
    points = cut_lineage(rows.groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec"))
    cells = fit_cells(points, degree, sorts, block, rounds, tolerance, seed)
    found = _search(points, cells, k).repartition("id").sortWithinPartitions("id")
    graph = cut_lineage(found.mapInArrow(_merge(k), "id long, rank int, neighbour long, similarity double"))
    return graph, members


def _merge(k: int):
    """The ``k`` nearest of each id from its lists, which lie side by side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # lists of the id at the end of what was read
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("id").to_numpy()
            if held and held[0].column("id")[0].as_py() != ids[0]:
                yield best(held)
                held = []
            last = int(np.searchsorted(ids, ids[-1]))
            if last:
                yield best([*held, batch.slice(0, last)])
                held = []
            held.append(batch.slice(last))
        if held:
            yield best(held)

    def best(lists: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(lists).combine_chunks()
        near, entries = table.column("near"), table.column("near").combine_chunks().flatten()
        lengths = np.concatenate([np.diff(c.offsets.to_numpy()) for c in near.chunks])
        ids, row = np.unique(np.repeat(table.column("id").to_numpy(), lengths), return_inverse=True)
        row, nb, sim, place = _ranked(row, entries.field("nb").to_numpy(), -entries.field("far").to_numpy(), k, once=True)
        arrays = [pa.array(ids[row]), pa.array((place + 1).astype(np.int32)), pa.array(nb), pa.array(sim)]
        return pa.RecordBatch.from_arrays(arrays, ["id", "rank", "neighbour", "similarity"])

    return run


def _ranked(row: np.ndarray, nb: np.ndarray, sim: np.ndarray, k: int, once: bool) -> tuple[np.ndarray, ...]:
    """``(row, nb, sim, place)`` of the ``k`` most similar of each row, in order, ties by the smaller id; ``once`` keeps an id once a row."""
    if once:
        order = np.lexsort((-sim, nb, row))
        new = np.ones(len(order), bool)
        new[1:] = (row[order][1:] != row[order][:-1]) | (nb[order][1:] != nb[order][:-1])
        row, nb, sim = (x[order[new]] for x in (row, nb, sim))
    order = np.lexsort((nb, -sim, row))
    row = row[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    kept = place < k
    return row[kept], nb[order][kept], sim[order][kept], place[kept]


def _matrix(column) -> np.ndarray:
    """A column of arrays of one length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


@dataclass(frozen=True)
class Cells:
    """Centres, and for each: its stored rows, the chunks they are cut into, and the tasks over which its visitors are dealt."""

    centres: np.ndarray
    probes: int
    enough: int
    stored: np.ndarray
    chunks: np.ndarray
    parts: np.ndarray

    def visited(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(row, cell)`` of the cells that rows look into: the ``probes`` nearest ones, and more until they hold ``enough`` rows."""
        order = np.argsort(-(v @ self.centres.T), axis=1, kind="stable")
        held = np.cumsum(self.stored[order], axis=1)
        before = np.hstack([np.zeros((len(v), 1), held.dtype), held[:, :-1]])
        row, at = np.nonzero((np.arange(len(self.centres)) < self.probes) | (before < self.enough))
        return row, order[row, at]


def fit_cells(points: DataFrame, degree: int, sorts: int, block: int, rounds: int, tolerance: float, seed: int) -> Cells:
    """Cells of ``points (id, vec)``; the driver holds the sample, the centres and a few numbers a cell."""
    n = points.count()
    wanted = max(1, min(_CELLS, n // (2 * block)), min(_MOST_CELLS, n // (512 * block)))
    turn = F.shiftrightunsigned(F.xxhash64("id", F.lit(seed)), 1)

    def sampled(size: int) -> DataFrame:
        return points if n <= size else points.where(turn < int(size / n * 2**63))

    rows = sampled(64 * wanted).select("vec", turn.alias("turn"), "id").collect()
    rows.sort(key=lambda r: (r["turn"], r["id"]))
    sample = np.array([r["vec"] for r in rows]) if rows else np.zeros((0, 0))
    centres = _lloyd(sample, wanted, rounds, tolerance)
    homes = points.mapInArrow(_home_of(centres), "id long, home int")
    stored = np.zeros(len(centres), np.int64)
    for r in homes.groupBy("home").count().collect():  # one row a cell
        stored[r["home"]] = r["count"]
    probes = min(sorts, len(centres))
    if probes < len(centres):
        asked = sampled(_SAMPLED)
        near = exact_neighbours(asked, points, degree).select("id", F.col("neighbour").alias("nb"))
        met = near.join(homes.withColumnRenamed("id", "nb"), "nb").select("id", "home").collect()  # ``degree`` rows for a sampled one
        order = {r["id"]: np.argsort(np.argsort(-(centres @ np.array(r["vec"])), kind="stable")) for r in asked.collect()}
        ranks = np.sort([order[r["id"]][r["home"]] for r in met])
        if len(ranks):
            probes = max(probes, int(ranks[math.ceil(_COVERED * len(ranks)) - 1]) + 1)
    chunks = -(-stored // (512 * block))
    cells = Cells(centres, probes, min(degree + 1, n), stored, chunks, np.ones(len(centres), np.int64))
    load = np.bincount(cells.visited(sample)[1], minlength=len(centres)) * stored
    parts = np.clip(-(-_TASKS * load // max(load.sum(), 1)), 1, 16)
    return replace(cells, parts=parts)


def _lloyd(sample: np.ndarray, wanted: int, rounds: int, tolerance: float) -> np.ndarray:
    """Centres of unit length: the means of the rows that are nearest to them, from the first rows of the sample on."""
    centres, home = sample[:wanted].copy(), np.full(len(sample), -1)
    for _ in range(rounds):
        moved = np.argmax(sample @ centres.T, axis=1) if len(sample) else home
        if (moved != home).sum() <= tolerance * len(sample):
            break
        home = moved
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        length = np.sqrt((sums * sums).sum(axis=1))
        centres[length > 0] = sums[length > 0] / length[length > 0, None]
    return centres


def _home_of(centres: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                home = np.argmax(_matrix(batch.column("vec")) @ centres.T, axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(home)], ["id", "home"])

    return run


def _search(points: DataFrame, cells: Cells, k: int) -> DataFrame:
    """``(id, near)``: for each row and each chunk of a cell that it looks into, its ``k`` nearest there."""
    names = ["cell", "chunk", "part", "asks", "id", "vec"]
    shared = points.sparkSession.sparkContext.broadcast(cells)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for whole in batches:
            for batch in (whole.slice(at, _STORED) for at in range(0, whole.num_rows, _STORED)):
                v, ids = _matrix(batch.column("vec")), batch.column("id").to_numpy()
                mixed = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24)
                home = np.argmax(v @ c.centres.T, axis=1)
                row, cell = c.visited(v)
                # Stored once for each part of its cell, and asking once for each chunk of a visited cell.
                for asks, row, cell, times in ((0, np.arange(len(v)), home, c.parts), (1, row, cell, c.chunks)):
                    copies = times[cell]
                    row, cell = np.repeat(row, copies), np.repeat(cell, copies)
                    each = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies)
                    own = (mixed[row] % (c.parts if asks else c.chunks)[cell].astype(np.uint64)).astype(np.int64)
                    chunk, part = (each, own) if asks else (own, each)
                    for at in range(0, len(row), _STORED):
                        here = slice(at, at + _STORED)
                        taken = batch.take(pa.array(row[here]))
                        given = [pa.array(x[here].astype(np.int32)) for x in (cell, chunk, part)]
                        flags = pa.array(np.full(taken.num_rows, asks, np.int32))
                        yield pa.RecordBatch.from_arrays([*given, flags, taken.column("id"), taken.column("vec")], names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, stored = None, [], []
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in names[:4]], axis=1)
            cuts = np.append(np.flatnonzero(np.append(True, (marks[1:] != marks[:-1]).any(axis=1))) if len(marks) else [], len(marks)).astype(int)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if (found := tuple(marks[a, :3])) != key:
                    key, held, stored = found, [], []
                ids, v = batch.column("id").to_numpy()[a:b], _matrix(batch.column("vec").slice(a, b - a))
                if not marks[a, 3]:
                    held.append((ids, v))
                    continue
                if held:
                    all_ids, all_v = (np.concatenate(x) for x in zip(*held, strict=True))
                    stored, held = [(all_ids[at : at + _STORED], all_v[at : at + _STORED]) for at in range(0, len(all_ids), _STORED)], []
                for at in range(0, b - a, _PIECE):
                    best = _Nearest(ids[at : at + _PIECE], v[at : at + _PIECE], k, once=True)
                    for part in stored:
                        best.see(*part)
                    yield best.lists()

    dealt = points.mapInArrow(deal, "cell int, chunk int, part int, asks int, id long, vec array<double>")
    keyed = dealt.repartition("cell", "chunk", "part").sortWithinPartitions("cell", "chunk", "part", "asks")
    return keyed.mapInArrow(compare, "id long, near array<struct<far: double, nb: long>>")


class _Nearest:
    """The ``k`` nearest of some rows among the blocks of rows seen so far; ties go to the smaller id, a row is no neighbour of itself.

    With ``once`` an id that comes with several vectors counts once, by the nearest of them.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, once: bool = False):
        self.ids, self.vectors, self.k, self.once = ids, vectors, k, once
        self.floor = np.full(len(ids), -2.0)
        self.row, self.nb, self.sim = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def see(self, nb: np.ndarray, vectors: np.ndarray) -> None:
        sims = self.vectors @ vectors.T
        own = np.isin(self.ids, nb)
        sims[own] = np.where(self.ids[own, None] == nb, -3.0, sims[own])
        if not len(self.row) and len(nb) > self.k and not (self.once and len(np.unique(nb)) < len(nb)):
            self.floor = np.maximum(self.floor, np.partition(sims, -self.k, axis=1)[:, -self.k])
        row, at = np.nonzero(sims >= self.floor[:, None])
        row, nb, sim = np.append(self.row, row), np.append(self.nb, nb[at]), np.append(self.sim, sims[row, at])
        self.row, self.nb, self.sim, place = _ranked(row, nb, sim, self.k, self.once)
        last = place == self.k - 1
        self.floor[self.row[last]] = self.sim[last]

    def lists(self) -> pa.RecordBatch:
        ends = np.searchsorted(self.row, np.arange(len(self.ids) + 1)).astype(np.int32)
        entries = pa.StructArray.from_arrays([pa.array(-self.sim), pa.array(self.nb)], ["far", "nb"])
        return pa.RecordBatch.from_arrays([pa.array(self.ids), pa.ListArray.from_arrays(pa.array(ends), entries)], ["id", "near"])


def exact_neighbours(queries: DataFrame, points: DataFrame, k: int = 10, block: int = 2048) -> DataFrame:
    """``(id, rank, neighbour, similarity)`` by comparing a stated set of queries with all points, both ``(id, vec)``.

    Queries travel in blocks of about ``block`` rows, dealt by the hash of their id; each block is one pass over the points, whose tasks
    return at most ``k`` rows a query. Ties go to the smaller id; a row is no neighbour of itself.
    """
    n = queries.count()
    blocks = max(1, -(-n // block))
    found = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).select("id", "vec").collect()
        if not rows:
            continue
        shared = queries.sparkSession.sparkContext.broadcast((np.array([r["id"] for r in rows]), np.array([r["vec"] for r in rows])))
        part = points.select("id", "vec").mapInArrow(_nearest_of(shared, k), _FOUND)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = queries.select("id", F.col("id").alias("nb"), F.lit(0.0).alias("sim")).limit(0)
    rank = F.row_number().over(Window.partitionBy("id").orderBy(F.col("sim").desc(), "nb"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("id", "rank", F.col("nb").alias("neighbour"), F.col("sim").alias("similarity"))


def _nearest_of(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = shared.value
        best = _Nearest(ids, q, k)
        for batch in batches:
            for at in range(0, batch.num_rows, _STORED):
                part = batch.slice(at, _STORED)
                best.see(part.column("id").to_numpy(), _matrix(part.column("vec")))
        yield pa.RecordBatch.from_arrays([pa.array(ids[best.row]), pa.array(best.nb), pa.array(best.sim)], ["id", "nb", "sim"])

    return run


def recall(graph: DataFrame, exact: DataFrame, tie: float = 1e-9) -> DataFrame:
    """``(n_queries, n_true, n_found)``: how many of the exact neighbours' places the graph fills with rows as near.

    A neighbour counts if it is at least as near as the last exact one, so that ties are no misses.
    """
    last = exact.groupBy("id").agg(F.min("similarity").alias("_last"), F.count(F.lit(1)).alias("_n"))
    hits = last.join(graph.select("id", "similarity"), "id", "left").groupBy("id", "_n").agg(F.count_if(F.col("similarity") >= F.col("_last") - tie).alias("_hit"))
    return hits.agg(F.count(F.lit(1)).alias("n_queries"), F.coalesce(F.sum("_n"), F.lit(0)).alias("n_true"), F.coalesce(F.sum(F.least("_hit", "_n")), F.lit(0)).alias("n_found"))
