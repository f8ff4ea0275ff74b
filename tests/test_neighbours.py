import numpy as np
import pytest

from topicloom.operators import neighbours as nb


def frame(spark, ids, vectors):
    return spark.createDataFrame([(int(i), None if v is None else [float(x) for x in v]) for i, v in zip(ids, vectors, strict=True)], "vec_id long, embedding array<double>")


def brute(ids, v, k):
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -9)
    return {int(i): sorted(((-sims[a, b], int(ids[b])) for b in range(len(ids)) if b != a))[:k] for a, i in enumerate(ids)}


@pytest.mark.parametrize("dims", [3, 24])
def test_graph_finds_nine_of_ten_neighbours(spark, dims):
    rng = np.random.default_rng(dims)
    centres = rng.standard_normal((12, dims)) * 2
    v = centres[rng.integers(0, 12, 700)] + rng.standard_normal((700, dims))
    ids = rng.permutation(10_000)[:700]
    graph, members = nb.neighbour_graph(frame(spark, ids, v), 10, degree=20, sorts=2, block=32)
    got = {}
    for r in graph.collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbour, r.similarity))
    want = brute(ids, v, 10)
    assert got.keys() == want.keys() and members.where("id <> representative").isEmpty()
    hits = 0
    for i, rows in got.items():
        rows.sort()
        assert [r[0] for r in rows] == list(range(1, 11)) and len({r[1] for r in rows} - {i}) == 10
        assert [r[2] for r in rows] == sorted((r[2] for r in rows), reverse=True)
        hits += len({r[1] for r in rows} & {w[1] for w in want[i]})
    assert hits >= 0.95 * 10 * len(want)


def test_copies_are_one_node_and_rows_without_direction_are_left_out(spark):
    rng = np.random.default_rng(2)
    v = [*rng.standard_normal((30, 4))] + [np.array([1.0, 2, 3, 4])] * 400 + [np.zeros(4), None, np.array([np.nan, 1, 1, 1]), np.array([])]
    rows = frame(spark, range(len(v)), v)
    graph, members = nb.neighbour_graph(rows, 5, degree=8, sorts=2, block=16)
    nodes = {r.id for r in graph.collect()}
    assert nodes == set(range(31))
    assert {(r.id, r.representative) for r in members.collect()} == {(i, min(i, 30)) for i in range(430)}
    points = nb.directions(rows)
    exact = nb.exact_neighbours(points.where("id < 31"), points.where("id < 31"), 5)
    seen = nb.recall(graph, exact).first()
    assert (seen.n_queries, seen.n_true) == (31, 155) and seen.n_found >= 150


@pytest.mark.parametrize("block", [7, 2048])
def test_exact_neighbours_equal_brute_force(spark, block):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((120, 6))
    v[40:44] = v[3]
    points = nb.directions(frame(spark, range(120), v))
    got = {}
    for r in nb.exact_neighbours(points.where("id % 5 = 0"), points, 6, block).collect():
        got.setdefault(r.id, []).append((r["rank"], r.neighbour))
    want = brute(np.arange(120), v, 119)
    assert set(got) == set(range(0, 120, 5))
    for i, rows in got.items():
        similarity = {j: -s for s, j in want[i]}
        assert [similarity[j] for _, j in sorted(rows)] == pytest.approx([-s for s, _ in want[i][:6]])


def test_small_and_empty_inputs(spark):
    for n in (0, 1, 2, 5):
        graph, members = nb.neighbour_graph(frame(spark, range(n), np.eye(5)[:n]), 3, degree=4, block=8)
        assert graph.count() == n * min(3, max(n - 1, 0)) and members.count() == n
    with pytest.raises(ValueError):
        nb.neighbour_graph(frame(spark, [], []), 10, degree=5)


def test_a_row_travels_to_few_cells_however_many_rows_there_are(spark):
    rng = np.random.default_rng(9)
    copies = {}
    for n in (800, 3200):
        centres = rng.standard_normal((40, 16)) * 2
        v = centres[rng.integers(0, 40, n)] + rng.standard_normal((n, 16)) * 0.5
        points = nb.directions(frame(spark, range(n), v)).cache()
        cells = nb.fit_cells(points, 10, 2, 16, 15, 0.001, 7)
        assert len(cells.centres) == min(32, n // 32) and cells.stored.sum() == n and cells.probes < len(cells.centres)
        lists = nb._search(points, cells, 5).collect()
        copies[n] = len(lists) / n
        assert all(len(r["near"]) <= 5 for r in lists)
        got = {}
        for r in lists:
            got.setdefault(r["id"], []).extend((e["far"], e["nb"]) for e in r["near"])
        want = brute(np.arange(n), v, 5)
        hits = sum(len({j for _, j in sorted(got[i])[:5]} & {j for _, j in want[i]}) for i in want)
        assert hits >= 0.95 * 5 * n
    assert max(copies.values()) <= 32


def test_chunks_and_parts_of_a_cell_give_what_the_whole_cell_gives(spark):
    from dataclasses import replace

    rng = np.random.default_rng(10)
    v = rng.standard_normal((300, 4))
    points = nb.directions(frame(spark, range(300), v)).cache()
    cells = nb.fit_cells(points, 10, 2, 32, 15, 0.001, 7)
    cut = replace(cells, probes=len(cells.centres), chunks=np.full(len(cells.centres), 3), parts=np.full(len(cells.centres), 2))
    got = {}
    for r in nb._search(points, cut, 4).collect():
        got.setdefault(r["id"], []).extend((e["far"], e["nb"]) for e in r["near"])
    want = brute(np.arange(300), v, 4)
    assert {i: [j for _, j in sorted(x)[:4]] for i, x in got.items()} == {i: [j for _, j in x] for i, x in want.items()}


def test_an_id_with_two_vectors_is_one_neighbour(spark):
    v = np.array([[1, 0.0], [1, 0.1], [1, 0.2], [1, 0.3], [-1, 0.5]])
    graph, _ = nb.neighbour_graph(frame(spark, [1, 2, 2, 3, 4], v), 2, degree=4, block=8)
    got = {}
    for r in graph.orderBy("rank").collect():
        got.setdefault(r["id"], []).append(r["neighbour"])
    assert got == {1: [2, 3], 2: [3, 1], 3: [2, 1], 4: [3, 2]}
