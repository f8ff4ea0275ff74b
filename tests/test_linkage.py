import math

import numpy as np
import pytest

from topicloom.operators.linkage import average_hierarchy
from topicloom.operators.topicmap import distributions, js_distances, map_topics

KIND = "topic_id long, term string, weight double"


def terms_of(rng, topics, words, share):
    w = np.where(rng.random((topics, words)) < share, rng.random((topics, words)) + 0.05, 0.0)
    w[:, 0] += 0.01
    return w, [(t * 3 + 1, f"w{i}", float(w[t, i])) for t in range(topics) for i in range(words) if w[t, i] > 0]


def agglomerate(ids, sims):
    groups, out = {i: [k] for k, i in enumerate(ids)}, []
    while len(groups) > 1:
        average = lambda a, b: float(np.mean([[sims[x, y] for y in groups[b]] for x in groups[a]]))
        a, b = min(((a, b) for a in groups for b in groups if a < b), key=lambda p: (-average(*p), p))
        out.append((a, b, average(a, b), len(groups[a]) + len(groups[b])))
        groups[a] += groups.pop(b)
    return out


@pytest.mark.parametrize("topics", [2, 9, 24])
def test_average_linkage_equals_plain_agglomeration(spark, topics):
    w, rows = terms_of(np.random.default_rng(topics), topics, 30, 0.3)
    unit = w / np.linalg.norm(w, axis=1, keepdims=True)
    got = average_hierarchy(spark.createDataFrame(rows, KIND)).orderBy("merge_order").collect()
    want = agglomerate([t * 3 + 1 for t in range(topics)], unit @ unit.T)
    assert [(r.merge_order, r.topic_a, r.topic_b, r.size) for r in got] == [(i, a, b, n) for i, (a, b, _, n) in enumerate(want, 1)]
    assert [r.similarity for r in got] == pytest.approx([s for _, _, s, _ in want])


def test_average_linkage_of_apart_equal_and_no_topics(spark):
    rows = [(1, "a", 1.0), (2, "a", 2.0), (3, "b", 1.0), (4, "c", 0.0), (None, "a", 1.0)]
    got = average_hierarchy(spark.createDataFrame(rows, KIND)).orderBy("merge_order").collect()
    assert [(r.topic_a, r.topic_b, round(r.similarity, 9)) for r in got] == [(1, 2, 1.0), (1, 3, 0.0), (1, 4, 0.0)]
    assert average_hierarchy(spark.createDataFrame([], KIND)).collect() == []


def js(p, q):
    m = (p + q) / 2
    part = lambda x: sum(a * math.log(a / b) for a, b in zip(x, m) if a > 0)
    return (part(p) + part(q)) / 2


def test_distances_and_map_equal_numpy(spark):
    w, rows = terms_of(np.random.default_rng(4), 12, 25, 0.4)
    p = w / w.sum(axis=1, keepdims=True)
    d = np.array([[js(a, b) for b in p] for a in p])
    df = spark.createDataFrame(rows, KIND)
    for r in js_distances(distributions(df)).collect():
        assert r.distance == pytest.approx(d[r.topic_a // 3, r.topic_b // 3], abs=1e-12)
    centre = np.eye(12) - 1 / 12
    values, vectors = np.linalg.eigh(-0.5 * centre @ d**2 @ centre)
    want = vectors[:, ::-1][:, :3] * np.sqrt(values[::-1][:3])
    got = np.array([r[1:] for r in map_topics(df, dims=3).orderBy("topic_id").collect()])
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-9)
    assert (got.max(axis=0) >= -got.min(axis=0) - 1e-9).all()


def test_topics_beside_the_landmarks_are_placed_by_them(spark):
    w, rows = terms_of(np.random.default_rng(6), 10, 12, 0.7)
    twin = [(900, word, x / 4) for t, word, x in rows if t == 1]
    df = spark.createDataFrame(rows + twin + [(901, "alone", 0.001), (902, "w1", 0.0)], KIND)
    got = {r.topic_id: (r.x, r.y) for r in map_topics(df, landmarks=10).collect()}
    assert len(got) == 12 and got[900] == pytest.approx(got[1], abs=1e-9)
    assert all(math.isfinite(v) for v in got[901])
    assert map_topics(spark.createDataFrame([], KIND)).collect() == []
    assert [(r.x, r.y) for r in map_topics(spark.createDataFrame([(1, "a", 1.0)], KIND)).collect()] == [(0.0, 0.0)]
