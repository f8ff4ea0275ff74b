import random
import zlib

import pytest

from topicloom.llm import toxicity_kn as tk

LABELS = "doc_id long, quality int, toxic int"


def corpus(words, n, seed=1):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(max(2, len(text) // 30)):
                text.insert(rng.randrange(len(text)), "zlurp" + rng.choice(["a", "o", "ix", "ent", "ung"]))
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy(spark, make_docs, words, odd):
    rows, labels = corpus(words, 600)
    docs, marks = make_docs([(i + 1000, t) for i, t in rows] + odd), spark.createDataFrame([(i + 1000, q, t) for i, q, t in labels] + [(None, 1, 1), (3, None, None)], LABELS)
    model = tk.train(docs, marks)
    got = tk.score(docs, model).collect()
    assert len(got) == len(rows) + len(odd)
    toxic = {i + 1000: t for i, _, t in labels}
    tested = [r for r in got if r.doc_id in toxic and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert len(tested) > 100 and sum(r.predicted == toxic[r.doc_id] for r in tested) >= 0.98 * len(tested)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.predicted == 0 for r in got if r.doc_id in (1, 2, 3, 7))


def test_probabilities_sum_to_one(words):
    rng = random.Random(2)
    counts = [dict(), dict()]
    for c in counts:
        for w in rng.sample(words, 100):
            n = rng.randint(1, 5)
            for g in tk.letter_groups(w, 4):
                c[g] = c.get(g, 0) + n
    r = tk.Ratios(counts[0], counts[1], tk.Settings())
    letters = [*r.shared, "?"]  # one letter that was never seen
    for m in r.models:
        for context in ("", "t", "th", "ed", "\x02", "zz"):
            assert sum(m.probability(context + x, (r.shared.get(x, 0) + 1) / r.size) for x in letters) == pytest.approx(1)


def test_labels_of_the_held_out_fold_change_nothing(spark, make_docs, words):
    rows, labels = corpus(words, 120)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    docs = make_docs(rows)
    scores = [
        {r.doc_id: r.score for r in tk.score(docs, tk.train(docs, spark.createDataFrame(x, LABELS))).collect()} for x in (labels, flipped)
    ]
    assert scores[0] == scores[1]


def test_missing_classes_and_empty_tables(spark, make_docs, odd):
    none, docs = spark.createDataFrame([], LABELS), make_docs(odd)
    assert all(r.score < 1e-9 and r.predicted == 0 for r in tk.score(docs, tk.train(docs, none)).collect())
    only = spark.createDataFrame([(4, 1, 1), (7, 1, 1)], LABELS)
    assert all(r.predicted == 1 for r in tk.score(docs, tk.train(docs, only)).collect())
    assert tk.score(make_docs([]), tk.train(make_docs([]), only)).collect() == []
