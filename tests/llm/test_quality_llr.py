import math
import random
import re

import pytest
from pyspark.sql import functions as F

from topicloom.llm import quality_llr as ql


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen, covered = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            covered.update(i + k for i in at for k in range(8))
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return (len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), failed)


def texts(words, odd):
    rng = random.Random(6)
    rows = list(odd)
    for i in range(150):
        parts = []
        for _ in range(rng.randint(1, 6)):
            part = " ".join(rng.choice(words) for _ in range(rng.randint(1, 25)))
            parts += [part] * rng.choice([1, 1, 1, 2, 3])
        rng.shuffle(parts)
        rows.append((100 + i, rng.choice(["\n", " ", "  \n\t"]).join(parts) + rng.choice(["", "###", " |<>| ", "\n\n"])))
    junk = ["qx" + w for w in words[:50]]
    rows += [(400 + i, " ".join(rng.choice(junk) for _ in range(80))) for i in range(20)]
    return rows


def test_equals_brute_force(spark, make_docs, words, odd):
    rows = texts(words, odd)
    docs = make_docs(rows)
    labels = spark.createDataFrame([(100 + i, int(i % 7 > 0), 0) for i in range(150)] + [(400, 0, 0), (101, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    s = ql.Settings(buckets=8191)
    got = ql.score(docs, labels, s).collect()
    assert sorted((str(r.doc_id), *r[1:7]) for r in got) == sorted((str(i), *base(t)) for i, t in rows)
    # The ratio, with the buckets of Spark's hash.
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    grams = {(r.doc_id, r.text): [h % 8191 for h in [*r.one, *r.two]] for r in ql.word_hashes(hashed).collect()}
    trusted = {100 + i for i in range(150) if i % 7 > 0} - {101}
    raw, target = [0] * 8191, [0] * 8191
    for i, t in rows:
        for b in grams[i, t or ""]:
            raw[b] += 1
            target[b] += i in trusted
    weight = [math.log((t + 1) / (sum(target) + 8191)) - math.log((r + 1) / (sum(raw) + 8191)) for t, r in zip(target, raw)]
    values = {k: sum(weight[b] for b in g) / len(g) if g else 0.0 for k, g in grams.items()}
    want = sorted((str(i), values[i, t or ""]) for i, t in rows)
    for (i, v), (j, w) in zip(sorted((str(r.doc_id), r.llr) for r in got), want, strict=True):
        assert i == j and v == pytest.approx(w, abs=1e-9)
    assert all(r.kept == (not r.base_failed and r.llr >= -0.1) for r in got)
    assert not any(r.kept for r in got if r.doc_id and r.doc_id >= 400) and sum(r.kept for r in got) > 10


def test_the_plan_is_native_and_shuffles_no_text(spark, make_docs, words, odd):
    labels = spark.createDataFrame([(100, 1, 0)], "doc_id long, quality int, toxic int")
    plan = ql.score(make_docs(odd), labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty_tables(spark, make_docs, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert ql.score(make_docs([]), none).collect() == []
    assert all(abs(r.llr) < 1e-2 for r in ql.score(make_docs(odd), none, ql.Settings(smoothing=1e9)).collect())
