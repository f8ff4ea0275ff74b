import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.llm import oracles
from topicloom.llm import phrases as ph

SCHEMA = "doc_id long, text string, lang string"


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def brute(rows, least, limit=2000):
    counts = defaultdict(Counter)
    for _, text, lang in rows:
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower(text or "")):
            words = re.findall(r"[^ \t]+", piece)
            for i in range(len(words)):
                for k in range(1, 6):
                    if i + k <= len(words):
                        counts["und" if lang is None else lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        n = sum(c for g, c in f.items() if len(g) == 1)
        often = {g: c for g, c in f.items() if c >= least}
        inside = defaultdict(int)
        for g, c in often.items():
            for k in range(2, len(g)):
                for s in range(len(g) - k + 1):
                    inside[g[s : s + k]] = max(inside[g[s : s + k]], c)
        rows_ = []
        for g, a in often.items():
            if len(g) > 1 and inside[g] < a:
                score, cut = min((1000 * a * n // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g)))
                rows_.append((-score, -a, " ".join(g).encode(), f[g[:cut]], f[g[cut:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows_)[:limit], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n, -score))
    return sorted(out)


def corpus(seed, docs=300):
    rng = random.Random(seed)
    words = ["the", "of", "and", "a", "Ünder", "it", "x", "İ", "日本", "\x1cq", "nb sp", "end'"] + [f"w{i}" for i in range(60)]
    weights = [60, 40, 40, 30] + [3] * (len(words) - 4)
    passages = [" ".join(rng.choices(words, weights, k=rng.randint(3, 40))) for _ in range(6)]
    rows = []
    for i in range(docs):
        parts = []
        for _ in range(rng.randint(0, 12)):
            parts.append(rng.choice(passages) if rng.random() < 0.4 else " ".join(rng.choices(words, weights, k=rng.randint(1, 15))))
            parts.append(rng.choice([" ", ". ", ", ", "\n", "\t", "  ", "!?", " \r\n", "\x0b"]))
        rows.append((i, "".join(parts), rng.choice(["en", "en", "en", "de", None, "und", ""])))
    return rows + [(1, None, "en"), (2, "", None), (3, " \t\n.", "fr"), (4, "one", "fr"), (5, "A b c d e F " * 3000, "rep"), (6, "of the " * 50 + "of the", "en")]


def frame(spark, rows, parts=7):
    return spark.createDataFrame(rows, SCHEMA).repartition(parts)


@pytest.mark.parametrize("least, bits", [(20, None), (20, 16), (3, None), (40, 24)])
def test_equals_brute_force(spark, least, bits):
    rows = corpus(least)
    got = ph.mine(frame(spark, rows), least, bits=bits)
    assert sorted(map(tuple, got.collect())) == brute(rows, least)


def test_closed_or_open_buckets_do_not_matter(spark):
    rows = corpus(1, 150)
    docs = frame(spark, rows).select("lang", "text")
    every = ph.gram_counts(ph.windows(docs, np.full(1 << 13, 255, np.uint8), 16), 10)
    some = ph.gram_counts(ph.windows(docs, ph.open_buckets(docs, 16, 10), 16), 10)
    want = sorted(map(tuple, every.collect()))
    assert sorted(map(tuple, some.collect())) == want and len(want) > 50
    # One window a word, so the windows add up to the words.
    table = ph.windows(docs, ph.open_buckets(docs, 16, 10), 16)
    words = sum(len(re.findall(r"[^ \t]+", p)) for _, t, _ in rows for p in re.split(r"[.,;:!?\n\x0b\x0c\r]", t or ""))
    assert table.agg(F.sum("n")).first()[0] == words


def test_flushing_changes_nothing(spark, monkeypatch):
    rows = corpus(2, 150)
    monkeypatch.setattr(ph, "_FLUSH", 50)
    monkeypatch.setattr(ph, "_MAX_WORDS", 20)
    assert sorted(map(tuple, ph.mine(frame(spark, rows, 2), 10, bits=18).collect())) == brute(rows, 10)


def test_a_copied_passage_is_one_path(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, f"z{i} {passage} y{i}", "en") for i in range(30)] + [(90 + i, f"p10 p11 p12 p13 p14 tail{i}", "en") for i in range(5)]
    docs = frame(spark, rows).select("lang", "text")
    grams = ph.gram_counts(ph.windows(docs, ph.open_buckets(docs, 16, 25), 16), 25)
    paths, inside = ph.unary_paths(grams)
    words = passage.split()
    assert sorted((r.path, r.words, r.n) for r in paths.collect()) == sorted(
        [(" ".join(words[:14]), 14, 30), (" ".join(words[10:15]), 5, 35), (" ".join(words[11:]), 49, 30)]
    )
    # All nodes but the ends and the two beside the heavier edge.
    assert inside.count() == 57 - 4


def test_limit_and_oracle(spark):
    rows = [r for r in corpus(7, 900) if r[2] != "rep"]
    got = sorted(map(tuple, ph.mine(frame(spark, rows)).collect()))
    assert got == brute(rows, 100) and len(got) > 20
    assert sorted(map(tuple, ph.mine(frame(spark, rows), limit=3).collect())) == [r for r in got if r[1] <= 3]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    assert sorted(con.execute(oracles.PHRASES).fetchall()) == got


def test_big_numbers_are_exact(spark):
    big = 3_000_000_000_000
    grams = spark.createDataFrame([("en", "a b", 2, big), ("en", "a", 1, big + 1), ("en", "b", 1, big + 7)], "lang string, gram string, k int, n long")
    totals = spark.createDataFrame([("en", 20 * big + 3)], "lang string, n long")
    row = ph.scored(grams.where("k = 2"), grams, totals).first()
    assert row.score == 1000 * big * (20 * big + 3) // ((big + 1) * (big + 7))


def test_empty_table_and_extra_columns(spark):
    assert ph.mine(frame(spark, [])).collect() == []
    assert ph.mine(frame(spark, [(1, None, "en"), (2, "", None)])).collect() == []
    rows = corpus(3, 60)
    more = frame(spark, rows).withColumns({c: F.lit("x") for c in ("gram", "k", "n", "phrase", "cut", "rank")})
    assert sorted(map(tuple, ph.mine(more, 10).collect())) == brute(rows, 10)
