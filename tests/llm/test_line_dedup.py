import hashlib
from collections import defaultdict

from topicloom.llm import line_dedup as ld

BLANK = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows, min_documents, keep_first=False, same=None):
    docs = {(i, t or "") for i, t in rows}
    seen = defaultdict(set)
    lead = lambda k: keep_first and min(seen[k], key=lambda d: (d[0] is not None, d[0] or 0, same[d]))
    for d in docs:
        for line in d[1].split("\n"):
            seen[lower(line.strip(BLANK))].add(d)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keys = [lower(x.strip(BLANK)) for x in lines]
        stay = [x for x, k in zip(lines, keys) if not (k and len(seen[k]) >= min_documents and lead(k) != (i, t or ""))]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return sorted(out, key=str)


def result(df):
    return sorted(((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in df.collect()), key=str)


def test_equals_brute_force_with_a_hot_line(spark, make_docs, words, odd):
    import random

    rng = random.Random(3)
    rows = list(odd)
    for i in range(10, 400):
        lines = [" ".join(rng.sample(words, 3)) for _ in range(rng.randint(0, 5))]
        if i % 3:
            lines.insert(rng.randint(0, len(lines)), "  Common LINE\r")
        if i % 40 == 0:
            lines += ["forty", "forty\t", "ÉA"]
        rows.append((i, "\n".join(lines + rng.sample(["x", "y", "z"], 1))))
    for parts, least in ((1, 10), (7, 10), (61, 9), (61, 2), (61, 1)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            assert result(ld.drop_repeated_lines(make_docs(rows), least)) == brute(rows, least), (parts, least)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_first_document_keeps_its_lines(spark, make_docs, words, odd):
    import random

    from pyspark.sql import functions as F

    rng = random.Random(4)
    rows = list(odd)
    for i in range(10, 300):
        lines = [" ".join(rng.sample(words, 2)) for _ in range(rng.randint(0, 3))] + ["Hot line", "hot line "] * (i % 2)
        rows.append((i, "\n".join(lines + rng.sample(["x", "y", "z", "one line"], 2))))
    rows += [(900 + i, "a whole copy\nof two lines") for i in range(14)]
    docs = make_docs(rows)
    told = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("h"))
    same = {(r.doc_id, r.t): r.h for r in told.collect()}
    for parts, least in ((1, 10), (7, 10), (61, 9), (300, 2), (300, 40)):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = result(ld.drop_repeated_lines(docs, least, keep_first=True))
            assert got == brute(rows, least, True, same), (parts, least)
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_short_keys_stay_and_bitmaps_are_small(make_docs):
    rows = [(i, "ab\nabc\n" * 2000) for i in range(12)]
    maps = ld.keep_bitmaps(make_docs(rows), 10, min_chars=3).collect()
    assert len(maps) == 12 and all(len(r.keep) < 400 for r in maps)
    assert ld.unpack(maps[0].keep).tolist() == [True, False] * 2000


def test_empty_table(make_docs):
    assert ld.drop_repeated_lines(make_docs([])).collect() == []


def test_clashing_columns_are_named(make_docs):
    import pytest

    for name in ("n_lines", "n_dropped", "_line_doc", "_line_same", "_line_keep"):
        with pytest.raises(ValueError, match=name):
            ld.drop_repeated_lines(make_docs([]).withColumnRenamed("lang", name))
    with pytest.raises(ValueError, match="min_documents"):
        ld.drop_repeated_lines(make_docs([]), 1, keep_first=True)


def test_query_digest(spark, tmp_path, make_docs, odd):
    from topicloom.llm.queries import op8

    make_docs(odd).write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, t, n, d in brute(odd, 10) if i)
    assert sorted(tuple(r) for r in op8(spark, str(tmp_path)).collect() if r[0]) == want


def test_a_worker_holds_the_texts_of_few_documents():
    import pyarrow as pa

    texts = ["one\n\ntwo", "", "\u00e4"] * 700
    n = len(texts)
    batch = pa.record_batch({"doc": list(range(n)), "same": [7] * n, "text": texts})
    made = list(ld._split(1)(iter([batch])))
    assert max(len(set(b.column("doc").to_pylist())) for b in made) <= 512
    rows = [(r["doc"], r["pos"]) for b in made for r in b.to_pylist()]
    assert rows == [(i, at) for i, t in enumerate(texts) for at, line in enumerate(t.split("\n")) if line]
    met = pa.record_batch({"doc_id": list(range(n)), "text": texts, "_line_keep": pa.array([None] * n, pa.binary())})
    cut = list(ld._shorten(["doc_id", "text"])(iter([met])))
    assert max(b.num_rows for b in cut) <= 512
    assert [t for b in cut for t in b.column("text").to_pylist()] == texts
