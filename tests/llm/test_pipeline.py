from collections import Counter

import corpus_pipeline as cp


def test_stages_take_effect(spark, tmp_path, make_docs, words, odd):
    import random

    rng = random.Random(9)
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = say(25)
    base = say(120)
    rows = [(100 + i, say(60)) for i in range(80)] + [(300 + i, base) for i in range(14)]
    rows += [(400, say(20) + "\n" + item.upper() + " x " + say(20)), (401, "shared line")]
    rows += [(500 + i, say(30) + "\nShared line\n" + say(5)) for i in range(12)]
    toxic = [(600 + i, say(30) + " zlurp zlurpa " + say(10)) for i in range(60)]
    folder = f"{tmp_path}/sf"
    make_docs(rows + toxic + odd).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i >= 600)) for i, _ in rows + toxic], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = cp.run(spark, folder).collect()
    ids = Counter(r.doc_id for r in got)
    # 401 is the first document with the shared line, so the line stays there.
    assert not any(i in ids for i, _ in toxic) and 400 not in ids and ids[401] == 1
    assert [i for i in ids if i is not None and 300 <= i < 400] == [300]
    assert all(ids[i] == 1 for i in range(100, 180)) and all(ids[i] == 1 for i in range(500, 512))
    by_id = {r.doc_id: r for r in got}
    assert "hared line" not in by_id[500].text and by_id[500].n_chars == len(by_id[500].text)
    assert set(by_id[500].asDict()) == {"doc_id", "text", "lang", "source", "n_chars", "ids", "n_tokens"}
    # Empty texts are one group; the repeated row stays once; rows without an id stay.
    assert ids[1] == 1 and 2 not in ids and 3 not in ids and ids[4] == 1 and ids[None] == 1


def test_stage_names_and_columns():
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line_dedup", "near_dedup", "decontamination", "piece_encoding"]
    assert cp.ORACLE_SQL is None


def test_empty_tables(spark, tmp_path, make_docs):
    folder = f"{tmp_path}/empty"
    make_docs([]).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert cp.run(spark, folder).collect() == []
    make_docs([(1, "some words"), (2, "other words here")]).write.parquet(f"{folder}2/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").write.parquet(f"{folder}2/{name}.parquet")
    assert sorted(r.doc_id for r in cp.run(spark, f"{folder}2").collect()) == [1, 2]
