import random

import pytest
from pyspark.sql import functions as F

from topicloom.operators.dedupe import merge_by_status
from topicloom.streaming.clean import stream_records
from topicloom.streaming.latest import LatestTable, merge_stream

SCHEMA = "id long, ts int, seq long, part int, note string"


def rows(n, seed):
    rng = random.Random(seed)
    return [(rng.choice([None, *range(40)]), rng.choice([None, 1, 2, 3]), i, rng.randint(0, 1), f"n{i}") for i in range(n)]


def table(spark, path, buckets=8):
    return LatestTable(spark, str(path), spark.createDataFrame([], SCHEMA).schema, "id", "ts", ("part", "seq"), buckets)


def whole(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    sides = [df.where(F.col("part") == p).drop("part") for p in (0, 1)]
    return sorted(map(tuple, merge_by_status(*sides, "id", "ts", "seq").collect()), key=str)


def held(t):
    return sorted(map(tuple, t.read().drop("part").collect()), key=str)


def test_batches_with_one_repeated_equal_the_merge_of_all_rows(spark, tmp_path):
    data, t = rows(300, 1), table(spark, tmp_path / "t")
    assert t.read().collect() == []
    random.Random(2).shuffle(data)
    for batch, part in ((0, data[:100]), (1, data[100:110]), (1, data[100:110]), (0, data[:100]), (2, data[110:])):
        t.upsert(spark.createDataFrame(part, SCHEMA), batch)
    assert held(t) == whole(spark, data) and t.commits() == [0, 1, 2]
    t.vacuum()
    assert held(t) == whole(spark, data)


def test_a_batch_that_failed_before_its_commit_runs_again(spark, tmp_path, monkeypatch):
    data, t = rows(200, 3), table(spark, tmp_path / "t")
    t.upsert(spark.createDataFrame(data[:100], SCHEMA), 0)
    before = held(t)
    with monkeypatch.context() as m:
        m.setattr(LatestTable, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            t.upsert(spark.createDataFrame(data[100:150], SCHEMA), 1)
    assert held(t) == before
    t.upsert(spark.createDataFrame(data[100:], SCHEMA), 1)
    assert held(t) == whole(spark, data)


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = table(spark, tmp_path / "t", 16)
    t.upsert(spark.createDataFrame(rows(200, 4), SCHEMA), 0)
    first = t.folders()
    t.upsert(spark.createDataFrame([(7, 9, 999, 0, "new")], SCHEMA), 1)
    changed = {b for b, f in t.folders().items() if first.get(b) != f}
    assert len(changed) == 1 and len(first) > 10
    t.upsert(spark.createDataFrame([], SCHEMA), 2)
    assert t.commits() == [0, 1, 2] and {r["note"] for r in t.read().where("id = 7").collect()} >= {"new"} or t.read().where("id = 7 and ts is null").count()


def test_stream_equals_batch(spark, tmp_path):
    data, t = rows(240, 5), table(spark, tmp_path / "t")
    for at in range(0, 240, 80):
        spark.createDataFrame(data[at : at + 80], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = stream_records(spark, str(tmp_path / "in"), t.schema)
    merge_stream(stream, t, str(tmp_path / "ckpt"))
    merge_stream(stream, t, str(tmp_path / "ckpt"))
    assert held(t) == whole(spark, data)


def test_clashing_names(spark):
    with pytest.raises(ValueError, match="_bucket"):
        LatestTable(spark, "x", spark.createDataFrame([], "id long, _bucket int").schema, "id", "id", ("id",))
