import json

import pytest
from pyspark.sql import functions as F

from topicloom.operators import dedupe as dd
from topicloom.operators import profile as pf
from topicloom.operators.features import dense_ids
from topicloom.operators.ranking import examples_per_category
from topicloom.schema import require_language, require_settings, require_variant
from topicloom.sources import readers as rd
from topicloom.sources.timebins import adaptive_time_bins, plan_year_windows
from topicloom.sources.writers import write_csv, write_table


def test_keep_latest_ties_and_nulls(spark):
    rows = [(1, "2024-01-01", 1, "a"), (1, "2024-01-01", 2, "b"), (2, None, 1, "n"), (2, "2025-01-01", 2, "c"), (3, "2024-01-01", 1, "d")]
    df = spark.createDataFrame(rows, "id int, ts string, seq int, v string")
    assert {r["id"]: r["v"] for r in dd.keep_latest(df, "id", "ts", "seq").collect()} == {1: "b", 2: "n", 3: "d"}


def test_merge_order_of_steps(spark):
    schema = "id int, ts string, seq int, status string, description string"
    opened = spark.createDataFrame(
        [(1, "2024-01-01", 1, "Open ", "old text"), (2, "2024-01-01", 2, "open", "keep"), (3, "2024-01-02", 3, "pending", "x"), (4, "2024-01-01", 4, "open", "tie open")], schema
    )
    closed = spark.createDataFrame(
        [(1, "2024-02-01", 1, "closed", " "), (4, "2024-01-01", 1, "CLOSED", "tie closed"), (5, "2024-01-01", 2, "closed", "None")], schema
    )
    got = dd.merge_raw(opened, closed, "id", "ts", "seq", "status", "description")
    assert {r["id"]: r["description"] for r in got.collect()} == {2: "keep", 4: "tie closed"}


def test_year_windows(spark):
    bounds = spark.sql("select timestamp'2020-06-01' start, timestamp'2022-01-01' end union all select timestamp'2023-01-01', timestamp'2023-01-01'")
    got = [(str(r[0]), str(r[1])) for r in plan_year_windows(bounds).orderBy("win_start").collect()]
    assert got == [("2020-06-01 00:00:00", "2021-01-01 00:00:00"), ("2021-01-01 00:00:00", "2022-01-01 00:00:00")]


def test_time_bins_tile_and_respect_the_cap(spark):
    events = spark.range(3000).select(F.expr("timestampadd(SECOND, cast(pow(id, 2) as int), timestamp'2024-01-01')").alias("ts"))
    bounds = events.agg(F.min("ts").alias("start"), (F.max("ts") + F.expr("interval 1 second")).alias("end"))
    bins = adaptive_time_bins(events, "ts", plan_year_windows(bounds)).orderBy("bin_start").collect()
    assert all(a["bin_end"] == b["bin_start"] for a, b in zip(bins, bins[1:]))
    assert all(b["n_records"] < 100 or b["span_days"] <= 7 for b in bins)
    assert all(b["span_days"] <= 90 for b in bins)
    first = bounds.first()
    assert (bins[0]["bin_start"], bins[-1]["bin_end"]) == (first["start"], first["end"])
    assert sum(b["n_records"] for b in bins) == 3000


def test_csv_with_line_breaks_and_other_column_order(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text('status,lat,description,service_request_id\nopen,1.0,"line one\nline ""two""",7\nclosed,2.0,,8\n')
    got = rd.read_raw_csv(spark, str(path))
    assert got.columns == ["status", "description", "service_request_id"]
    assert [r["description"] for r in got.orderBy("service_request_id").collect()] == ['line one\nline "two"', ""]
    bad = tmp_path / "bad.csv"
    bad.write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="description"):
        rd.read_raw_csv(spark, str(bad))


def test_files_of_another_header_raise_instead_of_landing_under_wrong_names(spark, tmp_path):
    (tmp_path / "a.csv").write_text("service_request_id,description,status\n1,one,open\n")
    (tmp_path / "b.csv").write_text("status,description,service_request_id\nclosed,two,2\n")
    with pytest.raises(Exception, match="(?i)header"):
        rd.read_raw_csv(spark, str(tmp_path)).collect()
    each = [rd.read_raw_csv(spark, str(tmp_path / f)) for f in ("a.csv", "b.csv")]
    got = {(r["service_request_id"], r["status"]) for r in each[0].unionByName(each[1]).collect()}
    assert got == {("1", "open"), ("2", "closed")}


def test_landed_json(spark, tmp_path):
    row = {"service_request_id": "1", "description": "d", "lat": 3}
    bodies = {"list.json": [row, row], "object.json": {"n": 2, "requests": [row], "other": [row, row]}, "none.json": {"n": 2}}
    for name, body in bodies.items():
        (tmp_path / name).write_text(json.dumps(body))
    counts = {n: rd.read_landed_json(spark, str(tmp_path / n)).count() for n in bodies}
    assert counts == {"list.json": 2, "object.json": 1, "none.json": 0}
    assert rd.read_landed_json(spark, str(tmp_path / "list.json")).first()["description"] == "d"


def test_model_tables_are_pruned_by_partition(spark, tmp_path):
    df = spark.createDataFrame([("bow", "de", 1), ("bow", "en", 2), ("tfidf", "de", 3)], "variant string, language string, v int")
    path = str(tmp_path / "t")
    write_table(df, path, ("variant", "language"))
    assert [r["v"] for r in rd.read_labelled_table(spark, path, "en", "bow").collect()] == [2]
    assert rd.read_model_table(spark, path, "tfidf").count() == 1
    with pytest.raises(ValueError):
        rd.read_labelled_table(spark, path, "fr")
    with pytest.raises(ValueError):
        require_variant("nmf")
    assert require_language("de") == "de" and rd.language_suffix("en") == "_en" and rd.language_suffix("de") == ""
    write_csv(df, str(tmp_path / "c"))
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 3


def test_settings_and_alignment(spark):
    with pytest.raises(ValueError, match="min_df"):
        require_settings({"lowercase": False, "token_pattern": "", "ngram_range": (1, 2), "max_df": 1})
    a = spark.createDataFrame([(1,), (2,)], "doc_id int")
    rd.assert_aligned(a, a)
    with pytest.raises(ValueError):
        rd.assert_aligned(a, a.where("doc_id = 1"))


def test_quality_gate(spark):
    pf.assert_quality(spark.createDataFrame([("a", "b"), ("", "x")], "strong_text string, light_text string"))
    for row in [(None, "x"), ("nan", "x"), (" ", "")]:
        with pytest.raises(ValueError):
            pf.assert_quality(spark.createDataFrame([row], "strong_text string, light_text string"))


def test_examples_skip_rows_without_category(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("a", 3), (None, 4), ("b", 5)], "c string, i int")
    assert sorted((r["c"], r["i"]) for r in examples_per_category(df, "c", "i", 2).collect()) == [("a", 1), ("a", 2), ("b", 5)]


def test_dense_ids_are_sorted_and_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("k")).repartition(7)
    got = sorted((r["i"], r["k"]) for r in dense_ids(df, ["k"], "i").collect())
    assert [i for i, _ in got] == list(range(1000)) and [k for _, k in got] == sorted(k for _, k in got)


def test_sample_is_repeatable(spark):
    df = spark.range(100).select("id", F.lit("x").alias("t"))
    a, b = pf.sample_texts(df, "id", ["t"], 5).collect(), pf.sample_texts(df.repartition(5), "id", ["t"], 5).collect()
    assert a == b and len(a) == 5


def test_top_n_is_limited_before_the_shuffle(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("id"), F.col("id").alias("ts"), F.col("id").alias("seq"))
    plan = dd.keep_latest(df, "id", "ts", "seq")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
