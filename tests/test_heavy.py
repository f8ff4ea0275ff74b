import pytest
from pyspark.sql import functions as F

from topicloom.operators import heavy as hv


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
@pytest.mark.parametrize("weighted", [True, False])
def test_equals_a_plain_join(spark, how, weighted):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("df")).where("k is null or k <> 'k5'").unionByName(spark.createDataFrame([("none", 9)], "k string, df long"))
    got = hv.heavy_join(left, right, ["k"], "df" if weighted else None, how, share=0.01)
    assert rows(got.select(*sorted(got.columns))) == rows((want := left.join(right, "k", how)).select(*sorted(want.columns)))


def test_no_task_gets_a_heavy_key_whole(spark):
    left = spark.range(40_000).select("id", F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 997)).alias("k"))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("df"))
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.shuffle.partitions", 40)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in hv.heavy_join(left, right, ["k"], "df").groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for c, v in old.items():
            spark.conf.set(c, v)
    assert sum(sizes) == 40_000 and max(sizes) < 3 * sorted(sizes)[len(sizes) // 2]


def test_empty_sides_and_clashing_names(spark):
    left, right = spark.createDataFrame([], "k string, a int"), spark.createDataFrame([("x", 1)], "k string, df long")
    assert hv.heavy_join(left, right, ["k"], "df").collect() == []
    assert hv.heavy_join(left, right, ["k"]).collect() == []
    with pytest.raises(ValueError, match="_salt"):
        hv.heavy_join(left.withColumn("_salt", F.lit(1)), right, ["k"])
    with pytest.raises(ValueError, match="how"):
        hv.heavy_join(left, right, ["k"], how="outer")
