from pyspark.sql import functions as F

from topicloom.plans.pipeline import clean_corpus
from topicloom.streaming.clean import clean_stream, stream_records, write_available


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(["Lampe <b>defekt</b> http://x.y", "", "und 12", "Brunnen ohne Wasser"])]
    df = spark.createDataFrame(rows, "id int, t string")
    df.write.parquet(str(tmp_path / "in"))
    stream = clean_stream(stream_records(spark, str(tmp_path / "in"), df.schema), "id", "t", ["und"])
    assert stream.isStreaming
    write_available(stream, str(tmp_path / "out"), str(tmp_path / "ckpt"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("id").collect()
    assert got == clean_corpus(df, "id", "t", ["und"]).orderBy("id").collect()
    assert [r["id"] for r in got] == [0, 3]
