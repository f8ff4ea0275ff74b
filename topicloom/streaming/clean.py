"""The stateless steps on a stream: cleaning is a projection and a filter, so it needs no state."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from topicloom.plans.pipeline import clean_corpus


def stream_records(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).load(path)


def clean_stream(records: DataFrame, id_column: str, text: str, stopwords: Iterable[str]) -> DataFrame:
    return clean_corpus(records, id_column, text, stopwords)


def write_available(df: DataFrame, path: str, checkpoint: str) -> None:
    """Process what has landed, exactly once, and stop."""
    query = (
        df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
    query.awaitTermination()
