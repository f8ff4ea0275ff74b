"""Keep-latest, merge and status filters over dated records with several versions per id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.text import is_real_text_strict
from topicloom.functions.wordlists import PLACEHOLDERS_STRICT


def keep_latest(df: DataFrame, id_column: str, ts: str, seq: str) -> DataFrame:
    """The last row per id by timestamp, then by ingestion order; a null timestamp sorts last and wins.

    Spark turns ``row_number() = 1`` into a per-task group limit before the shuffle, so an id
    with very many versions sends one row per task and not its whole history.
    """
    newest = Window.partitionBy(id_column).orderBy(F.col(ts).desc_nulls_first(), F.col(seq).desc())
    return df.withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")


def has_status(status: Column, wanted: str) -> Column:
    return F.lower(F.trim(status.cast("string"))) == wanted.lower()


def latest_with_status(df: DataFrame, id_column: str, ts: str, seq: str, status: str, wanted: str) -> DataFrame:
    """Keep-latest first, status second: an id whose newest row has another status is gone."""
    return keep_latest(df, id_column, ts, seq).where(has_status(F.col(status), wanted))


def merge_by_status(open_rows: DataFrame, closed_rows: DataFrame, id_column: str, ts: str, seq: str) -> DataFrame:
    """Union of both slices, newest row per id; on equal timestamps the closed slice came later and wins."""
    both = open_rows.withColumn("_part", F.lit(0)).unionByName(closed_rows.withColumn("_part", F.lit(1)))
    ordered = both.withColumn("_seq", F.struct("_part", seq))
    return keep_latest(ordered, id_column, ts, "_seq").drop("_seq", "_part")


def merge_counts(open_rows: DataFrame, closed_rows: DataFrame, merged: DataFrame) -> DataFrame:
    """Rows before and after the merge and in each slice, as one row."""
    n = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return merged.agg(F.count(F.lit(1)).alias("after")).select(
        (n(open_rows) + n(closed_rows)).alias("before"),
        "after",
        n(open_rows).alias("open_rows"),
        n(closed_rows).alias("closed_rows"),
    )


def merge_raw(
    open_rows: DataFrame, closed_rows: DataFrame, id_column: str, ts: str, seq: str, status: str, text: str
) -> DataFrame:
    """The whole ingest: newest per slice, status filter, merge, then the placeholder filter.

    The text filter comes last, so an id whose newest text is blank disappears even when an
    older version had text.
    """
    merged = merge_by_status(
        latest_with_status(open_rows, id_column, ts, seq, status, "open"),
        latest_with_status(closed_rows, id_column, ts, seq, status, "closed"),
        id_column, ts, seq,
    )
    return merged.where(is_real_text_strict(F.col(text), PLACEHOLDERS_STRICT))
