"""Time windows over a record table, planned from one pass over its timestamps."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.functions.timefn import next_year_start, whole_days

DAY_MICROS = 86_400_000_000


def plan_year_windows(bounds: DataFrame, start: str = "start", end: str = "end") -> DataFrame:
    """Split each ``[start, end)`` row at the UTC year starts; empty ranges give no window."""
    years = F.sequence(F.date_trunc("year", start), F.col(end), F.expr("interval 1 year"))
    return (
        bounds.where(F.col(start) < F.col(end))
        .select(start, end, F.explode(years).alias("year"))
        .select(
            F.greatest(F.col("year"), F.col(start)).alias("win_start"),
            F.least(next_year_start(F.col("year")), F.col(end)).alias("win_end"),
        )
        .where(F.col("win_start") < F.col("win_end"))
    )


def _micros(ts: str):
    """Microseconds since the epoch; sessions run in UTC, so times with and without a zone agree."""
    return F.unix_micros(F.col(ts).cast("timestamp"))


def split_at_days(windows: DataFrame, max_days: int = 90) -> DataFrame:
    """Cut windows longer than ``max_days`` whole days into pieces of that length."""
    step = F.lit(max_days * DAY_MICROS)
    lo, hi = _micros("win_start"), _micros("win_end")
    # A rest of at most max_days whole days is not cut again, so it may reach max_days + 1.
    over = F.greatest(whole_days(F.col("win_start"), F.col("win_end")) - F.lit(max_days), F.lit(0))
    pieces = F.ceil(over / F.lit(max_days)).cast("long")
    return (
        windows.select(lo.alias("lo"), hi.alias("hi"), F.explode(F.sequence(F.lit(0), pieces)).alias("i"), pieces.alias("n"))
        .select(
            (F.col("lo") + F.col("i") * step).alias("bin_lo"),
            F.when(F.col("i") == F.col("n"), F.col("hi")).otherwise(F.col("lo") + (F.col("i") + 1) * step).alias("bin_hi"),
        )
    )


def adaptive_time_bins(
    records: DataFrame,
    ts: str,
    windows: DataFrame,
    cap: int = 100,
    max_days: int = 90,
    min_days: int = 7,
) -> DataFrame:
    """Bins that tile the windows and hold under ``cap`` records or at most ``min_days`` whole days.

    A bin is halved while it holds ``cap`` or more records and spans more than ``min_days``
    whole days. All halvings of a piece form a binary tree whose depth depends on its length
    only, so the records are counted once, in the smallest bins, and the counts are rolled up;
    the number of bins depends on the time range and not on the data.
    """
    pieces = split_at_days(windows, max_days).select(
        "bin_lo",
        "bin_hi",
        _halvings(F.col("bin_lo"), F.col("bin_hi"), max_days, min_days).alias("depth"),
    )
    leaves = pieces.select(
        "*", F.explode(F.expr("sequence(0L, shiftleft(1L, depth) - 1)")).alias("leaf")
    ).select(
        "bin_lo", "bin_hi", "depth", "leaf",
        _edge("leaf", "depth").alias("lo"),
        _edge("leaf + 1", "depth").alias("hi"),
    )
    # Equi-join on the day, then the exact range test.
    days = leaves.select(
        "*", F.explode(F.expr(f"sequence(lo div {DAY_MICROS}, (hi - 1) div {DAY_MICROS})")).alias("day")
    )
    times = (
        records.select(_micros(ts).alias("at"))
        .where(F.col("at").isNotNull())
        .groupBy("at").agg(F.count(F.lit(1)).alias("n"))
        .withColumn("day", F.expr(f"at div {DAY_MICROS}"))
    )
    counted = (
        times.join(days, (times["day"] == days["day"]) & (F.col("at") >= F.col("lo")) & (F.col("at") < F.col("hi")))
        .groupBy("bin_lo", "bin_hi", "leaf").agg(F.sum("n").alias("n"))
    )
    leaf_counts = leaves.join(counted, ["bin_lo", "bin_hi", "leaf"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    nodes = (
        leaf_counts.select("bin_lo", "bin_hi", "depth", "leaf", "n", F.explode(F.expr("sequence(0, depth)")).alias("level"))
        .withColumn("node", F.expr("leaf div shiftleft(1L, depth - level)"))
        .groupBy("bin_lo", "bin_hi", "depth", "level", "node")
        .agg(F.sum("n").alias("n"))
        .withColumn("lo", _edge("node", "level"))
        .withColumn("hi", _edge("node + 1", "level"))
        .withColumn("stops", (F.col("n") < cap) | (F.expr(f"(hi - lo) div {DAY_MICROS}") <= min_days))
    )
    # A node is a bin when it stops and no node above it stops. Each leaf takes its first stop.
    first_stop = (
        leaf_counts.select("bin_lo", "bin_hi", "depth", "leaf", F.explode(F.expr("sequence(0, depth)")).alias("level"))
        .withColumn("node", F.expr("leaf div shiftleft(1L, depth - level)"))
        .join(nodes.where("stops").select("bin_lo", "bin_hi", "level", "node", "lo", "hi", "n"), ["bin_lo", "bin_hi", "level", "node"])
        .groupBy("bin_lo", "bin_hi", "leaf")
        .agg(F.min(F.struct("level", "node", "lo", "hi", "n")).alias("b"))
    )
    return first_stop.select("b.lo", "b.hi", "b.n").distinct().select(
        F.timestamp_micros("lo").alias("bin_start"),
        F.timestamp_micros("hi").alias("bin_end"),
        F.expr(f"(hi - lo) div {DAY_MICROS}").alias("span_days"),
        F.col("n").alias("n_records"),
    )


def _halvings(lo, hi, max_days: int, min_days: int):
    """How often a piece can be halved before it spans ``min_days`` whole days or fewer."""
    most = max(1, math.ceil(math.log2((max_days + 1) / max(min_days, 1))) + 1)
    span = hi - lo
    depth = F.lit(most)
    for k in range(most - 1, -1, -1):
        depth = F.when(F.floor(span / F.lit(2**k * DAY_MICROS)) <= min_days, F.lit(k)).otherwise(depth)
    return depth


def _edge(index: str, depth: str):
    """The ``index``-th edge of a piece cut into ``2^depth`` equal parts, in microseconds."""
    return F.expr(f"bin_lo + ((bin_hi - bin_lo) * ({index})) div shiftleft(1L, {depth})")
