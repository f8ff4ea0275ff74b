"""A join that no key can overload: heavy keys of the left side are dealt over several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A key is heavy from this share of the left side's rows on, so there are at most 1 / HEAVY_SHARE heavy keys.
HEAVY_SHARE = 1e-3
_SALT, _SALTS = "_salt", "_salts"


def heavy_keys(weights: DataFrame, keys: list[str], weight: str, share: float = HEAVY_SHARE) -> DataFrame:
    """``(*keys, _salts)`` of the keys that hold at least ``share`` of the summed ``weight``: one salt for each such share.

    ``weights`` has one row per key. At most ``1 / share`` rows come back, whatever the input.
    """
    total = weights.agg(F.sum(weight)).scalar()
    part = F.col(weight) / (total * F.lit(share))
    return weights.where(part >= 1).select(*keys, F.ceil(part).cast("int").alias(_SALTS))


def heavy_join(
    left: DataFrame, right: DataFrame, keys: list[str], weight: str | None = None, how: str = "inner", share: float = HEAVY_SHARE,
    like: DataFrame | None = None, hashed: bool = False,
) -> DataFrame:
    """``left`` joined to ``right``, which has one row per key.

    ``weight`` names a column of ``right`` that tells how many rows of ``left`` hold the key, where that is known (a vocabulary's
    document frequency); else the keys of ``like`` or ``left`` are counted, combined map-side; ``like`` is a cheaper frame with the same
    rows. The rows of a heavy key get one of its salts by
    their hash (identical rows stay together), and its row of ``right`` is repeated once per salt, so each task gets about ``share`` of the rows of any key.
    The heavy keys are broadcast, which their number allows. ``hashed`` is for a ``right`` whose share of a task always fits its memory,
    such as a vocabulary beside the counts it was made from: both sides then are not sorted. ``how`` is ``inner``, ``left`` or ``left_semi``. Null keys match nothing.
    """
    if how not in ("inner", "left", "left_semi"):
        raise ValueError(f"how must be inner, left or left_semi, not {how!r}")
    clash = {_SALT, _SALTS} & {*left.columns, *right.columns}
    if clash:
        raise ValueError(f"columns exist already: {', '.join(sorted(clash))}")
    counts = right.select(*keys, weight) if weight else (left if like is None else like).groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))
    heavy = F.broadcast(heavy_keys(counts, keys, weight or "_rows", share))
    salt = F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col(_SALTS)), F.lit(0)).cast("int")
    dealt = left.join(heavy, keys, "left").withColumn(_SALT, salt).drop(_SALTS)
    every = F.explode(F.sequence(F.lit(0), F.coalesce(F.col(_SALTS), F.lit(1)) - 1))
    repeated = right.join(heavy, keys, "left").withColumn(_SALT, every).drop(_SALTS)
    return dealt.join(repeated.hint("shuffle_hash") if hashed else repeated, [*keys, _SALT], how).drop(_SALT)
