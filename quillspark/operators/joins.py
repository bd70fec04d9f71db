"""Join helpers: size-checked broadcast, range lookup (C2), config join (C1),
anti join of finished work (C6/A9), prediction-vs-gold (C5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS = 100_000


def small_enough(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> bool:
    """Size check before a broadcast: counts at most ``max_rows + 1`` rows."""
    return df.limit(max_rows + 1).count() <= max_rows


def checked_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``broadcast(df)`` when it has at most ``max_rows`` rows; otherwise the
    frame unchanged, so Spark (and AQE at run time) picks a shuffled join."""
    return F.broadcast(df) if small_enough(df, max_rows) else df


def join_null_safe(left: DataFrame, right: DataFrame, keys, how: str = "inner") -> DataFrame:
    """``left.join(right, keys, how)`` in which null keys equal each other, as
    they do in a ``groupBy`` (still an equi-join for Spark)."""
    keys = list(keys)
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(other, on, how).drop(*[f"_right_{k}" for k in keys])


def join_config(df: DataFrame, cfg: DataFrame, key: str = "dataset",
                how: str = "inner") -> DataFrame:
    """Dataset -> config row (n:1)."""
    return df.join(checked_broadcast(cfg), key, how)


def range_lookup(points: DataFrame, ranges: DataFrame, point: str, lo: str, hi: str,
                 n_buckets: int = 1 << 12) -> DataFrame:
    """Attach the range ``[lo, hi)`` containing ``point`` (ranges are
    disjoint; empty ones are dropped).

    An exact equi-join, not a nested loop: both sides are bucketed on
    ``value div width`` with ``width = ceil(max(hi) / n_buckets)`` (a scalar
    subquery); each range is exploded into the buckets it spans (at most
    ``#ranges + n_buckets`` rows), then the join on the bucket keeps the
    pairs whose range holds the point. AQE broadcasts the small side.
    """
    span = ranges.agg(F.max(hi)).scalar()
    width = F.greatest(F.lit(1), F.ceil(span / F.lit(n_buckets))).cast("bigint")
    r = ranges.filter(F.col(hi) > F.col(lo)).withColumn("_rb", F.explode(F.sequence(
        F.floor(F.col(lo) / width).cast("bigint"),
        F.floor((F.col(hi) - 1) / width).cast("bigint"))))
    p = points.withColumn("_rb", F.floor(F.col(point) / width).cast("bigint"))
    cond = (F.col(point) >= F.col(lo)) & (F.col(point) < F.col(hi))
    return p.join(r, "_rb").filter(cond).drop("_rb")


def anti_done(requested: DataFrame, done: DataFrame, key: str = "dataset") -> DataFrame:
    """Requested items whose output does not exist yet."""
    return requested.join(done.select(key).distinct(), key, "left_anti")
