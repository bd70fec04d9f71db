"""Ordered running state without a whole-dataset window.

A window ``partitionBy(dataset).orderBy(pos)`` runs one dataset in one task;
the largest source may hold a third of the corpus. Instead:

1. bucket every row by ``pos div width`` (at most ``width`` rows per bucket
   because ``pos`` is unique within a dataset, so no bucket can be hot);
2. sum the value per ``(keys, bucket)`` (partial aggregation, tiny output);
3. exclusive running sum over the bucket table (one row per bucket);
4. optionally drop buckets whose starting offset already passes a limit;
5. a window inside ``(keys, bucket)`` only, plus the bucket offset.

The join in step 5 and the window share the ``(keys, bucket)`` hash
distribution, so the big side is shuffled exactly once; AQE turns the join
into a broadcast when the bucket table is measured small.

The keys travel as one struct, which equals another with the same nulls, so
rows with null keys form a group like any other (as in a plain window). Rows
whose order value is null come first, in one bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows per bucket at most; with rows of some KB a bucket stays at some MB.
DEFAULT_BUCKET_WIDTH = 1 << 12


def _as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _order_cols(order) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def bucket_of(order, bucket_width: int) -> Column:
    """Bucket of the first order column (timestamps bucket by microseconds)."""
    first = _order_cols(order)[0]
    return F.coalesce(F.expr(f"`{first}` div {int(bucket_width)}").cast("bigint"), F.lit(-(1 << 62)))


def key_of(keys: Sequence[str]) -> Column:
    """All keys as one value that is never null (and so joins null keys too)."""
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0))


def running_sums(df: DataFrame, keys: Sequence[str], order: str, values: dict,
                 bucket_width: int = DEFAULT_BUCKET_WIDTH,
                 limits: dict | None = None, bucket: str | None = None) -> DataFrame:
    """Add one inclusive running sum per ``values`` entry (``out -> Column``)
    per ``keys`` in ``order`` — all of them in one two-phase pass.

    ``order`` (a column or a list; buckets come from the first one) must be
    unique within ``keys``. ``limits`` (``out -> int``) drops
    the buckets whose exclusive offset for ``out`` already exceeds the limit:
    with non-negative values no row there can satisfy ``out <= limit``.
    ``bucket`` names a column that holds the buckets already (ascending in
    ``order``), for instance the partitions of a range partitioning.
    """
    keys = list(keys)
    vals = {k: _as_col(v).cast("bigint") for k, v in values.items()}
    tmp = {k: f"_v_{i}" for i, k in enumerate(vals)}
    own = F.col(bucket).cast("bigint") if bucket else bucket_of(order, bucket_width)
    d = df.withColumn("_bk", own).withColumn("_key", key_of(keys))
    for k, v in vals.items():
        d = d.withColumn(tmp[k], v)
    sums = d.groupBy("_key", "_bk").agg(*[F.sum(tmp[k]).alias(f"_s_{tmp[k]}") for k in vals])
    w = Window.partitionBy("_key").orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offs = sums.select("_key", "_bk", *[
        F.coalesce(F.sum(f"_s_{tmp[k]}").over(w), F.lit(0)).cast("bigint").alias(f"_o_{tmp[k]}")
        for k in vals])
    for k, lim in (limits or {}).items():
        offs = offs.filter(F.col(f"_o_{tmp[k]}") <= F.lit(lim))
    d = d.join(offs, ["_key", "_bk"], "inner")
    wl = (Window.partitionBy("_key", "_bk").orderBy(*_order_cols(order))
          .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    for k in vals:
        d = d.withColumn(k, (F.sum(tmp[k]).over(wl) + F.col(f"_o_{tmp[k]}")).cast("bigint"))
    return d.drop("_bk", "_key", *tmp.values(), *[f"_o_{t}" for t in tmp.values()])


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value, out: str = "cum",
                bucket_width: int = DEFAULT_BUCKET_WIDTH,
                max_offset: int | None = None) -> DataFrame:
    """Add ``out`` = inclusive running sum of ``value`` per ``keys`` in ``order``."""
    return running_sums(df, keys, order, {out: value}, bucket_width,
                        None if max_offset is None else {out: max_offset})


def running_count(df: DataFrame, keys: Sequence[str], order: str, out: str = "rn",
                  bucket_width: int = DEFAULT_BUCKET_WIDTH, where=None) -> DataFrame:
    """1-based row number per ``keys`` in ``order`` (counting only rows where
    ``where`` holds, if given); two-phase like :func:`running_sums`."""
    v = F.lit(1) if where is None else F.when(_as_col(where), 1).otherwise(0)
    return running_sum(df, keys, order, v, out=out, bucket_width=bucket_width)


def range_buckets(df: DataFrame, order: Sequence[str], rows_per_bucket: int = 1 << 16) -> DataFrame:
    """``df`` as a stage with ``_part``, the range partition of ``order`` that
    a row is in: buckets of about ``rows_per_bucket`` rows, however the values
    are spread."""
    from quillspark.session import materialize
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), df.count() // rows_per_bucket + 1)
    return materialize(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "range-buckets")


def running_min(df: DataFrame, keys: Sequence[str], order, value, out: str = "prev_min",
                bucket_width: int = DEFAULT_BUCKET_WIDTH, bucket: str | None = None) -> DataFrame:
    """``out`` = min of ``value`` over the rows *before* each row, per
    ``keys`` in ``order`` (null for the first row); two-phase like
    :func:`running_sums` (bucket minima, exclusive running min over the
    bucket table, then a window inside each bucket)."""
    keys = list(keys)
    own = F.col(bucket).cast("bigint") if bucket else bucket_of(order, bucket_width)
    d = df.withColumn("_bk", own).withColumn("_mv", _as_col(value)) \
        .withColumn("_key", key_of(keys))
    mins = d.groupBy("_key", "_bk").agg(F.min("_mv").alias("_bmin"))
    w = Window.partitionBy("_key").orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)
    offs = mins.select("_key", "_bk", F.min("_bmin").over(w).alias("_omin"))
    d = d.join(offs, ["_key", "_bk"], "inner")
    wl = (Window.partitionBy("_key", "_bk").orderBy(*_order_cols(order))
          .rowsBetween(Window.unboundedPreceding, -1))
    local = F.min("_mv").over(wl)
    both = F.when(local.isNull(), F.col("_omin")).when(F.col("_omin").isNull(), local) \
        .otherwise(F.least(local, F.col("_omin")))
    return d.withColumn(out, both).drop("_bk", "_mv", "_omin", "_key")


def previous(df: DataFrame, keys: Sequence[str], order: str, value, out: str = "prev",
             bucket_width: int = DEFAULT_BUCKET_WIDTH, bucket: str | None = None) -> DataFrame:
    """``out`` = ``value`` of the row before, per ``keys`` in ``order`` (null
    for the first row): a lag inside each bucket, and for the first row of a
    bucket the last value of the bucket before."""
    own = F.col(bucket).cast("bigint") if bucket else bucket_of(order, bucket_width)
    d = df.withColumn("_bk", own).withColumn("_pv", _as_col(value)).withColumn("_key", key_of(keys))
    last = d.groupBy("_key", "_bk").agg(F.max_by("_pv", F.struct(*_order_cols(order))).alias("_last"))
    w = Window.partitionBy("_key").orderBy("_bk")
    offs = last.select("_key", "_bk", F.lag("_last").over(w).alias("_before"))
    d = d.join(offs, ["_key", "_bk"], "inner")
    wl = Window.partitionBy("_key", "_bk").orderBy(*_order_cols(order))
    d = d.withColumn("_rn", F.row_number().over(wl)).withColumn("_own", F.lag("_pv").over(wl))
    return d.withColumn(out, F.when(F.col("_rn") == 1, F.col("_before")).otherwise(F.col("_own"))) \
        .drop("_bk", "_key", "_pv", "_before", "_rn", "_own")
