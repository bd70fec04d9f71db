"""Packed token streams with one exchange of ids: E3, E5, H9, A10.

Documents keep their place in a stream through buckets of the order column
(``ordered``): narrow counts per bucket give every bucket its offset in the
stream. The id arrays are dealt to tasks once, by ranges of buckets, each
bucket behind a row with its offset; a task cuts its sorted buckets into
chunks as they pass (``mapInArrow``; it holds some chunks and a batch, never a
bucket). Only the ends of buckets, pieces of chunks that two buckets share,
are put together by a second, small exchange.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import StructField, StructType

from quillspark.operators.ordered import DEFAULT_BUCKET_WIDTH, bucket_of, key_of
from quillspark.session import map_arrow, materialize

DEFAULT_CHUNK = 1 << 16


def _bases(narrow: DataFrame, val_every: int | None) -> DataFrame:
    """One row per bucket: ``_docs`` in it, and what comes before it:
    documents ``_d0`` and tokens ``_t0`` (with a split by document number also
    ``_v0`` of the val stream, ``_t0`` being the train stream's)."""
    before = Window.partitionBy("_key").orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)

    def sums(t: DataFrame, **cols) -> DataFrame:
        return t.select("*", *[F.coalesce(F.sum(c).over(before), F.lit(0)).cast("bigint").alias(k) for k, c in cols.items()])

    if val_every is None:
        t = narrow.groupBy("_key", "_bk").agg(F.count("*").alias("_docs"), F.sum("_n").alias("_t"))
        return sums(t, _d0="_docs", _t0="_t").select("_key", "_bk", "_docs", "_d0", "_t0", F.lit(0).cast("bigint").alias("_v0"))
    first = sums(narrow.groupBy("_key", "_bk").agg(F.count("*").alias("_docs")), _d0="_docs")
    inside = Window.partitionBy("_key", "_bk").orderBy("_order", "_n")  # the cutter's order, in all that counts
    numbered = narrow.join(first, ["_key", "_bk"]).withColumn("_i", F.col("_d0") + F.row_number().over(inside) - 1)
    val = (F.col("_i") % val_every) == 0
    t = numbered.groupBy("_key", "_bk", "_docs", "_d0").agg(
        F.sum(F.when(val, 0).otherwise(F.col("_n"))).alias("_t"), F.sum(F.when(val, F.col("_n")).otherwise(0)).alias("_v"))
    return sums(t, _t0="_t", _v0="_v").select("_key", "_bk", "_docs", "_d0", "_t0", "_v0")


def _cutter(n_keys: int, n_cols: int, chunk_size: int, val_every: int | None, target):
    """Cuts sorted rows ``keys.., _bk, _docs, _d0, _t0, _v0, cols..`` (a bucket's
    first row has its bases, the others have none) into rows ``keys.., _val,
    chunk_id, _at, _whole, cols..``."""
    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        out: list[list] = [[] for _ in range(n_keys + 4 + n_cols)]

        class Stream:
            """The tokens of one bucket and split that are not cut yet, from position ``at`` on."""

            def __init__(self, keys, is_val, at):
                self.keys, self.is_val, self.at, self.parts, self.held = keys, is_val, at, [], 0

            def add(self, arrays):
                self.parts.append([x.copy() for x in arrays])  # a view would keep its whole batch
                self.held += len(arrays[0])
                if self.held >= 4 * chunk_size:
                    self.cut(False)

            def cut(self, last):
                if not self.held:
                    return
                joined = [np.concatenate([p[c] for p in self.parts]) for c in range(n_cols)]
                a = 0
                while a < self.held:
                    size = min(chunk_size - (self.at + a) % chunk_size, self.held - a)
                    complete = (self.at + a + size) % chunk_size == 0
                    if not (last or complete):
                        break
                    row = [*self.keys, self.is_val, (self.at + a) // chunk_size, (self.at + a) % chunk_size, size == chunk_size,
                           *[x[a:a + size] for x in joined]]
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    a += size
                self.parts, self.at, self.held = [[x[a:] for x in joined]], self.at + a, self.held - a

        def flush():
            if out[0]:
                arrays = []
                for field, column in zip(target, out, strict=True):
                    if pa.types.is_list(field.type):
                        flat = np.concatenate(column)
                        offs = np.append(0, np.cumsum([len(x) for x in column]))
                        arrays.append(pa.ListArray.from_arrays(pa.array(offs, pa.int32()), pa.array(flat, field.type.value_type)).cast(field.type))
                    else:
                        arrays.append(pa.array(column, field.type))
                    column.clear()
                yield pa.RecordBatch.from_arrays(arrays, schema=target)

        bucket, streams, docs, before, number = None, [], 0, 0, 0

        def close():
            if number != docs:
                raise ValueError(f"bucket {bucket} came with {number} of {docs} documents")
            for s in streams:
                s.cut(True)

        for b in batches:
            keys = [b.column(k).to_pylist() for k in range(n_keys + 1)]
            bases = [b.column(n_keys + 1 + k).to_pylist() for k in range(4)]
            lists = [b.column(n_keys + 5 + c) for c in range(n_cols)]
            offs = [x.offsets.to_numpy() for x in lists]
            values = [x.values.to_numpy(zero_copy_only=False) for x in lists]
            for r in range(len(b)):
                own = tuple(k[r] for k in keys)
                if bases[0][r] is not None:
                    close()
                    bucket, docs, before, number = own, bases[0][r], bases[1][r], 0
                    streams = [Stream(own[:-1], False, bases[2][r]), Stream(own[:-1], True, bases[3][r])]
                    continue
                if own != bucket:
                    raise ValueError(f"a document of bucket {own} came in {bucket}")
                is_val = val_every is not None and (before + number) % val_every == 0
                number += 1
                arrays = [v[o[r]:o[r + 1]] for v, o in zip(values, offs, strict=True)]
                if len(arrays[0]):
                    streams[is_val].add(arrays)
                if len(out[0]) >= 64:
                    yield from flush()
        close()
        yield from flush()
    return run


def cut_streams(docs: DataFrame, keys, order: str, cols=("ids",), chunk_size: int = DEFAULT_CHUNK, names=("tokens",), n_tokens: str | None = None,
                bucket: Column | None = None, bucket_width: int = DEFAULT_BUCKET_WIDTH, val_every: int | None = None) -> DataFrame:
    """Chunk table ``keys..[, split], chunk_id, names.., n_tokens`` of the
    streams ``keys`` in ``order``. ``docs`` should be a stage (it is read
    twice, once without the arrays ``cols``). ``n_tokens`` names its column of
    lengths, if it has one. ``bucket``: another bucket of the order column
    than ``order div bucket_width``. With ``val_every`` every so-manieth
    document of a stream, from the first on, goes to the ``val`` split of it
    and the others to ``train`` (E3).

    Null keys make a stream like any other; equal places of the order column
    come in any order; documents without tokens are counted and give nothing.
    """
    spark = docs.sparkSession
    keys, cols, names = list(keys), list(cols), list(names)
    n = F.col(n_tokens) if n_tokens else F.coalesce(F.size(cols[0]), F.lit(0))
    d = docs.withColumn("_key", key_of(keys)).withColumn("_bk", (bucket if bucket is not None else bucket_of(order, bucket_width)).cast("bigint"))
    bases = _bases(d.select("_key", "_bk", F.col(order).alias("_order"), n.cast("bigint").alias("_n")), val_every)
    bases = materialize(bases, "stream-bases")
    # a bucket's bases travel with its documents in the one exchange of ids. Its
    # number of tasks is given, so that Spark tears no bucket apart to even out sizes
    base = ["_docs", "_d0", "_t0", "_v0"]
    nothing = {c: F.array().cast(docs.schema[c].dataType) for c in cols}
    rows = d.select(*keys, "_key", "_bk", F.lit(1).alias("_row"), F.col(order).alias("_order"), n.cast("bigint").alias("_n"), *[F.lit(None).cast("bigint").alias(c) for c in base],
                    *[F.coalesce(c, nothing[c]).alias(c) for c in cols])
    heads = bases.select(*[F.col("_key")[k].alias(k) for k in keys], "_key", "_bk", F.lit(0).alias("_row"),
                         F.lit(None).cast(docs.schema[order].dataType).alias("_order"), F.lit(0).cast("bigint").alias("_n"), *base, *[nothing[c].alias(c) for c in cols])
    ready = rows.unionByName(heads).repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "_key", "_bk") \
        .sortWithinPartitions("_key", "_bk", "_row", "_order", "_n").select(*keys, "_bk", *base, *cols)
    from pyspark.sql.pandas.types import to_arrow_schema
    head = StructType([docs.schema[k] for k in keys])
    schema = StructType([*head.fields, *StructType.fromDDL("_val boolean, chunk_id bigint, _at int, _whole boolean").fields,
                         *[StructField(nm, docs.schema[c].dataType) for nm, c in zip(names, cols, strict=True)]])
    pieces = map_arrow(ready, _cutter(len(keys), len(cols), chunk_size, val_every, to_arrow_schema(schema)), schema)
    pieces = materialize(pieces, "stream-pieces")
    stream = [*keys, "_val"]
    # at most two pieces of a bucket and split are parts of a chunk, and a chunk has at most as many pieces as tokens
    place = [*stream, "chunk_id"]
    joined = pieces.filter(~F.col("_whole")).groupBy(*stream, "chunk_id").agg(F.array_sort(F.collect_list(F.struct("_at", *names))).alias("_ps"))
    field = lambda nm: lambda p: p[nm]
    parts = joined.select(*place, *[F.flatten(F.transform("_ps", field(nm))).alias(nm) for nm in names]) \
        .repartitionByRange(*place).sortWithinPartitions(*place)
    out = pieces.filter("_whole").select(*stream, "chunk_id", *names).unionByName(parts)
    if val_every is not None:
        out = out.withColumn("split", F.when(F.col("_val"), F.lit("val")).otherwise(F.lit("train")))
    return out.select(*keys, *(["split"] if val_every is not None else []), "chunk_id", *names, F.size(names[0]).cast("int").alias("n_tokens"))
