"""Token streams as chunk tables: E5, H9, A13, C3, C4, E6, B11.

A packed stream (one per ``keys``, e.g. ``dataset, split``) is stored as rows
``keys.., chunk_id, tokens array<int>[, mask array<tinyint>]`` of ``C`` tokens
each (token position ``p`` lives in chunk ``p div C``). Building it cuts every
document into at most a few pieces and shuffles by ``(keys, chunk_id)`` —
no per-token explode. A window ``[s, s+len)`` is fetched by exploding the
(1-2) chunk ids it touches, an equi-join, an ordered ``flatten`` and a
``slice``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.joins import BROADCAST_MAX_ROWS, join_null_safe
from quillspark.operators.ordered import DEFAULT_BUCKET_WIDTH, running_sums

DEFAULT_CHUNK = 1 << 16


def _field(name: str):
    """One-argument lambda (``transform`` reads a two-argument lambda as
    element + index)."""
    return lambda s: s[name]


def stream_offsets(df: DataFrame, keys, order: str, length: Column | str = "n_tokens",
                   out: str = "start", bucket_width: int = DEFAULT_BUCKET_WIDTH) -> DataFrame:
    """E5: start of each document in its packed stream (exclusive running sum)."""
    n = F.col(length) if isinstance(length, str) else length
    d = df.withColumn("_len", n.cast("bigint"))
    d = running_sums(d, list(keys), order, {"_end": F.col("_len")}, bucket_width)
    return d.withColumn(out, F.col("_end") - F.col("_len")).drop("_end", "_len")


def chunk_table(docs: DataFrame, keys, start: str = "start", cols=("ids",),
                chunk_size: int = DEFAULT_CHUNK, names=None) -> DataFrame:
    """H9: rebuild the packed stream as fixed-size chunks.

    ``docs`` has ``keys``, ``start`` and the array columns ``cols`` (equal
    length per row, e.g. ids and mask; C4 keeps them in one row so they can
    not drift apart). Output columns are ``names`` (default: ``tokens`` and
    ``mask`` for two columns, else the input names).
    """
    keys, cols = list(keys), list(cols)
    names = names or (["tokens", "mask"][:len(cols)] if len(cols) <= 2 else cols)
    C = F.lit(chunk_size).cast("bigint")
    n = F.size(cols[0]).cast("bigint")
    d = docs.filter(n >= 1).select(*keys, F.col(start).alias("_s"), *cols)
    d = d.withColumn("chunk_id", F.explode(F.sequence(
        F.floor(F.col("_s") / C), F.floor((F.col("_s") + F.size(cols[0]) - 1) / C))))
    lo = F.greatest(F.col("chunk_id") * C - F.col("_s"), F.lit(0))
    hi = F.least((F.col("chunk_id") + 1) * C - F.col("_s"), F.size(cols[0]).cast("bigint"))
    piece = F.struct(F.col("_s").alias("s"), *[
        F.slice(c, (lo + 1).cast("int"), (hi - lo).cast("int")).alias(f"p{i}")
        for i, c in enumerate(cols)])
    g = d.select(*keys, "chunk_id", piece.alias("_piece")).groupBy(*keys, "chunk_id").agg(
        F.array_sort(F.collect_list("_piece")).alias("_ps"))
    out = g.select(*keys, "chunk_id", *[
        F.flatten(F.transform("_ps", _field(f"p{i}"))).alias(nm)
        for i, nm in enumerate(names)])
    # The length as its own column: stream totals then read 4 bytes per
    # chunk instead of the token arrays.
    return out.withColumn("n_tokens", F.size(names[0]).cast("int"))


def stream_lengths(chunks: DataFrame, keys, tokens: str = "tokens",
                   mask: str | None = None) -> DataFrame:
    """Total tokens per stream (and trainable tokens); asserts that tokens
    and mask have equal length in every chunk."""
    n = F.col("n_tokens") if "n_tokens" in chunks.columns else F.size(tokens)
    aggs = [F.sum(n).cast("bigint").alias("total_tokens"),
            F.count(F.lit(1)).cast("bigint").alias("n_chunks")]
    if mask:
        aggs.append(F.sum(F.aggregate(mask, F.lit(0).cast("bigint"), lambda a, x: a + x))
                    .cast("bigint").alias("trainable_tokens"))
        aggs.append(F.min(F.assert_true(F.size(tokens) == F.size(mask),
                                        F.lit("tokens/mask length mismatch")))
                    .alias("_ok"))
    out = chunks.groupBy(*keys).agg(*aggs)
    return out.drop("_ok") if mask else out


def valid_starts(lengths: DataFrame, keys, block_size: int,
                 total: str = "total_tokens") -> DataFrame:
    """Per stream ``valid = max(len - block, 0)``, and its running range
    ``[lo, hi)`` over streams in ``keys`` order (one row per stream)."""
    from pyspark.sql import Window
    keys = list(keys)
    w = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = lengths.withColumn("valid", F.greatest(F.col(total) - block_size, F.lit(0)))
    d = d.withColumn("hi", F.sum("valid").over(w)).withColumn("lo", F.col("hi") - F.col("valid"))
    return d


def fetch_windows(windows: DataFrame, chunks: DataFrame, keys, start: str, length: int,
                  chunk_size: int = DEFAULT_CHUNK, cols=("tokens",), wid: str = "wid",
                  windows_bound: int | None = None,
                  max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Slice ``[start, start+length)`` of each window's stream.

    ``windows``: ``keys.., wid, start``; returns ``wid, <cols>`` sliced. When
    the caller knows a bound on the number of windows (a step plan has
    ``world*steps*micro*batch`` rows) and it is at most ``max_rows``, the
    window side (bound x chunks per window rows) is broadcast and the chunk
    table is scanned once without a shuffle; otherwise the join is left to
    the planner and AQE.
    """
    keys, cols = list(keys), list(cols)
    C = F.lit(chunk_size).cast("bigint")
    w = windows.select(*keys, wid, F.col(start).alias("_ws"))
    w = w.withColumn("chunk_id", F.explode(F.sequence(
        F.floor(F.col("_ws") / C), F.floor((F.col("_ws") + length - 1) / C))))
    per_window = 1 + -(-length // chunk_size)
    ch = chunks.select(*keys, "chunk_id", *cols)
    if windows_bound is not None and windows_bound * per_window <= max_rows:
        # The chunk ids a bounded plan touches (at most bound x per_window
        # values), with their streams, become a literal filter that reaches the Parquet scan:
        # row groups of a chunk table clustered by chunk id are skipped, so
        # fetching windows does not read the whole stream.
        need = w.groupBy(*keys).agg(F.collect_set("chunk_id").alias("_ids")).collect()
        some = F.lit(False)
        for r in need:
            own = F.col("chunk_id").isin(r["_ids"])
            for k in keys:
                own = own & F.col(k).eqNullSafe(F.lit(r[k]))
            some = some | own
        ch = ch.filter(some)
        w = F.broadcast(w)
    j = join_null_safe(w, ch, keys + ["chunk_id"])
    g = j.groupBy(*keys, wid, "_ws").agg(F.array_sort(F.collect_list(
        F.struct("chunk_id", *cols))).alias("_cs"))
    first = F.col("_cs")[0]["chunk_id"]
    off = (F.col("_ws") - first * C + 1).cast("int")
    return g.select(*keys, wid, F.col("_ws").alias(start), *[
        F.slice(F.flatten(F.transform("_cs", _field(c))), off, F.lit(length))
        .alias(c) for c in cols])


def verify_stream(chunks: DataFrame, keys, vocab_size: int, n_check: int | None = None,
                  chunk_size: int = DEFAULT_CHUNK, tokens: str = "tokens") -> DataFrame:
    """Per stream ``ok`` = non-empty and all ids (with ``n_check`` the
    first so many) are ``< vocab_size + 1000`` (every stream, train and val)."""
    lim = vocab_size + 1000
    if n_check is None:
        bad = F.size(F.filter(tokens, lambda t: t >= lim))
        return chunks.groupBy(*keys).agg(
            ((F.sum(F.size(tokens)) > 0) & (F.sum(bad) == 0)).alias("ok"))
    rem = F.greatest(F.least(F.lit(n_check) - F.col("chunk_id") * chunk_size,
                             F.size(tokens).cast("bigint")), F.lit(0)).cast("int")
    head = F.slice(tokens, 1, rem)
    bad = F.size(F.filter(head, lambda t: t >= lim))
    return chunks.groupBy(*keys).agg(
        (F.sum(F.size(tokens)) > 0).alias("_nonempty"),
        F.sum(F.when(rem > 0, bad).otherwise(0)).alias("_bad")).select(
        *keys, (F.col("_nonempty") & (F.col("_bad") == 0)).alias("ok"))
