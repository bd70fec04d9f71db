"""Sort, limit, top-k and deterministic sampling: F1-F8.

Randomness is a pure function of its key: ``hash64`` (md5 of the key parts)
replaces ``random``/``torch.randint``, so every draw is reproducible,
partition-independent, resumable and the same in Spark and DuckDB. The
distribution matches the reference; the individual draws do not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.text import hash64
from quillspark.operators.ordered import running_sums
from quillspark.operators.pack import DEFAULT_CHUNK, fetch_windows, valid_starts
from quillspark.operators.joins import join_null_safe, range_lookup

HASH_SPACE = 1 << 60
#: Rows of a bucket of the hash space (about).
ROWS_PER_BUCKET = 1 << 12
TRAIN_SEED = 42
N_REDRAWS = 10


def head_n(df: DataFrame, n: int, keys=("task",), order: str = "pos") -> DataFrame:
    """the first ``min(n, len)`` rows per group in ``order``."""
    # the rank limit reaches the partial side: a task passes on n rows per group
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def seeded_shuffle(df: DataFrame, seed: int, *parts: str, out: str = "shuffle_key") -> DataFrame:
    """a seeded permutation key (sort by it to interleave datasets)."""
    return df.withColumn(out, hash64(F.lit(seed), *parts))


def hash_bucket(df: DataFrame, key: str = "shuffle_key") -> Column:
    """A bucket of the 60-bit hash ``key``, ascending with it: as many buckets
    as the rows of ``df`` ask for (a scalar subquery)."""
    n = df.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / ROWS_PER_BUCKET))).scalar()
    return F.floor(F.col(key) / F.ceil(F.lit(HASH_SPACE) / n)).cast("bigint")


def fraction_split(df: DataFrame, fraction: float, key: str = "shuffle_key") -> DataFrame:
    """F4 + G2: ``n_val = max(1, int(n * fraction))``; the first ``n_val`` rows
    in ``key`` order are val, the rest train (disjoint and exhaustive; rows
    with the last val key go to val together, so repeated rows may add some).

    The key of rank ``n_val`` decides. It is found on the keys alone, by
    counts per hash bucket and the ranks inside the one bucket that holds it;
    the rows themselves are compared with it and not shuffled.
    """
    keys = df.select(F.col(key).alias("_k"))
    n = keys.agg(F.count(F.lit(1))).scalar()
    n_val = F.greatest(F.lit(1), F.floor(n * F.lit(float(fraction))).cast("bigint"))
    bucketed = keys.withColumn("_b", hash_bucket(keys, "_k"))
    ends = bucketed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n")) \
        .withColumn("_end", F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    holding = ends.filter((F.col("_end") >= n_val) & (F.col("_end") - F.col("_n") < n_val)).select("_b", (n_val - F.col("_end") + F.col("_n")).alias("_rank"))
    ranked = bucketed.join(F.broadcast(holding), "_b").withColumn("_i", F.row_number().over(Window.partitionBy("_b").orderBy("_k")))
    last = ranked.filter("_i = _rank").agg(F.max("_k")).scalar()
    return df.withColumn("split", F.when(F.col(key) <= last, F.lit("val")).otherwise(F.lit("train")))


def step_plan(spark: SparkSession, world: int, steps: int, micro: int, batch: int,
              first_step: int = 0) -> DataFrame:
    """one row per drawn window ``rank, step, micro, slot``; a pure function
    of the coordinates, so resuming is a filter ``step >= k``."""
    n = world * steps * micro * batch
    r = spark.range(n)
    slot = F.col("id") % batch
    m = F.floor(F.col("id") / batch) % micro
    st = F.floor(F.col("id") / (batch * micro)) % steps + first_step
    rk = F.floor(F.col("id") / (batch * micro * steps))
    return r.select(rk.cast("int").alias("rank"), st.cast("bigint").alias("step"),
                    m.cast("int").alias("micro"), slot.cast("int").alias("slot"))


def _draw(seed: int, *cols) -> Column:
    return hash64(F.lit(seed), *cols)


def sample_windows(plan: DataFrame, chunks: DataFrame, lengths: DataFrame, keys,
                   block_size: int, seed: int = TRAIN_SEED,
                   chunk_size: int = DEFAULT_CHUNK, plan_rows: int | None = None) -> DataFrame:
    """F5 (+ E6, C2, C3, E10): uniform over all valid starts of all streams; a
    window never crosses a stream. ``x = s[i:i+B]``, ``y = s[i+1:i+B+1]``."""
    keys = list(keys)
    p = locate_windows(plan, lengths, keys, block_size, seed)
    w = fetch_windows(p.select(*keys, "wid", "start"), chunks, keys, "start", block_size + 1,
                      chunk_size, windows_bound=plan_rows)
    w = w.withColumn("x", F.slice("tokens", 1, block_size)) \
         .withColumn("y", F.slice("tokens", 2, block_size)).drop("tokens")
    return join_null_safe(p, w.drop("start"), keys + ["wid"])


def locate_windows(plan: DataFrame, lengths: DataFrame, keys, block_size: int, seed: int = TRAIN_SEED) -> DataFrame:
    """``rank, step, micro, slot, wid, keys.., start`` of every window of
    the plan; no token is read."""
    keys = list(keys)
    files = valid_starts(lengths, keys, block_size)
    total = files.agg(F.sum("valid")).scalar()  # scalar subquery
    checked = F.when(F.coalesce(total, F.lit(0)) > 0, total).otherwise(F.raise_error(F.lit(
        f"no stream is long enough for block_size={block_size}")))
    coords = ["rank", "step", "micro", "slot"]
    p = plan.withColumn("wid", F.concat_ws(":", *coords)) \
        .withColumn("_off", _draw(seed, *coords) % checked.cast("bigint"))
    p = range_lookup(p, files.select(*keys, "lo", "hi"), "_off", "lo", "hi")
    return p.select(*coords, "wid", *keys, (F.col("_off") - F.col("lo")).alias("start"))


def mask_directory(chunks: DataFrame, keys) -> DataFrame:
    """Rank directory of the loss masks, one row per chunk: the mask's bits in
    words of 64, the ones before each word, in the chunk (``_total``) and in
    earlier chunks (``_before``). It is made once, beside the chunks (some 1.5
    bits a token); a lookup reads one row of it and no mask."""
    keys = list(keys)
    word = lambda a: F.aggregate(F.transform(F.slice("mask", a + 1, F.lit(64)), _bit), F.lit(0).cast("bigint"),
                                 lambda w, x: w.bitwiseOR(x))
    starts = F.when(F.size("mask") > 0, F.sequence(F.lit(0), F.size("mask") - 1, F.lit(64))).otherwise(F.array().cast("array<int>"))
    t = chunks.select(*keys, "chunk_id", F.size("mask").alias("_size"), F.transform(starts, word).alias("_words"))
    up_to = F.aggregate("_words", F.array(F.lit(0)), lambda acc, w: F.concat(acc, F.array(F.element_at(acc, -1) + F.bit_count(w))))
    t = t.withColumn("_ones", up_to).withColumn("_total", F.element_at("_ones", -1).cast("bigint"))
    t = running_sums(t, keys, "chunk_id", {"_cum": F.col("_total")})
    return t.select(*keys, "chunk_id", "_size", "_words", "_ones", "_total", (F.col("_cum") - F.col("_total")).alias("_before"))


def _bit(x: Column, i: Column) -> Column:
    """Mask value ``x`` as bit ``i`` of a word."""
    return F.when(x != 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))


def mask_ones_at(points: DataFrame, directory: DataFrame, keys, pos: str, chunk_size: int = DEFAULT_CHUNK) -> DataFrame:
    """``<pos>_ones``: mask ones strictly before stream position ``pos`` (at
    most the stream's length), from one directory row each."""
    # the end of a stream is the end of its last chunk
    cid = F.floor(F.greatest(F.col(pos) - 1, F.lit(0)) / chunk_size).cast("bigint")
    p = points.withColumn("chunk_id", cid).withColumn("_in", (F.col(pos) - cid * chunk_size).cast("int"))
    p = join_null_safe(p, directory, [*keys, "chunk_id"], "left")
    place = F.floor(F.col("_in") / 64).cast("int")
    below = F.get("_words", place).bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("bigint"), (F.col("_in") % 64).cast("int"))))
    inside = F.when(F.col("_in") >= F.col("_size"), F.col("_total")).otherwise(F.get("_ones", place) + F.bit_count(below))
    return p.withColumn(f"{pos}_ones", F.col("_before") + inside).drop("chunk_id", "_in", "_size", "_words", "_ones", "_total", "_before")


def sample_windows_masked(plan: DataFrame, chunks: DataFrame, stream: dict, block_size: int,
                          seed: int = TRAIN_SEED, chunk_size: int = DEFAULT_CHUNK,
                          plan_rows: int | None = None, directory: DataFrame | None = None) -> DataFrame:
    """as F5 on one masked stream (``stream`` = its key values, e.g.
    ``{"split": "train"}``), with up to 10 redraws while the window has no
    trainable target. Trainable counts come from the rank ``directory`` of
    the masks (made here if not given), so candidates are checked without
    reading tokens or masks. After 10 failed
    redraws the 11th candidate is kept, fully masked, and flagged (as the
    reference does)."""
    keys = list(stream)
    sel = F.lit(True)
    for k, v in stream.items():
        sel = sel & F.col(k).eqNullSafe(F.lit(v))
    ch = chunks.filter(sel)
    n = F.col("n_tokens") if "n_tokens" in ch.columns else F.size("tokens")
    total_tokens = ch.agg(F.sum(n)).scalar()  # scalar subquery
    n_valid = F.when(F.coalesce(total_tokens, F.lit(0)) - block_size > 0,
                     total_tokens - block_size).otherwise(F.raise_error(F.lit(
                         f"stream too small for block_size={block_size}"))).cast("bigint")
    coords = ["rank", "step", "micro", "slot"]
    cand = plan.withColumn("wid", F.concat_ws(":", *coords)).withColumn(
        "cand", F.explode(F.sequence(F.lit(0), F.lit(N_REDRAWS))))
    for k, v in stream.items():
        cand = cand.withColumn(k, F.lit(v))
    cand = cand.withColumn("i", _draw(seed, *coords, "cand") % F.lit(n_valid))
    cand = cand.withColumn("a", F.col("i") + 1).withColumn("b", F.col("i") + block_size + 1)
    ranks = mask_directory(ch, keys) if directory is None else directory.filter(sel)
    cand = mask_ones_at(cand, ranks, keys, "a", chunk_size)
    cand = mask_ones_at(cand, ranks, keys, "b", chunk_size)
    cand = cand.withColumn("trainable", F.col("b_ones") - F.col("a_ones"))
    first_ok = cand.filter((F.col("trainable") > 0) & (F.col("cand") < N_REDRAWS)) \
        .groupBy("wid").agg(F.min("cand").alias("_k"))
    pick = cand.join(first_ok, "wid", "left").filter(
        F.col("cand") == F.coalesce(F.col("_k"), F.lit(N_REDRAWS)))
    pick = pick.withColumn("fully_masked", F.col("_k").isNull())
    w = fetch_windows(pick.select(*keys, "wid", F.col("i").alias("start")), ch, keys,
                      "start", block_size + 1, chunk_size, cols=("tokens", "mask"),
                      windows_bound=plan_rows)
    w = w.select("wid", F.slice("tokens", 1, block_size).alias("x"),
                 F.slice("tokens", 2, block_size).alias("_y"),
                 F.slice("mask", 2, block_size).alias("_m"))
    out = pick.select(*coords, "wid", *keys, F.col("i").alias("start"), "fully_masked",
                      "trainable").join(w, "wid")
    y = F.when(F.col("fully_masked"), F.transform("_y", lambda t: F.lit(-1))).otherwise(
        F.zip_with("_y", "_m", lambda t, m: F.when(m == 0, F.lit(-1)).otherwise(t)))
    return out.withColumn("y", y).drop("_y", "_m")


def sample_segments(lengths: DataFrame, keys, n_samples: int, seg_len: int,
                    seed: int = TRAIN_SEED, total: str = "total_tokens") -> DataFrame:
    """F8: ``n_samples`` segments per stream, start uniform in
    ``[0, total - seg_len]`` inclusive; streams shorter than ``seg_len`` are
    skipped. Returns ``keys.., sample, start``."""
    keys = list(keys)
    d = lengths.filter(F.col(total) >= seg_len).withColumn(
        "sample", F.explode(F.sequence(F.lit(1), F.lit(n_samples))))
    span = F.col(total) - seg_len + 1
    return d.select(*keys, "sample", (_draw(seed, *keys, "sample") % span).alias("start"))
