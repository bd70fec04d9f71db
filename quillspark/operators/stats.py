"""Stream and run statistics: D4, D11, D13, D14, D16, D17, E8, E9."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.operators.encode import EOS_ID, UNK_ID


def mean_of_ratios(df: DataFrame, keys, num: str, den: str, out: str = "mean_ratio") -> DataFrame:
    """Mean over rows of ``num/den`` (not the ratio of sums, D3)."""
    return df.groupBy(*keys).agg(F.avg(F.try_divide(F.col(num).cast("double"),
                                                    F.col(den).cast("double"))).alias(out))


def segment_metrics(segments: DataFrame, vocab_size: int, tokens: str = "tokens",
                    text: str = "text") -> DataFrame:
    """D11 per segment: EOS, UNK, ids >= vocab, U+FFFD count, chars/token."""
    t = F.col(tokens)
    return segments.select(
        "*",
        F.size(F.filter(t, lambda x: x == EOS_ID)).cast("bigint").alias("eos"),
        F.size(F.filter(t, lambda x: x == UNK_ID)).cast("bigint").alias("unk"),
        F.size(F.filter(t, lambda x: x >= vocab_size)).cast("bigint").alias("oov"),
        (F.length(text) - F.length(F.regexp_replace(text, "�", ""))).cast("bigint")
        .alias("replacement_chars"),
        (F.length(text) / F.size(t)).alias("chars_per_token"))


def segment_quality(metrics: DataFrame, keys=("dataset", "split")) -> DataFrame:
    """D11 summary per stream: mean chars/token and EOS, totals of the rest."""
    return metrics.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("bigint").alias("samples"),
        F.avg("chars_per_token").alias("mean_chars_per_token"),
        F.avg("eos").alias("mean_eos"),
        F.sum("unk").cast("bigint").alias("unk_total"),
        F.sum("oov").cast("bigint").alias("oov_total"),
        F.sum("replacement_chars").cast("bigint").alias("replacement_total"))


def samples_per_dataset(samples: DataFrame, keys=("dataset", "split")) -> DataFrame:
    """Number of samples per (dataset, split), name-ordered."""
    return samples.groupBy(*keys).agg(F.count(F.lit(1)).cast("bigint").alias("samples")) \
        .orderBy(*keys)


def tokenizer_compare(df: DataFrame) -> DataFrame:
    """Per ``tokenizer, text_type`` chars, tokens, chars/token; plus one
    overall row per tokenizer (``text_type = 'ALL'``) = mean of the per-type
    ratios (D4). Input: ``tokenizer, text_type, n_chars, n_tokens``."""
    per = df.groupBy("tokenizer", "text_type").agg(
        F.sum("n_chars").cast("bigint").alias("chars"),
        F.sum("n_tokens").cast("bigint").alias("tokens"))
    per = per.withColumn("chars_per_token", F.try_divide(F.col("chars").cast("double"),
                                                         F.col("tokens").cast("double")))
    overall = per.groupBy("tokenizer").agg(
        F.sum("chars").cast("bigint").alias("chars"),
        F.sum("tokens").cast("bigint").alias("tokens"),
        F.avg("chars_per_token").alias("chars_per_token")).withColumn("text_type", F.lit("ALL"))
    return per.unionByName(overall)


def steps_for_epochs_col(tokens_col, epochs: float, batch: int, accum: int, block: int = 2048,
                         world: int = 1):
    """``max(1, ceil(epochs*tokens/(b*a*w*block)))``."""
    per_step = batch * accum * world * block
    return F.greatest(F.lit(1), F.ceil(F.col(tokens_col) * F.lit(float(epochs)) / F.lit(per_step))) \
        .cast("bigint")


def steps_for_tokens_col(tokens_col, batch: int, accum: int, block: int = 2048, world: int = 1):
    """D16, floor variant for a token target."""
    return F.floor(F.col(tokens_col) / F.lit(batch * accum * world * block)).cast("bigint")


def run_metrics(events: DataFrame, rows_per_bucket: int = 1 << 16) -> DataFrame:
    """Map ``events`` onto run metrics: run = ``event_type``, loss = ``value``,
    step = 1-based order by ``(ts, event_id)`` per run.

    Rows are range-partitioned by ``(run, ts, event_id)``, a partition is a
    bucket of the two-phase running count, and the result is a stage: however
    many events fall into one run and hour, they spread over partitions of
    about ``rows_per_bucket`` rows."""
    from quillspark.operators.ordered import range_buckets, running_sums
    from quillspark.session import materialize
    d = events.select(F.col("event_type").alias("run"), "ts", "event_id",
                      F.unix_micros(F.col("ts").cast("timestamp")).alias("_us"), F.col("value").alias("loss"))
    d = range_buckets(d, ["run", "_us", "event_id"], rows_per_bucket)
    d = running_sums(d, ["run"], ["_us", "event_id"], {"step": F.lit(1)}, bucket="_part")
    return materialize(d.drop("_us", "_part"), "run-metrics")


def best_so_far(metrics: DataFrame, keys=("run",), order: str = "step",
                loss: str = "loss", bucket_width: int = 1 << 16) -> DataFrame:
    """Running min of the loss before each row (two-phase); ``improved``
    flags strict improvements (the first row always improves)."""
    from quillspark.operators.ordered import running_min
    d = running_min(metrics, list(keys), order, F.col(loss), "prev_best", bucket_width)
    return d.withColumn("improved", F.col("prev_best").isNull() | (F.col(loss) < F.col("prev_best")))


def every_n_steps(metrics: DataFrame, n: int, step: str = "step") -> DataFrame:
    """Rows at ``step % n == 0`` (log / eval / save intervals)."""
    return metrics.filter(F.col(step) % n == 0)


def interval_means(metrics: DataFrame, n: int, keys=("run",), step: str = "step",
                   loss: str = "loss") -> DataFrame:
    """E9 grouping: mean loss per interval ``(step-1) div n``."""
    return metrics.groupBy(*keys, F.floor((F.col(step) - 1) / n).cast("bigint").alias("interval")) \
        .agg(F.avg(loss).alias("mean_loss"), F.count(F.lit(1)).cast("bigint").alias("rows"))


def throughput(metrics: DataFrame, tokens_per_step: int, keys=("run",), step: str = "step",
               ts: str = "ts", log_every: int = 1) -> DataFrame:
    """Tokens in a log interval of ``log_every`` steps / seconds since the
    previous log row (the interval after an evaluation includes that time)."""
    from quillspark.operators.ordered import previous
    d = every_n_steps(metrics, log_every, step)
    d = previous(d, list(keys), step, F.col(ts), "_prev_ts")
    secs = (F.unix_micros(F.col(ts).cast("timestamp"))
            - F.unix_micros(F.col("_prev_ts").cast("timestamp"))) / 1e6
    return d.withColumn("tokens_per_sec", F.try_divide(F.lit(float(tokens_per_step * log_every)), secs)) \
        .withColumn("tokens_seen", (F.col(step) * tokens_per_step).cast("bigint")) \
        .drop("_prev_ts")


def val_loss_ppl(batch_losses: DataFrame, keys=(), loss: str = "loss") -> DataFrame:
    """Mean of batch means (unweighted); ``exp`` only if < 10, else inf;
    NaN without validation data."""
    agg = batch_losses.groupBy(*keys).agg(F.avg(loss).alias("val_loss"))
    return agg.withColumn("val_ppl", F.when(F.col("val_loss") < 10, F.exp("val_loss"))
                          .when(F.col("val_loss").isNull(), F.lit(float("nan")))
                          .otherwise(F.lit(float("inf"))))
