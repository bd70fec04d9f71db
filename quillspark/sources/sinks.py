"""Sinks: A7-A12, A14, A15, A17.

Spark's file commit protocol gives atomic outputs (A8): files appear only at
job commit and ``_SUCCESS`` marks a complete output, so a partial dump is
never taken as complete. Idempotent stages (A9) anti-join the requested
work against what a manifest says is done.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.joins import anti_done
from quillspark.session import path_exists


def sink_jsonl(df: DataFrame, path: str, mode: str = "errorifexists",
               compression: str | None = None) -> str:
    """JSON lines (UTF-8). ``compression``: a codec of Spark's writer, or
    ``zst``, which needs no native one (it replaces what is there)."""
    if compression == "zst":
        from quillspark.sources.zst_lines import write_zst_lines
        return write_zst_lines(df.select(F.to_json(F.struct(*df.columns))), path)
    w = df.write.mode(mode)
    if compression:
        w = w.option("compression", compression)
    w.json(path)
    return path


def is_complete(spark: SparkSession, path: str) -> bool:
    """An output counts as complete only if the commit marker exists."""
    return path_exists(spark, path.rstrip("/") + "/_SUCCESS")


def sink_token_stream(chunks: DataFrame, path: str, keys=("dataset", "split"),
                      mode: str = "overwrite") -> str:
    """A10: the chunk table in one directory per stream. Rows are range
    partitioned on ``(keys, chunk_id)`` — a large stream is spread over many
    tasks, each writing a contiguous run of chunks — and sorted within each
    file, so Parquet min/max statistics skip chunks at read time."""
    (chunks.repartitionByRange(*keys, "chunk_id").sortWithinPartitions(*keys, "chunk_id")
     .write.mode(mode).partitionBy(*keys).parquet(path))
    return path


def sink_packed_masked(chunks: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Tokens + mask chunks of each split in one row (never misaligned)."""
    return sink_token_stream(chunks, path, keys=("split",), mode=mode)


def sink_manifest(spark: SparkSession, manifest: dict, path: str) -> str:
    """One-row JSON manifest / statistics (written by Spark, atomically)."""
    import json
    df = spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string")
    df.coalesce(1).write.mode("overwrite").text(path)
    return path


def sink_samples(samples: DataFrame, path: str, mode: str = "overwrite") -> str:
    """Decoded samples with their metric header, one JSON row each,
    partitioned by dataset and split."""
    samples.write.mode(mode).partitionBy("dataset", "split").json(path)
    return path


def sink_eval(summary: DataFrame, path: str, details: DataFrame | dict[str, DataFrame] | None = None) -> str:
    """Summary JSON (+ optional per-example details), timestamped.
    ``details``: records of one shape, or a table for each shape by name."""
    summary.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyyMMdd_HHmmss")) \
        .coalesce(1).write.mode("overwrite").json(os.path.join(path, "summary"))
    if isinstance(details, DataFrame):
        details.write.mode("overwrite").json(os.path.join(path, "examples"))
    for name, own in (details if isinstance(details, dict) else {}).items():
        own.write.mode("overwrite").json(os.path.join(path, "examples", name))
    return path


def sample_rows(generated: DataFrame, step: int | str, prompt: str = "prompt", text: str = "text") -> DataFrame:
    """``step, prompt, completion`` of texts generated from prompts; the
    text goes on from its prompt, which it may repeat. ``step``: a number or a
    column's name."""
    from quillspark.operators.evalops import strip_prompt
    return generated.select((F.col(step) if isinstance(step, str) else F.lit(step)).cast("bigint").alias("step"), F.col(prompt).alias("prompt"),
                            strip_prompt(F.col(text), F.col(prompt)).alias("completion"))


def sink_metrics(metrics: DataFrame, path: str) -> str:
    """Append metric / sample rows to a Parquet table."""
    metrics.write.mode("append").parquet(path)
    return path


def pending_work(requested: DataFrame, manifest_path: str, spark: SparkSession,
                 key: str = "dataset") -> DataFrame:
    """Requested items not yet in the manifest table (if any)."""
    if not is_complete(spark, manifest_path):
        return requested
    done = spark.read.parquet(manifest_path)
    return anti_done(requested, done, key)
