"""Corpus collection and statistics: B1-B4, B6, E1-E3, D1-D3, D12, D15."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import estimate_tokens, text_field
from quillspark.operators.joins import join_null_safe
from quillspark.operators.ordered import DEFAULT_BUCKET_WIDTH, running_sum


def corpus_from_documents(documents: DataFrame) -> DataFrame:
    """Map the driver's ``documents`` table onto the corpus model:
    ``dataset = source``, ``pos = doc_id`` (the order key)."""
    return documents.select(
        F.col("source").alias("dataset"), F.col("doc_id").alias("pos"),
        "text", "lang")


def extract_text(df: DataFrame, code_datasets=("stack_v2",)) -> DataFrame:
    """B1: pick the text field by dataset name (``content`` for code sets)."""
    content = F.col("content") if "content" in df.columns else F.lit(None).cast("string")
    return df.withColumn("text", text_field("dataset", F.col("text"), content, code_datasets))


def filter_nonempty(df: DataFrame, col: str = "text") -> DataFrame:
    """B2: falsy text (null or '') is dropped."""
    return df.filter(F.length(F.col(col)) > 0)


def filter_min_chars(df: DataFrame, min_chars: int = 50, col: str = "text") -> DataFrame:
    """Code files shorter than ``min_chars`` characters are dropped."""
    return df.filter(F.length(F.col(col)) >= min_chars)


def with_estimate(df: DataFrame, col: str = "text", out: str = "est") -> DataFrame:
    """``len(text) // 4``."""
    return df.withColumn(out, estimate_tokens(col))


def stringify_nested_ts(df: DataFrame, struct_col: str = "meta",
                        field: str = "timestamp") -> DataFrame:
    """``meta.timestamp`` becomes a string when present."""
    if struct_col not in df.columns:
        return df
    st = df.schema[struct_col].dataType
    if field not in getattr(st, "fieldNames", lambda: [])():
        return df
    return df.withColumn(struct_col, F.col(struct_col).withField(
        field, F.col(f"{struct_col}.{field}").cast("string")))


def token_budget(df: DataFrame, max_tokens: int | None, keys=("dataset",),
                 order: str = "pos", est: str = "est",
                 bucket_width: int = DEFAULT_BUCKET_WIDTH,
                 quota=None) -> DataFrame:
    """Admit rows in ``order`` until the next one would pass the budget.

    ``quota`` (a Column) overrides ``max_tokens`` per row group (E2). A null or
    zero budget means no limit. Adds ``cum_tokens`` (inclusive running sum).
    """
    limit = quota if quota is not None else F.lit(max_tokens)
    if quota is None and not max_tokens:
        return running_sum(df, keys, order, F.col(est), out="cum_tokens",
                           bucket_width=bucket_width)
    prune = None if quota is not None else int(max_tokens)
    d = running_sum(df, keys, order, F.col(est), out="cum_tokens",
                    bucket_width=bucket_width, max_offset=prune)
    return d.filter(limit.isNull() | (limit == 0) | (F.col("cum_tokens") <= limit))


def token_budget_lang(df: DataFrame, max_tokens: int, langs: Mapping[str, list] | None = None,
                      bucket_width: int = DEFAULT_BUCKET_WIDTH) -> DataFrame:
    """Quota per language is ``max // n_langs``; each language stops on its
    own. ``langs`` maps dataset -> language list; by default the languages
    present per dataset (a tiny aggregate, joined back by AQE broadcast)."""
    if langs is None:
        n = df.groupBy("dataset").agg(F.countDistinct("lang").cast("bigint").alias("_n_langs"))
    else:
        spark = df.sparkSession
        n = spark.createDataFrame([(k, len(v)) for k, v in langs.items()],
                                  "dataset string, _n_langs bigint")
        pairs = [(k, lang) for k, v in langs.items() for lang in v]
        allowed = spark.createDataFrame(pairs, "dataset string, lang string")
        df = df.join(F.broadcast(allowed), ["dataset", "lang"], "left_semi")
    # a row per dataset, whose size Spark measures; a null dataset is one like any other
    d = join_null_safe(df, n, ["dataset"])
    quota = F.floor(F.lit(max_tokens) / F.col("_n_langs")).cast("bigint")
    d = d.withColumn("_quota", quota)
    out = token_budget(d, None, keys=("dataset", "lang"), quota=F.col("_quota"),
                       bucket_width=bucket_width)
    return out.drop("_n_langs", "_quota")


def collect_counts(admitted: DataFrame, est: str = "est") -> DataFrame:
    """Documents and estimated tokens admitted per dataset."""
    return admitted.groupBy("dataset").agg(
        F.count(F.lit(1)).cast("bigint").alias("docs"),
        F.coalesce(F.sum(est), F.lit(0)).cast("bigint").alias("tokens"))


def val_every_n(df: DataFrame, n: int = 100, keys=("dataset",), order: str = "pos",
                bucket_width: int = DEFAULT_BUCKET_WIDTH) -> DataFrame:
    """``doc_index % n == 0`` goes to val; the index counts from 0 over the
    non-empty documents of one dataset (so the first document is val)."""
    d = running_sum(df, keys, order, F.lit(1), out="doc_index", bucket_width=bucket_width)
    d = d.withColumn("doc_index", F.col("doc_index") - 1)
    return d.withColumn("is_val", (F.col("doc_index") % F.lit(n)) == 0)


def ratio_of_sums(num, den):
    """D3: ``sum(num)/sum(den)``, 0 when there is nothing."""
    return F.coalesce(F.try_divide(F.sum(num).cast("double"), F.sum(den).cast("double")),
                      F.lit(0.0))


def token_stats(encoded: DataFrame) -> DataFrame:
    """Per dataset train/val docs and tokens (EOS included), characters,
    chars per token and stream sizes in MB (2 bytes per token).

    Input columns: ``dataset, is_val, n_tokens`` (with EOS), ``n_chars``.
    """
    tv = F.col("is_val")
    agg = encoded.groupBy("dataset").agg(
        F.sum(F.when(~tv, F.col("n_tokens")).otherwise(0)).cast("bigint").alias("train_tokens"),
        F.sum(F.when(tv, F.col("n_tokens")).otherwise(0)).cast("bigint").alias("val_tokens"),
        F.sum(F.when(~tv, 1).otherwise(0)).cast("bigint").alias("train_docs"),
        F.sum(F.when(tv, 1).otherwise(0)).cast("bigint").alias("val_docs"),
        F.sum("n_chars").cast("bigint").alias("total_chars"),
    )
    total = F.col("train_tokens") + F.col("val_tokens")
    return (agg
            .withColumn("chars_per_token", F.coalesce(
                F.try_divide(F.col("total_chars").cast("double"), total.cast("double")),
                F.lit(0.0)))
            .withColumn("train_size_mb", F.col("train_tokens") * 2 / F.lit(1024.0 ** 2))
            .withColumn("val_size_mb", F.col("val_tokens") * 2 / F.lit(1024.0 ** 2)))


def totals_rollup(stats: DataFrame) -> DataFrame:
    """Per-dataset train/val tokens plus a grand-total row
    (``dataset = 'TOTAL'``, ``is_total = true``)."""
    r = stats.rollup("dataset").agg(
        F.sum("train_tokens").cast("bigint").alias("train_tokens"),
        F.sum("val_tokens").cast("bigint").alias("val_tokens"),
        F.grouping_id().alias("_g"))
    return r.select(
        F.when(F.col("_g") == 1, F.lit("TOTAL")).otherwise(F.col("dataset")).alias("dataset"),
        (F.col("_g") == 1).alias("is_total"), "train_tokens", "val_tokens")


def mixture_report(counts: DataFrame, targets: DataFrame) -> DataFrame:
    """Target share per source and how often its data repeats
    (planned consumption / available tokens).

    ``counts``: ``dataset, tokens`` (D1). ``targets``: ``dataset, target_tokens``
    and optionally ``planned_tokens``. Both are one row per dataset.
    """
    t = targets if "planned_tokens" in targets.columns else \
        targets.withColumn("planned_tokens", F.col("target_tokens"))
    w = Window.partitionBy()  # over the tiny per-dataset table only
    j = t.join(counts.select("dataset", "tokens"), "dataset", "left")
    return j.select(
        "dataset",
        F.col("target_tokens").cast("bigint").alias("target_tokens"),
        F.round(100.0 * F.col("target_tokens") / F.sum("target_tokens").over(w), 6)
        .alias("target_share_pct"),
        F.coalesce(F.col("tokens"), F.lit(0)).cast("bigint").alias("available_tokens"),
        F.round(F.try_divide(F.col("planned_tokens").cast("double"),
                             F.col("tokens").cast("double")), 6).alias("repeat_factor"))


def budget_and_split(df: DataFrame, max_tokens: int | None, val_every: int = 100,
                     keys=("dataset",), order: str = "pos", est: str = "est",
                     bucket_width: int = DEFAULT_BUCKET_WIDTH) -> DataFrame:
    """E1 then E3 in one two-phase pass (one shuffle of the corpus).

    Admission keeps a prefix of each dataset, so the document index among the
    admitted rows equals the index among all non-empty rows: both running
    sums come from the same windows.
    """
    from quillspark.operators.ordered import running_sums
    d = running_sums(df, keys, order, {"cum_tokens": F.col(est), "doc_index": F.lit(1)},
                     bucket_width,
                     limits={"cum_tokens": int(max_tokens)} if max_tokens else None)
    if max_tokens:
        d = d.filter(F.col("cum_tokens") <= F.lit(int(max_tokens)))
    d = d.withColumn("doc_index", F.col("doc_index") - 1)
    return d.withColumn("is_val", (F.col("doc_index") % F.lit(val_every)) == 0)
