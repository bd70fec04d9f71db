"""Benchmark evaluation: items -> candidates per task -> token log-probs ->
scores -> predictions -> accuracy per task -> macro average."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import evalops as V
from quillspark.operators.ngram import BigramScorer, fit_ngram


def bigram_model(documents: DataFrame, encoder) -> BigramScorer:
    """K0: bigram counts over the non-empty documents, BOS + ids + EOS."""
    d = documents.filter(F.length("text") > 0).select("text")
    e = encoder.encode(d, "text", "ids", add_bos=True, add_eos=True, drop_text=True)
    return BigramScorer(fit_ngram(e), encoder.vocab_size, materialize=True)


def gsm8k_rows(items: DataFrame) -> DataFrame:
    """GSM8K-shaped rows derived from the items: the answer ends with
    ``#### n`` (thousands separated), the completion states a number that is
    right for even items."""
    n = F.col("item_id") * 1234
    return items.select(
        F.lit("gsm8k").alias("task"), "item_id", F.col("context").alias("question"),
        F.concat(F.col("context"), F.lit(" #### "), F.format_number(n, 0)).alias("answer"),
        F.concat(F.lit("The answer is "), F.format_number(
            F.when(F.col("item_id") % 2 == 0, n).otherwise(n + 1), 0), F.lit(".")).alias("completion"))


def mc_results(items: DataFrame, tasks, encoder, scorer) -> DataFrame:
    """Per task: ``task, item_id, pred, gold, is_correct``. The candidates of
    all multiple-choice tasks are scored in one pass (one encode, one
    log-prob join, one aggregation); Winogrande (whole-sequence scoring) is
    the second pass."""
    out = []
    mc = [t for t in tasks if t in V.MC_TASKS]
    blanks = ["winogrande"] if "winogrande" in tasks else []
    # numbered and gathered once for all tasks
    made = V.suite_items(items, [*mc, *blanks]) if mc or blanks else None
    if mc:
        out.append(V.predict_and_score(V.choice_scores(made.filter(F.col("task").isin(mc)), encoder, scorer)))
    if blanks:
        c = V.build_candidates(made.filter(F.col("task").isin(blanks)), V.filled_blanks)
        out.append(V.predict_and_score(V.fill_blank_scores(c, encoder, scorer), one_based=True))
    if not out:
        return None
    r = out[0]
    for x in out[1:]:
        r = r.unionByName(x)
    return r


def suite_accuracy(benchmark: DataFrame, tasks: str, encoder, scorer) -> DataFrame:
    """Accuracy per task of a suite (``quick``/``default``/``full``/``arc``/
    ``instruction`` or a comma list). GSM8K scores its derived completions;
    HumanEval rows are collected with accuracy null (K15)."""
    names = V.TASK_SUITES.get(tasks, tasks.split(","))
    items = V.benchmark_items(benchmark)
    parts = []
    r = mc_results(items, names, encoder, scorer)
    if r is not None:
        parts.append(V.accuracy(r))
    if "gsm8k" in names:
        g = V.extract_pred_number(V.extract_gold_number(gsm8k_rows(items)))
        parts.append(V.accuracy(g.select("task", "item_id", "is_correct")))
    if "humaneval" in names:
        h = items.select(F.lit("humaneval").alias("task"), "item_id")
        parts.append(h.groupBy("task").agg(
            F.lit(0).cast("bigint").alias("correct"),
            F.count(F.lit(1)).cast("bigint").alias("total"))
            .withColumn("accuracy", F.lit(None).cast("double")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
