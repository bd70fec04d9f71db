"""Benchmark scoring: K1, K3-K16, D7-D10, E7, F2, C5.

All tasks and items are one DataFrame exploded to (task, item, choice,
token); scoring is one log-prob join and one aggregation, prediction an
``max_by``, accuracy a ``groupBy``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.joins import join_null_safe
from quillspark.operators.ordered import range_buckets, running_sums
from quillspark.session import materialize

# Task suites.
TASK_SUITES = {
    "quick": ["hellaswag"],
    "default": ["hellaswag", "arc_easy", "arc_challenge", "winogrande", "piqa"],
    "full": ["hellaswag", "arc_easy", "arc_challenge", "winogrande", "piqa", "mmlu", "gsm8k",
             "humaneval"],
    "arc": ["arc_easy", "arc_challenge"],
    "instruction": ["mmlu", "gsm8k", "humaneval"],
}
MC_TASKS = ("hellaswag", "arc_easy", "arc_challenge", "piqa", "mmlu")


# ---------------------------------------------------------------- items
def benchmark_items(benchmark: DataFrame) -> DataFrame:
    """Multiple-choice items from ``benchmark(item_id, text)``: context = the
    first half of the words, gold = the rest."""
    w = F.split("text", " ")
    half = F.floor(F.size(w) / 2).cast("int")
    return benchmark.select(
        "item_id",
        F.array_join(F.slice(w, 1, half), " ").alias("context"),
        F.array_join(F.slice(w, half + 1, F.size(w) - half), " ").alias("gold_text"))


def _item(task: str, context: Column, choices: Column, gold: Column, item_id: str) -> list[Column]:
    return [F.lit(task).alias("task"), F.col(item_id).alias("item_id"), context.alias("context"), choices.alias("choices"),
            gold.cast("int").alias("gold")]


def normalize_label(key: str) -> Column:
    """K8: ARC key: digit -> n-1; letter -> index in the alphabet."""
    k = F.col(key)
    return F.when(k.rlike("^[0-9]+$"), k.cast("int") - 1) \
        .otherwise(F.ascii(F.upper(k)) - 65).cast("int")


# Native item schemas -> ``task, item_id, context, choices, gold`` (K1).
# The prompts' texts.
def hellaswag_items(df: DataFrame, task: str = "hellaswag", item_id: str = "item_id") -> DataFrame:
    """``ctx, endings array, label``: the raw context."""
    return df.select(*_item(task, F.col("ctx"), F.col("endings"), F.col("label"), item_id))


def arc_items(df: DataFrame, task: str, item_id: str = "item_id") -> DataFrame:
    """``question, choices struct<text: array>, answerKey``: a letter or a 1-based digit."""
    return df.select(*_item(task, F.col("question"), F.col("choices.text"), normalize_label("answerKey"), item_id))


def winogrande_items(df: DataFrame, task: str = "winogrande", item_id: str = "item_id") -> DataFrame:
    """``sentence, option1, option2, answer`` (1 or 2): the sentence with its blank."""
    return df.select(*_item(task, F.col("sentence"), F.array("option1", "option2"), F.col("answer").cast("int") - 1, item_id))


def piqa_items(df: DataFrame, task: str = "piqa", item_id: str = "item_id") -> DataFrame:
    """``goal, sol1, sol2, label``."""
    ctx = F.concat(F.lit("Question: "), F.col("goal"), F.lit("\nAnswer:"))
    return df.select(*_item(task, ctx, F.array("sol1", "sol2"), F.col("label"), item_id))


def mmlu_items(df: DataFrame, task: str = "mmlu", item_id: str = "item_id") -> DataFrame:
    """``question, choices array, answer``: the choices are listed with letters."""
    listed = F.transform("choices", lambda c, i: F.concat(F.lit("\n"), F.char(i + 65), F.lit(". "), c))
    ctx = F.concat(F.lit("Question: "), F.col("question"), F.lit("\nChoices:"), F.array_join(listed, ""), F.lit("\nAnswer:"))
    return df.select(*_item(task, ctx, F.col("choices"), F.col("answer"), item_id))


def numbered_items(items: DataFrame) -> DataFrame:
    """``item_no``: from 0 without gaps in the order of ``item_id``, whatever
    the ids are; rows with one id are items of their own (two-phase)."""
    order = ["item_id", "context", "gold_text"]
    d = running_sums(range_buckets(items.select(*order), order), [], order, {"item_no": F.lit(1)}, bucket="_part")
    # read twice, and equal rows may be numbered either way
    return materialize(d.select(*order, (F.col("item_no") - 1).alias("item_no")), "numbered-items")


def _item_keys(df: DataFrame) -> list[str]:
    """What tells items apart: ``item_no`` too where there is one, as ids may be repeated."""
    return ["task", "item_id", *[c for c in df.columns if c == "item_no"]]


def suite_items(items: DataFrame, tasks) -> DataFrame:
    """Items of the given tasks in one table, with ``item_no``, drawn from
    ``benchmark`` items (a fixture: choices are the gold texts of the items
    that follow by number). The choice texts are gathered once; each task is a
    projection of them in its native schema through its adapter."""
    items = numbered_items(items)
    n = items.agg(F.count(F.lit(1))).scalar()
    k = items.select("item_no", "item_id", "context", F.posexplode(F.sequence(F.lit(0), F.lit(3))).alias("k", "_"))
    src = items.select(F.col("item_no").alias("_src"), F.col("gold_text").alias("text"))
    near = k.withColumn("_src", (F.col("item_no") + F.col("k")) % n).join(src, "_src") \
        .groupBy("item_no").agg(F.first("item_id").alias("item_id"), F.first("context").alias("context"), F.array_sort(F.collect_list(F.struct("k", "text"))).alias("_t"))
    near = materialize(near.select("item_no", "item_id", "context", F.transform("_t", lambda x: x["text"]).alias("texts")), "suite-items")
    # the adapters carry both through
    near = near.withColumn("item_id", F.struct("item_id", "item_no"))

    def turned(size: int) -> tuple[Column, Column]:
        """The texts with the gold one at ``item_no % size``, and that index."""
        g = (F.col("item_no") % size).cast("int")
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda j: F.get("texts", (j - g + size) % size)), g

    c4, g4 = turned(4)
    c2, g2 = turned(2)
    key = F.when(F.col("item_no") % 2 == 0, F.char(g4 + 65)).otherwise((g4 + 1).cast("string"))
    arc = near.select("item_id", F.col("context").alias("question"), F.struct(c4.alias("text")).alias("choices"), key.alias("answerKey"))
    two = near.select("item_id", "context", F.get(c2, F.lit(0)).alias("a"), F.get(c2, F.lit(1)).alias("b"), g2.alias("g"))
    made = {
        "hellaswag": lambda: hellaswag_items(near.select("item_id", F.col("context").alias("ctx"), c4.alias("endings"), g4.cast("string").alias("label"))),
        "arc_easy": lambda: arc_items(arc, "arc_easy"), "arc_challenge": lambda: arc_items(arc, "arc_challenge"),
        "piqa": lambda: piqa_items(two.select("item_id", F.col("context").alias("goal"), F.col("a").alias("sol1"), F.col("b").alias("sol2"), F.col("g").alias("label"))),
        "mmlu": lambda: mmlu_items(near.select("item_id", F.col("context").alias("question"), c4.alias("choices"), g4.alias("answer"))),
        "winogrande": lambda: winogrande_items(two.select("item_id", F.concat("context", F.lit(" _")).alias("sentence"), F.col("a").alias("option1"),
                                                          F.col("b").alias("option2"), (F.col("g") + 1).cast("string").alias("answer"))),
    }
    out = None
    for t in tasks:
        part = made[t]()
        out = part if out is None else out.unionByName(part)
    return out.select("task", "item_id.item_id", "item_id.item_no", "context", "choices", "gold")


def full_texts(items: DataFrame) -> Column:
    """``context + " " + choice`` for each choice."""
    return F.transform("choices", lambda c: F.concat(F.col("context"), F.lit(" "), c))


def filled_blanks(items: DataFrame) -> Column:
    """K7: the sentence with every ``_`` replaced by each option."""
    return F.transform("choices", lambda c: F.replace(F.col("context"), F.lit("_"), c))


def build_candidates(items: DataFrame, texts=full_texts) -> DataFrame:
    """K1: ``task, item_id, choice_idx, context, choice, full_text, gold`` of items."""
    keys = _item_keys(items)
    return items.select(*keys, "context", "choices", "gold", texts(items).alias("_full")) \
        .select(*keys, "context", "choices", "gold", F.posexplode("_full").alias("choice_idx", "full_text")) \
        .select(*keys, "choice_idx", "context", F.get("choices", F.col("choice_idx")).alias("choice"), "full_text", "gold")


# ---------------------------------------------------------------- scoring
def encode_candidates(items: DataFrame, encoder) -> DataFrame:
    """``task, item_id, choice_idx, gold, ctx_ids, ids`` (both with BOS): an
    item's context and full texts are encoded in one row, the context once."""
    d = items.withColumn("_t", F.concat(F.array("context"), full_texts(items)))
    keys = _item_keys(items)
    d = encoder.encode_column(d.select(*keys, "gold", "_t"), F.col("_t"), "_e", drop=["_t"])
    bos = F.array(F.lit(1))
    d = d.select(*keys, "gold", F.get("_e", F.lit(0)).alias("_c"), F.posexplode(F.slice("_e", F.lit(2), F.size("_e"))).alias("choice_idx", "_f"))
    return d.select(*keys, "choice_idx", "gold", F.concat(bos, "_c").alias("ctx_ids"), F.concat(bos, "_f").alias("ids"))


def truncate_for_scoring(d: DataFrame, max_length: int | None = None) -> DataFrame:
    """B14 + deviation 2: keep the last ``max_length`` ids (a model's context
    window; ``None``: all); the context length becomes ``max(0, n_kept -
    n_choice_tokens)`` (choice tokens are never counted twice or lost to a
    stale context length)."""
    n = F.size("ids")
    nctx = F.size("ctx_ids")
    if max_length is None:
        return d.withColumn("ctx_len", nctx)
    return d.withColumn("ctx_len", F.when(n > max_length, F.greatest(
        F.lit(0), F.lit(max_length) - (n - nctx))).otherwise(nctx).cast("int")) \
        .withColumn("ids", F.when(n > max_length, F.slice("ids", -max_length, max_length))
                    .otherwise(F.col("ids")))


def _numbered(d: DataFrame, name: str) -> DataFrame:
    """``d`` as a stage with ``_row``, a number of each row, so that scores go
    back to their row whatever its keys are (null or repeated ones too)."""
    return materialize(d.withColumn("_row", F.monotonically_increasing_id()), name)


def choice_scores(items: DataFrame, encoder, scorer, keys=None,
                  max_length: int | None = None) -> DataFrame:
    """K3 + K4 + K6 per candidate (with ``gold``): ``score`` (normalized by the number of
    choice tokens; raw sum when there are none), ``score_sum``, ``is_greedy``.
    ``scorer``: a ``BigramScorer``, ``BatchScorer`` or any object with their
    ``sequence_scores``."""
    keys = list(keys or [*_item_keys(items), "choice_idx"])
    e = truncate_for_scoring(encode_candidates(items, encoder), max_length)
    e = _numbered(e.select(*keys, "gold", "ids", "ctx_len", F.size("ids").alias("n_tokens")), "scored-candidates")
    d = scorer.sequence_scores(e, "ids", "ctx_len").withColumnRenamed("logprob_sum", "score_sum")
    n_choice = F.col("n_tokens") - F.col("ctx_len")
    return d.drop("ids", "_row").withColumn("n_choice_tokens", n_choice.cast("bigint")).withColumn(
        "score", F.when(n_choice > 0, F.col("score_sum") / n_choice).otherwise(F.col("score_sum")))


def rolling_scores(texts: DataFrame, encoder, scorer, keys, max_length: int | None = None,
                   text: str = "full_text") -> DataFrame:
    """K5 (and K7's numerator): sum of log-probs over the whole sequence
    except the first token; BOS added, last ``max_length`` ids kept (``None``: all).
    ``n_tokens`` counts BOS."""
    keys = list(keys)
    e = encoder.encode_column(texts, F.col(text), "ids", add_bos=True)
    if max_length is not None:
        e = e.withColumn("ids", F.when(F.size("ids") > max_length, F.slice("ids", -max_length, max_length))
                         .otherwise(F.col("ids")))
    e = _numbered(e.select(*keys, "ids", F.lit(1).alias("_start")), "rolling-texts")
    return scorer.sequence_scores(e, "ids", "_start") \
        .select(*keys, F.size("ids").cast("bigint").alias("n_tokens"), "logprob_sum")


def fill_blank_scores(wino: DataFrame, encoder, scorer, max_length: int | None = None) -> DataFrame:
    """K7: whole-sequence sum / number of tokens including BOS."""
    keys = [*_item_keys(wino), "choice_idx", "gold"]
    r = rolling_scores(wino, encoder, scorer, keys, max_length)
    return r.withColumn("score", F.col("logprob_sum") / F.col("n_tokens"))


def argmax_first(scores: DataFrame, keys=("task", "item_id"), out: str = "pred") -> DataFrame:
    """F2: index of the best score; ties -> lowest index."""
    return scores.groupBy(*keys).agg(F.max_by(
        F.col("choice_idx"), F.struct(F.col("score"), -F.col("choice_idx"))).alias(out))


def predict_and_score(scores: DataFrame, one_based: bool = False) -> DataFrame:
    """F2 + C5: ``task, item_id, pred, gold, is_correct`` of scores that carry
    their item's ``gold`` (both 1-based for Winogrande-style answers)."""
    best = F.max_by(F.col("choice_idx"), F.struct(F.col("score"), -F.col("choice_idx")))
    base = 1 if one_based else 0
    p = scores.groupBy(*_item_keys(scores)).agg((best + base).alias("pred"), (F.first("gold") + base).alias("gold"))
    return p.withColumn("is_correct", F.col("pred") == F.col("gold"))


def accuracy(results: DataFrame) -> DataFrame:
    """``100 * correct / total`` per task; null when total is 0."""
    return results.groupBy("task").agg(
        F.sum(F.col("is_correct").cast("int")).cast("bigint").alias("correct"),
        F.count(F.lit(1)).cast("bigint").alias("total")).withColumn(
        "accuracy", F.try_divide(F.col("correct") * 100.0, F.col("total").cast("double")))


def macro_average(acc: DataFrame) -> DataFrame:
    """Unweighted mean of the task accuracies (null ones excluded)."""
    return acc.agg(F.avg("accuracy").alias("average_accuracy"),
                   F.count("accuracy").cast("bigint").alias("tasks"))


def example_number(df: DataFrame, keys=("task",), order="item_id") -> DataFrame:
    """1-based running item number per task (two-phase)."""
    return running_sums(df, list(keys), order, {"example_id": F.lit(1)})


def example_details(scores: DataFrame, cands: DataFrame, results: DataFrame) -> DataFrame:
    """One nested record per item: choices, prediction, gold, scores and
    the exact model input strings (ordered by choice)."""
    keys = _item_keys(scores)
    per = join_null_safe(cands, scores.select(*keys, "choice_idx", "score"), [*keys, "choice_idx"])
    g = per.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(
        "choice_idx", "choice", "full_text", "score"))).alias("_c"), F.first("context").alias("context"))
    d = join_null_safe(g, results, keys)
    d = example_number(d, order=keys[1:])
    return d.select(
        "task", "example_id", "item_id", "context",
        F.transform("_c", lambda c: c["choice"]).alias("choices"),
        F.col("pred").alias("model_prediction"),
        F.col("_c")[F.col("pred")]["choice"].alias("model_choice"),
        F.col("gold").alias("correct_label"),
        F.col("_c")[F.col("gold")]["choice"].alias("correct_choice"),
        "is_correct",
        F.transform("_c", lambda c: c["full_text"]).alias("model_input_strings"),
        F.transform("_c", lambda c: c["score"]).alias("model_scores"))


def winogrande_details(items: DataFrame, scores: DataFrame, results: DataFrame) -> DataFrame:
    """K12 for the sentences with a blank: the filled sentences are choices and
    inputs, predictions and labels count from 1."""
    keys = _item_keys(scores)
    s = scores.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("choice_idx", "score"))).alias("_s"))
    d = join_null_safe(items.select(*keys, "context", "choices", filled_blanks(items).alias("_full")), s, keys)
    d = example_number(join_null_safe(d, results, keys), order=keys[1:])
    return d.select("task", "example_id", "item_id", F.col("context").alias("sentence"), F.get("choices", F.lit(0)).alias("option1"),
                    F.get("choices", F.lit(1)).alias("option2"), F.col("_full").alias("choices"), F.col("pred").alias("model_prediction"),
                    F.get("_full", F.col("pred") - 1).alias("model_choice"), F.col("gold").alias("correct_label"),
                    F.get("_full", F.col("gold") - 1).alias("correct_choice"), "is_correct", F.col("_full").alias("model_input_strings"),
                    F.transform("_s", lambda x: x["score"]).alias("model_scores"))


def number_details(answers: DataFrame, question: str = "question") -> DataFrame:
    """K12 for number answers (rows of :func:`extract_pred_number`)."""
    d = example_number(answers, order=_item_keys(answers)[1:])
    return d.select("task", "example_id", "item_id", F.col(question).alias("question"), F.col("gold_number").alias("correct_answer"),
                    F.col("completion").alias("model_generation"), F.col("pred_number").alias("model_answer"), "is_correct")


# ---------------------------------------------------------------- text answers
# Answer patterns (digits as [0-9] so Java regex and RE2 agree).
GOLD_NUMBER = r"####\s*(-?[0-9]+(?:,?[0-9]+)*)"
PRED_NUMBER = r"(-?[0-9]+(?:,?[0-9]+)*)"


def extract_gold_number(df: DataFrame, answer: str = "answer") -> DataFrame:
    """K9: ``#### n`` (commas removed); items without the marker are dropped."""
    g = F.regexp_extract(answer, GOLD_NUMBER, 1)
    return df.withColumn("gold_number", F.replace(g, F.lit(","), F.lit(""))).filter(
        F.col(answer).rlike(GOLD_NUMBER))


def extract_pred_number(df: DataFrame, completion: str = "completion") -> DataFrame:
    """First number in the completion (commas removed), '' if none;
    correct when equal to the gold string."""
    p = F.regexp_extract(completion, PRED_NUMBER, 1)
    return df.withColumn("pred_number", F.replace(p, F.lit(","), F.lit(""))) \
        .withColumn("is_correct", (F.col("pred_number") == F.col("gold_number"))
                    & (F.col("pred_number") != ""))


def stop_truncate(text: Column, stops) -> Column:
    """Cut at each stop string in turn (the first occurrence)."""
    out = text
    for s in stops:
        out = F.split_part(out, F.lit(s), F.lit(1)) if s else out
    return out


def strip_prompt(text: Column, prompt: Column) -> Column:
    """The completion = text without the prompt when it starts with it."""
    return F.when(text.startswith(prompt), F.substr(text, F.length(prompt) + 1, F.length(text))) \
        .otherwise(text)


def flat_preview(text: Column, n: int = 160) -> Column:
    """K14 log form: newlines shown as ``\\n``, first ``n`` characters."""
    return F.left(F.replace(text, F.lit("\n"), F.lit("\\n")), F.lit(n))


def collect_completions(df: DataFrame) -> DataFrame:
    """Completion rows kept; accuracy is null (not executed, so not 0)."""
    return df.withColumn("accuracy", F.lit(None).cast("double"))


def perplexity(logprobs: DataFrame, keys=()) -> DataFrame:
    """``exp(-sum(logprob)/count)`` over scored tokens; inf if none."""
    a = logprobs.groupBy(*keys).agg(F.sum("logprob").alias("_s"), F.count(F.lit(1)).alias("_n"))
    return a.select(*keys, F.when(F.col("_n") > 0, F.exp(-F.col("_s") / F.col("_n")))
                    .otherwise(F.lit(float("inf"))).alias("perplexity"),
                    F.col("_n").cast("bigint").alias("tokens"))
