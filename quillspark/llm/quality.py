"""Quality rules with risk-controlled thresholds.

Counts of every whole text give the values of a few rules (higher is worse).
For each rule and stratum (a class of text lengths) a list of cutoffs is
tested from the mildest on, against labelled good documents: a cutoff passes
if the exact binomial probability of as few false rejections as seen, at the
rule's share of the allowed rate, is at most the error level divided by the
number of rules and strata (Bonferroni); the first failure ends the list (a
fixed sequence needs no further correction). Every rule is tested on all good
documents of the stratum that pass the base check, whatever the other rules
do, so no choice made on the holdout enters a test. So, with the stated
confidence for all rules and strata together, each rule rejects at most its
share of a stratum's good documents, and all rules together at most
``max_rate`` of them. Among the cutoffs that passed, a rule takes the one that
rejects most bad documents net of the good ones (each weighs ``good_cost``),
counted on the documents that the rules before let through; ties go to the
mildest, and a rule without gain stays off.

Everything is DataFrame expressions; only tables of strata x rules x cutoffs
rows are windowed or broadcast.

Defined results: null or empty text has no words and fails the base check;
repeated rows are judged each; a document labelled more than once counts as
good if one label says so, null labels are no labels; a stratum with too few
labels to prove anything has no cutoffs; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import documents, materialize

# The word pattern, the symbols counted and the base limits.
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
SPACES = " \t\n\x0b\x0c\r"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Upper ends of the strata, in words; the last stratum is open.
STRATA = (150, 400, 1000)
#: Rules as SQL over the counts, with their cutoffs from the mildest on; a value of at least the cutoff is rejected.
RULES = {
    "symbols": ("n_symbols / n_words", (3.0, 2.0, 1.5, 1.0, 0.75, 0.5, 0.4, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05, 0.02)),
    "copied_lines": ("n_dup_lines / n_lines", (0.9, 0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1)),
    "repeats": ("n_repeat_words / n_words", (0.5, 0.45, 0.4, 0.35, 0.3, 0.25, 0.2, 0.15, 0.1, 0.05)),
    "long_words": ("word_chars / n_words", (20.0, 15.0, 12.0, 10.0, 9.5, 9.0, 8.5, 8.0, 7.5, 7.0)),
    "short_words": ("n_words / word_chars", (1.0, 0.75, 0.6, 0.5, 0.45, 0.4, 0.36, 0.33, 0.3)),
}
MAX_RATE = 0.05
ERROR = 0.05
GOOD_COST = 5


def counts(docs: DataFrame, rows: bool = False) -> DataFrame:
    """``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_lines, base_failed`` of every row, with ``rows`` also ``doc``, the whole
    row as a struct."""
    df = documents(docs, *([F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if rows else []))
    doc = ["doc"] * rows
    trimmed = F.btrim("text", F.lit(SPACES))
    df = df.select("doc_id", *doc, "text", F.when(trimmed == "", F.array().cast("array<string>"))
                   .otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+")).alias("_w"))
    df = df.select(
        "doc_id", *doc, "_w", F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.concat_ws("", "_w")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        F.filter(F.split("text", "\n"), lambda line: F.btrim(line, F.lit(SPACES)) != "").alias("_l"),
        F.when(F.size("_w") >= 3, F.transform(F.sequence(F.lit(0), F.size("_w") - 3), lambda i: F.xxhash64(
            F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)))).otherwise(F.array().cast("array<bigint>")).alias("_h"))
    df = df.select(
        "doc_id", *doc, "n_words", "word_chars", "n_symbols", F.size("_l").cast("bigint").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        # windows in order of hash and place, only for texts in which one comes twice
        F.when(F.size(F.array_distinct("_h")) < F.size("_h"), F.array_sort(F.transform(
            "_h", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))).alias("_s"))
    twice = F.filter("_s", lambda x, i: (F.get("_s", i - 1)["h"] == x["h"]) | (F.get("_s", i + 1)["h"] == x["h"]))
    places = F.array_sort(F.transform(twice, lambda x: x["p"]))
    # a window adds its words but those that the window before has covered
    covered = F.aggregate(places, F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")),
                          lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(3), p - acc["last"])).alias("n")),
                          lambda acc: acc["n"])
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("bigint"))).drop("_s")
    return df.withColumn("base_failed", F.expr(
        f"n_words < {MIN_WORDS} or 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words"))


def stratum() -> Column:
    return F.expr("case " + " ".join(f"when n_words < {n} then {i}" for i, n in enumerate(STRATA)) + f" else {len(STRATA)} end")


def _log_gamma(x: Column) -> Column:
    """Stirling's series seven places up (x >= 1), good to 12 digits."""
    z = x + 7
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, 3)) + 1 / (1260 * F.pow(z, 5)) - 1 / (1680 * F.pow(z, 7))
    shift = sum((F.log(x + i) for i in range(1, 7)), F.log(x))
    return (z - 0.5) * F.log(z) - z + 0.9189385332046727 + series - shift


def log_binomial_cdf(k: Column, n: Column, rate: float) -> Column:
    """Log of the probability of at most ``k`` of ``n`` at ``rate``, for
    ``k < n * rate``: the largest term, and the sum of the ones below relative
    to it, which fall geometrically and are nil after 60 deviations."""
    n, k = n.cast("double"), k.cast("double")
    top = (_log_gamma(n + 1) - _log_gamma(k + 1) - _log_gamma(n - k + 1)
           + k * F.log(F.lit(rate)) + (n - k) * F.log(F.lit(1 - rate)))
    steps = F.least(k, 60 * F.sqrt(n * rate) + 200).cast("int")
    total = F.aggregate(
        F.sequence(F.lit(0), steps), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")),
        lambda a, j: F.struct((a["term"] * (k - j) / (n - k + j + 1) * ((1 - rate) / rate)).alias("term"),
                              (a["sum"] + a["term"]).alias("sum")),
        lambda a: a["sum"])
    return top + F.log(total)


def cutoffs(stats: DataFrame, labels: DataFrame, max_rate: float = MAX_RATE, error: float = ERROR,
            good_cost: int = GOOD_COST) -> DataFrame:
    """One row per stratum with a column ``_rule`` for each rule: its cutoff, null where it is off."""
    good = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("good")) \
        .filter("doc_id is not null and good is not null").groupBy("doc_id").agg(F.max("good").alias("good"))
    left = materialize(stats.filter("not base_failed").withColumn("stratum", stratum()).join(good, "doc_id"), "quality_holdout") \
        .withColumn("left", F.lit(True))
    rate, level = max_rate / len(RULES), error / (len(RULES) * (len(STRATA) + 1))
    n_good = Window.partitionBy("stratum")
    in_order = Window.partitionBy("stratum").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    limits = stats.sparkSession.range(len(STRATA) + 1).select(F.col("id").cast("int").alias("stratum"))
    for rule, (value, cuts) in RULES.items():
        # how many cutoffs a document's value reaches, from the strictest (last) on
        reached = sum((F.expr(f"cast({value} >= {c}D as int)") for c in cuts), F.lit(0))
        seen = left.groupBy("stratum", reached.alias("reached")).agg(
            F.sum(F.expr("cast(good = 1 as bigint)")).alias("good"), F.sum(F.expr("cast(good = 1 and left as bigint)")).alias("good_left"),
            F.sum(F.expr("cast(good <> 1 and left as bigint)")).alias("bad_left"))
        # one row per stratum and cutoff: what it rejects of all, for the test, and of what is left, for the choice
        table = seen.withColumn("n", F.sum("good").over(n_good)) \
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("reached")))).filter("j > 0") \
            .groupBy("stratum", (len(cuts) + 1 - F.col("j")).alias("place"), "n") \
            .agg(F.sum("good").alias("k"), F.sum("good_left").alias("k_left"), F.sum("bad_left").alias("bad_left"))
        passed = F.when(F.col("k") < F.col("n") * rate,
                        log_binomial_cdf(F.col("k"), F.col("n"), rate) <= F.log(F.lit(level))).otherwise(F.lit(False))
        best = table.withColumn("ok", F.min(passed.cast("int")).over(in_order)) \
            .withColumn("gain", F.col("bad_left") - good_cost * F.col("k_left")).filter("ok = 1 and gain > 0") \
            .groupBy("stratum").agg(F.max_by("place", F.struct(F.col("gain"), -F.col("place"))).alias("place"))
        chosen = materialize(best.select("stratum", F.element_at(F.array(*map(F.lit, cuts)), F.col("place").cast("int")).alias(f"_{rule}")),
                             "quality_cutoffs")
        limits = limits.join(F.broadcast(chosen), "stratum", "left")
        left = left.join(F.broadcast(chosen), "stratum", "left") \
            .withColumn("left", F.col("left") & F.coalesce(F.expr(f"{value} < _{rule}"), F.lit(True))).drop(f"_{rule}")
    return limits


def _apply(stats: DataFrame, limits: DataFrame) -> DataFrame:
    """``stats`` with ``kept``, by a broadcast of the strata's cutoffs."""
    out = stats.withColumn("stratum", stratum()).join(F.broadcast(limits), "stratum", "left")
    broken = F.lit(False)
    for r, (value, _) in RULES.items():
        broken = broken | F.coalesce(F.expr(f"{value} >= _{r}"), F.lit(False))
    # short circuit: a text without words is never divided by
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(~broken)
    return out.withColumn("kept", kept).drop("stratum", *[f"_{r}" for r in RULES])


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The counts of every row with ``kept``."""
    stats = materialize(counts(docs), "quality_counts")
    return _apply(stats, cutoffs(stats, labels, **options))


def judge_rows(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc`` (the whole row as a struct) with the counts and ``kept``. Rows
    are counted once and written with their counts, of which the cutoffs read
    the narrow columns alone, so that no text is shuffled."""
    stats = materialize(counts(docs, rows=True), "quality_counts")
    return _apply(stats, cutoffs(stats.drop("doc"), labels, **options))
