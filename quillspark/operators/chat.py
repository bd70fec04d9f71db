"""Instruction-data operators: H1-H8, B5, B7-B9, B13-B15, E4, D5, D6.

A conversation is one row holding ``messages array<struct<role, content>>``;
all converters are Column -> Column expressions (higher-order functions), so
they run inside whole-stage codegen with no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import py_strip
from quillspark.operators.encode import BOS_ID, EOS_ID
from quillspark.operators.ordered import DEFAULT_BUCKET_WIDTH, running_sums

# Conversation length limit (skip, never truncate) and the
# shuffle seed.
MAX_TOKENS_PER_CONVERSATION = 2048
SFT_SEED = 1337

# ShareGPT speaker names -> roles.
SHAREGPT_ROLES = {
    "system": "system",
    "human": "user",
    "user": "user",
    "gpt": "assistant",
    "assistant": "assistant",
}
CHAT_ROLES = ("system", "user", "assistant")

# Registry of instruction datasets -> (raw shape, default count).
DATASETS = {
    "openhermes": ("sharegpt", 15_000),
    "slimorca": ("sharegpt", 20_000),
    "tulu": ("messages", 15_000),
    "magicoder": ("qa_problem_solution", 10_000),
    "metamath": ("qa_query_response", 10_000),
    "orca_math": ("qa_question_answer", 5_000),
    "smoltalk": ("messages", 50_000),
    "magpie": ("sharegpt", 25_000),
    "ultrachat": ("messages", 15_000),
    "no_robots": ("messages", 10_000),
    "capybara": ("pairs", 15_000),
    "numinamath": ("qa_problem_solution", 15_000),
}

_MSG = "struct<role:string,content:string>"


def _msg(role, content) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(role.alias("role"), content.alias("content"))


def _all_or_null(arr: Column, ok) -> Column:
    """The array if every element passes ``ok``, else null (whole-row reject)."""
    return F.when(F.forall(arr, ok), arr)


# ---------------------------------------------------------------- raw shapes
def collect_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns array<struct<turn, role, text>>`` ordered by turn.
    A conversation is one bounded group (its own turns)."""
    return conversations.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))


def messages_shape(turns: str = "turns") -> Column:
    """Messages shape: ``array<struct<role, content>>``."""
    return F.transform(turns, lambda t: _msg(t["role"], t["text"]))


def sharegpt_shape(turns: str = "turns") -> Column:
    """ShareGPT shape: ``array<struct<from, value>>``."""
    to_from = F.create_map(F.lit("user"), F.lit("human"), F.lit("assistant"), F.lit("gpt"))
    return F.transform(turns, lambda t: F.struct(
        F.coalesce(F.try_element_at(to_from, t["role"]), t["role"]).alias("from"),
        t["text"].alias("value")))


def pairs_shape(turns: str = "turns") -> Column:
    """Pair shape: ``array<struct<input, output>>`` from turns (2k, 2k+1); a
    missing partner is null."""
    n = F.size(turns)
    ks = F.sequence(F.lit(0), F.floor((n - 1) / 2).cast("int"))
    return F.when(n > 0, F.transform(ks, lambda k: F.struct(
        F.try_element_at(turns, (2 * k + 1).cast("int"))["text"].alias("input"),
        F.try_element_at(turns, (2 * k + 2).cast("int"))["text"].alias("output")))) \
        .otherwise(F.array().cast("array<struct<input:string,output:string>>"))


def qa_shape(turns: str = "turns") -> tuple[Column, Column]:
    """Flat QA shape: two strings from turns 0 and 1."""
    return (F.try_element_at(turns, F.lit(1))["text"], F.try_element_at(turns, F.lit(2))["text"])


def as_messages(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", messages_shape().alias("messages"))


def as_sharegpt(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", sharegpt_shape().alias("conversations"))


def as_pairs(turns: DataFrame) -> DataFrame:
    return turns.select("conv_id", pairs_shape().alias("conversation"))


def as_qa(turns: DataFrame, q: str = "question", a: str = "answer") -> DataFrame:
    qc, ac = qa_shape()
    return turns.select("conv_id", qc.alias(q), ac.alias(a))


# ---------------------------------------------------------------- converters
def convert_sharegpt(col: str = "conversations") -> Column:
    """H1 = B7 + B8: unknown speaker or blank turn rejects the conversation."""
    roles = F.create_map(*[x for k, v in SHAREGPT_ROLES.items() for x in (F.lit(k), F.lit(v))])
    m = F.transform(col, lambda t: _msg(F.try_element_at(roles, t["from"]),
                                        py_strip(F.coalesce(t["value"], F.lit("")))))
    return _all_or_null(m, lambda x: x["role"].isNotNull() & (F.length(x["content"]) > 0))


def convert_messages(col: str = "messages") -> Column:
    """H2: roles limited to system/user/assistant, content stripped, non-empty."""
    m = F.transform(col, lambda t: _msg(t["role"], py_strip(F.coalesce(t["content"], F.lit("")))))
    return _all_or_null(m, lambda x: F.coalesce(x["role"].isin(*CHAT_ROLES), F.lit(False))
                        & (F.length(x["content"]) > 0))


def convert_pairs(col: str = "conversation") -> Column:
    """H3: each {input, output} -> user turn, assistant turn; blanks reject."""
    pairs = F.transform(col, lambda t: F.struct(
        py_strip(F.coalesce(t["input"], F.lit(""))).alias("u"),
        py_strip(F.coalesce(t["output"], F.lit(""))).alias("a")))
    ok = F.forall(pairs, lambda p: (F.length(p["u"]) > 0) & (F.length(p["a"]) > 0))
    m = F.flatten(F.transform(pairs, lambda p: F.array(_msg("user", p["u"]),
                                                      _msg("assistant", p["a"]))))
    return F.when(ok, m)


def convert_qa(q: str, a: str) -> Column:
    """H4: two columns -> two turns, no strip and no blank check. A null
    column drops the row (the reference would raise)."""
    return F.when(F.col(q).isNotNull() & F.col(a).isNotNull(),
                  F.array(_msg("user", F.col(q)), _msg("assistant", F.col(a))))


QA_COLUMNS = {
    "qa_problem_solution": ("problem", "solution"),
    "qa_query_response": ("query", "response"),
    "qa_question_answer": ("question", "answer"),
}


def shape_messages(turns: DataFrame, names=None) -> DataFrame:
    """H5 once per raw shape: ``datasets array<string>, pos, messages`` (null
    messages = rejected by the converter). Datasets of one shape read the same
    conversation rows here, so each shape is converted (and later encoded)
    once and its datasets are fanned out afterwards.

    One projection, not a union of branches: the conversation rows are fanned
    out to the (at most four) shapes and each row takes its converter by a
    CASE, which builds that shape only."""
    names = list(DATASETS) if names in (None, "all") else list(names)
    unknown = [n for n in names if n not in DATASETS]
    if unknown:
        raise ValueError(f"unknown dataset(s) {unknown}; available: {', '.join(DATASETS)}")
    of_shape: dict[str, list[str]] = {}
    for n in names:
        shape = DATASETS[n][0]
        of_shape.setdefault("qa" if shape in QA_COLUMNS else shape, []).append(n)
    d = turns.select(F.col("conv_id").alias("pos"), "turns", F.explode(F.array(*[
        F.struct(F.lit(k).alias("shape"), F.array(*map(F.lit, v)).alias("datasets")) for k, v in of_shape.items()])).alias("_s"))
    qc, ac = qa_shape()
    d = d.withColumn("conversations", sharegpt_shape()).withColumn("_msgs", messages_shape()) \
        .withColumn("conversation", pairs_shape()).withColumn("_q", qc).withColumn("_a", ac)
    shape = F.col("_s.shape")
    conv = F.when(shape == "sharegpt", convert_sharegpt("conversations")) \
        .when(shape == "messages", convert_messages("_msgs")) \
        .when(shape == "pairs", convert_pairs("conversation")) \
        .otherwise(convert_qa("_q", "_a"))
    return d.select(F.col("_s.datasets").alias("datasets"), "pos", conv.alias("messages"))


def registry_messages(turns: DataFrame, names=None) -> DataFrame:
    """H5 + G1: every selected registry dataset's conversations in one bag:
    ``dataset, pos, messages``."""
    return shape_messages(turns, names).select(F.explode("datasets").alias("dataset"), "pos", "messages")


def dataset_counts(names=None, limit: int | None = None) -> dict:
    """E4 quota per dataset: ``limit or default_count`` (0 means default)."""
    names = list(DATASETS) if names in (None, "all") else list(names)
    return {n: (limit or DATASETS[n][1]) for n in names}


# ---------------------------------------------------------------- validity
def valid_conversation(col: str = "messages") -> Column:
    """>= 2 messages (system included); the last non-system role is
    assistant; some user turn exists. Alternation is not required."""
    m = F.col(col)
    non_sys = F.filter(m, lambda x: x["role"] != "system")
    return F.coalesce(
        (F.size(m) >= 2)
        & (F.try_element_at(non_sys, F.lit(-1))["role"] == "assistant")
        & F.exists(m, lambda x: x["role"] == "user"),
        F.lit(False))


def merge_system(col: str = "messages") -> Column:
    """H6: a *leading* system text is stripped and prefixed as
    ``{sys}\\n\\n{user}`` to the first user turn; dropped when empty or when
    the next turn is not a user turn. The user text is not stripped here."""
    m = F.col(col)
    first = F.try_element_at(m, F.lit(1))
    rest = F.slice(m, 2, F.greatest(F.size(m) - 1, F.lit(0)))
    sys = py_strip(first["content"])
    nxt = F.try_element_at(rest, F.lit(1))
    merged_head = _msg("user", F.concat(sys, F.lit("\n\n"), nxt["content"]))
    merged = F.concat(F.array(merged_head), F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0))))
    can_merge = (F.length(sys) > 0) & (F.size(rest) > 0) & (nxt["role"] == "user")
    return F.when(m.isNull(), m).when(
        F.coalesce(first["role"] == "system", F.lit(False)),
        F.when(F.coalesce(can_merge, F.lit(False)), merged).otherwise(rest)).otherwise(m)


# The template's tags, here and in tokenize_conversation.
def format_prompt(col: str = "messages", merge: bool = True) -> Column:
    """H7: ``[INST] {user} [/INST]`` and `` {assistant}</s>``, joined, no BOS.
    ``merge=False`` renders turn-wise without folding the system text in
    (system turns then contribute nothing)."""
    m = merge_system(col) if merge else F.col(col)
    return F.array_join(F.transform(m, lambda x: F.when(
        x["role"] == "user", F.concat(F.lit("[INST] "), py_strip(x["content"]), F.lit(" [/INST]")))
        .when(x["role"] == "assistant", F.concat(F.lit(" "), py_strip(x["content"]), F.lit("</s>")))
        .otherwise(F.lit(""))), "")


def tokenize_conversation(df: DataFrame, encoder, col: str = "messages",
                          max_length: int | None = None, drop=None) -> DataFrame:
    """H8: ``ids`` = BOS + per-turn pieces (each turn encoded separately);
    ``mask`` 1 on assistant tokens and their EOS, else 0. Other roles (a
    non-leading system turn) are skipped. ``max_length`` = B15. ``drop``:
    input columns not needed afterwards (not shipped through Arrow)."""
    m = merge_system(col)
    d = df.withColumn("_m", m).withColumn("_turn_text", F.transform("_m", lambda x: F.when(
        x["role"] == "user", F.concat(F.lit("[INST] "), py_strip(x["content"]), F.lit(" [/INST]")))
        .when(x["role"] == "assistant", py_strip(x["content"])).otherwise(F.lit(""))))
    d = d.withColumn("_roles", F.transform("_m", lambda x: x["role"]))
    d = encoder.encode_column(d, F.col("_turn_text"), "_turn_ids",
                              drop=["_m", "_turn_text", *(drop or [])])
    parts = F.arrays_zip(F.col("_roles").alias("r"), F.col("_turn_ids").alias("p"))

    def piece_ids(z):
        r = z["r"]
        return F.when(r == "assistant", F.concat(z["p"], F.array(F.lit(EOS_ID)))) \
            .when(r == "user", z["p"]).otherwise(F.array().cast("array<int>"))

    def piece_mask(z):
        r = z["r"]
        return F.when(r == "assistant", F.array_repeat(F.lit(1).cast("tinyint"), F.size(z["p"]) + 1)) \
            .when(r == "user", F.array_repeat(F.lit(0).cast("tinyint"), F.size(z["p"]))) \
            .otherwise(F.array().cast("array<tinyint>"))

    ids = F.concat(F.array(F.lit(BOS_ID)), F.flatten(F.transform(parts, piece_ids)))
    mask = F.concat(F.array(F.lit(0).cast("tinyint")), F.flatten(F.transform(parts, piece_mask)))
    d = d.withColumn("ids", ids).withColumn("mask", mask).drop("_roles", "_turn_ids")
    if max_length is not None:
        d = truncate_right(truncate_right(d, max_length, "ids"), max_length, "mask")
    return d


# ---------------------------------------------------------------- B5, B13-B15
def filter_max_tokens(df: DataFrame, max_tokens: int = MAX_TOKENS_PER_CONVERSATION,
                      col: str = "ids") -> DataFrame:
    """Conversations over ``max_tokens`` are skipped, never truncated."""
    return df.filter(F.size(col) <= max_tokens)


def truncate_left(df: DataFrame, n: int, col: str = "ids") -> DataFrame:
    """Keep the last ``n`` ids."""
    c = F.col(col)
    return df.withColumn(col, F.when(F.size(c) > n, F.slice(c, -n, n)).otherwise(c))


def truncate_right(df: DataFrame, n: int, col: str = "ids") -> DataFrame:
    """Keep the first ``n`` ids."""
    return df.withColumn(col, F.slice(F.col(col), 1, n))


def mask_targets(y: Column, mask: Column) -> Column:
    """Target -1 where the mask is 0."""
    return F.zip_with(y, mask, lambda t, m: F.when(m == 0, F.lit(-1)).otherwise(t))


# ---------------------------------------------------------------- E4, D5, D6
def first_n_valid(df: DataFrame, counts: dict, max_tokens: int = MAX_TOKENS_PER_CONVERSATION,
                  bucket_width: int = DEFAULT_BUCKET_WIDTH) -> DataFrame:
    """E4 + D5 flags: rows in ``pos`` order per dataset; a row is *processed*
    while fewer than ``count`` rows were collected before it. Adds
    ``is_valid, too_long, processed, taken``. Input needs ``ids``
    (null/absent for invalid rows) and ``messages``."""
    spark = df.sparkSession
    cnt = spark.createDataFrame(list(counts.items()), "dataset string, _quota bigint")
    valid = valid_conversation("messages")
    too_long = F.coalesce(F.size("ids") > max_tokens, F.lit(False))
    d = (df.join(F.broadcast(cnt), "dataset")  # one row per registry dataset
           .withColumn("is_valid", F.col("is_valid") if "is_valid" in df.columns else valid)
           .withColumn("too_long", F.col("is_valid") & too_long)
           .withColumn("_pass", (F.col("is_valid") & ~F.col("too_long")).cast("int")))
    d = running_sums(d, ["dataset"], "pos", {"_npass": F.col("_pass")}, bucket_width)
    d = d.withColumn("processed", (F.col("_npass") - F.col("_pass")) < F.col("_quota"))
    d = d.withColumn("taken", F.col("processed") & (F.col("_pass") == 1))
    return d.drop("_pass", "_npass", "_quota")


def collect_skips(flagged: DataFrame) -> DataFrame:
    """Collected, skipped-invalid, skipped-too-long per dataset, counted
    only over processed rows (counting stops where the quota fills)."""
    p = F.col("processed")
    return flagged.groupBy("dataset").agg(
        F.sum((p & F.col("taken")).cast("int")).cast("bigint").alias("collected"),
        F.sum((p & ~F.col("is_valid")).cast("int")).cast("bigint").alias("skipped_invalid"),
        F.sum((p & F.col("too_long")).cast("int")).cast("bigint").alias("skipped_long"))


def split_stats(df: DataFrame, keys=("split",)) -> DataFrame:
    """Tokens, trainable tokens, examples and trainable % per split."""
    a = df.groupBy(*keys).agg(
        F.sum(F.size("ids")).cast("bigint").alias("tokens"),
        F.sum(F.aggregate("mask", F.lit(0).cast("bigint"), lambda acc, x: acc + x))
        .cast("bigint").alias("trainable_tokens"),
        F.count(F.lit(1)).cast("bigint").alias("examples"))
    return a.withColumn("trainable_pct", F.round(F.try_divide(
        F.col("trainable_tokens") * 100.0, F.col("tokens").cast("double")), 6))
