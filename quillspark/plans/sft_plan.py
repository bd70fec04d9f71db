"""Instruction data: conversations -> converters -> validity -> tokenize with
loss mask -> first-N per dataset -> seeded shuffle -> val/train split ->
packed masked streams (chunk tables)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators import chat as H
from quillspark.operators.ordered import running_sums
from quillspark.operators.sample import fraction_split, hash_bucket, seeded_shuffle
from quillspark.operators.streams import DEFAULT_CHUNK, cut_streams
from quillspark.session import materialize


def sft_candidates(conversations: DataFrame, encoder, names=None) -> DataFrame:
    """``dataset, pos, is_valid, ids, mask`` for every registry dataset; ids
    and mask are null where the converter or B9 rejected the conversation
    (only valid conversations are encoded)."""
    turns = H.collect_turns(conversations)
    # converted and encoded once per raw shape, fanned out to its datasets from the stage
    msgs = H.shape_messages(turns, names)
    d = msgs.withColumn("is_valid", H.valid_conversation("messages"))
    d = d.withColumn("_enc", F.when(F.col("is_valid"), F.col("messages")))
    out = H.tokenize_conversation(d, encoder, "_enc", drop=["_enc", "messages"])
    # Stage output: E4's two-phase pass reads it twice; never tokenize twice.
    out = materialize(out, "sft-candidates")
    return out.select(F.explode("datasets").alias("dataset"), *[c for c in out.columns if c != "datasets"])


#: Rows encoded beyond what the pass rate so far asks for.
HEADROOM = 1.1


def quota_prefix(conversations: DataFrame, encoder, names=None, limit: int | None = None,
                 max_tokens: int = H.MAX_TOKENS_PER_CONVERSATION) -> DataFrame:
    """``dataset, pos, is_valid, ids, mask`` of as many first rows of each
    dataset as its quota needs (E4): rows are encoded in rounds, each a
    further stretch in ``pos`` order whose length follows from the share of
    valid rows that were short enough so far, until the quota is full or the
    rows are out. Only counts per raw shape come to the driver."""
    counts = H.dataset_counts(names, limit)
    msgs = H.shape_messages(H.collect_turns(conversations), names)
    msgs = materialize(msgs.withColumn("is_valid", H.valid_conversation("messages")).withColumn("shape", F.array_join("datasets", ",")), "sft-messages")
    valid = F.coalesce(F.col("is_valid"), F.lit(False)).cast("int")
    number = materialize(running_sums(msgs.select("shape", "pos", valid.alias("_valid")), ["shape"], "pos", {"_v": F.col("_valid")}).drop("_valid"), "sft-valid")
    left = {r["shape"]: r["n"] for r in number.groupBy("shape").agg(F.max("_v").alias("n")).collect()}
    quota = {k: max(counts[d] for d in k.split(",")) for k in left}
    reach = {k: math.ceil(HEADROOM * quota[k]) for k in left}
    done: dict = dict.fromkeys(left)  # place of the last row encoded
    passed, rounds, open_ = dict.fromkeys(left, 0), [], list(left)
    while open_:
        ends = {r["shape"]: r["pos"] for r in number.filter(_any(F.col("shape").eqNullSafe(F.lit(k)) & (F.col("_v") <= reach[k]) for k in open_))
                .groupBy("shape").agg(F.max("pos").alias("pos")).collect()}
        stretch = []
        for k in open_:
            own = F.col("shape") == k
            # rows without a place come first
            later = F.col("pos").isNotNull() if rounds else F.lit(True)
            if done[k] is not None:
                later = F.col("pos") > done[k]
            up_to = F.lit(True)
            if reach[k] < left[k]:
                up_to = F.col("pos").isNull() if ends.get(k) is None else F.coalesce(F.col("pos") <= ends[k], F.lit(True))
            own = own & later & up_to
            stretch.append(own)
        rows = msgs.filter(_any(stretch)).withColumn("_enc", F.when(F.col("is_valid"), F.col("messages")))
        rounds.append(materialize(H.tokenize_conversation(rows, encoder, "_enc", drop=["_enc", "messages"]), "sft-round"))
        fits = (valid == 1) & (F.size("ids") <= max_tokens)
        for r in rounds[-1].groupBy("shape").agg(F.count_if(fits).alias("n")).collect():
            passed[r["shape"]] += r["n"]
        open_ = [k for k in open_ if passed[k] < quota[k] and reach[k] < left[k]]
        for k in open_:
            done[k] = ends.get(k)
            share = max(passed[k], 1) / reach[k]
            reach[k] += math.ceil(HEADROOM * (quota[k] - passed[k]) / share)
    out = rounds[0] if rounds else materialize(H.tokenize_conversation(msgs.withColumn("_enc", F.col("messages")), encoder, "_enc", drop=["_enc", "messages"]), "sft-round")
    for r in rounds[1:]:
        out = out.unionByName(r)
    return out.select(F.explode("datasets").alias("dataset"), "pos", "is_valid", "ids", "mask")


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def sft_flagged(conversations: DataFrame, encoder, names=None, limit: int | None = None,
                max_tokens: int = H.MAX_TOKENS_PER_CONVERSATION) -> DataFrame:
    """E4 + D5 flags (``is_valid, too_long, processed, taken``) of the rows up
    to where the quotas fill; later rows are neither processed nor encoded."""
    cand = quota_prefix(conversations, encoder, names, limit, max_tokens)
    return H.first_n_valid(cand, H.dataset_counts(names, limit), max_tokens)


def sft_examples(conversations: DataFrame, encoder, names=None, limit: int | None = None,
                 quota: bool = False, max_tokens: int | None = None) -> DataFrame:
    """G1: ``dataset, pos, ids, mask`` of all datasets' valid conversations, of
    at most ``max_tokens`` tokens if given. With ``quota`` the first ones of
    each dataset, as E4 takes them (``limit``: rows per dataset instead of the
    registry's counts)."""
    if quota:
        ex = sft_flagged(conversations, encoder, names, limit, max_tokens or H.MAX_TOKENS_PER_CONVERSATION).filter("taken")
    else:
        ex = sft_candidates(conversations, encoder, names).filter(F.col("is_valid") & F.col("ids").isNotNull())
        if max_tokens:
            ex = H.filter_max_tokens(ex, max_tokens)
    return ex.select("dataset", "pos", "ids", "mask")


def sft_split(conversations: DataFrame, encoder, names=None, limit: int | None = None, quota: bool = False,
              max_tokens: int | None = None, val_fraction: float = 0.02, seed: int = H.SFT_SEED) -> DataFrame:
    """F3 + F4: the examples, shuffled and split."""
    ex = seeded_shuffle(sft_examples(conversations, encoder, names, limit, quota, max_tokens), seed, "dataset", "pos")
    return materialize(fraction_split(ex, val_fraction).withColumn("n_tokens", F.size("ids").cast("bigint")), "sft-split")


def sft_stream(split: DataFrame, chunk_size: int = DEFAULT_CHUNK) -> DataFrame:
    """H9 + E5: the packed ``split, chunk_id, tokens, mask`` chunk table, in
    shuffle order within each split."""
    return cut_streams(split, ["split"], "shuffle_key", ("ids", "mask"), chunk_size, ("tokens", "mask"), n_tokens="n_tokens",
                       bucket=hash_bucket(split.select("shuffle_key")))
