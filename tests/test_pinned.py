"""Pinned numbers of FIXTURES.md §3 (sf0.01 unless stated)."""

from pyspark.sql import functions as F

from conftest import SF_CHECK
from quillspark.operators import chat as H
from quillspark.operators import corpus as C
from quillspark.session import table


def _corpus(spark, sf=SF_CHECK):
    return C.with_estimate(C.filter_nonempty(C.corpus_from_documents(table(spark, sf, "documents"))))


def _docs_tokens(df):
    r = df.agg(F.count(F.lit(1)).alias("n"), F.sum("est").alias("t")).first()
    return r.n, r.t


def test_min_chars_and_estimate(spark):
    d = C.corpus_from_documents(table(spark, SF_CHECK, "documents"))
    assert C.filter_min_chars(d, 50).count() == 988
    assert C.with_estimate(d).agg(F.sum("est")).first()[0] == 602_096


def test_budget_per_source(spark):
    assert _docs_tokens(C.token_budget(_corpus(spark), 5_000, bucket_width=64)) == (164, 92_812)


def test_budget_over_all(spark):
    d = _corpus(spark).withColumn("all", F.lit("all"))
    assert _docs_tokens(C.token_budget(d, 100_000, keys=("all",), bucket_width=100)) == (171, 98_816)
    d50 = C.filter_min_chars(d, 50)
    assert _docs_tokens(C.token_budget(d50, 100_000, keys=("all",))) == (168, 98_795)


def test_val_every_n_counts(spark):
    assert C.val_every_n(_corpus(spark), 100).filter("is_val").count() == 20
    assert C.val_every_n(_corpus(spark), 10, bucket_width=32).filter("is_val").count() == 100


def test_conversation_counts(spark):
    turns = H.collect_turns(table(spark, SF_CHECK, "conversations"))
    m = H.as_messages(turns)
    assert m.count() == 100
    assert m.filter(H.valid_conversation("messages")).count() == 54
    lead_sys = m.filter(F.col("messages")[0]["role"] == "system").count()
    assert lead_sys == 24


def test_budget_sf01(spark):
    got = _docs_tokens(C.token_budget(_corpus(spark, "/root/testdata/sf0.1"), 100_000,
                                      bucket_width=500))
    assert got == (3_097, 1_988_817)


def test_turnwise_chat_text_chars(spark):
    m = H.as_messages(H.collect_turns(table(spark, SF_CHECK, "conversations")))
    total = m.select(F.sum(F.length(H.format_prompt("messages", merge=False)))).first()[0]
    assert total == 284_943


def test_encoder_piece_total(spark):
    from quillspark.functions.text import pieces
    from quillspark.operators.encode import piece_counts
    docs = table(spark, SF_CHECK, "documents")
    assert piece_counts(docs, "text").agg(F.sum("n")).first()[0] == 497_333
    assert docs.select(F.sum(F.size(pieces("text")))).first()[0] == 497_333


def test_role_counts(spark):
    c = table(spark, SF_CHECK, "conversations")
    got = {r.role: r.n for r in c.groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"user": 279, "assistant": 233, "system": 24}
