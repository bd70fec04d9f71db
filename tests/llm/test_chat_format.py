import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import chat_format as cf

LOG = "conv_id bigint, turn bigint, copy int, seq int, role string, op string, text string"


def test_escape_is_reverted_and_leaves_no_marks(spark):
    bits = [*cf.CONTROL, cf.ESCAPE, "0", "a", "l", "<", ">", "|", "[", "\n", "x", ""]
    texts = [a + b + c for a in bits for b in bits for c in ("", "0", "</s>", cf.ESCAPE)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cf.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", cf.unescape(F.col("e")).alias("u")).collect():
        assert r["u"] == r["t"] and not any(m in r["e"] for m in cf.CONTROL)


def test_fold_of_deltas_edits_and_regenerations(spark):
    log = spark.createDataFrame([
        (1, 0, 1, 0, "user", "delta", "draft"), (1, 0, 1, 1, None, "edit", "Hi"), (1, 0, 1, 2, "user", "delta", " there"),
        (1, 1, 1, 3, "assistant", "delta", "wrong"), (1, 1, 1, 4, "assistant", "regenerate", None),
        (1, 1, 1, 6, "assistant", "delta", "!"), (1, 1, 1, 5, "assistant", "delta", "Hello"),
        (1, 200, 1, 7, None, "delta", None), (2, None, 1, 0, "assistant", "delta", "no turn"),
        (2, 0, 1, 0, "user", "delta", "a"), (2, 0, 2, 0, "user", "delta", "a")], LOG).repartition(5)
    out = {(r["conv_id"], r["turn"], r["copy"]): (r["role"], r["text"]) for r in cf.messages(log).collect()}
    assert out == {(1, 0, 1): ("user", "Hi there"), (1, 1, 1): ("assistant", "Hello!"), (1, 200, 1): ("", ""),
                   (2, None, 1): ("assistant", "no turn"), (2, 0, 1): ("user", "a"), (2, 0, 2): ("user", "a")}
    rows = {r["conv_id"]: r for r in cf.digests(cf.format_conversations(log)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert rows[1]["n_turns"] == 3 and rows[1]["turns_sha256"] == sha("user\nHi there\nassistant\nHello!\n\n\n")
    assert rows[1]["loss_sha256"] == sha("Hello!") and rows[1]["loss_chars"] == 6
    assert rows[2]["turns_sha256"] == sha("assistant\nno turn\nuser\na\nuser\na\n")


def test_parts_of_a_long_conversation(spark):
    n = 5 * cf.PART_TURNS + 3
    df = spark.range(n).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.expr("if(id % 2 = 0, 'user', 'assistant')").alias("role"),
                               F.expr("concat('t\n', id, '<|end|>')").alias("text"), F.lit("clash").alias("part"))
    parts = cf.format_conversations(cf.conversation_log(df)).cache()
    assert parts.count() == 6
    row = cf.digests(parts).first()
    roles = ["user", "assistant"]
    want = "".join(f"{roles[i % 2]}\nt\n{i}<|end|>\n" for i in range(n))
    assert row["n_turns"] == n and row["turns_sha256"] == hashlib.sha256(want.encode()).hexdigest()
    assert row["loss_sha256"] == hashlib.sha256("".join(f"t\n{i}<|end|>" for i in range(1, n, 2)).encode()).hexdigest()


@settings(max_examples=3, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["user", "assistant", None, "a\nb", "<|end|>"]),
                          st.one_of(st.none(), st.text(st.sampled_from("ab<|end>␛0\n/s[INST] é😀"), max_size=12))), min_size=1, max_size=20))
def test_any_conversations_read_back(spark, turns):
    rows = [(c, i, r, t) for i, (c, r, t) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for r in cf.digests(cf.format_conversations(cf.conversation_log(df))).collect():
        own = [(x[2] or "", x[3] or "") for x in rows if x[0] == r["conv_id"]]
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert r["loss_chars"] == sum(len(b) for a, b in own if a == "assistant")


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert cf.digests(cf.format_conversations(cf.conversation_log(df))).count() == 0
