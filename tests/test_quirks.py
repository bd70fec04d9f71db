"""Literal-row tests for the quirks of SURVEY §2 / FIXTURES §4."""

import math

from pyspark.sql import functions as F

from quillspark.functions.text import py_strip
from quillspark.operators import chat as H
from quillspark.operators import corpus as C
from quillspark.operators import evalops as V
from quillspark.operators import sample as S
from quillspark.operators import stats as T
from quillspark.operators.encode import Encoder


def _docs(spark, ests, dataset="d"):
    return spark.createDataFrame([(dataset, i, e) for i, e in enumerate(ests)],
                                 "dataset string, pos long, est long")


def test_budget_stops_at_first_overflow(spark):
    got = C.token_budget(_docs(spark, [4, 9, 1]), 6).orderBy("pos").collect()
    assert [r.pos for r in got] == [0]


def test_budget_zero_estimates_pass_at_limit(spark):
    got = C.token_budget(_docs(spark, [3, 0, 3, 0]), 6).collect()
    assert sorted(r.pos for r in got) == [0, 1, 2, 3]


def test_budget_none_is_unlimited(spark):
    assert C.token_budget(_docs(spark, [5, 5, 5]), None).count() == 3


def test_two_phase_equals_plain_window(spark):
    from pyspark.sql import Window
    rows = [(f"s{i % 3}", i, (i * 37) % 11) for i in range(600)]
    df = spark.createDataFrame(rows, "dataset string, pos long, est long")
    two = C.token_budget(df, 300, bucket_width=17).select("dataset", "pos", "cum_tokens")
    w = Window.partitionBy("dataset").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    one = df.withColumn("cum_tokens", F.sum("est").over(w)).filter("cum_tokens <= 300") \
        .select("dataset", "pos", "cum_tokens")
    assert two.exceptAll(one).count() == 0 and one.exceptAll(two).count() == 0


def test_val_every_n_skips_empty_text(spark):
    df = spark.createDataFrame([("d", 0, ""), ("d", 1, "a"), ("d", 2, "b")],
                               "dataset string, pos long, text string")
    got = {r.text: r.is_val for r in C.val_every_n(C.filter_nonempty(df), 2).collect()}
    assert got == {"a": True, "b": False}


def test_strip_is_python_strip(spark):
    r = spark.createDataFrame([("\t a  ",), ("　x ",)], "s string") \
        .select(py_strip("s").alias("t")).collect()
    assert [x.t for x in r] == ["a", "x"]


def _msgs(spark, convs):
    rows = [(i, [{"role": r, "content": c} for r, c in m]) for i, m in enumerate(convs)]
    return spark.createDataFrame(rows, "pos long, messages array<struct<role:string,content:string>>")


def _sharegpt(spark, convs):
    rows = [(i, [{"from": r, "value": c} for r, c in m]) for i, m in enumerate(convs)]
    return spark.createDataFrame(rows, "pos long, conversations array<struct<from:string,value:string>>")


def test_unknown_role_drops_conversation(spark):
    d = _sharegpt(spark, [[("human", "hi"), ("tool", "x"), ("gpt", "ok")], [("human", "hi"), ("gpt", "ok")]])
    got = [r.m for r in d.select(H.convert_sharegpt().alias("m")).orderBy("pos").collect()]
    assert got[0] is None and len(got[1]) == 2


def test_blank_turn_drops_conversation(spark):
    d = _msgs(spark, [[("user", "   "), ("assistant", "ok")]])
    assert d.select(H.convert_messages().alias("m")).first().m is None


def test_valid_conversation_rules(spark):
    d = _msgs(spark, [[("system", "s"), ("assistant", "a")],
                      [("user", "u"), ("user", "u"), ("assistant", "a")],
                      [("user", "u"), ("assistant", "a"), ("system", "s")]])
    got = [r.v for r in d.select("pos", H.valid_conversation().alias("v")).orderBy("pos").collect()]
    assert got == [False, True, True]


def test_merge_system(spark):
    d = _msgs(spark, [[("system", " be brief "), ("user", "hi "), ("assistant", "a")],
                      [("system", "s"), ("assistant", "a")]])
    got = d.select("pos", H.merge_system().alias("m")).orderBy("pos").collect()
    assert got[0].m[0].content == "be brief\n\nhi " and got[0].m[0].role == "user"
    assert [x.role for x in got[1].m] == ["assistant"]


def test_conversation_mask(spark):
    enc = Encoder(["hi", "ok", "[", "INST", "]", " [", "/", " hi"], vocab_size=11)
    d = _msgs(spark, [[("user", "hi"), ("assistant", "ok")]])
    r = H.tokenize_conversation(d, enc).first()
    assert r.ids[0] == 1 and r.mask[0] == 0 and r.ids[-1] == 2 and r.mask[-1] == 1
    n_user = len(r.ids) - 3  # BOS, "ok", EOS
    assert list(r.mask) == [0] + [0] * n_user + [1, 1]


def test_quota_stops_counting(spark):
    cand = spark.createDataFrame(
        [("tulu", 0, True, [1, 2]), ("tulu", 1, False, None)],
        "dataset string, pos long, is_valid boolean, ids array<int>")
    fl = H.first_n_valid(cand, {"tulu": 1})
    r = H.collect_skips(fl).first()
    assert (r.collected, r.skipped_invalid, r.skipped_long) == (1, 0, 0)


def test_limit_zero_means_default():
    assert H.dataset_counts(["tulu"], 0) == {"tulu": 15_000}


def test_argmax_ties_lowest(spark):
    s = spark.createDataFrame([("t", 1, 0, -1.0), ("t", 1, 1, -1.0)],
                              "task string, item_id long, choice_idx int, score double")
    assert V.argmax_first(s).first().pred == 0


def test_windows_never_start_in_short_file(spark):
    from quillspark.operators.pack import chunk_table, stream_lengths
    docs = spark.createDataFrame([("a", "train", 0, list(range(5))),
                                  ("b", "train", 0, list(range(100, 200)))],
                                 "dataset string, split string, start long, ids array<int>")
    ch = chunk_table(docs, ["dataset", "split"], "start", ("ids",), chunk_size=16)
    lengths = stream_lengths(ch, ["dataset", "split"])
    w = S.sample_windows(S.step_plan(spark, 1, 4, 2, 8), ch, lengths, ["dataset", "split"], 8,
                         chunk_size=16, plan_rows=64).collect()
    assert len(w) == 64 and all(r.dataset == "b" for r in w)
    assert all(list(r.x[1:]) == list(r.y[:-1]) for r in w)


def test_fully_masked_window_flagged(spark):
    from quillspark.operators.pack import chunk_table
    docs = spark.createDataFrame([("train", 0, list(range(3, 60)), [0] * 57)],
                                 "split string, start long, ids array<int>, mask array<tinyint>")
    ch = chunk_table(docs, ["split"], "start", ("ids", "mask"), chunk_size=16)
    w = S.sample_windows_masked(S.step_plan(spark, 1, 1, 1, 2), ch, {"split": "train"}, 8,
                                chunk_size=16, plan_rows=2).collect()
    assert all(r.fully_masked for r in w) and all(set(r.y) == {-1} for r in w)


def test_arc_label(spark):
    d = spark.createDataFrame([("3",), ("c",)], "k string")
    assert [r.g for r in d.select(V.normalize_label("k").alias("g")).collect()] == [2, 2]


def test_gsm8k_numbers(spark):
    d = spark.createDataFrame([(1, "x #### -1,234", "so -1234 it is"), (2, "no marker", "1")],
                              "item_id long, answer string, completion string")
    g = V.extract_pred_number(V.extract_gold_number(d)).collect()
    assert len(g) == 1 and g[0].gold_number == "-1234" and g[0].is_correct


def test_fill_blank_replaces_all(spark):
    d = spark.createDataFrame([("_ and _", "a")], "s string, o string")
    assert d.select(F.replace("s", F.lit("_"), F.col("o")).alias("t")).first().t == "a and a"


def test_left_truncation_context_length(spark):
    d = spark.createDataFrame([(list(range(13)), list(range(10)))], "ids array<int>, ctx_ids array<int>")
    r = V.truncate_for_scoring(d, 5).first()
    assert len(r.ids) == 5 and r.ctx_len == 2 and len(r.ids) - r.ctx_len == 3


def test_val_ppl_inf(spark):
    b = spark.createDataFrame([(10.0,)], "loss double")
    assert math.isinf(T.val_loss_ppl(b).first().val_ppl)


def test_best_so_far_flags(spark):
    m = spark.createDataFrame([("r", i + 1, x) for i, x in enumerate([3.0, 2.0, 2.0, 1.0])],
                              "run string, step long, loss double")
    got = [r.improved for r in T.best_so_far(m, bucket_width=2).orderBy("step").collect()]
    assert got == [True, True, False, True]


def test_stop_truncate(spark):
    d = spark.createDataFrame([("abc\ndef. g",)], "t string")
    assert d.select(V.stop_truncate(F.col("t"), ["\n", "."]).alias("x")).first().x == "abc"
