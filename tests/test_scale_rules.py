"""Null keys, many buckets, shared storage, unknown ids, streams that go on."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.operators import corpus as C
from quillspark.operators import encode as J
from quillspark.operators import ordered as O
from quillspark.operators import stats as T
from quillspark.session import checkpoint_dir, scratch_path
from quillspark.streaming import stateful as SS


def test_null_keys_equal_the_plain_window(spark):
    rows = [(None, 1, 5), (None, 9, 7), ("a", 2, 1), ("a", 3, 2), (None, 5, 1), ("b", None, 4), ("b", 1, 3)]
    df = spark.createDataFrame(rows, "dataset string, pos bigint, v bigint")
    w = Window.partitionBy("dataset").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    want = sorted(map(str, df.withColumn("cum", F.sum("v").over(w)).collect()))
    for width in (1, 2, 3, 100):
        assert sorted(map(str, O.running_sum(df, ["dataset"], "pos", "v", bucket_width=width).collect())) == want
    before = Window.partitionBy("dataset").orderBy("pos")
    want = sorted(map(str, df.withColumn("m", F.min("v").over(before.rowsBetween(Window.unboundedPreceding, -1))).collect()))
    assert sorted(map(str, O.running_min(df, ["dataset"], "pos", "v", "m", bucket_width=2).collect())) == want
    want = sorted(map(str, df.withColumn("p", F.lag("v").over(before)).collect()))
    assert sorted(map(str, O.previous(df, ["dataset"], "pos", "v", "p", bucket_width=2).collect())) == want


def test_budget_keeps_null_datasets(spark):
    df = spark.createDataFrame([(None, 1, 3), (None, 2, 3), (None, 3, 3), ("a", 1, 9)], "dataset string, pos bigint, est bigint")
    out = C.token_budget(df, 6, bucket_width=1)
    assert sorted((r.dataset or "", r.pos) for r in out.collect()) == [("", 1), ("", 2)]


def test_a_cluster_without_a_shared_folder_is_refused(spark, monkeypatch):
    class Conf:
        def get(self, *_):
            return None

    class Context:
        master = "spark://somewhere:7077"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(Session())


def test_ids_outside_the_vocabulary_decode_to_nothing(spark):
    enc = J.Encoder(["a", " b", "c"], vocab_size=6)
    df = spark.createDataFrame([([3, 9, -4, 5, 2],), (None,), ([],)], "ids array<int>")
    assert [r.t for r in enc.decode(df, "ids", "t").collect()] == ["ac", None, ""]
    assert [r.t for r in enc.decode(df, "ids", "t", skip_special=False).collect()] == ["ac</s>", None, ""]


def test_join_encoder_equals_the_broadcast_encoder(spark):
    texts = spark.createDataFrame([(1, "a b a"), (2, "c, a"), (3, ""), (4, None), (5, "a b a")], "k int, text string")
    fitted = J.Encoder.fit(texts.filter("length(text) > 0"), "text", 5)
    joined = J.JoinEncoder(J.build_vocab(texts.filter("length(text) > 0"), "text", 5), 5)
    rows = lambda d: sorted(map(str, d.collect()))
    a, b = (e.encode(texts.filter("text is not null"), "text", "ids", add_eos=True) for e in (fitted, joined))
    assert rows(a.select("k", "ids")) == rows(b.select("k", "ids"))
    assert rows(fitted.decode(a, "ids", "d").select("k", "d")) == rows(joined.decode(b, "ids", "d").select("k", "d"))
    pairs = F.array("text", F.lit("a c"))
    filled = texts.filter("text is not null")
    a, b = (e.encode_column(filled, pairs, "e").select("k", "e") for e in (fitted, joined))
    assert rows(a) == rows(b)


def test_external_encoder_is_loaded_once_per_worker(spark):
    loads = spark.sparkContext.accumulator(0)

    def factory():
        loads.add(1)
        return lambda t: [len(w) for w in t.split()]

    df = spark.createDataFrame([(f"a bb {'c' * i}",) for i in range(64)], "text string").repartition(16)
    out = J.PandasEncoder(factory).encode(df).collect()
    assert all(r.ids == [len(w) for w in r.text.split()] for r in out)
    assert 1 <= loads.value < 16  # once for each worker of local[4], not for each of the 16 tasks


def test_a_busy_hour_is_spread_and_numbered(spark):
    ev = spark.range(5000).select(F.lit("r").alias("event_type"), F.timestamp_micros(F.col("id") % 7).alias("ts"),
                                  F.col("id").alias("event_id"), F.col("id").cast("double").alias("value"))
    m = T.run_metrics(ev, rows_per_bucket=200)
    want = {r.event_id: i + 1 for i, r in enumerate(ev.orderBy("ts", "event_id").collect())}
    assert {r.event_id: r.step for r in m.collect()} == want
    parts = O.range_buckets(ev.withColumn("_us", F.unix_micros("ts")), ["event_type", "_us", "event_id"], 200)
    assert parts.groupBy("_part").count().agg(F.max("count")).first()[0] < 1000


def test_streams_go_on_and_refuse_to_go_back(spark):
    rows = [("a", i, 3) for i in range(10)] + [(None, i, 4) for i in range(10)]
    df = spark.createDataFrame(rows, "dataset string, pos bigint, est bigint")
    root, path = scratch_path(spark, "t-src"), scratch_path(spark, "t-out")
    step = SS.budget_step(20, 3)
    run = lambda: SS.run_steps(spark, SS.read_ordered_files(spark, root, df.schema), step, SS.BUDGET_OUT, SS.BUDGET_STATE, path)
    src = root + "/parts"
    df.filter("pos < 4").coalesce(1).write.parquet(src)
    first = run().count()
    df.filter("pos between 4 and 7").coalesce(1).write.mode("append").parquet(src)  # a restart from the checkpoint
    second = run()
    want = C.val_every_n(C.token_budget(df, 20), 3).select("dataset", "pos", "est", "cum_tokens", "doc_index", "is_val")
    assert first == 8 and sorted(map(str, second.collect())) == sorted(map(str, want.filter("pos < 8").collect()))
    df.filter("pos = 2").coalesce(1).write.mode("append").parquet(src)
    with pytest.raises(Exception, match="went back"):
        run()


def test_throughput_goes_on_between_batches(spark):
    at = lambda s: f"2024-01-01 00:00:{s:02d}"
    rows = [("a", i, at(t), float(-i)) for i, t in enumerate((0, 2, 2, 6, 7, 17))] + [(None, 10 + i, at(t), 1.0) for i, t in enumerate((1, 3))]
    df = spark.createDataFrame(rows, "run string, event_id bigint, ts string, loss double").withColumn("ts", F.to_timestamp("ts"))
    root, path = scratch_path(spark, "t-runs"), scratch_path(spark, "t-runs-out")
    run = lambda: SS.run_steps(spark, SS.read_ordered_files(spark, root, df.schema), SS.run_step(100), SS.RUN_OUT, SS.RUN_STATE, path)
    df.filter("event_id in (0, 1, 10)").coalesce(1).write.parquet(root + "/parts")
    run()
    df.filter("event_id not in (0, 1, 10)").coalesce(1).write.mode("append").parquet(root + "/parts")
    got = {r.event_id: (r.step, r.tokens_per_sec, r.tokens_seen) for r in run().collect()}
    assert got == {0: (1, None, 100), 1: (2, 50.0, 200), 2: (3, None, 300), 3: (4, 25.0, 400), 4: (5, 100.0, 500), 5: (6, 10.0, 600),
                   10: (1, None, 100), 11: (2, 50.0, 200)}
    # the same time again, but an earlier event
    late = spark.createDataFrame([("a", 4, at(17), 0.0)], "run string, event_id bigint, ts string, loss double").withColumn("ts", F.to_timestamp("ts"))
    late.coalesce(1).write.mode("append").parquet(root + "/parts")
    with pytest.raises(Exception, match="went back"):
        run()
