"""Invariants as queries on the driver's small tables."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from quillspark.operators import pack as K
from quillspark.plans import corpus_plan as CP
from quillspark.plans import registry as R
from quillspark.plans import sft_plan as SP
from quillspark.session import table


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns[:3] == ["dataset", "train_tokens", "val_tokens"]


def test_registry_has_sql_for_most(spark):
    import __spark_entry__ as E
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 100


def test_train_plus_val_is_all(spark):
    docs = table(spark, SF_SMALL, "documents")
    e = CP.encoded_corpus(docs, None, 10, R._encoder(spark, SF_SMALL))
    n_nonempty = docs.filter(F.length("text") > 0).count()
    by = {r.is_val: r.c for r in e.groupBy("is_val").agg(F.count(F.lit(1)).alias("c")).collect()}
    assert by[True] + by[False] == n_nonempty


def test_chunks_rebuild_stream(spark):
    docs = table(spark, SF_SMALL, "documents")
    e = CP.encoded_corpus(docs, None, 10, R._encoder(spark, SF_SMALL))
    ch = CP.corpus_streams(CP.encoded_stage(docs, None, R._encoder(spark, SF_SMALL)), chunk_size=97, val_every=10, bucket_width=50)
    total = e.agg(F.sum("n_tokens")).first()[0]
    assert ch.agg(F.sum(F.size("tokens"))).first()[0] == total
    # every chunk but the last of a stream is full
    last = ch.groupBy("dataset", "split").agg(F.max("chunk_id").alias("m"))
    short = ch.join(last, ["dataset", "split"]).filter(
        (F.col("chunk_id") < F.col("m")) & (F.size("tokens") != 97)).count()
    assert short == 0
    # rebuilt stream equals the plain concatenation for one stream
    one = e.filter((F.col("dataset") == "src0") & ~F.col("is_val")).orderBy("pos").collect()
    flat = [t for r in one for t in r.ids]
    rebuilt = [t for r in ch.filter((F.col("dataset") == "src0") & (F.col("split") == "train"))
               .orderBy("chunk_id").collect() for t in r.tokens]
    assert rebuilt == flat


def test_sft_mask_aligned_and_split_disjoint(spark):
    conv = table(spark, SF_SMALL, "conversations")
    enc = R._encoder(spark, SF_SMALL)
    sp = SP.sft_split(conv, enc, limit=5, quota=True)
    assert sp.filter(F.size("ids") != F.size("mask")).count() == 0
    val = sp.filter("split = 'val'").select("dataset", "pos")
    train = sp.filter("split = 'train'").select("dataset", "pos")
    assert val.intersect(train).count() == 0
    assert val.count() >= 1 and val.count() + train.count() == sp.count()
    ch = SP.sft_stream(sp, 64)
    lens = K.stream_lengths(ch, ["split"], "tokens", "mask").collect()
    assert sum(r.total_tokens for r in lens) == sp.agg(F.sum(F.size("ids"))).first()[0]


def test_windows_are_shifted_slices(spark):
    w = R._windows(spark, SF_SMALL).collect()
    assert len(w) == R._PLAN_ROWS
    assert all(len(r.x) == R.BLOCK and list(r.x[1:]) == list(r.y[:-1]) for r in w)


def test_stream_equals_batch(spark):
    s = R.q_stream_budget(spark, SF_SMALL)
    b = R.q_token_budget(spark, SF_SMALL)
    assert s.exceptAll(b).count() == 0 and b.exceptAll(s).count() == 0


def test_run_stream_equals_batch(spark):
    s = R.q_stream_run_metrics(spark, SF_SMALL)
    best = s.drop("tokens_per_sec", "tokens_seen")
    b = R.q_best_so_far(spark, SF_SMALL)
    assert best.exceptAll(b).count() == 0 and b.exceptAll(best).count() == 0
    rate = s.select("run", "step", "tokens_per_sec", "tokens_seen")
    t = R.q_throughput(spark, SF_SMALL)
    assert rate.exceptAll(t).count() == 0 and t.exceptAll(rate).count() == 0


def test_budget_is_tight(spark):
    """Admitted tokens <= budget, and the next document would pass it."""
    from quillspark.operators import corpus as C
    docs = C.with_estimate(C.filter_nonempty(C.corpus_from_documents(table(spark, SF_SMALL, "documents"))))
    budget = 3000
    adm = C.token_budget(docs, budget, bucket_width=7)
    last = adm.groupBy("dataset").agg(F.max("pos").alias("last"), F.max("cum_tokens").alias("cum"))
    assert last.filter(F.col("cum") > budget).count() == 0
    nxt = docs.join(last, "dataset").filter(F.col("pos") > F.col("last")) \
        .groupBy("dataset", "cum").agg(F.min_by("est", "pos").alias("next_est"))
    assert nxt.filter(F.col("cum") + F.col("next_est") <= budget).count() == 0
