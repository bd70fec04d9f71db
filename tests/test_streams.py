"""Streams cut with one exchange of ids, against plain concatenation; windows and scores of rows with null keys."""

import random

from pyspark.sql import functions as F

from quillspark.operators.pack import stream_lengths
from quillspark.operators.sample import fraction_split, mask_directory, mask_ones_at, sample_windows, step_plan
from quillspark.operators.streams import cut_streams


def _documents(spark, n=300, seed=1):
    rng = random.Random(seed)
    rows, token = [], 0
    for i in range(n):
        size = rng.choice([0, 1, 3, 10, 40, 200])
        rows.append((rng.choice(["a", "b", None]), i * 7, list(range(token, token + size)), [rng.randint(0, 1) for _ in range(size)]))
        token += size
    return rows, spark.createDataFrame(rows, "dataset string, pos bigint, ids array<int>, mask array<tinyint>").repartition(5)


def _plain(rows, val_every):
    streams = {}
    for key in {r[0] for r in rows}:
        for i, r in enumerate(sorted((r for r in rows if r[0] == key), key=lambda r: r[1])):
            split = "all" if val_every is None else "val" if i % val_every == 0 else "train"
            ids, mask = streams.setdefault((key, split), ([], []))
            ids += r[2]
            mask += r[3]
    return {k: v for k, v in streams.items() if v[0]}


def _rebuilt(chunks, chunk_size):
    out = {}
    for r in sorted(chunks.collect(), key=lambda r: r["chunk_id"]):
        ids, mask = out.setdefault((r["dataset"], r["split"] if "split" in chunks.columns else "all"), ([], []))
        assert len(ids) == r["chunk_id"] * chunk_size and r["n_tokens"] == len(r["tokens"]) == len(r["mask"])
        ids += r["tokens"]
        mask += r["mask"]
    return out


def test_streams_equal_concatenation(spark):
    rows, docs = _documents(spark)
    for val_every, chunk, width in ((None, 64, 100), (3, 64, 100), (10, 1000, 700), (2, 5, 1)):
        chunks = cut_streams(docs, ["dataset"], "pos", ("ids", "mask"), chunk, ("tokens", "mask"), bucket_width=width, val_every=val_every)
        assert _rebuilt(chunks, chunk) == _plain(rows, val_every)


def test_one_exchange_of_ids(spark):
    _, docs = _documents(spark)
    from quillspark.operators import streams
    plans, keep = {}, streams.materialize
    streams.materialize = lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString()), keep(df, name))[1]
    try:
        cut_streams(docs.coalesce(2), ["dataset"], "pos", ("ids", "mask"), 64, ("tokens", "mask"), val_every=3)
    finally:
        streams.materialize = keep
    exchanges = [line for line in plans["stream-pieces"].split("\n") if "Exchange" in line and "rangepartitioning" in line]
    assert len(exchanges) == 1


def test_repeated_places_and_empty_documents(spark):
    rows = [("a", 1, [i] * (i % 4), [1] * (i % 4)) for i in range(50)]
    docs = spark.createDataFrame(rows, "dataset string, pos bigint, ids array<int>, mask array<tinyint>").repartition(4)
    chunks = cut_streams(docs, ["dataset"], "pos", ("ids", "mask"), 16, ("tokens", "mask"), val_every=5)
    got = _rebuilt(chunks, 16)
    assert sorted(x for ids, _ in got.values() for x in ids) == sorted(x for r in rows for x in r[2])
    assert cut_streams(docs.limit(0), ["dataset"], "pos", ("ids",), 16).count() == 0


def test_windows_of_a_stream_without_a_name(spark):
    rows, docs = _documents(spark)
    chunks = cut_streams(docs, ["dataset"], "pos", ("ids",), 64).cache()
    lengths = stream_lengths(chunks, ["dataset"])
    plan = step_plan(spark, 1, 5, 2, 4)
    want = {k[0]: v[0] for k, v in _plain(rows, None).items()}
    for bound in (40, None):
        got = sample_windows(plan, chunks, lengths, ["dataset"], 16, chunk_size=64, plan_rows=bound).collect()
        assert len(got) == 40 and {r["dataset"] for r in got} == {"a", "b", None}
        for r in got:
            s = want[r["dataset"]]
            assert r["x"] == s[r["start"]:r["start"] + 16] and r["y"] == s[r["start"] + 1:r["start"] + 17]


def test_mask_directory_counts_every_place(spark):
    rows, docs = _documents(spark, 60)
    chunks = cut_streams(docs, ["dataset"], "pos", ("ids", "mask"), 100, ("tokens", "mask")).cache()
    want = {k[0]: v[1] for k, v in _plain(rows, None).items()}
    points = spark.createDataFrame([(k, p) for k, m in want.items() for p in range(len(m) + 1)], "dataset string, p bigint")
    got = mask_ones_at(points, mask_directory(chunks, ["dataset"]), ["dataset"], "p", 100).collect()
    assert len(got) == sum(len(m) + 1 for m in want.values())
    assert all(r["p_ones"] == sum(want[r["dataset"]][:r["p"]]) for r in got)


def test_split_by_the_key_of_a_rank(spark):
    from quillspark.operators import sample
    rng = random.Random(3)
    keys = [rng.randrange(1 << 60) for _ in range(1000)]
    df = spark.createDataFrame([(k,) for k in keys], "shuffle_key bigint")
    keep, sample.ROWS_PER_BUCKET = sample.ROWS_PER_BUCKET, 10
    try:
        for fraction, n in ((0.02, 20), (0.0001, 1), (0.5, 500), (1.0, 1000)):
            val = {r[0] for r in fraction_split(df, fraction).filter("split = 'val'").select("shuffle_key").collect()}
            assert val == set(sorted(keys)[:n])
    finally:
        sample.ROWS_PER_BUCKET = keep


def test_null_dataset_has_a_language_quota(spark):
    from quillspark.operators.corpus import token_budget_lang
    rows = [(None, "en", 1, 10), (None, "de", 2, 10), (None, "en", 3, 10), ("a", "en", 4, 10)]
    df = spark.createDataFrame(rows, "dataset string, lang string, pos bigint, est bigint")
    assert sorted(r["pos"] for r in token_budget_lang(df, 30).collect()) == [1, 2, 4]
