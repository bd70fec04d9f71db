"""A worker's memory follows its slices, not the batches that Spark hands it."""

import collections
import tracemalloc

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from quillspark.functions import arrow_pieces as A
from quillspark.operators import encode as J
from quillspark.operators import ngram as N
from quillspark.operators import streams as S

MB = 1 << 20
WORDS = "the cat, sat. on  a ümlaut\nmat 42".split(" ")


class Frame:
    """Takes what an operator would run on the workers."""

    def __init__(self, spark, schema=None):
        self.sparkSession, self.schema = spark, schema

    def select(self, *_):
        return self

    groupBy = agg = select

    def mapInArrow(self, fn, schema):
        self.fn = fn
        return self


def run(frame, batch):
    """Rows out, and the peak MB of the arrays on the way."""
    tracemalloc.start()
    try:
        out = list(frame.fn(iter([batch])))
        return pa.Table.from_batches(out), tracemalloc.get_traced_memory()[1] / MB
    finally:
        tracemalloc.stop()


def texts(n):
    return [None if i % 97 == 5 else "" if i % 89 == 3 else " ".join(WORDS[(i + k) % len(WORDS)] for k in range(250)) for i in range(n)]


def pieces(t):
    return A.split_strings(pa.array([t]))[0].as_py()


def test_counting_pieces_of_a_large_batch_is_bounded(spark):
    rows = texts(12000)  # about 15 MB
    got, peak = run(J.piece_counts(Frame(spark), "text"), pa.record_batch([pa.array(rows)], ["text"]))
    times = collections.Counter(t for t in rows if t)
    want = collections.Counter()
    for t, n in times.items():
        for p in pieces(t):
            want[p] += n
    assert dict(zip(*(c.to_pylist() for c in got.columns), strict=True)) == want
    assert peak < 64


@pytest.mark.parametrize("nested", [False, True])
def test_encoding_a_large_batch_is_bounded(spark, nested):
    rows = texts(12000)
    if nested:
        rows = [None if i % 31 == 7 else rows[i:i + i % 3] for i in range(0, 12000)]
    kind = ArrayType(StringType()) if nested else StringType()
    vocab = sorted({p for t in texts(40) if t for p in pieces(t)})[1:]
    class Bc:
        value = vocab
    frame = Frame(spark, StructType([StructField("k", IntegerType()), StructField("t", kind)]))
    got, peak = run(J._arrow_ids(frame, "t", "ids", Bc, f"test-{nested}"), pa.record_batch([pa.array(range(12000), pa.int32()), pa.array(rows, pa.list_(pa.string()) if nested else pa.string())], ["k", "t"]))
    ids = {p: i + J.N_SPECIALS for i, p in enumerate(vocab)}
    seen = {}

    def one(t):
        if t not in seen:
            seen[t] = None if t is None else [ids.get(p, J.UNK_ID) for p in pieces(t)] if t else []
        return seen[t]
    assert got["k"].to_pylist() == list(range(12000))
    step = 53
    assert got["ids"].take(list(range(0, 12000, step))).to_pylist() == [one(r) if not nested else None if r is None else [one(t) for t in r] for r in rows[::step]]
    assert peak < 64


def test_counting_pairs_of_a_large_batch_is_bounded(spark, monkeypatch):
    rows = [None if i % 50 == 9 else [] if i % 50 == 3 else [(i * 7 + k * k) % 900 for k in range(i % 2000)] for i in range(4000)]
    want = collections.Counter(p for r in rows if r for p in zip(r, r[1:], strict=False))
    batch = pa.record_batch([pa.array(rows, pa.list_(pa.int32()))], ["ids"])
    for bound in (1 << 20, 1000):  # the second sends counts on early
        monkeypatch.setattr(N, "PAIR_ROWS", bound)
        got, peak = run(N.fit_ngram(Frame(spark), "ids"), batch)
        sums = got.group_by(["prev", "token"]).aggregate([("n", "sum")])
        assert {(r["prev"], r["token"]): r["n_sum"] for r in sums.to_pylist()} == want
        assert peak < 96


def test_slices_are_whole_rows_within_the_bound():
    rows = ["a" * n for n in (3, 0, 9, 1, 1, 40, 2)] + [None, "", "b"]
    batch = pa.record_batch([pa.array(rows), pa.array([[r, None, "x"] if r else None for r in rows]), pa.array([[1] * len(r or "") for r in rows])], ["t", "n", "i"])
    for b in (batch, batch.slice(2, 6), batch.slice(3, 0)):
        for col in ("t", "n", "i"):
            cut = list(A.row_slices(b, col, 10))
            assert [r for s in cut for r in s.to_pylist()] == b.to_pylist()
            size = lambda v: sum(map(size, v)) if isinstance(v, list) else len(v) if isinstance(v, str) else v or 0
            assert all(len(s) == 1 or sum(map(size, s[col].to_pylist())) <= 10 for s in cut)
    s = batch.slice(2, 5)
    assert A.split_nested(s["n"]).to_pylist() == [[None if t is None else pieces(t) for t in r] for r in s["n"].to_pylist()]


def test_a_session_hands_over_small_batches(spark):
    new = spark.newSession()
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    new.conf.unset(setting)
    J.piece_counts(new.createDataFrame([("a b",)], "text string"), "text").collect()
    assert new.conf.get(setting) == str(8 * MB)


def test_the_cutter_keeps_no_batch_for_a_row_of_it():
    """The val stream takes few rows of a batch; they do not hold its arrays."""
    schema = pa.schema([("dataset", pa.string()), ("_val", pa.bool_()), ("chunk_id", pa.int64()), ("_at", pa.int32()), ("_whole", pa.bool_()), ("ids", pa.list_(pa.int32()))])
    none = [None] * 4
    head = ["a", 0, 400, 0, 0, 0, []]
    docs = [["a", 0, *none, [1] * 1000] for _ in range(400)]
    names = ["dataset", "_bk", "_docs", "_d0", "_t0", "_v0", "ids"]
    kinds = [pa.string(), *[pa.int64()] * 5, pa.list_(pa.int32())]

    def batches():
        rows = [head, *docs]
        for a in range(0, len(rows), 20):
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows[a:a + 20], strict=True), kinds, strict=True)], names)
            held.append(pa.total_allocated_bytes())
    held: list = []
    before = pa.total_allocated_bytes()
    tokens = sum(pc.sum(pc.list_value_length(b["ids"])).as_py() for b in S._cutter(1, 1, 4096, 20, schema)(batches()))
    assert tokens == 400_000
    assert max(held) - before < MB // 2
