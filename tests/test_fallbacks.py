"""The exact paths beyond the broadcast bounds give the same answers."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from quillspark.operators.encode import Encoder, JoinEncoder, PandasEncoder, build_vocab
from quillspark.operators.joins import range_lookup
from quillspark.session import table


def test_join_encoder_equals_broadcast_encoder(spark):
    docs = table(spark, SF_SMALL, "documents").filter(F.length("text") > 0).select("doc_id", "text")
    vt = build_vocab(docs, "text", vocab_size=500)
    rows = vt.orderBy("id").select("piece").collect()
    a = Encoder([r[0] for r in rows], 500).encode(docs, "text", "ids", add_eos=True)
    b = JoinEncoder(vt, 500).encode(docs, "text", "ids", add_eos=True)
    assert a.select("doc_id", "ids").exceptAll(b.select("doc_id", "ids")).count() == 0
    assert b.count() == docs.count()


def test_join_encoder_on_rows_with_maps_and_repeats(spark):
    vt = build_vocab(spark.createDataFrame([("a b c a",)], "text string"), "text", vocab_size=10)
    rows = [(1, {"k": 1}, ["a b", None, "c"]), (1, {"k": 1}, ["a b", None, "c"]), (2, None, []), (3, {}, None)]
    df = spark.createDataFrame(rows, "i int, m map<string,int>, t array<string>")
    a = JoinEncoder(vt, 10).encode_column(df, F.col("t"), "e", drop=["t"]).orderBy("i").collect()
    b = Encoder([r[0] for r in vt.orderBy("id").select("piece").collect()], 10).encode_column(df, F.col("t"), "e", drop=["t"]).orderBy("i").collect()
    assert a[0] == a[1] and [(r["i"], r["m"]) for r in a] == [(r["i"], r["m"]) for r in b]
    assert [len(x) for x in a[0]["e"]] == [2, 0, 1] and a[0]["e"][0] == b[0]["e"][0] and a[2]["e"] == [] and a[3]["e"] is None


def test_pandas_encoder_runs_any_callable(spark):
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    e = PandasEncoder(lambda: (lambda t: [len(w) for w in t.split()])).encode(docs)
    r = e.select(F.sum(F.size("ids"))).first()[0]
    words = docs.select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    assert r > 0 and abs(r - words) <= docs.count()


def test_range_lookup_many_ranges(spark):
    ranges = spark.createDataFrame([(i, i * 10, i * 10 + (0 if i % 7 == 0 else 10))
                                    for i in range(2000)], "rid int, lo long, hi long")
    pts = spark.range(0, 20000, 3).withColumnRenamed("id", "p")
    got = range_lookup(pts, ranges, "p", "lo", "hi", n_buckets=64)
    exp = pts.filter(((F.col("p") / 10).cast("int") % 7) != 0).count()
    assert got.count() == exp
    assert got.filter((F.col("p") < F.col("lo")) | (F.col("p") >= F.col("hi"))).count() == 0
