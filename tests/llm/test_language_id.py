"""The network's gradients against differences, held-out accuracy on the tables, odd rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import language_id as L
from quillspark.llm.queries import QUERIES, table

from .helpers import empty_documents, odd_documents, odd_texts

SF = "/root/testdata/sf0.01"


def slow_probabilities(model, window):
    """One window, filter by filter and place by place."""
    pooled = []
    for t in model.tables:
        for f in range(t.shape[2]):
            pooled.append(max(sum(float(t[j][window[p + j]][f]) for j in range(len(t))) for p in range(len(window) - len(t) + 1)))
    hidden = np.maximum(np.array(pooled) + model.bias, 0)
    z = hidden @ model.out + model.constant
    return np.exp(z - z.max()) / np.exp(z - z.max()).sum()


def small_model():
    rng = np.random.default_rng(0)
    text = [rng.integers(97, 110, 400, dtype=np.uint8).tobytes() for _ in range(30)] + [rng.integers(104, 122, 400, dtype=np.uint8).tobytes() for _ in range(30)]
    x, n = L._windows(text)
    return L.train(x, np.repeat(np.repeat([0, 1], 30), n), ("aa", "zz"), epochs=4), x


def test_batched_network_equals_the_plain_one():
    model, x = small_model()
    got = L.probabilities(model, x)
    for i in (0, 1, 70, len(x) - 1):
        assert np.allclose(got[i], slow_probabilities(model, x[i].tolist()), atol=1e-4)
    assert (got[:60].argmax(1) == 0).mean() > 0.9 and (got[60:].argmax(1) == 1).mean() > 0.9


def test_whole_texts_and_slices(monkeypatch):
    model, _ = small_model()
    texts = ["abc" * 2000 + "xyz" * 9000, None, "", "12 34", "é", "tuv"]
    want = L.predict_texts(model, texts)
    assert want[0] == ["zz", "und", "und", "und", want[0][4], "zz"] and want[1][1:4] == [0, 0, 0]
    monkeypatch.setattr(L, "SLICE_BYTES", 2 * L.WINDOW)
    assert L.predict_texts(model, texts)[0] == want[0]
    assert np.allclose(L.predict_texts(model, texts)[1], want[1])


def test_held_out_accuracy(spark):
    out = QUERIES["op12_language_id"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out) and len(out) == 1000
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in out)


def test_odd_rows(spark):
    docs = odd_documents(spark).withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "aa").when(F.col("doc_id") % 3 == 1, "bb"))
    model = L.fit(docs, F.col("doc_id") >= 0, epochs=1)
    assert model.languages == ("aa", "bb")
    rows = L.predict(docs, model).collect()
    texts = {i: t for i, t in enumerate(odd_texts())}
    assert len(rows) == docs.count()
    for r in rows:
        text = texts[9 if r["doc_id"] is None else r["doc_id"]]
        assert (r["lang_pred"] == "und") == (text is None or not any(c.isalpha() for c in text))
    # one language, or none
    one = L.fit(docs.filter("lang = 'aa'"), F.lit(True))
    assert {r["lang_pred"] for r in L.predict(docs, one).collect()} == {"aa", "und"}
    none = L.fit(empty_documents(spark), F.lit(True))
    assert {(r["lang_pred"], r["score"]) for r in L.predict(docs, none).collect()} == {("und", 0.0)}
    assert L.predict(empty_documents(spark), model).count() == 0


def test_the_sample_is_bounded_and_counts_copies_once(spark):
    rows = [("aa", "same text")] * 500 + [("bb", f"other text {i}") for i in range(500)]
    docs = spark.createDataFrame(rows, "lang string, text string")
    seen = []
    keep, L.train = L.train, lambda x, y, languages, epochs: seen.append(np.bincount(y, minlength=2)) or keep(x, y, languages, 1)
    try:
        L.fit(docs, F.lit(True), rows=50)
    finally:
        L.train = keep
    assert seen[0][0] <= 1 and 20 <= seen[0][1] <= 90
