import random

import numpy as np

from quillspark.llm import toxicity as tx

from .helpers import empty_documents, odd_documents, words


def texts(rng, n, toxic):
    out = []
    for _ in range(n):
        w = words(rng, rng.randint(30, 200)).split()
        if toxic:
            for _ in range(rng.randint(1, 5)):
                w.insert(rng.randrange(len(w)), rng.choice(["grumphead", "snarkwit", "blorgface", "vexil" + rng.choice(["um", "ans", "or"])]))
        out.append(" ".join(w))
    return out


def test_held_out_accuracy():
    rng = random.Random(1)
    model = tx.train(texts(rng, 150, True), texts(rng, 300, False), 0.15)
    assert {g.strip()[:5] for g in model.grams} >= {"grump", "snark", "blorg", "vexil"} and len(model.grams) < 10
    a, b = tx._compressor(model.ordinary), tx._compressor(model.toxic)
    score = lambda ts: model.score(np.array([tx.features(tx.gains(t, a, b)) for t in ts]))
    toxic, clean = score(texts(rng, 100, True)), score(texts(rng, 200, False))
    assert (toxic >= 0.5).mean() >= 0.93 and (clean >= 0.5).mean() <= 0.02
    assert np.mean([(clean < s).mean() for s in toxic]) > 0.98


def scores(model, ts):
    a, b = tx._compressor(model.ordinary), tx._compressor(model.toxic)
    return model.score(np.array([tx.features(tx.gains(t, a, b)) for t in ts]))


def test_word_combinations_are_learned_beside_stems():
    """Ordinary words in toxic combinations, while one frequent stem is there to be found."""
    rng = random.Random(5)
    common = sorted(set(words(rng, 600).split()))
    phrases = [" ".join(rng.sample(common, 3)) for _ in range(20)]

    def made(n, what):
        out = []
        for _ in range(n):
            w = [rng.choice(common) for _ in range(rng.randint(60, 200))]
            for _ in range(rng.randint(3, 6) if what else 0):
                w.insert(rng.randrange(len(w)), rng.choice(what))
            out.append(" ".join(w))
        return out

    model = tx.train(made(60, ["grumphead"]) + made(240, phrases), made(600, None), 1 / 3)
    assert any(g.startswith(" grump") for g in model.grams)
    toxic, clean = scores(model, made(150, phrases)), scores(model, made(300, None))
    assert np.mean([(clean < s).mean() + (clean == s).mean() / 2 for s in toxic]) > 0.75


def test_windows_cover_the_whole_text():
    w = words(random.Random(2), 101).split()
    got = tx.windows("\n".join(w))
    assert len(got) == 6 and sum(len(x) - 1 for x in got) + 1 == len(" ".join(w)) + 2
    # coding: equal words are equal wherever they stand, the end of one is not the beginning of another
    assert tx.windows("ab cdab")[0] == tx.coded(b" ab cdab ")[0] and tx.coded(b" ab")[0] not in tx.coded(b" cdab")[0]
    assert tx.windows("") == tx.windows(" \n") == []


def test_training_text_is_drawn_from_the_whole_text():
    w = words(random.Random(8), 30_000).split()
    got = tx.training_text(" ".join(w), 10_000)
    assert 9_000 < len(got) <= 10_000 and got == tx.training_text(" ".join(w), 10_000)
    lines = [" ".join(w[i:i + tx.WINDOW_WORDS]) for i in range(0, len(w), tx.WINDOW_WORDS)]
    at = [lines.index(x) for x in got.split("\n")]
    assert at == sorted(at) and min(at) < len(lines) / 10 and max(at) > 0.9 * len(lines)
    assert tx.training_text(" ".join(w[:100]), 10_000) == " ".join(w[:100])
    assert 0 < len(tx.training_text("x" * 500_000)) <= tx.FIT_CHARS


def test_long_texts_are_calibrated_whole(spark):
    """Toxic words stand only behind the first FIT_CHARS characters."""
    rng = random.Random(9)

    def made(toxic):
        w = words(rng, 12_000).split()
        for _ in range(60 if toxic else 0):
            w.insert(rng.randrange(9_500, len(w)), rng.choice(["grumphead", "snarkwit", "blorgface"]))
        return " ".join(w)

    rows = [(i, made(i % 3 == 0)) for i in range(150)]
    assert all(len(" ".join(t.split()[:9_500])) > tx.FIT_CHARS for _, t in rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    model = tx.fit(docs.filter("doc_id < 90"), spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(90)], "doc_id bigint, toxic int"))
    got = {r["doc_id"]: r["score"] >= 0.5 for r in tx.score(docs.filter("doc_id >= 90"), model).collect()}
    assert np.mean([got[i] == (i % 3 == 0) for i in got]) >= 0.95


def test_odd_rows_and_labels(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame([(0, 1), (1, None), (None, 1), (3, 0), (3, 1), (7, 0), (99, 0)], "doc_id bigint, toxic int")
    model = tx.fit(docs, labels)
    rows = tx.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    same = {r["score"] for r in rows if r["doc_id"] in (0, 1, 2, 3)}
    assert len(same) == 1  # no windows
    whole = tx.score_rows(docs, model)
    assert whole.select("doc.*").columns == docs.columns and whole.count() == docs.count()
    none = tx.fit(docs, labels.limit(0))
    assert {round(r["score"], 6) for r in tx.score(docs, none).collect()} == {0.0}
    one = tx.fit(docs, labels.filter("toxic = 1"))
    assert {round(r["score"], 6) for r in tx.score(docs, one).collect()} == {1.0}
    assert tx.score(empty_documents(spark), model).count() == 0


def test_query_separates_held_out_rows(spark):
    import zlib

    from quillspark.llm import queries
    sf = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.QUERIES["op10_toxicity"](spark, sf).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in queries.table(spark, sf, "labels").collect()}
    assert len(rows) == queries.table(spark, sf, "documents").count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.5) for i, r in rows.items())
    held = [(rows[i]["score"], y) for i, y in labels.items() if rows[i]["held_out"]]
    p, q = [s for s, y in held if y == 1], [s for s, y in held if y == 0]
    assert np.mean([np.mean([(a > b) + (a == b) / 2 for b in q]) for a in p]) > 0.8
