import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import packing
from quillspark.llm.pretok import load_tokenizer

from .helpers import BYTE_BPE, empty_documents, odd_documents


def check(docs, out, limit):
    """Whole documents, gapless sequences, right ids."""
    tok = load_tokenizer(BYTE_BPE)
    want = sorted((r["doc_id"] is None, r["doc_id"] or 0, tuple(tok.encode(r["text"] or "", add_special_tokens=False).ids + [2])) for r in docs.collect())
    rows = out.collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        ids = np.array(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"]
        by_doc.setdefault((r["doc_id"], r["piece"], r["start"]), []).append(tuple(r["ids"]))
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    assert sum(r["length"] for r in rows) == sum(len(w[2]) for w in want)
    for absent, doc_id, ids in set(want):
        n = len(ids)
        first = (n - 1) % limit + 1
        cuts = [(0, first), *((a, a + limit) for a in range(first, n, limit))]
        for k, (a, b) in enumerate(cuts):
            assert ids[a:b] in by_doc[None if absent else doc_id, k, a]
    return len(by_sequence)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    check(docs, packing.pack_documents(docs, BYTE_BPE, 2, 64, with_ids=True), 64)
    assert packing.pack_documents(empty_documents(spark), BYTE_BPE, 2).count() == 0


def test_rounds_reach_nearly_the_least_number(spark, monkeypatch):
    rng = random.Random(3)
    docs = spark.createDataFrame([(i, " ".join(rng.choices("the of and to in".split(), k=rng.randint(1, 90)))) for i in range(2000)],
                                 "doc_id bigint, text string").repartition(16)
    monkeypatch.setattr(packing, "PORTION", 60)
    out = packing.pack_documents(docs, BYTE_BPE, 2, 128, with_ids=True).cache()
    n = check(docs, out, 128)
    total = out.agg(F.sum("length")).first()[0]
    assert n <= 1.03 * math.ceil(total / 128)


def test_best_fit_takes_the_tightest_bin():
    assert packing.best_fit(np.array([60, 50, 40, 45]), 100) == [[0, 2], [1, 3]]
    assert packing.best_fit(np.array([100, 100]), 100) == [[0], [1]]
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1025, 5000)
    bins = packing.best_fit(sizes, 1024)
    assert sorted(i for b in bins for i in b) == list(range(5000))
    assert all(sizes[b].sum() <= 1024 for b in bins) and len(bins) <= 1.02 * math.ceil(sizes.sum() / 1024)


def test_small_bins_among_many_that_never_merge_meet(spark, monkeypatch):
    # documents of over half a sequence, and in each of 16 parts one small one
    rows = [(i, "a b c d e f g h i j " * 6) for i in range(480)] + [(1000 + i, "x") for i in range(16)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(16, F.col("doc_id") % 16)
    out = packing.pack_documents(docs, BYTE_BPE, end_id=2, max_tokens=64, slack=0).collect()
    small = {r["sequence_id"] for r in out if r["doc_id"] >= 1000}
    total = sum(r["length"] for r in out)
    assert len(out) == 496 and (len(small) == 1 or len({r["sequence_id"] for r in out}) <= 480) and total == sum(r["length"] for r in out)


def test_query_against_the_library(spark):
    from quillspark.llm import queries
    sf = "/root/testdata/sf0.001"
    tok, texts = load_tokenizer(BYTE_BPE), {r["doc_id"]: r["text"] or "" for r in queries.table(spark, sf, "documents").collect()}
    rows = queries.QUERIES["op3_best_fit_packing"](spark, sf).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for i, pieces in by_doc.items():
        ids = np.array(tok.encode(texts[i], add_special_tokens=False).ids + [2], "<u4")
        pieces.sort(key=lambda r: r["piece"])
        assert [p["piece"] for p in pieces] == list(range(-(-len(ids) // 1024))) and sum(p["length"] for p in pieces) == len(ids)
        for p in pieces:
            assert p["ids_crc32"] == zlib.crc32(ids[p["start"]:p["start"] + p["length"]].tobytes())
    for members in by_sequence.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 1024
