import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillspark.llm import dac
from quillspark.llm.pretok import load_tokenizer

from .helpers import WORD_BPE, empty_documents, odd_documents


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70_000), st.integers(0, 2 ** 32 - 1)), min_size=1, max_size=1500))
def test_codes_round_trip_and_random_access(ids):
    levels = dac.dac_encode(np.array(ids, np.uint32))
    chunks, more, ranks = map(list, zip(*levels, strict=True))
    assert dac.dac_decode(chunks, more).tolist() == ids
    for i in {0, len(ids) // 2, len(ids) - 1, *range(500, len(ids), 97)}:
        if i < len(ids):
            assert dac.dac_access(chunks, more, ranks, i) == ids[i]


def expected(docs):
    tok = load_tokenizer(WORD_BPE)
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in docs.collect()), key=lambda x: (x[0], x[1], x[2].encode()))
    out, at = [], 0
    for known, doc_id, text in rows:
        ids = np.array(tok.encode(text, add_special_tokens=False).ids + [1], "<u4")
        out.append((doc_id if known else None, at, len(ids), zlib.crc32(ids.tobytes()), ids.tolist()))
        at += len(ids)
    return out


def test_files_hold_all_documents_in_order(spark):
    docs = odd_documents(spark)
    want = expected(docs)
    path = dac.write_token_files(docs, WORD_BPE, 1, partitions=3, segment_tokens=100)
    rows = sorted(map(tuple, dac.read_documents(spark, path).collect()), key=lambda r: r[1])
    assert [r[:4] for r in rows] == [w[:4] for w in want]
    assert [r[4] for r in rows] == [w[4][len(w[4]) // 2] for w in want]
    assert spark.read.parquet(path).count() > 3
    flat = [x for w in want for x in w[4]]
    positions = spark.createDataFrame([(i,) for i in range(0, len(flat), 7)] + [(len(flat) + 5,), (None,)], "position bigint")
    got = {r["position"]: r["id"] for r in dac.read_tokens(positions, path, width=50).collect()}
    assert got == {i: flat[i] for i in range(0, len(flat), 7)}


def test_empty_table(spark):
    path = dac.write_token_files(empty_documents(spark), WORD_BPE, 1, partitions=2)
    assert dac.read_documents(spark, path).count() == 0


def test_rows_of_one_id_are_spread(spark):
    for doc_id in (None, 7):
        docs = spark.createDataFrame([(doc_id, f"text {i}") for i in range(800)], "doc_id bigint, text string").repartition(4)
        path = dac.write_token_files(docs, WORD_BPE, 1, partitions=8)
        parts = {r["part"]: len(r["doc_ids"]) for r in spark.read.parquet(path).collect()}
        assert len(parts) == 8 and max(parts.values()) < 250 and sum(parts.values()) == 800
        starts = sorted((r["start"], r["n_tokens"]) for r in dac.read_documents(spark, path).collect())
        assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False))
