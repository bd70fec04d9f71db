"""Perfect hashing, and alignment against a plain reading of the definition."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quillspark.llm import alignment
from quillspark.llm.perfect_hash import PerfectHash
from quillspark.llm.pretok import BYTE_TABLE, load_tokenizer
from quillspark.llm.queries import QUERIES, table

from .helpers import BYTE_BPE, empty_documents, odd_documents, odd_texts

PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_minimal_perfect_hash(n):
    keys = np.random.default_rng(n).choice(10 ** 9, n, replace=False).astype(np.int64)
    for h in (own := PerfectHash.build(keys), PerfectHash.from_bytes(own.to_bytes())):
        assert sorted(h.index(keys).tolist()) == list(range(n))
        others = h.index(np.arange(10 ** 9, 10 ** 9 + 200, dtype=np.int64))
        assert ((others >= -1) & (others < max(n, 1))).all()


def brute(texts):
    """Byte by byte, with the libraries alone."""
    tok, sp = load_tokenizer(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECE_BPE)
    tok.encode_special_tokens = True
    back = {c: i for i, c in enumerate(BYTE_TABLE)}
    results, total = [], Counter()
    for text in texts:
        text = text or ""
        data = (" " + text).encode()
        a = [(i, bytes(back[c] for c in tok.id_to_token(i))) for i in tok.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, bytes([int(sp.id_to_piece(i)[1:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
        if not text or b"".join(x for _, x in a) != data or b"".join(x for _, x in b) != data:
            results.append(None)
            continue
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(i, j) for i, p, q in spans[0] for j, r, s in spans[1] if p < s and r < q]
        total.update(links)
        both = sorted({q for _, _, q in spans[0]} & {q for _, _, q in spans[1]})
        low, groups = 0, []
        for high in both:
            groups.append("|".join(",".join(str(i) for i, p, q in side if low <= p and q <= high) for side in spans))
            low = high
        results.append((len(a), len(b), len(both), links, ";".join(groups)))
    highest = Counter()
    for (_, j), n in total.items():
        highest[j] = max(highest[j], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else
            (r[0], r[1], r[2], len(r[3]), sum(total[x] == highest[x[1]] for x in r[3]), sum(total[x] for x in r[3]), hashlib.sha256(r[4].encode()).hexdigest())
            for r in results]


def check(df, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    want = Counter((i, *r) for (i, _), r in zip(rows, brute([t for _, t in rows]), strict=True))
    assert Counter((r["doc_id"], *[r[c] for c in COLUMNS]) for r in df.collect()) == want


def odd(spark):
    rng = random.Random(2)
    pieces = ["a", " ", "  ", "\n", "\n\n", "▁", "é", "é", "日本", "😀", "</s>", "<unk>", "<|endoftext|>", "the", " and", "1234", "\x00", "'t", "\t", " ", "ing", "…"]
    more = ["".join(rng.choices(pieces, k=rng.randint(1, 25))) for _ in range(150)]
    return odd_documents(spark).select("doc_id", "text", "ids", "key").filter("text is null or length(text) < 500").unionByName(
        spark.createDataFrame([(1000 + i, t, "x", "y") for i, t in enumerate(more)], "doc_id bigint, text string, ids string, key string"))


def test_odd_rows_against_brute_force(spark):
    docs = odd(spark)
    check(alignment.align(docs, BYTE_BPE, PIECE_BPE), docs)
    assert alignment.align(empty_documents(spark), BYTE_BPE, PIECE_BPE).count() == 0
    none = alignment.align(spark.createDataFrame([(1, None), (2, "a▁b")], "doc_id int, text string"), BYTE_BPE, PIECE_BPE).collect()
    assert [[r[c] for c in COLUMNS] for r in none] == [[0] * 6 + [""]] * 2


def test_several_blocks_shards_and_parts(spark, monkeypatch):
    docs = odd(spark).repartition(6)
    monkeypatch.setattr(alignment, "SHARD_KEYS", 15)
    monkeypatch.setattr(alignment, "BLOCK_KEYS", 60)
    monkeypatch.setattr(alignment, "FAN_IN", 2)
    check(alignment.align(docs, BYTE_BPE, PIECE_BPE), docs)
    ids = alignment.encoded(docs, BYTE_BPE, PIECE_BPE)
    found, blocks, n_shards = alignment.pair_counts(ids, (BYTE_BPE, PIECE_BPE))
    assert len(blocks) > 2 and n_shards > 10 and found.count() == found.select("shard").distinct().count()


def test_small_slices_give_the_same():
    pair = alignment.tokenizer_pair(BYTE_BPE, PIECE_BPE)
    texts = [t for t in odd_texts() if t]
    batch = next(alignment._encode((BYTE_BPE, PIECE_BPE))([__import__("pyarrow").RecordBatch.from_pydict(
        {"doc_id": list(range(len(texts))), "text": texts})]))
    whole = [(i + r, k) for i, _, keys, row in alignment._aligned(pair, batch) for k, r in zip(keys.tolist(), row.tolist(), strict=True)]
    alignment.SLICE_IDS, keep = 100, alignment.SLICE_IDS
    try:
        parts = [(i + r, k) for i, _, keys, row in alignment._aligned(pair, batch) for k, r in zip(keys.tolist(), row.tolist(), strict=True)]
    finally:
        alignment.SLICE_IDS = keep
    assert sorted(whole) == sorted(parts)


def test_query_on_a_small_table(spark):
    sf = "/root/testdata/sf0.001"
    out = QUERIES["op11_token_alignment"](spark, sf)
    docs = table(spark, sf, "documents")
    short = docs.filter(F.length("text") < 1500)
    rows = {r["doc_id"]: r for r in out.collect()}
    assert len(rows) == docs.count()
    # groups and links of a document need no other document
    texts = [(r["doc_id"], r["text"]) for r in short.limit(25).collect()]
    for (i, _), want in zip(texts, brute([t for _, t in texts]), strict=True):
        assert tuple(rows[i][c] for c in ("n_a", "n_b", "n_groups", "n_links")) == want[:4] and rows[i]["groups_sha256"] == want[6]
        assert rows[i]["n_best"] <= rows[i]["n_links"] <= rows[i]["count_sum"]
