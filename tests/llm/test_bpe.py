"""Pre-tokens, library encoder and trie encoder against the tokenizers library."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import bpe_trie
from quillspark.llm.pretok import library_encoder, load_tokenizer

from .helpers import BYTE_BPE, WORD_BPE, empty_documents, odd_documents, odd_texts

PIECES = ["a", "s", "t", "'", "''", "r", "e", "ve", "ll", "1", "²", "½", "\n", "\t", "!", ",", "é", "É", "é", "Σ", "ς", "<|endoftext|>",
          "<|startoftext|>", "İ", " ", "　", "_", "́", " ", " ", " ", "  ", "\x85", "\x1c", "日", "😀", "ﬁ", "don't", " the", "ing"]


def strings():
    rng = random.Random(4)
    return [t or "" for t in odd_texts()] + ["".join(rng.choices(PIECES, k=rng.randint(1, 16))) for _ in range(4000)]


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
@pytest.mark.parametrize("make", [library_encoder, bpe_trie.trie_encoder])
def test_ids_equal_the_library(path, make):
    tok, texts = load_tokenizer(path), strings()
    ids, counts = make(path).encode(texts)
    for text, own in zip(texts, np.split(ids, np.cumsum(counts)[:-1]), strict=True):
        assert own.tolist() == tok.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_full_cache_starts_anew(monkeypatch):
    from quillspark.llm import pretok
    monkeypatch.setattr(pretok, "CACHE_WORDS", 3)
    tok = load_tokenizer(BYTE_BPE)
    enc = pretok.CachedEncoder(tok, lambda words: [tok.encode(w, add_special_tokens=False).ids for w in words])
    for text in ("one two three four", "five six", "one two", "seven one"):
        assert enc.encode([text])[0].tolist() == tok.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BYTE_BPE, WORD_BPE])
def test_encode_and_decode_of_odd_rows(spark, path):
    tok = load_tokenizer(path)
    docs = odd_documents(spark).drop("ids")
    both = bpe_trie.encode(docs, path, decoded=True)
    apart = bpe_trie.decode(bpe_trie.encode(docs, path), path)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["ids"])
    rows = sorted(both.select("doc_id", "ids", "decoded").collect(), key=key)
    assert rows == sorted(apart.select("doc_id", "ids", "decoded").collect(), key=key)
    assert len(rows) == docs.count() and "score" in both.columns
    by_text = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in rows:
        want = tok.encode(by_text[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == want and r["decoded"] == tok.decode(want, skip_special_tokens=False)


def test_empty_table_and_unknown_ids(spark):
    assert bpe_trie.encode(empty_documents(spark), WORD_BPE, decoded=True).count() == 0
    odd = spark.createDataFrame([(1, [320, 10 ** 8, -1]), (2, None)], "doc_id int, ids array<int>")
    tok = load_tokenizer(WORD_BPE)
    assert [r["decoded"] for r in bpe_trie.decode(odd, WORD_BPE).orderBy("doc_id").collect()] == [tok.decode([320], skip_special_tokens=False), ""]


def test_shared_prefixes_and_unreachable_tokens():
    # ab is never reached: bc merges first
    bpe = bpe_trie.TrieBpe({"a": 0, "b": 1, "c": 2, "bc": 3, "abc": 4, "ab": 5, "aa": 6}, [("b", "c"), ("a", "bc"), ("a", "b"), ("a", "a")])
    assert bpe.encode(["abc", "ab", "aaa", "aaaa", "abcc", "a", "aabc"]) == [[4], [5], [6, 0], [6, 6], [4, 2], [0], [0, 4]]
