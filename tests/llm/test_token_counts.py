import random

from pyspark.sql import functions as F

from quillspark.llm import token_counts as tc
from quillspark.llm.pretok import library_encoder, load_tokenizer

from .helpers import BYTE_BPE, empty_documents, odd_documents, odd_texts

BITS = ["", " ", "  ", "'", "'s", "re", "a", "é", "日", "1", "\n", " \n ", "!!", "don't ", "hello world, it's ", " " * 70, "x" * 100, "<|endoftext|>"]


def library():
    tok = load_tokenizer(BYTE_BPE)
    tok.encode_special_tokens = True
    return lambda t: len(tok.encode(t, add_special_tokens=False).ids)


def test_any_edits_give_the_count_of_the_edited_text():
    rng, count, encoder = random.Random(8), library(), library_encoder(BYTE_BPE)
    again = total = 0
    for text in [t or "" for t in odd_texts()] + ["   ", " 's 's", "don't" * 40, " " * 300 + "y", "\n " * 100]:
        chars, tokens, _ = encoder.pieces_tokens([text])
        doc = tc.Counted(encoder, text, tc._group(chars), tc.build_tree(tc._group(tokens)))
        assert doc.tokens == count(text)
        for _ in range(25):
            start, length = rng.choice([0, len(text), rng.randint(0, len(text) + 3)]), rng.choice([0, 0, 1, 2, 5, rng.randint(0, 60)])
            new = "".join(rng.choices(BITS, k=rng.randint(0, 3)))
            at = min(start, len(text))
            text = text[:at] + new + text[at + length:]
            doc.edit(start, length, new)
            assert doc.text == text and doc.tokens == count(text)
            assert int(doc.leaf_chars.sum()) == len(text) and (doc.tree == tc.build_tree(doc._leaf_tokens())).all()
            total += len(text)
        again += doc.reencoded
    assert again < 0.3 * total


def test_odd_rows_and_edits(spark):
    count, docs = library(), odd_documents(spark)
    state = tc.build(docs, BYTE_BPE)
    edits = F.expr("array(" + ", ".join(
        "null" if e is None else "named_struct('start', cast({} as bigint), 'length', cast({} as bigint), 'replacement', cast({} as string))".format(*e)
        for e in (None, ("null", "null", "null"), (1, 2, "' new'"), (-5, 99999999, "text"), (3, 0, "'!'"))) + ")")
    out = tc.apply_edits(state, edits, BYTE_BPE).withColumn("n", tc.n_tokens()).collect()
    assert len(out) == docs.count()
    for r in out:
        assert r["n"] == count(r["text"]) and r["edits"] == 4
    assert tc.apply_edits(tc.build(empty_documents(spark), BYTE_BPE), F.lit(None), BYTE_BPE).count() == 0
    assert {r["edits"] for r in tc.apply_edits(state, F.lit(None), BYTE_BPE).collect()} == {0}


def test_a_log_in_rounds_equals_one_round(spark):
    count = library()
    docs = spark.createDataFrame([(1, "one two three four five"), (2, "untouched"), (3, None)], "doc_id bigint, text string")
    log = spark.createDataFrame([(1, i, 2 * i, 1, f" w{i}") for i in range(7)] + [(3, 0, 0, 0, "new"), (9, 0, 0, 0, "no such document")],
                                "doc_id bigint, seq int, start bigint, length bigint, replacement string")
    text = "one two three four five"
    for i in range(7):
        text = text[:2 * i] + f" w{i}" + text[2 * i + 1:]
    for per_round in (2, 100):
        out = {r["doc_id"]: r for r in tc.apply_edit_log(tc.build(docs, BYTE_BPE), log, BYTE_BPE, per_round).withColumn("n", tc.n_tokens()).collect()}
        assert {k: r["text"] for k, r in out.items()} == {1: text, 2: "untouched", 3: "new"}
        assert all(r["n"] == count(r["text"]) for r in out.values())


def test_query_against_whole_encoding(spark):
    from quillspark.llm import queries
    count, sf = library(), "/root/testdata/sf0.001"
    state = tc.build(queries.table(spark, sf, "documents"), BYTE_BPE)
    texts = {r["doc_id"]: r["text"] for r in tc.apply_edits(state, queries.document_edits(), BYTE_BPE).collect()}
    whole = {r["doc_id"]: r["text"] for r in queries.table(spark, sf, "documents").collect()}
    rows = queries.QUERIES["op4_token_counts"](spark, sf).collect()
    assert len(rows) == len(whole)
    for r in rows:
        assert r["n_tokens"] == count(whole[r["doc_id"]]) and r["n_tokens_edited"] == count(texts[r["doc_id"]])
