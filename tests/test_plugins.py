"""External encoders and scorers give the rows of the built-in ones; items without an id are scored like others."""

import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from quillspark.operators import chat as H
from quillspark.operators import evalops as V
from quillspark.operators.encode import Encoder, PandasEncoder
from quillspark.operators.ngram import BatchScorer, score_sequences
from quillspark.plans import eval_plan as EP
from quillspark.plans import registry as R
from quillspark.session import table


def _external(spark):
    """The built-in vocabulary as somebody else's encoder."""
    built: Encoder = R._encoder(spark, SF_SMALL)
    pieces = list(built.pieces)

    def load():
        import pyarrow as pa

        from quillspark.functions.arrow_pieces import split_strings
        from quillspark.operators.encode import SPECIALS
        ids = {p: i + len(SPECIALS) for i, p in enumerate(pieces)}
        texts = dict(SPECIALS) | {i: p for p, i in ids.items()}

        class Plain:
            def encode(self, text):
                return [ids.get(p, 0) for p in split_strings(pa.array([text]))[0].as_py()]

            def decode(self, out):
                return "".join(texts.get(i, "") for i in out)
        return Plain()
    return built, PandasEncoder(load, vocab_size=built.vocab_size)


def _same(a, b):
    key = lambda r: repr(r)
    return sorted(map(tuple, a.collect()), key=key) == sorted(map(tuple, b.collect()), key=key)


def test_chat_with_an_external_encoder(spark):
    built, own = _external(spark)
    turns = H.collect_turns(table(spark, SF_SMALL, "conversations"))
    d = H.shape_messages(turns).filter(H.valid_conversation("messages"))
    a, b = (H.tokenize_conversation(d, e, "messages", drop=["messages"]).select("pos", "ids", "mask") for e in (built, own))
    assert a.count() > 0 and _same(a, b)


def test_documents_with_an_external_encoder(spark):
    built, own = _external(spark)
    docs = table(spark, SF_SMALL, "documents").select("doc_id", "text")
    a, b = (e.encode(docs, add_bos=True, add_eos=True, drop_text=True) for e in (built, own))
    assert _same(a, b)
    a, b = (e.decode(x, "ids", "back").select("doc_id", "back") for e, x in ((built, a), (own, b)))
    assert _same(a, b)


def _batch_scorer(scorer):
    counts = {(r["prev"], r["token"]): r["count"] for r in scorer.bigrams.collect()}
    contexts = {r["prev"]: (r["ctx_count"], r["top_token"]) for r in scorer.contexts.collect()}
    k, size = scorer.k, scorer.vocab_size

    def load():
        def model(ids, lengths):
            logprob, top = np.zeros(ids.shape), np.zeros(ids.shape, bool)
            for r in range(len(ids)):
                for j in range(1, int(lengths[r])):
                    p, t = int(ids[r, j - 1]), int(ids[r, j])
                    total, best = contexts.get(p, (0, 0))
                    logprob[r, j] = np.log((counts.get((p, t), 0) + k) / (total + k * size))
                    top[r, j] = t == best
            return logprob, top
        return model
    return BatchScorer(load, max_tokens=700, group=50)


def test_scores_of_a_batch_scorer(spark):
    encoder, scorer = R._encoder(spark, SF_SMALL), R._scorer(spark, SF_SMALL)
    stub = _batch_scorer(scorer)
    items = V.suite_items(V.benchmark_items(table(spark, SF_SMALL, "benchmark")), ["hellaswag", "mmlu"])
    for max_length in (None, 24):
        a, b = (V.choice_scores(items, encoder, s, max_length=max_length).select("task", "item_id", "choice_idx", "n_tokens", "n_choice_tokens", "is_greedy",
                                                                                   F.round("score", 9), F.round("score_sum", 9)) for s in (scorer, stub))
        assert a.count() > 0 and _same(a, b)
    texts = table(spark, SF_SMALL, "benchmark").withColumnRenamed("text", "full_text")
    a, b = (V.rolling_scores(texts, encoder, s, ["item_id"]).select("item_id", "n_tokens", F.round("logprob_sum", 8)) for s in (scorer, stub))
    assert _same(a, b)


def test_batches_are_bounded_and_padded(spark):
    shapes = []

    def model(ids, lengths):
        shapes.append(ids.shape)
        assert all((row[n:] == -7).all() for row, n in zip(ids, lengths, strict=True))
        return -ids.astype(float), ids % 2 == 0
    rng = np.random.default_rng(0)
    ids = [rng.integers(1, 9, n).tolist() for n in rng.integers(0, 30, 200)] + [None, [4]]
    start = rng.integers(0, 6, len(ids)).tolist()
    sums, greedy = score_sequences(model, ids, start, 100, -7)
    for x, s, total, g in zip(ids, start, sums, greedy, strict=True):
        own = (x or [])[max(s, 1):]
        assert total == -sum(own) and g == all(t % 2 == 0 for t in own)
    assert all(n * w <= 100 or n == 1 for n, w in shapes) and len(shapes) < 60


def test_items_without_an_id_are_scored_like_others(spark):
    encoder, scorer = R._encoder(spark, SF_SMALL), R._scorer(spark, SF_SMALL)
    rows = [(i, f"{'abcdef'[i]} the and of to in {i} is that it was") for i in range(6)]
    nulls = [(None if i < 3 else i, t) for i, t in rows]
    out = []
    for r in (rows, nulls):
        items = V.suite_items(V.benchmark_items(spark.createDataFrame(r, "item_id bigint, text string")), ["hellaswag", "arc_easy"])
        s = V.choice_scores(items, encoder, scorer)
        d = V.example_details(s, V.build_candidates(items), V.predict_and_score(s))
        a = V.accuracy(V.predict_and_score(s))
        out.append([sorted((x["task"], x["choice_idx"], round(x["score"], 9), x["is_greedy"]) for x in s.collect()),
                    sorted((x["task"], x["example_id"], x["context"], tuple(x["choices"]), tuple(round(v, 9) for v in x["model_scores"])) for x in d.collect()),
                    sorted(map(tuple, a.collect()))])
    assert out[0] == out[1] and len(out[0][0]) == 48 and len(out[0][1]) == 12
    wino = V.build_candidates(V.suite_items(V.benchmark_items(spark.createDataFrame(nulls, "item_id bigint, text string")), ["winogrande"]), V.filled_blanks)
    assert V.predict_and_score(V.fill_blank_scores(wino, encoder, scorer), one_based=True).count() == 6
    repeated = spark.createDataFrame([(1, "the and of"), (1, "it was")], "item_id bigint, full_text string")
    both = V.rolling_scores(repeated, encoder, scorer, ["item_id"]).collect()
    assert len({round(r["logprob_sum"], 9) for r in both}) == 2
    assert EP.suite_accuracy(spark.createDataFrame(nulls, "item_id bigint, text string"), "default", encoder, scorer).count() == 5
