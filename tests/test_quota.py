"""Quotas filled in rounds give the rows of encoding everything, with few rows encoded."""

from pyspark.sql import functions as F

from conftest import SF_SMALL
from quillspark.operators import chat as H
from quillspark.plans import registry as R
from quillspark.plans import sft_plan as SP
from quillspark.session import table


def test_rounds_equal_encoding_everything(spark):
    conv, enc = table(spark, SF_SMALL, "conversations"), R._encoder(spark, SF_SMALL)
    sizes = SP.sft_candidates(conv, enc).filter("ids is not null").agg(F.percentile(F.size("ids"), 0.4)).first()[0]
    for limit, max_tokens in ((3, 2048), (5, int(sizes)), (10 ** 6, 2048), (2, 1)):
        got = SP.sft_flagged(conv, enc, limit=limit, max_tokens=max_tokens)
        every = H.first_n_valid(SP.sft_candidates(conv, enc), H.dataset_counts(None, limit), max_tokens)
        key = lambda d: sorted(map(tuple, d.filter("processed").select("dataset", "pos", "is_valid", "too_long", "taken").collect()), key=repr)
        assert key(got) == key(every)
        assert sorted(map(tuple, H.collect_skips(got).collect())) == sorted(map(tuple, H.collect_skips(every).collect()))


def test_few_rows_are_encoded(spark):
    rows = [(i, t, r, f"text {i}") for i in range(400) for t, r in ((0, "user"), (1, "assistant"))]
    rows += [(None, 0, "user", "none"), (None, 1, "assistant", "none")]
    conv = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    enc = R._encoder(spark, SF_SMALL)
    d = SP.quota_prefix(conv, enc, ["no_robots"] if "no_robots" in H.DATASETS else [next(iter(H.DATASETS))], limit=20)
    n = d.filter("ids is not null").count()
    assert 20 <= n <= 30
