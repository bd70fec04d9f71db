"""Literal rows of the five native benchmark schemas."""

from quillspark.operators import evalops as V


def one(df):
    r = df.first()
    return r.task, r.item_id, r.context, list(r.choices), r.gold


def test_adapters(spark):
    h = spark.createDataFrame([(7, "A man", ["sits", "runs"], "1")], "item_id bigint, ctx string, endings array<string>, label string")
    assert one(V.hellaswag_items(h)) == ("hellaswag", 7, "A man", ["sits", "runs"], 1)
    a = spark.createDataFrame([(1, "Why?", (["x", "y", "z"],), "C"), ], "item_id bigint, question string, choices struct<text:array<string>>, answerKey string")
    assert one(V.arc_items(a, "arc_easy")) == ("arc_easy", 1, "Why?", ["x", "y", "z"], 2)
    digit = spark.createDataFrame([(1, "Why?", (["x"],), "1")], a.schema)
    assert one(V.arc_items(digit, "arc_challenge"))[4] == 0
    w = spark.createDataFrame([(3, "The _ and _ fit.", "cup", "mug", "2")], "item_id bigint, sentence string, option1 string, option2 string, answer string")
    assert one(V.winogrande_items(w)) == ("winogrande", 3, "The _ and _ fit.", ["cup", "mug"], 1)
    full = [r.full_text for r in V.build_candidates(V.winogrande_items(w), V.filled_blanks).orderBy("choice_idx").collect()]
    assert full == ["The cup and cup fit.", "The mug and mug fit."]
    p = spark.createDataFrame([(2, "open it", "pull", "push", 0)], "item_id bigint, goal string, sol1 string, sol2 string, label int")
    assert one(V.piqa_items(p)) == ("piqa", 2, "Question: open it\nAnswer:", ["pull", "push"], 0)
    m = spark.createDataFrame([(4, "2+2", ["3", "4"], 1)], "item_id bigint, question string, choices array<string>, answer int")
    assert one(V.mmlu_items(m)) == ("mmlu", 4, "Question: 2+2\nChoices:\nA. 3\nB. 4\nAnswer:", ["3", "4"], 1)
    rows = V.build_candidates(V.mmlu_items(m)).orderBy("choice_idx").collect()
    assert [(r.choice_idx, r.choice, r.full_text[-9:], r.gold) for r in rows] == [(0, "3", "Answer: 3", 1), (1, "4", "Answer: 4", 1)]


def test_items_without_choices_have_no_candidates(spark):
    h = spark.createDataFrame([(7, "A man", [], "1"), (8, None, ["a"], "0")], "item_id bigint, ctx string, endings array<string>, label string")
    assert [(r.item_id, r.full_text) for r in V.build_candidates(V.hellaswag_items(h)).collect()] == [(8, None)]


def test_items_with_gaps_and_repeated_ids(spark):
    """Choices come from the items that follow in the order of ids, whatever the ids are."""
    ids = [-3, 1, 2, 7, 7, 500, 10**7, 4 * 10**9]
    texts = [f"c{i} c{i} g{i} g{i}" for i in range(len(ids))]
    b = spark.createDataFrame(list(zip(ids, texts))[::-1], "item_id bigint, text string")
    items = V.suite_items(V.benchmark_items(b), ["hellaswag", "piqa"])
    rows = {(r.task, r.item_no): r for r in items.collect()}
    assert len(rows) == 2 * len(ids) == items.count()
    for i, item_id in enumerate(ids):
        for task, size in (("hellaswag", 4), ("piqa", 2)):
            r = rows[task, i]
            want = [f"g{(i + (j - i % size) % size) % len(ids)}" for j in range(size)]
            assert (r.item_id, list(r.choices), r.gold) == (item_id, [f"{w} {w}" for w in want], i % size)
            assert r.choices[r.gold] == f"g{i} g{i}" and f"c{i} c{i}" in r.context


def test_scores_do_not_depend_on_the_ids(spark):
    from pyspark.sql import functions as F

    from conftest import SF_SMALL
    from quillspark.plans import registry as R
    from quillspark.plans.eval_plan import mc_results

    b = R.table(spark, SF_SMALL, "benchmark")
    result = lambda d: [tuple(r) for r in mc_results(V.benchmark_items(d), ["piqa", "winogrande"], R._encoder(spark, SF_SMALL), R._scorer(spark, SF_SMALL))
                        .select("task", "item_id", "pred", "gold").orderBy("task", "item_id").collect()]
    plain = result(b)
    gaps = result(b.withColumn("item_id", F.col("item_id") * 7 + 3))
    assert len(plain) == 2 * b.count() and gaps == [(t, 7 * i + 3, p, g) for t, i, p, g in plain]
    # two items with each id stay two
    assert len(result(b.withColumn("item_id", F.floor(F.col("item_id") / 2)))) == len(plain)
