"""The pipeline on odd rows and on a small table, and the queries that SQL can express."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import quality, simhash
from quillspark.llm.queries import QUERIES, SQL, table
from tools.oracle_check import digest

from .helpers import empty_documents, odd_documents

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "labels", "pages", "conversations"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = QUERIES[name](spark, SF)
    want = con.execute(SQL[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert digest(df.columns, [tuple(r) for r in df.collect()])[0] == digest(columns, want.fetchall())[0]


def test_stages_keep_what_they_should(spark):
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "simhash_near_dedup", "best_fit_packing"]
    docs = table(spark, SF, "documents").cache()
    kept = {r["doc_id"] for r in stages["quality_rules"](spark, docs, SF).collect()}
    want = {r["doc_id"] for r in quality.judge(docs, table(spark, SF, "labels")).filter("kept").collect()}
    assert kept == want
    kept = stages["simhash_near_dedup"](spark, docs, SF)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r["component_id"] for r in simhash.near_duplicates(docs).collect()}


def test_odd_rows(spark):
    docs = odd_documents(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert len(rows) == len({(r["doc_id"], r["text"]) for r in rows}) or name != "simhash_near_dedup"
        assert stage(spark, empty_documents(spark), SF).count() == 0
    near = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    # texts without words are one group, of which the smallest id stays; of repeated rows one stays
    assert sorted(r["doc_id"] for r in near if r["doc_id"] in (0, 1, 2, 3)) == [0]
    assert sum(r["doc_id"] == 8 for r in near) == 1 and sum(r["doc_id"] is None for r in near) == 1
    lone = spark.createDataFrame([(None, "a b c d"), (None, "e f g h"), (None, "e f g h")], "doc_id bigint, text string")
    assert corpus_pipeline.drop_near_duplicates(spark, lone, SF).count() == 2


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "sequence_id", "offset", "ids"} <= set(out.columns)
    longest = out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0]
    assert 0 < longest <= 1024
