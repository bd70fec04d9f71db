"""A training corpus from raw documents, in four stages.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs,
sf_dir)`` and returns a DataFrame, which :func:`run` writes as Parquet and reads
again as the next one's ``docs``. All stages but the last return the columns
of ``documents``, for the documents that they keep; a stage judges only what
the one before has kept.

Defined results, besides those of the operators: a document without a
``doc_id`` is judged by its text like any other, but has no label; repeated
rows are exact copies and so one document after the near-duplicate stage;
empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import packing, quality, simhash, toxicity
from quillspark.llm.common import materialize, table, text_or_empty
from quillspark.llm.queries import BYTE_BPE, held_out

TOXIC_SCORE = 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").filter(~held_out()))
    return toxicity.score_rows(docs, model).filter(F.col("score") < TOXIC_SCORE).select("doc.*")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality.judge_rows(docs, table(spark, sf_dir, "labels")).filter("kept").select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays."""
    found = simhash.near_duplicates(docs, shingle=3, max_distance=3)
    # an id before none; the text's hash tells rows with one or no id apart
    first = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("m"))
    chosen = first.select(F.struct("m.doc_id", "m.text_hash").alias("key"))
    # repeated rows become one in the tasks that read them; a struct with a null id equals another
    key = F.struct(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash")).alias("key")
    rest = [c for c in docs.columns if c != "text"]
    rows = docs.select(key, F.struct(*[F.col(f"`{c}`") for c in [*rest, "text"]]).alias("doc")).groupBy("key").agg(F.min("doc").alias("doc"))
    return rows.join(chosen, "key", "left_semi").select(*[F.col(f"doc.`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of at most 1024 tokens: one row per piece, with its ids."""
    return packing.pack_documents(docs, BYTE_BPE, end_id=2, max_tokens=1024, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", keep_quality),
    ("simhash_near_dedup", drop_near_duplicates),
    ("best_fit_packing", pack),
]

#: SQL has neither zstandard dictionaries nor SimHash.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
