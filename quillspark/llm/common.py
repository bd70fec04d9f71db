"""Small helpers of the operators in this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.session import map_arrow, materialize, table

__all__ = ["documents", "map_arrow", "materialize", "shuffle_partitions", "table", "text_or_empty"]


def text_or_empty(name: str = "text"):
    """The text column with null as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def documents(docs: DataFrame, *extra: str) -> DataFrame:
    """``doc_id`` and ``text`` only (null text: empty), so that further or
    clashing columns of the input never reach an operator's plan."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"), *extra)


def shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
