"""Sources: A1-A6, A16. Every scan has an explicit schema (never inferred)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillspark.functions.text import py_strip
from quillspark.session import path_exists

CORPUS_SCHEMA = "dataset string, pos bigint, text string, content string, lang string"


def scan_jsonl(spark: SparkSession, path: str, schema: str | StructType = CORPUS_SCHEMA) -> DataFrame:
    """A1: one JSON object per line; blank lines are skipped by the reader; a
    malformed line fails the job (FAILFAST), like ``json.loads`` aborting."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def scan_table(spark: SparkSession, root: str, name: str, subset: str | None = None) -> DataFrame:
    """A2: a Parquet dataset by name and optional subset directory."""
    path = f"{root.rstrip('/')}/{name}" + (f"/{subset}" if subset else "")
    if not subset and not name.endswith(".parquet") and path_exists(spark, path + ".parquet"):
        path += ".parquet"
    return spark.read.parquet(path)


def scan_compressed_glob(spark: SparkSession, glob: str,
                         schema: str | StructType = CORPUS_SCHEMA) -> DataFrame:
    """A3: compressed JSONL. The codec comes from the file extension: ``.gz``
    and ``.bz2`` go through Spark's reader, ``.zst`` is inflated in the tasks
    (``zst_lines``), as Spark leaves it to a native codec."""
    if not glob.endswith(".zst"):
        return spark.read.schema(schema).option("mode", "FAILFAST").json(glob)
    from quillspark.sources.zst_lines import read_zst_lines
    kind = schema if isinstance(schema, StructType) else StructType.fromDDL(schema)
    lines = read_zst_lines(spark, glob).filter(F.length(py_strip("value")) > 0)
    return lines.select(F.from_json("value", kind, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def scan_with_stem(spark: SparkSession, root: str, names=None,
                   schema: str | StructType = CORPUS_SCHEMA, ext: str = "jsonl") -> DataFrame:
    """A4: every ``*.{ext}`` under ``root`` (a file, a Spark output directory
    or one of a partitioned output, ``key=stem.{ext}``); ``dataset`` = the file
    stem; optional name list."""
    d = spark.read.schema(schema).option("mode", "FAILFAST").json(f"{root.rstrip('/')}/*.{ext}")
    stem = F.regexp_extract(F.col("_metadata.file_path"), rf"/(?:[^/=]+=)?([^/=]+)\.{ext}(/[^/]*)?$", 1)
    d = d.withColumn("dataset", stem)
    if names:
        d = d.filter(F.col("dataset").isin(*names))
    return d


def scan_partitioned(spark: SparkSession, root: str, schema: str | StructType,
                     **partitions) -> DataFrame:
    """A5: Hive-style subset/language directories (``lang=python``); filters
    on partition columns prune directories before any file is opened."""
    d = spark.read.schema(schema).option("mode", "FAILFAST").json(root)
    for k, v in partitions.items():
        d = d.filter(F.col(k).isin(*v) if isinstance(v, (list, tuple)) else F.col(k) == v)
    return d


def scan_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines, stripped, blank lines dropped."""
    t = spark.read.text(path)
    return t.select(py_strip("value").alias("line")).filter(F.length("line") > 0)


def config_from_file(spark: SparkSession, path: str, section: str = "datasets") -> dict:
    """A mapping of a config file (``.yaml`` / ``.yml`` where PyYAML is
    installed, else JSON), read through Spark from wherever it is."""
    text = "\n".join(r[0] for r in spark.read.option("wholetext", True).text(path).collect())  # one small file
    if path.rstrip("/").endswith((".yaml", ".yml")):
        import yaml
        config = yaml.safe_load(text)
    else:
        import json
        config = json.loads(text)
    return (config or {}).get(section) or {}


def config_sources(spark: SparkSession, config: dict) -> DataFrame:
    """The ``datasets`` mapping of a config as rows (one per source)."""
    rows = [(k, v.get("name"), v.get("subset"), int(v.get("target_tokens") or 0),
             v.get("source")) for k, v in config.items()]
    return spark.createDataFrame(
        rows, "dataset string, repo string, subset string, target_tokens bigint, source string")


def check_sources(requested: DataFrame, available: DataFrame) -> DataFrame:
    """Requested names with ``status`` ok / unknown (unknown ones are
    reported and skipped, never fatal)."""
    av = available.select("dataset").distinct().withColumn("_ok", F.lit(True))
    return requested.join(av, "dataset", "left").select(
        "dataset", F.when(F.col("_ok"), F.lit("ok")).otherwise(F.lit("unknown")).alias("status"))
