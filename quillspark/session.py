"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app: str = "quillspark", extra: dict | None = None) -> SparkSession:
    """Session tuned for local tests; on a cluster use the cluster's builder
    and keep the AQE settings."""
    b = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
    )
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    Read ``spark.checkpoint.dir`` from the session; only a local session (one
    machine, as in tests) may go without it and gets a scratch folder. On a
    cluster a machine's own folder would be invisible to the other executors.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a shared folder on master {master}")
        d = tempfile.mkdtemp(prefix="quillspark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:  # register once (it creates a subfolder)
        sc.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique path under the shared checkpoint folder for written tables."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check on the cluster file system (HDFS, object store, local)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(conf).exists(p))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread_scan(df: DataFrame) -> DataFrame:
    """For a plain file scan feeding CPU-heavy text work: when the files
    give fewer splits (row groups) than the cluster has cores, spread the
    rows evenly. A scan's partition count is known without running anything;
    at scale (many more splits than cores) this is a no-op."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        return df.repartition(cores)
    return df


def materialize(df: DataFrame, name: str, cluster_by=None) -> DataFrame:
    """Write ``df`` as a Parquet table under the shared checkpoint folder and
    read it back: a stage boundary that cuts lineage (recovery after executor
    loss restarts from the table, not from the raw corpus) and lets several
    consumers share one computation with pushdown and column pruning.

    ``cluster_by``: range-partition and sort the rows on these columns first,
    so that each file holds a contiguous key range and Parquet min/max
    statistics let point lookups (``isin`` filters) skip row groups."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    if cluster_by:
        df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


class StageStore:
    """Stage tables kept by name and parameters and shared by the queries of
    an application, until :meth:`clear` removes them from shared storage."""

    def __init__(self):
        self._paths: dict[tuple, str] = {}

    def get(self, spark: SparkSession, key: tuple, build, cluster_by=None) -> DataFrame:
        """The stage ``key``, made by ``build()`` when it is first asked for."""
        key = (spark.sparkContext.applicationId, *key)
        if key not in self._paths:
            df = build()
            if cluster_by:
                df = df.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
            path = scratch_path(spark, str(key[-1]))
            df.write.mode("overwrite").parquet(path)
            self._paths[key] = path
        return spark.read.parquet(self._paths[key])

    def clear(self, spark: SparkSession) -> None:
        """Delete this application's stages."""
        jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for key in [k for k in self._paths if k[0] == spark.sparkContext.applicationId]:
            p = jvm.org.apache.hadoop.fs.Path(self._paths.pop(key))
            p.getFileSystem(conf).delete(p, True)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``quillspark`` importable in the Python workers (the Arrow
    encoder, vocabulary counts and streaming state functions run there):
    zip the package once per application and ``addPyFile`` it, so Spark
    distributes it to every executor."""
    import zipfile
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg)
    zpath = os.path.join(tempfile.mkdtemp(prefix="quillspark-py-"), "quillspark.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)


#: Bytes of rows handed to Python at once (a batch has one row at least), in
#: place of Spark's default; another setting of the session stays.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
_BATCH_DEFAULT = "67108864b"


def _tidy(fn):
    """``fn`` on a partition's batches; then Arrow's pool gives free memory
    back, as the worker process goes on to other tasks."""
    def run(batches):
        import pyarrow as pa
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
    return run


def map_arrow(df: DataFrame, fn, schema) -> DataFrame:
    """``mapInArrow`` with the package shipped to the Python workers, in
    batches of bounded size however long the texts are."""
    spark = df.sparkSession
    ship_package(spark)
    if spark.conf.get(_BATCH_SETTING) == _BATCH_DEFAULT:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(_tidy(fn), schema)
