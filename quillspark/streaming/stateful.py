"""Incremental collection with state kept between micro-batches.

"Streaming" in the reference means reading a dataset incrementally. A micro-
batch is an ordinary DataFrame here (``foreachBatch``): its running values come
from the two-phase operators of ``ordered``, so a hot dataset or run is never
one task, and a state table with one row per dataset (or run) carries them on.

Output and state of a batch are written under its number: a batch that is run
again after a failure overwrites its own output and reads the same state as
before. Files are taken in order of their modification time; a batch whose
order values go back behind the state's fails the query instead of giving
wrong sums.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.operators.ordered import previous, range_buckets, running_min, running_sums
from quillspark.session import materialize, path_exists

BUDGET_OUT = "dataset string, pos long, est long, cum_tokens long, doc_index long, is_val boolean"
BUDGET_STATE = "dataset string, tokens long, docs long, closed boolean, last long"
RUN_OUT = "run string, event_id long, step long, loss double, prev_best double, improved boolean, tokens_per_sec double, tokens_seen long"
RUN_STATE = "run string, steps long, best double, last long, last_id long"

Step = Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]]


def _with_state(df: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """``df`` with the state's row of its key (null keys meet null keys)."""
    own = state.withColumnRenamed(key, "_state_key")
    return df.join(own, df[key].eqNullSafe(own["_state_key"]), "left").drop("_state_key")


def _carry(seen: DataFrame, state: DataFrame, key: str, update: dict) -> DataFrame:
    """The new state: ``update`` (columns over ``seen`` and the old state,
    either of which may lack a key) for every key of both."""
    keys = seen.select(key).unionByName(state.select(key)).distinct()
    s = seen.select(F.struct("*").alias("_s"), F.col(key).alias("_k"))
    t = state.select(F.struct("*").alias("_t"), F.col(key).alias("_k"))
    both = keys.join(s, keys[key].eqNullSafe(s["_k"]), "left").drop("_k")
    both = both.join(t, both[key].eqNullSafe(t["_k"]), "left").drop("_k")
    return both.select(key, *[v.alias(k) for k, v in update.items()])


def budget_step(max_tokens: int | None, val_every: int = 100) -> Step:
    """S1 + S2 for one batch of ``dataset, pos, est``: admit documents until
    the per-dataset budget closes (it stays closed), every-Nth val split."""
    def step(batch: DataFrame, state: DataFrame):
        d = running_sums(batch.select("dataset", "pos", "est"), ["dataset"], "pos",
                         {"_cum": F.col("est"), "_n": F.lit(1)})
        d = _with_state(d, state, "dataset")
        cum = F.coalesce("tokens", F.lit(0)) + F.col("_cum")
        fits = (cum <= max_tokens) if max_tokens else F.lit(True)
        d = d.withColumn("_back", F.coalesce(F.col("pos") <= F.col("last"), F.lit(False))) \
            .withColumn("_in", ~F.coalesce("closed", F.lit(False)) & fits).withColumn("cum_tokens", cum) \
            .withColumn("doc_index", F.coalesce("docs", F.lit(0)) + F.col("_n") - 1)
        d = materialize(d, "stream-batch")  # read for the output and for the state
        # admission is a prefix, so the running values of admitted rows are those of all rows
        out = d.filter("_in").select("dataset", "pos", "est", "cum_tokens", "doc_index",
                                     (F.col("doc_index") % val_every == 0).alias("is_val"))
        seen = d.groupBy("dataset").agg(
            F.sum(F.when(F.col("_in"), F.col("est")).otherwise(0)).alias("tokens"),
            F.sum(F.col("_in").cast("long")).alias("docs"), F.max(~F.col("_in")).alias("closed"),
            F.max("pos").alias("last"), F.max("_back").alias("back"))
        zero = lambda c: F.coalesce(c, F.lit(0))
        no = lambda c: F.coalesce(c, F.lit(False))
        new = _carry(seen, state, "dataset", {
            "tokens": zero(F.col("_t.tokens")) + zero(F.col("_s.tokens")), "docs": zero(F.col("_t.docs")) + zero(F.col("_s.docs")),
            "closed": no(F.col("_t.closed")) | no(F.col("_s.closed")), "last": F.greatest("_t.last", "_s.last"),
            "back": no(F.col("_s.back"))})
        return out, new
    return step


def run_step(tokens_per_step: int = 1) -> Step:
    """S4 for one batch of ``run, event_id, ts, loss``: step number, best-so-far
    flags (E8) and throughput (D17: a step's tokens over the seconds since the
    run's step before, which an earlier batch may have brought; null for the
    first step and where no time has passed), in ``(ts, event_id)`` order."""
    def step(batch: DataFrame, state: DataFrame):
        d = batch.withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
        d = range_buckets(d, ["run", "_us", "event_id"])
        d = running_sums(d, ["run"], ["_us", "event_id"], {"_n": F.lit(1)}, bucket="_part")
        d = running_min(d, ["run"], ["_us", "event_id"], F.col("loss"), "_min", bucket="_part")
        d = previous(d, ["run"], ["_us", "event_id"], F.col("_us"), "_lag", bucket="_part")
        d = _with_state(d, state, "run").withColumn("prev_best", F.least("best", "_min"))
        secs = (F.col("_us") - F.coalesce("_lag", "last")) / 1e6
        d = d.withColumn("step", F.coalesce("steps", F.lit(0)) + F.col("_n")) \
            .withColumn("tokens_per_sec", F.try_divide(F.lit(float(tokens_per_step)), secs)) \
            .withColumn("_back", F.coalesce((F.col("_us") < F.col("last")) | ((F.col("_us") == F.col("last")) & (F.col("event_id") <= F.col("last_id"))), F.lit(False)))
        d = materialize(d, "stream-batch")  # read for the output and for the state
        out = d.select("run", "event_id", "step", "loss", "prev_best", (F.col("prev_best").isNull() | (F.col("loss") < F.col("prev_best"))).alias("improved"),
                       "tokens_per_sec", (F.col("step") * tokens_per_step).alias("tokens_seen"))
        seen = d.groupBy("run").agg(F.count(F.lit(1)).alias("steps"), F.min("loss").alias("best"), F.max(F.struct("_us", "event_id")).alias("last"),
                                    F.max("_back").alias("back"))
        newest = F.greatest(F.struct(F.col("_t.last").alias("us"), F.col("_t.last_id").alias("id")),
                            F.struct(F.col("_s.last._us").alias("us"), F.col("_s.last.event_id").alias("id")))
        zero = lambda c: F.coalesce(c, F.lit(0))
        new = _carry(seen, state, "run", {
            "steps": zero(F.col("_t.steps")) + zero(F.col("_s.steps")), "best": F.least("_t.best", "_s.best"),
            "last": newest["us"], "last_id": newest["id"], "back": F.coalesce("_s.back", F.lit(False))})
        return out, new
    return step


def run_events(stream: DataFrame) -> DataFrame:
    """Metric events as run rows: run = ``event_type``, loss = ``value``."""
    return stream.select(F.col("event_type").alias("run"), "event_id", "ts", F.col("value").alias("loss"))


def stream_token_stats(stream: DataFrame) -> DataFrame:
    """S3: running counters per dataset (update/complete output mode)."""
    return stream.groupBy("dataset").agg(
        F.count(F.lit(1)).cast("bigint").alias("docs"),
        F.sum("est").cast("bigint").alias("tokens"),
        F.sum("n_chars").cast("bigint").alias("total_chars"))


def run_steps(spark: SparkSession, stream: DataFrame, step: Step, out_schema: str, state_schema: str, path: str) -> DataFrame:
    """Drive a stream to its end (``availableNow``), batch by batch, and read
    the output back. ``path`` (in shared storage) keeps the query checkpoint,
    the batches' output and their states; a later call goes on from there."""
    def at(kind: str, epoch: int) -> str:
        return f"{path}/{kind}/batch={epoch:08d}"

    def write(batch: DataFrame, epoch: int) -> None:
        known = path_exists(spark, at("state", epoch - 1) + "/_SUCCESS") if epoch else False
        session = batch.sparkSession
        state = session.read.schema(state_schema).parquet(at("state", epoch - 1)) if known else session.createDataFrame([], state_schema)
        out, new = step(batch, state)
        new.write.mode("overwrite").parquet(at("state", epoch))
        if session.read.parquet(at("state", epoch)).filter("back").head(1):
            raise ValueError("input went back behind rows already taken; files must come in order")
        out.write.mode("overwrite").parquet(at("out", epoch))

    q = stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/checkpoint") \
        .trigger(availableNow=True).start()
    q.awaitTermination()
    if not path_exists(spark, f"{path}/out"):
        return spark.createDataFrame([], out_schema)
    return spark.read.schema(out_schema).parquet(f"{path}/out").select(*[c.strip().split(" ")[0] for c in out_schema.split(",")])


def run_to_table(spark: SparkSession, sdf: DataFrame, out_path: str, ckpt: str,
                 mode: str = "append", fmt: str = "parquet") -> DataFrame:
    """Drive a streaming query to completion (``availableNow``) into a table
    and read the table back. The query checkpoint makes it resumable (A9)."""
    if mode == "append":
        q = (sdf.writeStream.format(fmt).option("path", out_path)
             .option("checkpointLocation", ckpt).outputMode("append")
             .trigger(availableNow=True).start())
        q.awaitTermination()
        return spark.read.parquet(out_path)

    def write(batch, _epoch):
        batch.write.mode("overwrite").parquet(out_path)
    q = (sdf.writeStream.foreachBatch(write).option("checkpointLocation", ckpt)
         .outputMode(mode).trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.parquet(out_path)


def write_ordered_files(df: DataFrame, root: str, order: str, n_files: int = 4) -> str:
    """Replay helper: one range-partitioned write of a table, whose files get
    ascending modification times, so that a file stream takes them in
    ``order``. (Only the files' names and times pass through the driver.)"""
    spark = df.sparkSession
    path = f"{root.rstrip('/')}/parts"
    df.repartitionByRange(n_files, order).sortWithinPartitions(order).write.mode("overwrite").parquet(path)
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files = sorted(f.getPath().toString() for f in fs.listStatus(where) if f.getPath().getName().startswith("part-"))
    for i, f in enumerate(files):
        fs.setTimes(jvm.org.apache.hadoop.fs.Path(f), 1_000_000_000_000 + 60_000 * i, -1)
    return path


def read_ordered_files(spark: SparkSession, root: str, schema, files_per_trigger: int = 1):
    """A file stream over the files written by :func:`write_ordered_files`."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
            .parquet(f"{root.rstrip('/')}/parts"))
