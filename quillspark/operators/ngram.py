"""A count-based bigram language model trained by Spark, and
per-token log-probabilities as a table.

This is the re-aim of the reference's neural forward pass: any other scorer
plugs in by producing the same ``logprob`` table (e.g. with ``mapInPandas``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ADD_K = 1.0
#: Distinct pairs that a task counts before it sends them on.
PAIR_ROWS = 1 << 20


def token_pairs(df: DataFrame, ids: str = "ids", keys=()) -> DataFrame:
    """``keys.., pos, prev, token``: every adjacent pair of an id list
    (``pos`` = 0-based index of ``token``). Pairs are cut from the array in
    place; no window over the sequence."""
    n = F.size(ids)
    z = F.arrays_zip(F.slice(ids, 1, n - 1).alias("prev"), F.slice(ids, 2, n - 1).alias("token"))
    d = df.select(*keys, F.posexplode(F.when(n >= 2, z)).alias("_i", "_p"))
    return d.select(*keys, (F.col("_i") + 1).cast("int").alias("pos"),
                    F.col("_p.prev").alias("prev"), F.col("_p.token").alias("token"))


def fit_ngram(encoded: DataFrame, ids: str = "ids") -> DataFrame:
    """K0: bigram counts ``prev, token, count``.

    Each task counts the adjacent pairs of its rows with numpy, slice by
    slice, and holds at most some ``PAIR_ROWS`` distinct ones (no per-token
    rows leave the task, hot bigrams are combined at the source); the
    ``groupBy`` then sums the tasks' counts."""
    from quillspark.session import map_arrow

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from quillspark.functions.arrow_pieces import own_values, row_slices
        held, size = [], 0

        def summed():
            u, at = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
            c = np.zeros(len(u), np.int64)
            np.add.at(c, at, np.concatenate([n for _, n in held]))
            return u, c

        def rows(u, c):
            for a in range(0, len(u), 1 << 16):
                x = u[a:a + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array((x >> 32).astype(np.int32)), pa.array((x & 0xFFFFFFFF).astype(np.int32)),
                     pa.array(c[a:a + (1 << 16)])], names=["prev", "token", "n"])

        for part in (s for b in batches for s in row_slices(b, 0)):
            offs, values = own_values(part.column(0))
            offs, v = np.asarray(offs, dtype=np.int64), np.asarray(values, dtype=np.int64)
            if len(v) < 2:
                continue
            keep = np.ones(len(v) - 1, dtype=bool)
            starts = offs[1:-1]  # where a new row begins
            starts = starts[(starts > 0) & (starts < len(v))]
            keep[starts - 1] = False
            code = (v[:-1][keep] << 32) | v[1:][keep]
            if len(code) == 0:
                continue
            held.append(np.unique(code, return_counts=True))
            size += len(held[-1][0])
            if size > PAIR_ROWS:
                held = [summed()]
                size = len(held[0][0])
                if size > PAIR_ROWS // 2:
                    yield from rows(*held[0])
                    held, size = [], 0
        if held:
            yield from rows(*summed())
    pairs = map_arrow(encoded.select(ids), run, "prev int, token int, n long")
    return pairs.groupBy("prev", "token").agg(F.sum("n").cast("bigint").alias("count"))


class BigramScorer:
    """Add-k smoothed bigram model: ``P(t|p) = (c(p,t)+k) / (c(p)+k*V)``."""

    def __init__(self, bigrams: DataFrame, vocab_size: int, k: float = ADD_K,
                 materialize: bool = False):
        self.vocab_size = vocab_size
        self.k = k
        if materialize:  # the fitted model is a stage output, written once
            from quillspark.session import materialize as mat
            bigrams = mat(bigrams, "bigram-model")
        self.bigrams = bigrams
        # One aggregate per context token: its total and its most likely next
        # token (ties -> lowest id).
        contexts = bigrams.groupBy("prev").agg(
            F.sum("count").cast("bigint").alias("ctx_count"),
            F.max_by("token", F.struct(F.col("count"), -F.col("token"))).alias("top_token"))
        if materialize:
            from quillspark.session import materialize as mat
            contexts = mat(contexts, "bigram-contexts")
        self.contexts = contexts

    def token_logprobs(self, pairs: DataFrame) -> DataFrame:
        """Add ``logprob`` and ``is_top`` to a pair table
        (``prev, token`` columns). Only the distinct pairs that occur are
        looked up in the model; their counts then go to the pairs. No job runs
        while the plan is built: Spark measures the sides when it comes to
        them and broadcasts the small ones, or splits hot pairs."""
        need = pairs.select("prev", "token").distinct()
        ctx = need.select("prev").distinct().join(self.contexts, "prev")
        found = need.join(self.bigrams, ["prev", "token"], "left").join(ctx, "prev", "left")
        k, V = self.k, self.vocab_size
        lp = F.log((F.coalesce(F.col("count"), F.lit(0)) + F.lit(k))
                   / (F.coalesce(F.col("ctx_count"), F.lit(0)) + F.lit(k * V)))
        known = found.select("prev", "token", lp.alias("logprob"), (F.col("token") == F.coalesce(F.col("top_token"), F.lit(0))).alias("is_top"))
        return pairs.join(known, ["prev", "token"])

    def sequence_scores(self, rows: DataFrame, ids: str = "ids", start: str = "_start") -> DataFrame:
        """``rows`` (a stage with a unique ``_row``) with ``logprob_sum`` and
        ``is_greedy`` over the tokens from place ``start`` on (the first token
        is never scored); 0 and true where there is none."""
        pairs = token_pairs(rows, ids, ["_row", start]).filter(F.col("pos") >= F.col(start)) \
            .groupBy("_row", "prev", "token").agg(F.count(F.lit(1)).alias("_times"))
        agg = self.token_logprobs(pairs).groupBy("_row").agg(
            F.sum(F.col("logprob") * F.col("_times")).alias("logprob_sum"), F.bool_and("is_top").alias("is_greedy"))
        return rows.join(agg, "_row", "left").withColumn("logprob_sum", F.coalesce("logprob_sum", F.lit(0.0))) \
            .withColumn("is_greedy", F.coalesce("is_greedy", F.lit(True)))


class BatchScorer:
    """Any sequence model, run batch-wise in the Python workers.

    ``load()`` is called once per worker and gives ``model(ids, lengths)``:
    ``ids`` is an int32 matrix of sequences filled up with ``pad_id``; it
    returns two matrices of that shape with, for every place but the first,
    the log-probability of the token there given those before it, and whether
    it is the likeliest one (places beyond a sequence's length are ignored).
    Sequences are sorted by length in groups of ``group`` rows, so that a
    batch has little filling, and a batch holds at most ``max_tokens`` places
    (one sequence at least)."""

    def __init__(self, load, max_tokens: int = 1 << 16, group: int = 4096, pad_id: int = 0, name: str | None = None):
        import uuid
        self.load, self.max_tokens, self.group, self.pad_id = load, max_tokens, group, pad_id
        self.name = name or f"scorer-{uuid.uuid4().hex}"

    def sequence_scores(self, rows: DataFrame, ids: str = "ids", start: str = "_start") -> DataFrame:
        """As :meth:`BigramScorer.sequence_scores`, without a join: the rows
        pass through the workers with all their columns."""
        from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

        from quillspark.session import ship_package
        ship_package(rows.sparkSession)
        load, name, max_tokens, group, pad = self.load, self.name, self.max_tokens, self.group, self.pad_id
        schema = StructType([*rows.schema.fields, StructField("logprob_sum", DoubleType()), StructField("is_greedy", BooleanType())])

        def run(batches):
            import pyarrow as pa

            from quillspark.operators import ngram
            from quillspark.operators.encode import pa_schema
            model = ngram._MODELS.get(name)
            if model is None:
                model = ngram._MODELS[name] = load()
            target = pa_schema(schema)
            for whole in batches:
                for at in range(0, whole.num_rows, group):
                    b = whole.slice(at, group)
                    sums, greedy = ngram.score_sequences(model, b.column(ids).to_pylist(), b.column(start).to_pylist(), max_tokens, pad)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sums), pa.array(greedy)], schema=target)
        return rows.mapInArrow(run, schema)


_MODELS: dict = {}


def score_sequences(model, ids: list, start: list, max_tokens: int, pad: int):
    """Sums and greedy flags of the sequences, in their order."""
    import numpy as np
    ids = [x or [] for x in ids]
    length = np.fromiter(map(len, ids), np.int64, len(ids))
    first = np.maximum(np.array([s or 0 for s in start], np.int64), 1)
    sums, greedy = np.zeros(len(ids)), np.ones(len(ids), bool)
    order = [i for i in np.argsort(length, kind="stable").tolist() if length[i] > first[i]]
    while order:
        # the longest left first; shorter ones join while the padded batch stays in bounds
        width = int(length[order[-1]])
        n = max(1, min(len(order), max_tokens // width))
        batch, order = order[-n:], order[:-n]
        matrix = np.full((n, width), pad, np.int32)
        for r, i in enumerate(batch):
            matrix[r, :length[i]] = ids[i]
        logprob, top = model(matrix, length[batch])
        place = np.arange(width)
        counts = (place >= first[batch][:, None]) & (place < length[batch][:, None])
        sums[batch] = np.where(counts, logprob, 0.0).sum(1)
        greedy[batch] = np.where(counts, top, True).all(1)
    return sums, greedy
