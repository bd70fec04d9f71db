"""Tokenizer operators as Spark jobs: J1-J6.

The built-in encoder splits text into lossless pieces with one regular
expression (JVM-side) and maps each piece to an id by a frequency-ranked
vocabulary (J5). The vocabulary is bounded by ``vocab_size`` (a parameter), so
its map is broadcast as one row and looked up inside ``transform``: no
per-token explode and no shuffle of the token data. Above
``MAX_BROADCAST_VOCAB`` entries the exact fallback explodes the pieces, joins
the vocabulary by key and rebuilds each id list in order.

An external encoder (any Python callable) plugs in through ``mapInPandas``
with one load per Python worker (:class:`PandasEncoder`).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.text import pieces

# Special token ids and their text.
UNK_ID, BOS_ID, EOS_ID = 0, 1, 2
SPECIALS = {UNK_ID: "<unk>", BOS_ID: "<s>", EOS_ID: "</s>"}
N_SPECIALS = 3
DEFAULT_VOCAB_SIZE = 32_000
MAX_BROADCAST_VOCAB = 1_000_000  # ~tens of MB as one broadcast map row
#: Distinct pieces, and bytes of their counts, that a task holds before it sends them on.
COUNT_ROWS = 1 << 19
COUNT_BYTES = 16 << 20


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def build_vocab(texts: DataFrame, col: str = "text", vocab_size: int = DEFAULT_VOCAB_SIZE,
                sample_fraction: float | None = None, seed: int = 42) -> DataFrame:
    """``piece, id, count`` for the ``vocab_size - 3`` most frequent pieces,
    ids by rank (count desc, piece asc) after the three specials.

    Counting is a partially aggregated ``groupBy(piece)`` (hot pieces are
    combined map-side). ``sample_fraction`` reproduces the reference's
    document sample for vocabulary training; ``None`` counts the whole corpus.
    """
    src = texts.select(_c(col).alias("_t"))
    if sample_fraction is not None:
        src = src.sample(fraction=sample_fraction, seed=seed)
    counts = piece_counts(src, "_t").groupBy("piece").agg(F.sum("n").alias("count"))
    n = vocab_size - N_SPECIALS
    top = counts.orderBy(F.desc("count"), F.asc("piece")).limit(n)
    w = Window.orderBy(F.desc("count"), F.asc("piece"))  # over <= n rows only
    return top.select("piece", (F.row_number().over(w) + N_SPECIALS - 1).cast("int").alias("id"),
                      F.col("count").cast("bigint").alias("count"))


def piece_counts(df: DataFrame, col: str) -> DataFrame:
    """``piece, n``: piece counts of every task (map-side pre-aggregation,
    bounded: see ``COUNT_ROWS``), to be summed by a ``groupBy(piece)``."""
    from quillspark.session import map_arrow

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc
        from quillspark.functions.arrow_pieces import row_slices, split_strings
        held, size, held_bytes = [], 0, 0

        def summed():
            t = pa.concat_tables(held).group_by("piece").aggregate([("n", "sum")])
            return pa.table([t.column("piece"), t.column("n_sum")], names=["piece", "n"])

        # one count for the task, sent on early when it grows beyond its bound
        for part in (s for b in batches for s in row_slices(b, 0)):
            vc = pc.value_counts(pc.list_flatten(split_strings(part.column(0))))
            held.append(pa.table([vc.field("values"), vc.field("counts").cast(pa.int64())], names=["piece", "n"]))
            size, held_bytes = size + len(held[-1]), held_bytes + held[-1].nbytes
            if size > COUNT_ROWS or held_bytes > COUNT_BYTES:
                held = [summed()]
                size, held_bytes = len(held[0]), held[0].nbytes
                if size > COUNT_ROWS // 2 or held_bytes > COUNT_BYTES // 2:
                    yield from held[0].combine_chunks().to_batches(max_chunksize=1 << 16)
                    held, size, held_bytes = [], 0, 0
        if held:
            yield from summed().combine_chunks().to_batches(max_chunksize=1 << 16)
    return map_arrow(df.select(col), run, "piece string, n long")


class Encoder:
    """Built-in encoder: JVM regex pieces, ids from a frequency-ranked vocabulary.

    Like Spark ML's ``CountVectorizer``, fitting collects the (bounded,
    ``vocab_size``-checked) vocabulary to the driver once and broadcasts it;
    each task looks pieces up with Arrow's vectorized hash lookup
    (``mapInArrow``), so encoding is a narrow, shuffle-free map over the data.
    Spark's own map-column lookup is a linear scan per key and would be
    O(pieces x vocabulary).
    """

    def __init__(self, pieces_by_id: list[str], vocab_size: int = DEFAULT_VOCAB_SIZE,
                 table: DataFrame | None = None):
        if len(pieces_by_id) > MAX_BROADCAST_VOCAB:
            raise ValueError(f"vocabulary of {len(pieces_by_id)} pieces exceeds the "
                             f"broadcast bound {MAX_BROADCAST_VOCAB}; use JoinEncoder")
        self.pieces = list(pieces_by_id)  # pieces[i] has id i + N_SPECIALS
        self.vocab_size = vocab_size
        self.table = table
        self._bc = None

    @classmethod
    def fit(cls, texts: DataFrame, col: str = "text", vocab_size: int = DEFAULT_VOCAB_SIZE,
            sample_fraction: float | None = None):
        vt = build_vocab(texts, col, vocab_size, sample_fraction)
        rows = vt.orderBy("id").select("piece").collect()  # <= vocab_size rows
        return cls([r[0] for r in rows], vocab_size, vt)

    def vocab_table(self) -> DataFrame:
        return self.table

    @property
    def fingerprint(self) -> str:
        """Names the vocabulary by its content, for the workers' caches."""
        import hashlib
        return hashlib.md5("\x00".join(self.pieces).encode()).hexdigest()

    def _broadcast(self, spark):
        from quillspark.session import ship_package
        ship_package(spark)
        if self._bc is None:
            self._bc = spark.sparkContext.broadcast(self.pieces)
        return self._bc

    def encode(self, df: DataFrame, col: str = "text", out: str = "ids",
               add_bos: bool = False, add_eos: bool = False, drop_text: bool = False) -> DataFrame:
        """J1 (+ J2 with ``add_eos``): ``out array<int>`` of the whole text.
        ``drop_text`` drops the text column before the Arrow pass (only the
        pieces travel to Python, only the ids come back)."""
        return self.encode_column(df, F.col(col), out, add_bos, add_eos,
                                  drop=[col] if drop_text else None)

    def encode_column(self, df: DataFrame, text_col: Column, out: str,
                      add_bos: bool = False, add_eos: bool = False,
                      drop=None) -> DataFrame:
        """Encode a string expression (or an ``array<string>`` expression,
        giving ``array<array<int>>``). ``drop``: columns not needed after
        encoding, removed before the rows are shipped to Python."""
        d = df.withColumn("__text", text_col)
        if drop:
            d = d.drop(*drop)
        d = _arrow_ids(d, "__text", out, self._broadcast(df.sparkSession), self.fingerprint)
        return _specials(d, out, add_bos, add_eos)

    def decode(self, df: DataFrame, col: str = "ids", out: str = "decoded",
               skip_special: bool = True) -> DataFrame:
        """Ids -> text. Pieces are lossless, so decode(encode(x)) == x when
        no piece fell back to ``<unk>``."""
        from pyspark.sql.types import StringType, StructField, StructType

        from quillspark.session import map_arrow
        bc, name = self._broadcast(df.sparkSession), self.fingerprint
        schema = StructType(list(df.schema.fields) + [StructField(out, StringType())])

        def run(batches):
            import pyarrow as pa
            import pyarrow.compute as pc
            from quillspark.functions.arrow_pieces import own_values, row_slices
            table = _worker_array(bc, name, specials=not skip_special)
            for b in (s for whole in batches for s in row_slices(whole, col)):
                ids = b.column(col)
                offs, values = own_values(ids)
                # an id outside the vocabulary decodes to '' and is counted elsewhere
                known = pc.and_(pc.greater_equal(values, 0), pc.less(values, len(table)))
                vals = pc.fill_null(pc.take(table, pc.if_else(known, values, None)), "")
                strs = pa.ListArray.from_arrays(offs, vals, mask=ids.is_null())
                yield pa.RecordBatch.from_arrays(
                    list(b.columns) + [pc.binary_join(strs, "")], schema=pa_schema(schema))
        return map_arrow(df, run, schema)


class JoinEncoder:
    """Exact fallback for vocabularies above the broadcast bound: explode the
    pieces, join the vocabulary by key (shuffle) and rebuild each id list in
    order (second shuffle, by row)."""

    def __init__(self, vocab: DataFrame, vocab_size: int):
        self.table = vocab
        self.vocab = vocab.select("piece", F.col("id").cast("int").alias("id"))
        self.vocab_size = vocab_size

    def vocab_table(self) -> DataFrame:
        return self.table

    def encode(self, df: DataFrame, col: str = "text", out: str = "ids",
               add_bos: bool = False, add_eos: bool = False, drop_text: bool = False) -> DataFrame:
        return self.encode_column(df, F.col(col), out, add_bos, add_eos,
                                  drop=[col] if drop_text else None)

    def encode_column(self, df: DataFrame, text_col: Column, out: str,
                      add_bos: bool = False, add_eos: bool = False, drop=None) -> DataFrame:
        from pyspark.sql.types import ArrayType
        d = df.withColumn("__t", text_col)
        nested = isinstance(d.schema["__t"].dataType, ArrayType)
        # distinct texts take part in the join, named by themselves: rows need no number that a recomputed
        # branch could give to another row
        texts = d.select(F.explode("__t").alias("__x")) if nested else d.select(F.col("__t").alias("__x"))
        texts = texts.filter(F.col("__x").isNotNull()).distinct()
        ex = texts.select("__x", F.posexplode(pieces("__x")).alias("_i", "piece"))
        none = F.array().cast("array<int>")
        ids = (ex.join(self.vocab, "piece", "left").groupBy("__x")
               .agg(F.array_sort(F.collect_list(F.struct("_i", F.coalesce("id", F.lit(UNK_ID)).alias("id")))).alias("_p"))
               .select("__x", F.transform("_p", lambda s: s["id"]).alias("_ids")))
        if nested:
            # rows are numbered as they are written; only numbers and places travel through the join
            from quillspark.session import materialize
            one = materialize(d.withColumn("_n", F.monotonically_increasing_id()), "join-encoder")
            lists = one.select("_n", F.posexplode("__t").alias("_at", "__x")).join(ids, "__x", "left").groupBy("_n").agg(
                F.array_sort(F.collect_list(F.struct("_at", F.coalesce("_ids", none).alias("_ids")))).alias("_q"))
            d = one.join(lists, "_n", "left").withColumn(out, F.when(F.size("__t") == 0, F.array().cast("array<array<int>>")).otherwise(
                F.transform("_q", lambda s: s["_ids"])))
            return d.drop("_n", "_q", "__t", *(drop or []))
        d = d.join(ids, d["__t"] == ids["__x"], "left").withColumn(out, F.coalesce("_ids", none)) \
            .drop("_ids", "__x", "__t", *(drop or []))
        return _specials(d, out, add_bos, add_eos)

    def decode(self, df: DataFrame, col: str = "ids", out: str = "decoded", skip_special: bool = True) -> DataFrame:
        """J3 by a join on the distinct ids; an id outside the vocabulary is ''."""
        names = self.vocab.sparkSession.createDataFrame(
            [(i, "" if skip_special else t) for i, t in SPECIALS.items()], "id int, piece string")
        names = self.vocab.select("id", "piece").unionByName(names)
        lists = df.select(F.col(col).alias("_l")).filter(F.col("_l").isNotNull()).distinct()
        ex = lists.select("_l", F.posexplode("_l").alias("_i", "id"))
        text = ex.join(names, "id", "left").groupBy("_l").agg(F.array_sort(F.collect_list(
            F.struct("_i", F.coalesce("piece", F.lit("")).alias("piece")))).alias("_p")) \
            .select("_l", F.array_join(F.transform("_p", lambda s: s["piece"]), "").alias("_d"))
        return df.join(text, df[col] == text["_l"], "left").withColumn(
            out, F.when(F.col(col).isNotNull(), F.coalesce("_d", F.lit("")))).drop("_l", "_d")


def pa_schema(spark_schema):
    from pyspark.sql.pandas.types import to_arrow_schema
    return to_arrow_schema(spark_schema)


_WORKER_CACHE: dict = {}


def _worker_array(bc, name: str, specials: bool | None = None):
    """Per Python worker: the vocabulary ``name`` as an Arrow array, built once.

    ``specials=None``: pieces only (index = id - 3), for lookups.
    ``specials`` True/False: indexable by id, specials as text or ''.
    """
    import pyarrow as pa
    key = (name, specials)
    arr = _WORKER_CACHE.get(key)
    if arr is None:
        vals = list(bc.value)
        if specials is not None:
            head = [SPECIALS[i] if specials else "" for i in range(N_SPECIALS)]
            vals = head + vals
        arr = pa.array(vals, pa.string())
        _WORKER_CACHE[key] = arr
    return arr


def _lookup(arr, value_set):
    """Map a (possibly nested) list array of pieces to int32 ids."""
    import pyarrow as pa
    import pyarrow.compute as pc
    if pa.types.is_list(arr.type) or pa.types.is_large_list(arr.type):
        inner = _lookup(arr.values, value_set)
        return pa.ListArray.from_arrays(arr.offsets, inner, mask=arr.is_null())
    idx = pc.index_in(arr, value_set=value_set)
    ids = pc.add(idx.cast(pa.int32()), pa.scalar(N_SPECIALS, pa.int32()))
    return pc.fill_null(ids, pa.scalar(UNK_ID, pa.int32()))


def _arrow_ids(d: DataFrame, pieces_col: str, out: str, bc, name: str) -> DataFrame:
    """Text (or array of texts) -> ids, inside Arrow batches: vectorized
    piece splitting (``functions/arrow_pieces``) and hash lookup."""
    from pyspark.sql.types import ArrayType, IntegerType

    from quillspark.session import map_arrow
    src = d.schema[pieces_col].dataType
    depth, t = 1, src
    while isinstance(t, ArrayType):
        depth, t = depth + 1, t.elementType
    out_type = IntegerType()
    for _ in range(depth):
        out_type = ArrayType(out_type)
    keep = [f for f in d.schema.fields if f.name != pieces_col]
    from pyspark.sql.types import StructField, StructType
    schema = StructType(keep + [StructField(out, out_type)])

    def run(batches):
        import pyarrow as pa
        from quillspark.functions.arrow_pieces import row_slices, split_nested
        vs = _worker_array(bc, name)
        target = pa_schema(schema)
        for b in (s for whole in batches for s in row_slices(whole, pieces_col)):
            names = b.schema.names
            cols = [b.column(i) for i, n in enumerate(names) if n != pieces_col]
            ids = _lookup(split_nested(b.column(names.index(pieces_col))), vs)
            yield pa.RecordBatch.from_arrays(cols + [ids], schema=target)
    return map_arrow(d, run, schema)


def _specials(d: DataFrame, out: str, add_bos: bool, add_eos: bool) -> DataFrame:
    if add_bos:
        d = d.withColumn(out, F.concat(F.array(F.lit(BOS_ID)), F.col(out)))
    if add_eos:
        d = append_eos(d, out)
    return d


def append_eos(df: DataFrame, col: str = "ids") -> DataFrame:
    """One EOS after every document (no BOS)."""
    return df.withColumn(col, F.concat(F.col(col), F.array(F.lit(EOS_ID))))


def token_lengths(df: DataFrame, col: str = "ids", out: str = "n_tokens") -> DataFrame:
    """Tokens per document / conversation."""
    return df.withColumn(out, F.size(col).cast("bigint"))


def roundtrip_check(encoder: Encoder, df: DataFrame, col: str = "text") -> DataFrame:
    """Per row ``roundtrip_ok`` (decode(encode(x)) == x) and
    ``chars_per_token``; ``compression_ok`` flags chars/token > 3.0."""
    e = encoder.encode(df, col, "_ids")
    d = encoder.decode(e, "_ids", "_dec")
    n = F.size("_ids")
    return (d.withColumn("roundtrip_ok", F.col("_dec") == F.col(col))
             .withColumn("n_tokens", n.cast("bigint"))
             .withColumn("chars_per_token",
                         F.when(n > 0, F.length(col) / n).otherwise(F.lit(0.0)))
             .withColumn("compression_ok", F.col("chars_per_token") > 3.0)
             .drop("_ids", "_dec"))


class PandasEncoder:
    """Any Python encoder (``str -> list[int]``), run over Arrow batches
    and exchangeable with :class:`Encoder` in chat and scoring.

    ``factory`` is called once per Python worker (the loaded encoder is cached
    in the worker), never per row; it returns the encoding function, or an
    object with ``encode`` and ``decode`` (``list[int] -> str``). Its ids are
    used as they are; ``bos_id`` and ``eos_id`` are put around them on request
    and left out by ``decode`` with ``skip_special``. Null texts give no ids,
    null ids a null text.
    """

    def __init__(self, factory: Callable[[], Callable[[str], list]], name: str | None = None, vocab_size: int = DEFAULT_VOCAB_SIZE,
                 bos_id: int = BOS_ID, eos_id: int = EOS_ID):
        self.factory, self.vocab_size, self.bos_id, self.eos_id = factory, vocab_size, bos_id, eos_id
        # the factory is another object in every task, its name is not
        self.name = name or f"{getattr(factory, '__module__', '')}.{getattr(factory, '__qualname__', '')}-{uuid.uuid4().hex}"

    def encode(self, df: DataFrame, col: str = "text", out: str = "ids",
               add_bos: bool = False, add_eos: bool = False, drop_text: bool = False) -> DataFrame:
        return self.encode_column(df, F.col(col), out, add_bos, add_eos, drop=[col] if drop_text else None)

    def encode_column(self, df: DataFrame, text_col: Column, out: str,
                      add_bos: bool = False, add_eos: bool = False, drop=None) -> DataFrame:
        """As :meth:`Encoder.encode_column`: a string expression or an
        ``array<string>`` expression."""
        from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

        from quillspark.session import ship_package
        ship_package(df.sparkSession)
        d = df.withColumn("__text", text_col)
        if drop:
            d = d.drop(*drop)
        nested = isinstance(d.schema["__text"].dataType, ArrayType)
        ids_type = ArrayType(ArrayType(IntegerType())) if nested else ArrayType(IntegerType())
        schema = StructType([f for f in d.schema.fields if f.name != "__text"] + [StructField(out, ids_type)])
        factory, name = self.factory, self.name

        def run(batches):
            import pyarrow as pa

            import quillspark.operators.encode as m
            enc = m.worker_encoder(name, factory)
            one = getattr(enc, "encode", enc)
            target = pa_schema(schema)
            for b in batches:
                at = b.schema.names.index("__text")
                texts = b.column(at).to_pylist()
                ids = [t if t is None else [list(one(x or "")) for x in t] for t in texts] if nested else [list(one(t or "")) for t in texts]
                yield pa.RecordBatch.from_arrays([c for i, c in enumerate(b.columns) if i != at] + [pa.array(ids, target.field(out).type)], schema=target)
        d = d.mapInArrow(run, schema)
        if add_bos:
            d = d.withColumn(out, F.concat(F.array(F.lit(self.bos_id)), F.col(out)))
        return d.withColumn(out, F.concat(F.col(out), F.array(F.lit(self.eos_id)))) if add_eos else d

    def decode(self, df: DataFrame, col: str = "ids", out: str = "decoded", skip_special: bool = True) -> DataFrame:
        """J3 by the encoder's own ``decode``."""
        from pyspark.sql.types import StringType, StructField, StructType

        from quillspark.session import ship_package
        ship_package(df.sparkSession)
        schema = StructType(list(df.schema.fields) + [StructField(out, StringType())])
        factory, name, special = self.factory, self.name, {self.bos_id, self.eos_id} if skip_special else set()

        def run(batches):
            import pyarrow as pa

            import quillspark.operators.encode as m
            enc = m.worker_encoder(name, factory)
            for b in batches:
                text = [None if x is None else enc.decode([i for i in x if i not in special]) for x in b.column(col).to_pylist()]
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], schema=pa_schema(schema))
        return df.mapInArrow(run, schema)


def worker_encoder(name: str, factory):
    """The loaded encoder of this Python worker."""
    if name not in _WORKER_CACHE:
        _WORKER_CACHE[name] = factory()
    return _WORKER_CACHE[name]
