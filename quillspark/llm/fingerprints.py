"""Document fingerprints by a homomorphic multiset hash.

Every paragraph (line of a text) is hashed to a wide vector of integers, and a
document's fingerprint is the sum of its paragraphs' vectors modulo 2^60. So
the order of paragraphs does not matter, and a paragraph is inserted or
deleted by adding or subtracting its vector. A paragraph's vector has

* ``WIDE`` lanes of 60 hash bits, which tell texts apart;
* the numbers of paragraphs and of sentences;
* ``PACKED`` integers with two 30-bit counters each (no text that fits a row
  has more sentences): counter ``i`` counts the sentences whose hash has bit
  ``i`` set. Less half the number of sentences,
  the counters are a random-sign sketch of the multiset of sentences, whose
  scalar products estimate how much two documents share.

Everything is DataFrame expressions over arrays within a row.

Defined results: null or empty text has the zero vector, blank lines add
nothing; repeated rows have equal fingerprints; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import documents, shuffle_partitions

MODULUS = 1 << 60
_MASK = MODULUS - 1
WIDE = 4
PACKED = 60
_FIELD = 30
_COUNTERS = 1 | 1 << _FIELD
SIZE = WIDE + 2 + PACKED


def _long(x: int) -> Column:
    return F.lit(x).cast("bigint")


def with_vector(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with ``out array<bigint>``, the vector of column ``text``.

    The steps are selects of their own, so each array is made once."""
    keep = [F.col(f"`{c}`") for c in df.columns]
    df = df.select(*keep, F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: p != "").alias("_p"))
    df = df.select(*keep, F.transform("_p", lambda p: F.struct(F.xxhash64(p).alias("a"), F.xxhash64(F.lit(1), p).alias("b"))).alias("_k"),
                   F.flatten(F.transform("_p", lambda p: F.split(p, "[.!?] +"))).alias("_s"))
    df = df.select(*keep, "_k", F.transform("_s", lambda s: F.xxhash64(s)).alias("_x"),
                   F.transform("_s", lambda s: F.xxhash64(F.lit(2), s)).alias("_y"))

    def total(values: str, of) -> Column:
        return F.aggregate(values, _long(0), lambda acc, v: (acc + of(v)).bitwiseAND(_long(_MASK)))

    def wide(i: int) -> Column:
        return total("_k", lambda k: F.xxhash64(k["a"], k["b"], F.lit(i)).bitwiseAND(_long(_MASK)))

    def packed(values: str) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(_FIELD - 1)), lambda j: total(
            values, lambda h: F.call_function("shiftright", h, j).bitwiseAND(_long(_COUNTERS))))

    vector = F.concat(F.array(*[wide(i) for i in range(WIDE)], F.size("_k").cast("bigint"), F.size("_x").cast("bigint")),
                      packed("_x"), packed("_y"))
    return df.select(*keep, vector.alias(out))


def insert(a: Column, b: Column) -> Column:
    """The fingerprint of two texts' paragraphs together."""
    return F.zip_with(a, b, lambda x, y: (x + y).bitwiseAND(_long(_MASK)))


def delete(a: Column, b: Column) -> Column:
    """The fingerprint without the paragraphs of ``b``."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, _long(MODULUS)))


def to_string(vector: Column) -> Column:
    digits = F.array_join(F.transform(vector, lambda x: F.lpad(F.hex(x), 15, "0")), "")
    return F.replace(F.base64(F.unhex(digits)), F.lit("\r\n"), F.lit(""))


def _signs(vector: Column) -> Column:
    """The sketch: sentences less twice each counter."""
    sentences = F.element_at(vector, WIDE + 2)
    fields = F.slice(vector, WIDE + 3, PACKED)
    one = lambda shift: F.transform(fields, lambda x: (sentences - 2 * F.shiftright(x, shift).bitwiseAND(_long((1 << _FIELD) - 1))).cast("double"))
    return F.concat(one(0), one(_FIELD))


def likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    """``df`` with ``out``: the estimated cosine of the two multisets of
    sentences (0 to 1; error about 0.09), exactly 1 for equal fingerprints."""
    keep = [F.col(f"`{c}`") for c in df.columns]
    df = df.select(*keep, _signs(F.col(a)).alias("_a"), _signs(F.col(b)).alias("_b"))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    df = df.select(*keep, dot("_a", "_b").alias("_ab"), dot("_a", "_a").alias("_aa"), dot("_b", "_b").alias("_bb"))
    cosine = F.when((F.col("_aa") == 0) | (F.col("_bb") == 0), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_ab") / F.sqrt(F.col("_aa") * F.col("_bb")))))
    return df.select(*keep, F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(cosine).alias(out))


def _buckets(order: str, quantiles: list, share_of_null: float, n: int) -> Column:
    """The bucket of a row by ``order`` and the hash ``_h``, ascending in both.
    A value that several quantiles fall on (or null) has as many buckets, by
    ranges of the hash."""
    def split(count: Column) -> Column:
        # the hash's range in so many equal parts
        return F.least(F.floor((F.col("_h") / float(1 << 64) + 0.5) * count).cast("int"), count - 1)

    nulls = max(1, round(share_of_null * n))
    values, times, equal, after = sorted(set(quantiles)), [], [], [nulls]
    for q in values:
        times.append(quantiles.count(q))
        equal.append(after[-1] + 1)
        after.append(equal[-1] + times[-1])
    ints = lambda x: F.array(*map(F.lit, x)) if x else F.array().cast("array<int>")
    bounds = F.array(*map(_long, values)) if values else F.array().cast("array<bigint>")
    place = F.size(F.filter(bounds, lambda q: q <= F.col(order)))  # how many bounds are not above the value
    return F.when(F.col(order).isNull(), split(F.lit(nulls))) \
        .when(F.get(bounds, place - 1) == F.col(order), F.get(ints(equal), place - 1) + split(F.get(ints(times), place - 1))) \
        .otherwise(F.get(ints(after), place))


def with_next(df: DataFrame, order: str, columns: list[str], buckets: int | None = None, ties: str | None = None) -> DataFrame:
    """``df`` with ``next_<column>`` of the row that follows in ``order``
    (after the last: the first), without a window over the whole table.

    Rows are dealt to buckets by quantiles of ``order`` and, where one value
    (or null) fills several, by the hash of ``ties`` (by default of the
    columns), which also orders ties; null comes first. One row of the least
    place of a bucket is also sent, as a guest, to the bucket before. Only the
    bounds and least places of the buckets (about as many as shuffle
    partitions) come to the driver. Rows that are alike in all this share a
    bucket."""
    n = buckets or shuffle_partitions(df)
    keep = [F.col(f"`{c}`") for c in df.columns]
    df = df.select(*keep, F.xxhash64(*([ties] if ties else columns)).alias("_h"))
    bounds = df.agg(F.percentile_approx(order, F.array(*[F.lit(i / n) for i in range(1, n)]) if n > 1 else F.array(F.lit(0.5)),
                                        F.lit(10_000)).alias("q"), F.avg(F.col(order).isNull().cast("int")).alias("null")).first()
    df = df.withColumn("_b", _buckets(order, bounds["q"] or [], bounds["null"] or 0.0, n))
    place = F.struct(F.col(order).isNotNull().alias("known"), F.col(order).alias("value"), F.col("_h").alias("h"))
    least = df.groupBy("_b").agg(F.min(place).alias("least")).orderBy("_b").collect()
    # the least place of each bucket, and the bucket before (for the first: the last)
    size = max((r["_b"] for r in least), default=0) + 1
    value, h, prev = [None] * size, [0] * size, [None] * size
    for i, r in enumerate(least):
        value[r["_b"]], h[r["_b"]], prev[r["_b"]] = r["least"]["value"], r["least"]["h"], least[i - 1]["_b"]
    at = lambda x, kind: F.get(F.array(*[F.lit(v).cast(kind) for v in x]), F.col("_b"))
    guest = F.when(F.col(order).eqNullSafe(at(value, "bigint")) & (F.col("_h") == at(h, "bigint")), at(prev, "int"))
    guests = df.withColumn("_to", guest).filter("_to is not null") \
        .groupBy(F.col("_to").alias("_b"), F.col(order), "_h").agg(*[F.first(c).alias(c) for c in columns if c != order]) \
        .withColumn("_guest", F.lit(1))
    rows = df.withColumn("_guest", F.lit(0)).unionByName(guests, allowMissingColumns=True)
    w = Window.partitionBy("_b").orderBy("_guest", F.col(order).asc_nulls_first(), "_h")
    out = rows.select(*keep, "_guest", *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return out.filter("_guest = 0").drop("_guest")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, the second
    half of which gives way to the beginning of the next document.

    The edited text's fingerprint comes from the document's: the paragraphs
    from the cut on are deleted, those that stand there now are inserted."""
    df = with_vector(documents(docs), "text", "vector")
    df = with_next(df, "doc_id", ["text", "vector"], ties="text")
    half = F.floor(F.length("text") / 2).cast("int")
    df = df.withColumn("n_chars", F.length("text").cast("bigint")) \
        .withColumn("kept", F.left("text", F.length("text") - half)) \
        .withColumn("added", F.left("next_text", half))
    # what stands after the last line break before the cut belongs to the paragraph that is cut
    df = df.withColumn("tail", F.substring_index("kept", "\n", -1))
    df = df.withColumn("old", F.substr("text", F.length("kept") - F.length("tail") + 1)) \
        .withColumn("new", F.concat("tail", "added"))
    df = df.select("doc_id", "n_chars", F.sha2(F.concat("kept", "added"), 256).alias("edited_sha256"), "vector", "next_vector", "old", "new")
    df = with_vector(with_vector(df, "old", "old_vector"), "new", "new_vector")
    df = df.select("doc_id", "n_chars", "edited_sha256", "vector", "next_vector",
                   insert(delete(F.col("vector"), F.col("old_vector")), F.col("new_vector")).alias("edited_vector"))
    df = likeness(likeness(df, "vector", "edited_vector", "near_edited"), "vector", "next_vector", "near_next")
    return df.select("doc_id", "n_chars", "edited_sha256", to_string(F.col("vector")).alias("fingerprint"),
                     to_string(F.col("edited_vector")).alias("edited_fingerprint"), "near_edited", "near_next")
