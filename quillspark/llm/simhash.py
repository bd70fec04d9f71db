"""SimHash near-duplicates by multi-index hashing.

Fingerprints (64 bits over word shingles) are cut into segments, so few that
by the pigeonhole principle two fingerprints within the maximum distance
differ in at most one bit in one segment at least. The Hamming ball of radius
one around each segment is enumerated and looked up in the table of exact
segments, and full distances are verified. Two segments that differ in one
bit meet when the bit is cleared in the one that has it, so clearing bits
covers the ball from both sides with half the probes.

Only distinct fingerprints take part, so exact copies (however many) are one
row. Linked fingerprints become components by alternating large-star and
small-star rounds, each written to the shared folder.

Defined results: null or empty text and text without words has the fingerprint
zero and links like any other; repeated rows share a component; a null
``doc_id`` takes part, and ``component_id`` is null only where no row of the
component has one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import documents, map_arrow, materialize

BITS = 64
SEED = 42
_CHUNK = 1 << 16


def fingerprint(text: str, shingle: int) -> int:
    """SimHash of a text's word shingles, as a signed 64-bit integer."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    start = np.append(0, stop[:-1] + 1)
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(start[:len(words) - k + 1].tolist(), stop[k - 1:].tolist(), strict=True)),
                    np.uint64, len(words) - k + 1)
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(h), _CHUNK):
        bits = np.unpackbits(h[i:i + _CHUNK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big", signed=True)


def _fingerprints(shingle: int):
    def run(batches):
        for batch in batches:
            fps = [fingerprint(t or "", shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(fps, pa.int64())],
                                             names=["doc_id", "text_hash", "fp"])
    return run


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id, text_hash, fp`` of every row."""
    rows = documents(docs).withColumn("text_hash", F.xxhash64("text"))
    return map_arrow(rows, _fingerprints(shingle), "doc_id bigint, text_hash bigint, fp bigint")


def segment_bounds(max_distance: int) -> list[tuple[int, int]]:
    """``(shift, width)`` of the fewest segments of which one differs in at most one bit."""
    n = max_distance // 2 + 1
    cuts = [BITS * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def links(fps: DataFrame, max_distance: int) -> DataFrame:
    """Pairs ``a, b`` of distinct values of ``fp`` within ``max_distance`` bits
    (a pair may come more than once)."""
    parts = segment_bounds(max_distance)
    key = lambda a, w: F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << w) - 1 if w < 64 else -1))
    exact = F.array(*[F.struct(F.lit(i).alias("segment"), key(a, w).alias("key"), F.lit(0).alias("cleared"))
                      for i, (a, w) in enumerate(parts)])
    # the segment with one of its bits cleared
    def ball(i, a, w):
        bits = F.array(*[F.lit(-(1 << 63) if j == 63 else 1 << j) for j in range(w)])
        own = F.filter(bits, lambda bit: key(a, w).bitwiseAND(bit) != 0)
        return F.transform(own, lambda bit: F.struct(F.lit(i).alias("segment"), key(a, w).bitwiseXOR(bit).alias("key"), F.lit(1).alias("cleared")))

    balls = [ball(i, a, w) for i, (a, w) in enumerate(parts)] if max_distance else []
    tables = fps.select(F.col("fp").alias("b"), F.explode(exact).alias("s")).select("b", "s.segment", "s.key")
    probes = fps.select(F.col("fp").alias("a"), F.explode(F.concat(exact, *balls)).alias("s")) \
        .select("a", "s.segment", "s.key", "s.cleared")
    # equal segments meet from both sides, one order is enough
    return probes.join(tables, ["segment", "key"]).filter(
        "(cleared = 1 or a < b) and a != b and bit_count(a ^ b) <= " + str(int(max_distance))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (the smallest node reachable) for every node of ``edges (a, b)``."""
    name = "components"
    cur = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), name)
    state = None
    while True:
        # large star: neighbours above a node join its smallest neighbour
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and its neighbours below join the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v").filter("u != v").distinct()
        cur = materialize(small, name)
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            break
        state = now
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")) \
        .unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """``doc_id, text_hash, fp, component, component_id`` of every row:
    ``component`` is the smallest fingerprint and ``component_id`` the
    smallest ``doc_id`` of the row's component."""
    fps = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct_fingerprints")
    member = components(links(distinct.select("fp"), max_distance))
    labelled = distinct.join(member, distinct.fp == member.node, "left") \
        .select("fp", "least", F.coalesce("component", "fp").alias("component"))
    ids = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    label = materialize(labelled.join(ids, "component").select("fp", "component", "component_id"), "labels")
    return fps.join(label, "fp").select("doc_id", "text_hash", "fp", "component", "component_id")
