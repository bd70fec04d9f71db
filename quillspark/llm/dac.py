"""Token ids as binary files of directly addressable codes.

An id is split into 8-bit chunks. Level 0 holds the lowest chunk of every id
and a bit per id that tells whether more chunks follow; level 1 holds the next
chunk of those ids, with its own bits, and so on. A rank directory (ones
before each block of 512 bits) finds the place of an id's next chunk, so any
token is read by a few probes, without decoding its block.

The files are a Parquet table, one row per *segment* of whole documents (about
``SEGMENT_TOKENS`` ids), so that any store Spark can write to holds them:
``part`` and ``segment`` (order of the file), ``part_start`` (ids of the part
before it), ``doc_ids``, ``doc_tokens`` and the levels' ``chunks``, ``more``
and ``ranks``.

Defined results: null or empty text is the end id alone; rows are ordered by
``doc_id`` (null first), those of one id by their text's hash, then text, so
that rows of one or of no id are spread over the files; repeated rows are
written each; an empty table gives no segment; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.common import documents, map_arrow, shuffle_partitions
from quillspark.llm.pretok import encode_in_slices, library_encoder
from quillspark.session import scratch_path

SEGMENT_TOKENS = 1 << 20
RANK_BITS = 512

SEGMENTS = ("part int, segment int, part_start bigint, n_tokens bigint, doc_ids array<bigint>, doc_tokens array<bigint>, "
            "chunks array<binary>, more array<binary>, ranks array<binary>")


def dac_encode(ids: np.ndarray) -> list[tuple[bytes, bytes, bytes]]:
    """Levels of ``(chunks, continuation bitmap, rank directory)``."""
    levels, cur = [], ids.astype(np.uint32)
    while True:
        more = cur > 0xFF
        bitmap = np.packbits(more, bitorder="little")
        block = np.add.reduceat(more.astype(np.uint32), np.arange(0, len(more), RANK_BITS)) if len(more) else np.zeros(0, np.uint32)
        ranks = (np.cumsum(block) - block).astype("<u4")
        levels.append(((cur & 0xFF).astype(np.uint8).tobytes(), bitmap.tobytes(), ranks.tobytes()))
        if not more.any():
            return levels
        cur = cur[more] >> 8


def dac_decode(chunks: list[bytes], more: list[bytes]) -> np.ndarray:
    """All ids of a segment, from the last level upwards."""
    ids = np.zeros(0, np.uint32)
    for c, m in zip(reversed(chunks), reversed(more), strict=True):
        level = np.frombuffer(c, np.uint8).astype(np.uint32)
        goes_on = np.unpackbits(np.frombuffer(m, np.uint8), count=len(level), bitorder="little").view(bool)
        level[goes_on] |= ids << 8
        ids = level
    return ids


def dac_access(chunks: list[bytes], more: list[bytes], ranks: list[bytes], i: int) -> int:
    """The id at place ``i``: one chunk per level, found by rank."""
    value = 0
    for k, c in enumerate(chunks):
        value |= c[i] << (8 * k)
        m = more[k]
        if not m[i >> 3] >> (i & 7) & 1:
            return value
        block = i // RANK_BITS
        before = int.from_bytes(ranks[k][4 * block:4 * block + 4], "little")
        lo = block * RANK_BITS // 8
        bits = int.from_bytes(m[lo:(i >> 3) + 1], "little") & ((1 << (i - 8 * lo)) - 1)
        i = before + bits.bit_count()
    return value


def _segments(path: str, end_id: int, segment_tokens: int):
    def run(batches):
        from pyspark import TaskContext
        part = TaskContext.get().partitionId()
        encoder = library_encoder(path)
        doc_ids, tokens, parts = [], [], []
        size = start = k = 0

        def segment():
            levels = dac_encode(np.concatenate(parts))
            row = {"part": part, "segment": k, "part_start": start, "n_tokens": size, "doc_ids": doc_ids,
                   "doc_tokens": tokens, "chunks": [x[0] for x in levels], "more": [x[1] for x in levels],
                   "ranks": [x[2] for x in levels]}
            return pa.RecordBatch.from_pylist([row], schema=pa.schema([
                ("part", pa.int32()), ("segment", pa.int32()), ("part_start", pa.int64()), ("n_tokens", pa.int64()),
                ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())), ("chunks", pa.list_(pa.binary())),
                ("more", pa.list_(pa.binary())), ("ranks", pa.list_(pa.binary()))]))

        for batch in batches:
            own = batch.column("doc_id").to_pylist()
            for a, b, ids, counts in encode_in_slices(encoder, batch.column("text").to_pylist()):
                ids = np.insert(ids, np.cumsum(counts), end_id)
                counts = counts + 1
                # whole documents up to the segment's size, then the next segment
                stop = np.cumsum(counts)
                i = at = 0
                while i < b - a:
                    j = max(i + 1, int(np.searchsorted(stop, at + segment_tokens - size, side="left")) + 1)
                    j = min(j, b - a)
                    parts.append(ids[at:stop[j - 1]])
                    doc_ids += own[a + i:a + j]
                    tokens += counts[i:j].tolist()
                    size += int(stop[j - 1]) - at
                    at, i = int(stop[j - 1]), j
                    if size >= segment_tokens:
                        yield segment()
                        start, k = start + size, k + 1
                        doc_ids, tokens, parts, size = [], [], [], 0
        if parts:
            yield segment()
    return run


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, path: str | None = None,
                      partitions: int | None = None, segment_tokens: int = SEGMENT_TOKENS) -> str:
    """Write all documents' ids in ascending ``doc_id`` order; returns the path
    (by default a new one under the shared checkpoint folder)."""
    path = path or scratch_path(docs.sparkSession, "token_files")
    n = partitions or shuffle_partitions(docs)
    order = ["doc_id", F.xxhash64("text")]
    rows = documents(docs).repartitionByRange(n, *order).sortWithinPartitions(*order, "text")
    map_arrow(rows, _segments(tokenizer, end_id, segment_tokens), SEGMENTS).write.mode("overwrite").parquet(path)
    return path


def read_segments(spark, path: str) -> DataFrame:
    """The segments with their global ``start``. Only the parts' totals (one
    row per part, a parameter of the writer) are summed up in order."""
    segments = spark.read.parquet(path)
    parts = segments.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("bigint").alias("_before"))
    return segments.join(F.broadcast(parts), "part").withColumn("start", F.col("_before") + F.col("part_start")).drop("_before")


def _read_documents(batches):
    for batch in batches:
        for row in batch.to_pylist():
            ids = dac_decode(row["chunks"], row["more"]).astype("<u4")
            count = np.array(row["doc_tokens"], np.int64)
            stop = np.cumsum(count)
            begin = stop - count
            crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
            middle = [dac_access(row["chunks"], row["more"], row["ranks"], i) for i in (begin + count // 2).tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], pa.int64()), pa.array(begin + row["start"]), pa.array(count), pa.array(crc, pa.int64()),
                 pa.array(middle, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32", "middle_id"])


def read_documents(spark, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``,
    and ``middle_id``, the id at place ``n_tokens // 2`` by random access."""
    segments = read_segments(spark, path).select("start", "doc_ids", "doc_tokens", "chunks", "more", "ranks")
    return map_arrow(segments, _read_documents, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, middle_id bigint")


def _probe(batches):
    for batch in batches:
        for r in batch.to_pylist():
            ids = [dac_access(r["chunks"], r["more"], r["ranks"], p - r["start"]) for p in r["positions"]]
            yield pa.RecordBatch.from_arrays([pa.array(r["positions"], pa.int64()), pa.array(ids, pa.int64())], names=["position", "id"])


def read_tokens(positions: DataFrame, path: str, width: int = SEGMENT_TOKENS) -> DataFrame:
    """The ids at global ``position``s, each by random access into its segment;
    a repeated position comes once, one that is not there not at all.

    Positions find their segment by an equi-join of places alone, on
    ``position div width`` and the blocks a segment touches. Those of a segment
    (at most as many as it has tokens) are gathered and meet it once."""
    segments = read_segments(positions.sparkSession, path)
    places = segments.select("start", "n_tokens", F.explode(F.sequence(
        F.expr(f"start div {width}"), F.expr(f"(start + n_tokens - 1) div {width}"))).alias("_block"))
    at = positions.select(F.col("position").cast("bigint").alias("position")).filter("position is not null").distinct() \
        .withColumn("_block", F.expr(f"position div {width}"))
    hit = at.join(places, "_block").filter("position >= start and position < start + n_tokens") \
        .groupBy("start").agg(F.collect_list("position").alias("positions"))
    found = segments.select("start", "chunks", "more", "ranks").join(hit, "start")
    return map_arrow(found.select("start", "chunks", "more", "ranks", "positions"), _probe, "position bigint, id bigint")
