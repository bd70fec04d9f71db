"""Best-fit packing of documents into training sequences, by hierarchical
residual packing.

Each partition encodes its documents and packs their pieces best-fit
(decreasing) on its own. Bins that are nearly full are final; underfull bins
become the items of the next round, which runs on fewer partitions, until
what is left fits one task or the same number of tasks no longer helps; bins
that no other one fits into stay behind as they are. A bin holds at most
``max_tokens`` tokens and so at most as many members, which travel with it:
no join puts the result together, and only underfull bins are shuffled.

Defined results: null or empty text gives the end id alone; null ``doc_id``
is kept; repeated rows are packed each; an empty table gives no rows; other
columns are ignored. A document longer than ``max_tokens`` is cut into full
pieces after a first piece that takes the remainder; shorter ones stay whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import documents, map_arrow, materialize
from quillspark.llm.pretok import SLICE_CHARS, encode_in_slices, library_encoder

#: Items a task packs at once; more come in further portions, with the
#: underfull bins of the portion before among them.
PORTION = 50_000
#: With ids a portion also ends at so many of them, to bound a task's memory.
PORTION_TOKENS = 1 << 20
#: And texts are cut in slices of so many characters.
PORTION_CHARS = 1 << 20
#: Bins with at most this many free tokens are final.
SLACK = 8

MEMBER = ("struct<doc_id:bigint,piece:int,start:bigint,length:int,ids_crc32:bigint,offset:int,ids:array<int>>")
BINS = f"full boolean, used int, members array<{MEMBER}>"
_MEMBER_TYPE = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                          ("length", pa.int32()), ("ids_crc32", pa.int64()), ("offset", pa.int32()),
                          ("ids", pa.list_(pa.int32()))])


def best_fit(sizes: np.ndarray, limit: int) -> list[list[int]]:
    """Best-fit decreasing: bins as lists of item indices. Open bins are kept
    by their free space, with a bit set of the spaces at hand."""
    free: list[list[int]] = [[] for _ in range(limit + 1)]
    bins: list[list[int]] = []
    at_hand = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fits = at_hand >> size
        if fits:
            space = (fits & -fits).bit_length() - 1 + size
            b = free[space].pop()
            if not free[space]:
                at_hand &= ~(1 << space)
            bins[b].append(i)
        else:
            space, b = limit, len(bins)
            bins.append([i])
        if space > size:
            free[space - size].append(b)
            at_hand |= 1 << (space - size)
    return bins


def _batches(bins: list[list[int]], used: np.ndarray, offsets: np.ndarray, members: pa.StructArray,
             full: bool) -> pa.RecordBatch:
    """Bins of items, where item ``i`` has the members ``offsets[i]:offsets[i+1]``."""
    items = np.fromiter((i for b in bins for i in b), np.int64)
    n_members = offsets[items + 1] - offsets[items]
    stop = np.cumsum(n_members)
    take = np.repeat(offsets[items] - (stop - n_members), n_members) + np.arange(int(stop[-1]))
    rows = members.take(pa.array(take))
    n_items = np.fromiter(map(len, bins), np.int64, len(bins))
    bounds = np.append(0, stop)[np.append(0, np.cumsum(n_items))]
    length = rows.field("length").to_numpy()
    ends = np.cumsum(length, dtype=np.int64)
    begin = ends - length
    offset = (begin - np.repeat(begin[bounds[:-1]], np.diff(bounds))).astype(np.int32)
    fields = [pa.array(offset) if f.name == "offset" else rows.field(f.name) for f in _MEMBER_TYPE]
    lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(_MEMBER_TYPE)))
    total = np.add.reduceat(used[items], np.append(0, np.cumsum(n_items))[:-1]).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array([full] * len(bins)), pa.array(total), lists], names=["full", "used", "members"])


def _write_bins(bins, used, offsets, members, full) -> Iterator[pa.RecordBatch]:
    for k in range(0, len(bins), 500):
        yield _batches(bins[k:k + 500], used, offsets, members, full)


class _Packer:
    """Packs portions of items; keeps underfull bins as items of the next portion."""

    def __init__(self, limit: int, slack: int, with_ids: bool):
        self.limit, self.slack = limit, slack
        self.most = PORTION_TOKENS if with_ids else float("inf")
        self.tokens = 0
        self.used: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.members: list[pa.StructArray] = []
        self.n = 0

    def add(self, used: np.ndarray, counts: np.ndarray, members: pa.StructArray) -> None:
        self.used.append(used)
        self.counts.append(counts)
        self.members.append(members)
        self.n += len(used)
        self.tokens += int(used.sum())

    @property
    def full(self) -> bool:
        return self.n >= PORTION or self.tokens >= self.most

    def run(self, last: bool) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        used = np.concatenate(self.used)
        offsets = np.append(0, np.cumsum(np.concatenate(self.counts)))
        members = pa.concat_arrays(self.members)
        bins = best_fit(used, self.limit)
        total = [int(used[b].sum()) for b in bins]
        done = [b for b, t in zip(bins, total, strict=True) if t >= self.limit - self.slack]
        rest = [b for b, t in zip(bins, total, strict=True) if t < self.limit - self.slack]
        self.used, self.counts, self.members, self.n, self.tokens = [], [], [], 0, 0
        yield from _write_bins(done, used, offsets, members, True)
        if last:
            yield from _write_bins(rest, used, offsets, members, False)
        else:
            for batch in _write_bins(rest, used, offsets, members, False):
                self.add_rows(batch)

    def add_rows(self, batch: pa.RecordBatch) -> None:
        lists = batch.column("members")
        self.add(batch.column("used").to_numpy(), np.diff(lists.offsets.to_numpy()), lists.flatten())


def _pieces(doc_id: pa.Array, ids: np.ndarray, counts: np.ndarray, end_id: int, limit: int, with_ids: bool) -> pa.StructArray:
    """The members that a slice of documents gives, each alone in its bin."""
    flat = np.insert(ids, np.cumsum(counts), end_id).astype("<u4")
    n = counts + 1
    n_pieces = (n + limit - 1) // limit
    doc = np.repeat(np.arange(len(n)), n_pieces)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
    head = ((n - 1) % limit + 1)[doc]  # the first piece takes the remainder
    start = np.where(piece == 0, 0, head + (piece - 1) * limit)
    length = np.where(piece == 0, head, limit)
    begin = (np.cumsum(n) - n)[doc] + start
    crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
    # pieces follow each other in the ids
    lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(flat)), pa.int32()), pa.array(flat.astype(np.int32))) \
        if with_ids else pa.nulls(len(doc), pa.list_(pa.int32()))
    fields = [doc_id.take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()),
              pa.array(crc, pa.int64()), pa.array(np.zeros(len(doc), np.int32)), lists]
    return pa.StructArray.from_arrays(fields, fields=list(_MEMBER_TYPE))


def _pack_documents(path: str, end_id: int, limit: int, slack: int, with_ids: bool):
    def run(batches):
        encoder, packer = library_encoder(path), _Packer(limit, slack, with_ids)
        for batch in batches:
            doc_id = batch.column("doc_id")
            for a, b, ids, counts in encode_in_slices(encoder, batch.column("text").to_pylist(), PORTION_CHARS if with_ids else SLICE_CHARS):
                items = _pieces(doc_id.slice(a, b - a), ids, counts, end_id, limit, with_ids)
                length = items.field("length").to_numpy()
                packer.add(length, np.ones(len(items), np.int64), items)
                if packer.full:
                    yield from packer.run(last=False)
        yield from packer.run(last=True)
    return run


def _pack_bins(limit: int, slack: int, with_ids: bool):
    def run(batches):
        packer = _Packer(limit, slack, with_ids)
        for batch in batches:
            packer.add_rows(batch)
            if packer.full:
                yield from packer.run(last=False)
        yield from packer.run(last=True)
    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, max_tokens: int = 1024,
                   slack: int = SLACK, fan_in: int = 8, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32,
    sequence_id, offset`` (and ``ids`` on request). ``tokenizer`` is the file
    of a public tokenizer, readable on every executor."""
    spark = docs.sparkSession
    bins = map_arrow(documents(docs), _pack_documents(tokenizer, end_id, max_tokens, slack, with_ids), BINS)
    tasks = bins.rdd.getNumPartitions()
    made = materialize(bins, "packing")
    done, before = [], None
    while True:
        least, = made.filter(~F.col("full")).agg(F.min("used")).first()
        # a bin that not even the smallest one fits into is final
        fits = ~F.col("full") & (F.col("used") <= max_tokens - (least or 0))
        rest = made.filter(fits)
        n = rest.count() if tasks > 1 else 0
        following = max(1, tasks // fan_in, n // PORTION)
        # stop when one task has seen all that is left, or the same number of tasks helps no more
        if n < 2 or (before is not None and following == tasks and n > 0.99 * before):
            break
        done.append(made.filter(~fits))
        before, tasks = n, following
        again = rest.repartition(tasks, F.col("members")[0]["doc_id"], F.col("members")[0]["piece"]) \
            if tasks > 1 else rest.repartition(1)
        made = materialize(map_arrow(again, _pack_bins(max_tokens, slack, with_ids), BINS), "packing")
    for r in done:
        made = made.unionByName(r)
    done = made
    # number the bins first: in one select the id would be made after the explode
    one = done.select(F.monotonically_increasing_id().alias("sequence_id"), "members") \
        .select("sequence_id", F.explode("members").alias("m"))
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    return one.select(*[F.col(f"m.{c}").cast("bigint" if c == "length" else one.schema["m"].dataType[c].dataType).alias(c) for c in cols],
                      "sequence_id", F.col("m.offset").cast("bigint").alias("offset"),
                      *([F.col("m.ids").alias("ids")] if with_ids else []))
