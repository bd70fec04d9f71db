"""Cross-tokenizer alignment with corpus-wide counts of linked ids.

Every text is encoded by two tokenizers, A (byte-level) and B (pieces with
byte fallback), whose tokens both cut the same bytes. Byte offsets where an A
and a B token both end cut them into groups; an A and a B token whose bytes
overlap are linked. How often each pair of ids is linked in the corpus is
counted by minimal perfect hashing:

1. The ids of every document are written once; tasks send the distinct pairs
   that they meet, and the distinct pairs are dealt to shards by a hash, of
   which each builds its minimal perfect hash and lists its keys in its order.
2. Tasks align the documents again and count into dense vectors, one for each
   shard, at the pair's index. The vectors are added up as a tree.
3. A second pass aligns the documents again and looks up each link's count. At
   every lookup the key stored at the index is compared.

Distinct pairs are at most as many as the two vocabularies' product, but tasks
hold only ``BLOCK_KEYS`` of them at a time (some 35 MB): passes 2 and 3 run
once for each block of shards, and a document's sums are added up. So memory
is bounded at any size; the ids, not the texts, are read again.

Defined results: a text that is null or empty, or whose joined A or B tokens
are not a space and the text (as with U+2581 inside), has no tokens: zeros and
an empty ``groups_sha256``; a null ``doc_id`` is kept; repeated rows count
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import documents, map_arrow, materialize
from quillspark.llm.perfect_hash import PerfectHash, mix
from quillspark.llm.pretok import BYTE_TABLE, CachedEncoder, byte_chars, load_tokenizer, slices

#: Distinct pairs of a shard (about), and those a task holds at a time.
SHARD_KEYS = 1 << 14
BLOCK_KEYS = 1 << 21
#: Distinct pairs a task gathers before it sends them on.
GATHER_KEYS = 1 << 22
#: Vectors added up by one group of a round of the tree.
FAN_IN = 8
#: Text characters, and ids, aligned at once.
SLICE_CHARS = 1 << 18
SLICE_IDS = 1 << 18
_BUCKET_BITS = 20
_BUCKET_SEED = 99


class TokenizerPair:
    """Both encoders, and the bytes of their ids."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        tok = load_tokenizer(path_a)
        tokenize = tok.model.tokenize
        self.a = CachedEncoder(tok, lambda words: [[t.id for t in tokenize(byte_chars(w))] for w in words])
        self.a.special = None  # their strings are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        back = {c: i for i, c in enumerate(BYTE_TABLE)}
        entries = {i: t for t, i in tok.get_vocab().items()}
        raw = lambda t: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode()
        self.bytes_a = [raw(entries.get(i, "")) for i in range(max(entries) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[1:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.n_b = len(pieces)
        self.len_a, self.len_b = (np.array(list(map(len, x)), np.int64) for x in (self.bytes_a, self.bytes_b))
        self.flat_a, self.flat_b = (np.frombuffer(b"".join(x), np.uint8) for x in (self.bytes_a, self.bytes_b))
        self._rendered: np.ndarray | None = None

    @property
    def rendered(self) -> np.ndarray:
        """Decimal ids with each of the four separators."""
        if self._rendered is None:
            self._rendered = np.array([f"{i}{s}" for i in range(max(len(self.bytes_a), self.n_b)) for s in SEPARATORS], object)
        return self._rendered

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """A's ids, how many each text has, and the same of B; none for texts
        that either side does not give back."""
        spaced = [" " + t if t else "" for t in texts]
        a, n_a = self.a.encode(spaced)
        lists = self.b.encode(texts, num_threads=1)
        n_b = np.fromiter(map(len, lists), np.int64, len(lists))
        b = np.fromiter(chain.from_iterable(lists), np.int32, int(n_b.sum()))
        data = [t.encode() for t in spaced]
        whole = np.array([bool(t) for t in texts], bool)
        for ids, n, size, flat in ((a, n_a, self.len_a, self.flat_a), (b, n_b, self.len_b, self.flat_b)):
            whole &= _gives_back(ids, n, size, flat, data)
        return a[np.repeat(whole, n_a)], np.where(whole, n_a, 0), b[np.repeat(whole, n_b)], np.where(whole, n_b, 0)


def _gives_back(ids: np.ndarray, n: np.ndarray, size: np.ndarray, flat: np.ndarray, data: list[bytes]) -> np.ndarray:
    """Whether the joined bytes of each text's tokens are its ``data``."""
    length = np.fromiter(map(len, data), np.int64, len(data))
    stop = np.append(0, np.cumsum(size[ids]))[np.cumsum(n)]
    same = np.diff(stop, prepend=0) == length
    ids = ids[np.repeat(same, n)]
    took = size[ids]
    end = np.cumsum(took)
    joined = flat[np.repeat((np.cumsum(size) - size)[ids] - (end - took), took) + np.arange(int(took.sum()))]
    wanted = np.frombuffer(b"".join(x for x, ok in zip(data, same.tolist(), strict=True) if ok), np.uint8)
    wrong = np.flatnonzero(joined != wanted)
    if len(wrong):
        of = np.flatnonzero(same)
        same[of[np.unique(np.searchsorted(np.cumsum(length[of]), wrong, side="right"))]] = False
    return same


SEPARATORS = ",", "|", ";", ""
_PAIRS: dict = {}


def tokenizer_pair(path_a: str, path_b: str) -> TokenizerPair:
    """One per worker process and files."""
    if (path_a, path_b) not in _PAIRS:
        _PAIRS[path_a, path_b] = TokenizerPair(path_a, path_b)
    return _PAIRS[path_a, path_b]


class Alignment:
    """Tokens of consecutive texts by their ends in the joined bytes."""

    def __init__(self, len_a: np.ndarray, len_b: np.ndarray, a, n_a, b, n_b):
        self.a, self.n_a, self.b, self.n_b = a, n_a, b, n_b
        end_a, end_b = np.cumsum(len_a[a]), np.cumsum(len_b[b])
        # the ends of both sides' tokens cut the bytes into cells, a link each: of the two tokens that hold the cell
        ends = np.zeros(int(end_a[-1]) + 1 if len(a) else 1, np.uint8)
        ends[end_a] = 1
        ends[end_b] += 2
        ends = ends[np.flatnonzero(ends)]
        closes_a, closes_b = (ends & 1).view(bool), ends > 1
        self.cell_a, self.cell_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        self.shared_a, self.shared_b = closes_b[closes_a], closes_a[closes_b]

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A id, B id and text of every link."""
        return self.a[self.cell_a], self.b[self.cell_b], np.repeat(np.arange(len(self.n_a)), self.n_a)[self.cell_a]

    def n_groups(self) -> np.ndarray:
        return np.bincount(np.repeat(np.arange(len(self.n_a)), self.n_a)[self.shared_a], minlength=len(self.n_a))

    def groups(self, rendered: np.ndarray) -> Iterator[str]:
        """``a1,a2|b1;a3|b2,b3`` of every text."""
        group_a, group_b = np.cumsum(self.shared_a) - self.shared_a, np.cumsum(self.shared_b) - self.shared_b
        total = int(self.shared_a.sum())
        first_a, first_b = (np.searchsorted(g, np.arange(total + 1)) for g in (group_a, group_b))
        codes = np.zeros(len(self.a) + len(self.b), np.int64)
        codes[np.arange(len(self.a)) + first_b[group_a]] = 4 * self.a.astype(np.int64) + self.shared_a
        separator = 2 * self.shared_b
        separator[np.cumsum(self.n_b)[self.n_b > 0] - 1] = 3
        codes[np.arange(len(self.b)) + first_a[group_b + 1]] = 4 * self.b.astype(np.int64) + separator
        strings = rendered[codes].tolist()
        stops = np.cumsum(self.n_a + self.n_b).tolist()
        for a, b in zip([0, *stops[:-1]], stops, strict=True):
            yield "".join(strings[a:b])


_IDS = ("doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, n_best bigint, "
        "count_sum bigint, a array<int>, b array<int>")
_PLAIN = _IDS.rsplit(", ", 2)[0]


def _int_lists(flat: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(flat, pa.int32()))


def _encode(paths: tuple[str, str]):
    def run(batches):
        pair = tokenizer_pair(*paths)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for i, j in slices(list(map(len, texts)), SLICE_CHARS):
                own = Alignment(pair.len_a, pair.len_b, *pair.encode(texts[i:j]))
                n_groups = own.n_groups()
                digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in own.groups(pair.rendered)]
                none = pa.array(np.zeros(j - i, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), *map(pa.array, (own.n_a.astype(np.int64), own.n_b.astype(np.int64), n_groups.astype(np.int64),
                     (own.n_a + own.n_b - n_groups).astype(np.int64))), pa.array(digests, pa.string()), none, none,
                     _int_lists(own.a, own.n_a), _int_lists(own.b, own.n_b)], names=[c.split()[0] for c in _IDS.split(", ")])
    return run


def encoded(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Counts, digest and ids of every row."""
    return map_arrow(documents(docs), _encode((path_a, path_b)), _IDS)


def _aligned(pair: TokenizerPair, batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Ranges of rows with the keys and rows of their links."""
    a, b = batch.column("a"), batch.column("b")
    n_a, n_b = (x.value_lengths().to_numpy().astype(np.int64) for x in (a, b))
    for i, j in slices((n_a + n_b).tolist(), SLICE_IDS):
        part = [x.slice(i, j - i).flatten().to_numpy() for x in (a, b)]
        own = Alignment(pair.len_a, pair.len_b, part[0], n_a[i:j], part[1], n_b[i:j])
        id_a, id_b, row = own.links()
        yield i, j, id_a.astype(np.int64) * pair.n_b + id_b, row


def _buckets(keys: np.ndarray) -> np.ndarray:
    return (mix(keys, _BUCKET_SEED) >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)


def _distinct(paths: tuple[str, str]):
    def run(batches):
        pair, parts, size = tokenizer_pair(*paths), [], 0

        def send():
            keys = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
            for i in range(0, len(keys), 1 << 18):
                k = keys[i:i + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(_buckets(k).astype(np.int32))], names=["key", "bucket"])

        for batch in batches:
            for _, _, keys, _ in _aligned(pair, batch):
                parts.append(pd.unique(keys))
                size += len(parts[-1])
                if size > GATHER_KEYS:
                    parts = [np.unique(np.concatenate(parts))]
                    size = len(parts[0])
                    if size > GATHER_KEYS // 2:
                        yield from send()
                        parts, size = [], 0
        yield from send()
    return run


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    keys = np.sort(rows["key"].to_numpy())
    own = PerfectHash.build(keys)
    listed = np.empty(len(keys), np.int64)
    listed[own.index(keys)] = keys
    return pd.DataFrame({"shard": [key[0]], "n": [len(keys)], "hash": [own.to_bytes()], "keys": [listed.tobytes()]})


class Block:
    """The hashes of some shards; ``first`` is where a shard begins in the block's vectors."""

    def __init__(self, n_shards: int, rows: list):
        self.n_shards, self.shards, self.size = n_shards, {}, 0
        for r in rows:
            keys = np.frombuffer(r["keys"], np.int64)
            self.shards[r["shard"]] = (PerfectHash.from_bytes(r["hash"]), keys, self.size)
            self.size += len(keys)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """Where each (sorted or not) key is in the block, -1 where it is not."""
        out = np.full(len(keys), -1, np.int64)
        shard = _buckets(keys) * self.n_shards >> _BUCKET_BITS
        order = np.argsort(shard, kind="stable")
        cuts = np.flatnonzero(np.diff(shard[order])) + 1
        for at in np.split(order, cuts) if len(keys) else ():
            own = self.shards.get(int(shard[at[0]]))
            if own:
                hashed, listed, first = own
                found = hashed.index(keys[at])
                # the key stored at the index tells whether it is this one
                out[at] = np.where((found >= 0) & (listed[found] == keys[at]), first + found, -1)
        return out


def _count(paths: tuple[str, str], n_shards: int, rows):
    """Dense vectors of counts of one task, a row for each shard of the block."""
    def run(batches):
        pair, block = tokenizer_pair(*paths), Block(n_shards, rows.value)
        total = np.zeros(block.size, np.int64)
        for batch in batches:
            for _, _, keys, _ in _aligned(pair, batch):
                code, found = pd.factorize(keys)
                n, at = np.bincount(code, minlength=len(found)), block.index(found)
                total[at[at >= 0]] += n[at >= 0]
        node = TaskContext.get().partitionId()
        for shard, (_, keys, first) in block.shards.items():
            own = total[first:first + len(keys)]
            if own.any():
                yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "node": pa.array([node], pa.int32()),
                                                  "counts": pa.array([own.tobytes()], pa.binary())})
    return run


def _add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(c, np.int64) for c in rows["counts"])
    return pd.DataFrame({"shard": [key[0]], "node": [key[1]], "counts": [total.tobytes()]})


def _best_of_b(n_b: int):
    def run(batches):
        for batch in batches:
            for keys, counts in zip(batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                best = np.zeros(n_b, np.int64)
                np.maximum.at(best, np.frombuffer(keys, np.int64) % n_b, np.frombuffer(counts, np.int64))
                b = np.flatnonzero(best)
                yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(best[b])], names=["b", "best"])
    return run


def _look_up(paths: tuple[str, str], n_shards: int, rows, best, last: bool):
    """Adds the links of one block to each row's sums."""
    def run(batches):
        pair, block = tokenizer_pair(*paths), Block(n_shards, rows.value)
        counts = np.concatenate([np.frombuffer(r["counts"], np.int64) for r in rows.value]) if rows.value else np.zeros(0, np.int64)
        highest = best.value
        for batch in batches:
            sums = [batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("n_best", "count_sum")]
            for i, _, keys, row in _aligned(pair, batch):
                inverse, found = pd.factorize(keys)
                at = block.index(found)
                count = np.where(at >= 0, counts[at], 0) if len(counts) else np.zeros(len(found), np.int64)
                is_best = (at >= 0) & (count == highest[found % pair.n_b])
                np.add.at(sums[0], i + row, is_best[inverse].astype(np.int64))
                np.add.at(sums[1], i + row, count[inverse])
            columns = [*batch.columns[:6], *map(pa.array, sums), *([] if last else batch.columns[8:])]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:len(columns)])
    return run


def pair_counts(ids: DataFrame, paths: tuple[str, str]) -> tuple[DataFrame | None, list[list[int]], int]:
    """The table ``shard, n, hash, keys, counts`` of all linked pairs, the
    shards of each block, and how many shards there are."""
    spark = ids.sparkSession
    pairs = materialize(map_arrow(ids.select("a", "b"), _distinct(paths), "key bigint, bucket int").distinct(), "alignment_pairs")
    n = pairs.count()
    if not n:
        return None, [], 0
    n_shards = -(-n // SHARD_KEYS)
    sharded = pairs.select("key", F.expr(f"cast(shiftright(cast(bucket as bigint) * {n_shards}, {_BUCKET_BITS}) as int)").alias("shard"))
    hashes = materialize(sharded.groupBy("shard").applyInPandas(_build, "shard int, n bigint, hash binary, keys binary"), "alignment_hashes")
    blocks: list[list[int]] = [[]]
    held = 0
    for r in hashes.select("shard", "n").orderBy("shard").collect():
        if held and held + r["n"] > BLOCK_KEYS:
            blocks.append([])
            held = 0
        blocks[-1].append(r["shard"])
        held += r["n"]
    # a task makes one vector of all splits dealt to it, so there are as many vectors as task slots, not splits
    narrow = ids.select("a", "b").coalesce(2 * spark.sparkContext.defaultParallelism)
    sums = None
    for block in blocks:
        rows = spark.sparkContext.broadcast(block_rows(hashes, block, ["shard", "hash", "keys"]))
        nodes = map_arrow(narrow, _count(paths, n_shards, rows), "shard int, node int, counts binary")
        width = 2 * spark.sparkContext.defaultParallelism
        while width > 1:
            width = -(-width // FAN_IN)
            nodes = nodes.groupBy("shard", F.expr(f"cast(node div {FAN_IN} as int)").alias("node")) \
                .applyInPandas(_add, "shard int, node int, counts binary")
        own = materialize(nodes.select("shard", "counts"), "alignment_counts")
        sums = own if sums is None else sums.unionByName(own)
        rows.unpersist()
    return materialize(hashes.join(sums, "shard"), "alignment_table"), blocks, n_shards


def block_rows(shards: DataFrame, block: list[int], columns: list[str]) -> list[dict]:
    """The rows of a block's shards (together at most ``BLOCK_KEYS`` keys, or one shard)."""
    rows = shards.filter(F.col("shard").between(block[0], block[-1])).select(columns).orderBy("shard").collect()
    return [{c: bytes(v) if isinstance(v, bytearray) else v for c, v in r.asDict().items()} for r in rows]


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum``
    of every row. The paths are files of public tokenizers, readable on every
    executor: A for the tokenizers library (byte-level), B for sentencepiece."""
    spark, paths = docs.sparkSession, (path_a, path_b)
    ids = materialize(encoded(docs, *paths), "alignment_ids")
    table, blocks, n_shards = pair_counts(ids, paths)
    if table is None:
        return ids.select(*[c.split()[0] for c in _PLAIN.split(", ")])
    n_b = tokenizer_pair(*paths).n_b
    highest = np.zeros(n_b, np.int64)
    # at most a row for each id of B
    for r in map_arrow(table.select("keys", "counts"), _best_of_b(n_b), "b bigint, best bigint").groupBy("b").agg(F.max("best").alias("best")).collect():
        highest[r["b"]] = r["best"]
    best = spark.sparkContext.broadcast(highest)
    for k, block in enumerate(blocks):
        rows = spark.sparkContext.broadcast(block_rows(table, block, ["shard", "hash", "keys", "counts"]))
        last = k + 1 == len(blocks)
        ids = map_arrow(ids, _look_up(paths, n_shards, rows, best, last), _PLAIN if last else _IDS)
    return ids
