"""Interaction of document filters, by decision diagrams.

Every document has a mask of the filters that it fails. Masks are counted per
part, and each part's counts become a decision diagram: a level per filter,
an edge for passing and one for failing, shared nodes, and at every node the
weight (documents, good ones, toxic ones) of what it stands for. Two adjacent
levels are swapped in place, so the chain of adjacent swaps that visits all
orders of the filters rebuilds no diagram. In each order the path of passing
edges gives the steps: the failing edge there weighs what the step removes.

Only counts of masks (at most ``2 ** filters`` rows a part) are gathered into
a task. Texts are read once and never shuffled; copies are found by their
SHA-256, and rows are counted before each shuffle, so neither a large group of
copies nor a repeated id or part fills a task.

Defined results: null text is empty; a null part is the empty string; a null
``doc_id`` is smaller or larger than none, so that its row passes the copies'
filter, as do all rows of the least id of a text; a row without an id has no
label; a document labelled more than once has a label if one row says so;
repeated rows count each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import documents, map_arrow, materialize
from quillspark.session import ship_package

# The filters' limits, the symbols and the white space between words.
MIN_WORDS = 50
DISTINCT_PERCENT = 65
UPPER_PERCENT = 5
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SYMBOLS = b"#$%&*|"
SPACE = re.compile(rb"[\x20\x09-\x0D]")
FILTERS = "ABCDE"
#: The filter that a text alone does not decide.
COPY = FILTERS.index("E")
#: Bytes of a text whose words are listed at once.
PIECE_BYTES = 1 << 20

Weight = tuple[int, int, int]


class Diagram:
    """A decision diagram over masks. Node ``i`` has the edges ``passing[i]``
    and ``failing[i]`` and the weight ``weight[i]``; ``order`` lists the
    filters (bit numbers) from the root's level down."""

    def __init__(self, n: int, counts: dict[int, Weight]):
        self.order = list(range(n))
        self.passing: list[int] = []
        self.failing: list[int] = []
        self.weight: list[Weight] = []
        self.levels: list[dict[tuple[int, int], int]] = [{} for _ in range(n)]
        leaves: dict[Weight, int] = {}

        def leaf(weight: Weight) -> int:
            if weight not in leaves:
                leaves[weight] = self._new(-1, -1, weight)
            return leaves[weight]

        def build(level: int, mask: int) -> int:
            if level == n:
                return leaf(counts.get(mask, (0, 0, 0)))
            return self._node(level, build(level + 1, mask), build(level + 1, mask | 1 << level))

        self.root = build(0, 0)

    def _new(self, passing: int, failing: int, weight: Weight) -> int:
        self.passing.append(passing)
        self.failing.append(failing)
        self.weight.append(weight)
        return len(self.weight) - 1

    def _node(self, level: int, passing: int, failing: int) -> int:
        """The level's one node with these edges."""
        table = self.levels[level]
        if (passing, failing) not in table:
            a, b = self.weight[passing], self.weight[failing]
            table[passing, failing] = self._new(passing, failing, (a[0] + b[0], a[1] + b[1], a[2] + b[2]))
        return table[passing, failing]

    def swap(self, level: int) -> None:
        """Exchange a level with the next one. A node of the upper level keeps
        its number, as it stands for the same documents: nothing above changes."""
        upper = list(self.levels[level].values())
        self.levels[level], self.levels[level + 1] = {}, {}
        for node in upper:
            a, b = self.passing[node], self.failing[node]
            p = self._node(level + 1, self.passing[a], self.passing[b])
            f = self._node(level + 1, self.failing[a], self.failing[b])
            self.passing[node], self.failing[node] = p, f
            self.levels[level][p, f] = node
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> Iterator[tuple[int, Weight, Weight]]:
        """``(filter, removed, kept)`` along the path of passing edges."""
        node = self.root
        for f in self.order:
            yield f, self.weight[self.failing[node]], self.weight[self.passing[node]]
            node = self.passing[node]


def swaps(n: int) -> Iterator[int]:
    """Levels to swap with the next one, so that all orders of ``n`` come up:
    the last filter sweeps to and fro, between its sweeps the others change by one swap."""
    if n < 2:
        return
    down, others = True, swaps(n - 1)
    while True:
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        step = next(others, None)
        if step is None:
            return
        yield step + down  # the last filter stands at the top after a sweep down, and shifts the others by one
        down = not down


def all_orders(n: int, counts: dict[int, Weight]) -> Iterator[tuple[tuple[int, ...], list]]:
    """``(order, steps)`` for every order of ``n`` filters."""
    d = Diagram(n, counts)
    yield tuple(d.order), list(d.steps())
    for level in swaps(n):
        d.swap(level)
        yield tuple(d.order), list(d.steps())


def audit_part(filters: str, counts: dict[int, Weight]) -> list[tuple]:
    """``filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley`` of one part."""
    orders = list(all_orders(len(filters), counts))
    total, alone, shapley = {}, {}, dict.fromkeys(range(len(filters)), 0)
    for order, steps in orders:
        total[order[0]] = steps[0][1][0]  # the first filter removes all that fail it
        alone[order[-1]] = steps[-1][1][0]  # the last one those that no other filter has removed
        for f, removed, _ in steps:
            shapley[f] += removed[0]
    return [("".join(filters[f] for f in order), i, kept[0], removed[0], total[f] - removed[0], alone[f], removed[1], removed[2], shapley[f])
            for order, steps in orders for i, (f, removed, kept) in enumerate(steps, 1)]


AUDIT = ("filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, "
         "good_lost bigint, toxic_lost bigint, shapley bigint")


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """``masks``: ``part, mask, n, good, toxic`` (bit ``i`` of the mask is set
    where filter ``i`` fails). One row per part, order of the filters and step."""
    ship_package(masks.sparkSession)
    counted = masks.groupBy(F.coalesce("part", F.lit("")).alias("part"), "mask") \
        .agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("n", "good", "toxic")])
    columns = [c.split()[0] for c in AUDIT.split(", ")]

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        counts = {m: (n, g, t) for m, n, g, t in rows[["mask", "n", "good", "toxic"]].itertuples(index=False)}
        out = pd.DataFrame(audit_part(filters, counts), columns=columns)
        out.insert(0, "part", key[0])
        return out

    return counted.groupBy("part").applyInPandas(one, f"part string, {AUDIT}")


def _pieces(text: bytes) -> Iterable[bytes]:
    """The text, cut at white space into pieces of bounded size (a word stays whole)."""
    at = 0
    while len(text) - at > PIECE_BYTES:
        cut = SPACE.search(text, at + PIECE_BYTES)
        if not cut:
            break
        yield text[at:cut.start()]
        at = cut.end()
    yield text[at:] if at else text


def text_mask(text: bytes, n_chars: int) -> int:
    """The mask of the filters that the text alone decides."""
    n, seen = 0, set()
    for piece in _pieces(text):
        words = piece.split()  # of bytes: at the six ASCII characters
        n += len(words)
        seen.update(words)
    upper = len(text) - len(text.translate(None, UPPER))
    failed = (n < MIN_WORDS, 100 * len(seen) < DISTINCT_PERCENT * n, 100 * upper > UPPER_PERCENT * n_chars,
              len(text.translate(None, SYMBOLS)) < len(text))
    return sum(1 << i for i, x in enumerate(failed) if x)


def _masks(batches):
    for batch in batches:
        texts = batch.column("text")
        n_chars = pc.utf8_length(texts).to_pylist()
        digests, masks = [], []
        for value, n in zip(texts, n_chars, strict=True):
            text = value.as_buffer().to_pybytes()
            digests.append(hashlib.sha256(text).digest())
            masks.append(text_mask(text, n))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(digests, pa.binary()), pa.array(masks, pa.int32())],
                                         names=["doc_id", "part", "digest", "mask"])


def filter_masks(docs: DataFrame, labels: DataFrame, part: str = "source") -> DataFrame:
    """``part, mask, n, good, toxic``: how many documents fail just the filters of ``mask``."""
    rows = documents(docs, F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"))
    found = map_arrow(rows, _masks, "doc_id bigint, part string, digest binary, mask int")
    texts = materialize(found.groupBy("digest", "doc_id", "part", "mask").agg(F.count("*").alias("n")), "audit_texts")
    # the least id of each text, joined by both: a group of copies is spread by its ids
    least = texts.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marked = texts.join(least, ["digest", "doc_id"], "left").select(
        "doc_id", "part", "n", F.expr(f"mask + if(doc_id is not null and first is null, {1 << COPY}, 0)").alias("mask"))
    # at most as many rows of an id as there are parts and masks
    ids = marked.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality", "toxic").filter("doc_id is not null") \
        .groupBy("doc_id").agg(F.max(F.expr("if(quality = 1, 1, 0)")).alias("good"), F.max(F.expr("if(toxic = 1, 1, 0)")).alias("toxic"))
    return ids.join(known, "doc_id", "left").groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.expr("n * coalesce(good, 0)")).alias("good"), F.sum(F.expr("n * coalesce(toxic, 0)")).alias("toxic"))


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of the five filters, per source."""
    return audit(filter_masks(docs, labels))
