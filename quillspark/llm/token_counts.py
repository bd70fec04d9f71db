"""Edit-aware token counts by segment trees over pre-tokens.

A document's pre-tokens are grouped into leaves of ``LEAF_PIECES``; a leaf has
its characters and tokens, and a segment tree (an array in heap order) has the
tokens of every subtree. An edit re-encodes from the leaf that starts at least
``CONTEXT`` characters before it up to the first leaf boundary behind it where
the new pre-tokens meet the old ones again: the pre-tokenizer reads from left
to right and looks at most two characters (or a run of white space) ahead, so
from there on nothing can have changed. Only the touched leaves and the sums
above them are updated; a tree whose number of leaves changed is summed anew.

Defined results: null or empty text has no tokens and one empty leaf; edits
apply in array order, each to the text that the ones before left; a start or
length beyond the text is cut to it, null starts and lengths are 0, a null
replacement is empty, null edits are left out; special tokens' strings are
ordinary text; repeated rows are counted each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import map_arrow
from quillspark.llm.pretok import CachedEncoder, library_encoder, slices

LEAF_PIECES = 32
CONTEXT = 4
#: Characters behind a boundary that must be part of the text split there.
AHEAD = 64

EDIT = "struct<start:bigint,length:bigint,replacement:string>"
STATE = "doc_id bigint, text string, leaf_chars array<bigint>, tree array<bigint>"


def _group(values: np.ndarray) -> np.ndarray:
    """Sums of ``LEAF_PIECES`` values each."""
    return np.add.reduceat(values, np.arange(0, len(values), LEAF_PIECES)) if len(values) else np.zeros(1, np.int64)


def build_tree(leaf_tokens: np.ndarray) -> np.ndarray:
    """Heap order: the root at 1, the leaves from the size's next power of two on."""
    size = 1 << max(0, int(len(leaf_tokens) - 1).bit_length())
    level = np.zeros(size, np.int64)
    level[:len(leaf_tokens)] = leaf_tokens
    levels = [level]
    while len(level) > 1:
        level = level.reshape(-1, 2).sum(axis=1)
        levels.append(level)
    return np.concatenate([np.zeros(1, np.int64), *reversed(levels)])


class Counted:
    """One document: its text, leaves and tree."""

    def __init__(self, encoder: CachedEncoder, text: str, leaf_chars: np.ndarray, tree: np.ndarray):
        self.encoder, self.text, self.tree = encoder, text, tree
        self.leaf_chars = leaf_chars
        self.reencoded = 0

    @property
    def tokens(self) -> int:
        return int(self.tree[1])

    def _leaf_tokens(self) -> np.ndarray:
        return self.tree[len(self.tree) // 2:][:len(self.leaf_chars)]

    def begin(self, start: int, length: int, replacement: str) -> None:
        """Change the text; what to encode again is then :meth:`view`."""
        start = min(max(start, 0), len(self.text))
        length = min(max(length, 0), len(self.text) - start)
        self.text = self.text[:start] + replacement + self.text[start + length:]
        self.shift = len(replacement) - length
        self.ends = np.cumsum(self.leaf_chars)
        # the last leaf that starts early enough before the edit; its beginning is a sure boundary
        self.first = max(0, int(np.searchsorted(self.ends - self.leaf_chars, start - CONTEXT, side="right")) - 1)
        self.origin = int(self.ends[self.first] - self.leaf_chars[self.first])
        self.last = min(int(np.searchsorted(self.ends, start + length, side="left")), len(self.ends) - 1)
        self.step = 1

    def view(self) -> str:
        """The touched leaves' text, and some more behind them."""
        if self.last == len(self.ends) - 1:
            return self.text[self.origin:]
        return self.text[self.origin:int(self.ends[self.last]) + self.shift + AHEAD * self.step]

    def finish(self, chars: np.ndarray, tokens: np.ndarray) -> bool:
        """Take the view's pre-tokens; false if they do not meet the old ones
        at the last touched leaf's end, and a longer view is needed."""
        whole, at = self.last == len(self.ends) - 1, np.cumsum(chars)
        size = int(at[-1]) if len(at) else 0
        self.reencoded += size
        stop = int(self.ends[self.last]) + self.shift - self.origin
        cut = len(at) if whole else int(np.searchsorted(at, stop)) + 1
        # where the text goes on beyond the view its last pieces are not sure
        if not (whole or (cut < len(at) and at[cut - 1] == stop and at[cut] < size)):
            self.last, self.step = min(self.last + self.step, len(self.ends) - 1), self.step * 2
            return False
        first, last = self.first, self.last
        new_chars, new_tokens = _group(chars[:cut]), _group(tokens[:cut])
        if not cut and len(self.leaf_chars) > last + 1 - first:
            new_chars = new_tokens = np.zeros(0, np.int64)
        if len(new_chars) == last + 1 - first:
            base = len(self.tree) // 2
            for i, t in enumerate(new_tokens.tolist(), base + first):
                change = t - int(self.tree[i])
                while change and i:
                    self.tree[i] += change
                    i >>= 1
            self.leaf_chars[first:last + 1] = new_chars
        else:
            leaf_tokens = self._leaf_tokens()
            self.tree = build_tree(np.concatenate([leaf_tokens[:first], new_tokens, leaf_tokens[last + 1:]]))
            self.leaf_chars = np.concatenate([self.leaf_chars[:first], new_chars, self.leaf_chars[last + 1:]])
        return True

    def edit(self, start: int, length: int, replacement: str) -> None:
        self.begin(start, length, replacement)
        encode_views(self.encoder, [self])


def encode_views(encoder: CachedEncoder, docs: list[Counted]) -> None:
    """Encode the views of all edited documents at once, until each is finished."""
    while docs:
        again = []
        views = [d.view() for d in docs]
        for a, b in slices(list(map(len, views))):
            chars, tokens, count = encoder.pieces_tokens(views[a:b])
            cuts = np.cumsum(count)[:-1]
            for d, c, t in zip(docs[a:b], np.split(chars, cuts), np.split(tokens, cuts), strict=True):
                if not d.finish(c, t):
                    again.append(d)
        docs = again


def _state_batch(doc_id: pa.Array, docs: list[Counted], more: dict | None = None) -> pa.RecordBatch:
    lists = lambda arrays: pa.ListArray.from_arrays(
        pa.array(np.append(0, np.cumsum([len(a) for a in arrays])), pa.int32()), pa.array(np.concatenate(arrays), pa.int64()))
    cols = {"doc_id": doc_id, "text": pa.array([d.text for d in docs], pa.string()), "leaf_chars": lists([d.leaf_chars for d in docs]),
            "tree": lists([d.tree for d in docs])} | (more or {})
    return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))


def _build(path: str):
    def run(batches):
        encoder = library_encoder(path)
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for a, b in slices(list(map(len, texts))):
                chars, tokens, count = encoder.pieces_tokens(texts[a:b])
                docs, at = [], 0
                for text, n in zip(texts[a:b], count.tolist(), strict=True):
                    leaf_chars, leaf_tokens = _group(chars[at:at + n]), _group(tokens[at:at + n])
                    docs.append(Counted(encoder, text, leaf_chars, build_tree(leaf_tokens)))
                    at += n
                yield _state_batch(batch.column("doc_id").slice(a, b - a), docs)
    return run


def build(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The state of every document: ``doc_id, text, leaf_chars, tree``."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, _build(tokenizer), STATE)


def _arrays(column: pa.ListArray) -> list[np.ndarray]:
    """The lists of a column, as arrays of their own."""
    offsets = column.offsets.to_numpy()
    return [x.copy() for x in np.split(column.flatten().to_numpy(), (offsets - offsets[0])[1:-1])]


def _apply(path: str, keep: list[str]):
    def run(batches):
        encoder = library_encoder(path)
        for batch in batches:
            for a in range(0, len(batch), 2000):
                part = batch.slice(a, 2000)
                docs = [Counted(encoder, t or "", c, tree) for t, c, tree in zip(
                    part.column("text").to_pylist(), _arrays(part.column("leaf_chars")), _arrays(part.column("tree")), strict=True)]
                todo = [[e for e in x or [] if e is not None] for x in part.column("todo").to_pylist()]
                # the first edits of all documents, then the second ones
                for k in range(max(map(len, todo), default=0)):
                    now = [(d, x[k]) for d, x in zip(docs, todo, strict=True) if k < len(x)]
                    for d, e in now:
                        d.begin(e["start"] or 0, e["length"] or 0, e["replacement"] or "")
                    encode_views(encoder, [d for d, _ in now])
                yield _state_batch(part.column("doc_id"), docs, {c: part.column(c) for c in keep} | {
                    "edits": pa.array(list(map(len, todo)), pa.int64()), "reencoded_chars": pa.array([d.reencoded for d in docs], pa.int64())})
    return run


def apply_edits(state: DataFrame, edits, tokenizer: str, keep: list[str] | tuple = ()) -> DataFrame:
    """The state after each row's ``edits`` (a column of ``array<struct<start,
    length, replacement>>`` over the state's columns), with the columns of
    ``keep``, how many edits there were (``edits``) and how many characters
    were encoded again (``reencoded_chars``)."""
    todo = edits.cast(f"array<{EDIT}>").alias("todo")
    rows = state.select("doc_id", "text", "leaf_chars", "tree", *keep, todo)
    kept = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return map_arrow(rows, _apply(tokenizer, list(keep)), f"{STATE}{kept}, edits bigint, reencoded_chars bigint")


def apply_edit_log(state: DataFrame, log: DataFrame, tokenizer: str, per_round: int = 1000) -> DataFrame:
    """The state after a log of edits ``doc_id, seq, start, length,
    replacement``, in ``seq`` order. A document's edits are applied in rounds
    of ``per_round``, each a stored stage, so none gathers more in one row."""
    from pyspark.sql import Window

    from quillspark.llm.common import materialize
    numbered = materialize(log.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("seq", "start", "length", "replacement")) - 1)
                           .withColumn("_round", F.expr(f"_n div {per_round}")), "edits")
    rounds = (numbered.agg(F.max("_round")).first()[0] if numbered.head(1) else None)
    state = state.select("doc_id", "text", "leaf_chars", "tree")
    for r in range((rounds if rounds is not None else -1) + 1):
        todo = numbered.filter(F.col("_round") == r).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("_n", "start", "length", "replacement"))).alias("_e"))
        joined = state.join(todo, "doc_id", "left")
        edits = F.transform("_e", lambda e: F.struct(e["start"].alias("start"), e["length"].alias("length"), e["replacement"].alias("replacement")))
        state = materialize(apply_edits(joined.select(*state.columns, edits.alias("_todo")), F.col("_todo"), tokenizer).select(*state.columns), "token_counts")
    return state


def n_tokens(tree: str = "tree"):
    """The whole document's count: the root of its tree."""
    return F.element_at(tree, 2)
