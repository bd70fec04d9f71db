"""Language identification by a byte convolutional network.

A text's UTF-8 bytes (ASCII letters in lower case) are cut into windows of
fixed length. Filters of several
widths slide over a window (a filter adds a weight for each byte at each of
its places), the largest value of each filter goes through a rectifier, and a
softmax over these gives the languages' probabilities. A document's
probabilities are the mean over its windows, weighed by their letter bytes.
All windows of whole texts are scored, in batches of bounded size.

The network is trained with numpy (Adam, cross entropy) on the driver, on a
bounded sample: per language about ``rows`` labelled documents, chosen by a
hash of their text among distinct texts (so copies count once), and at most
``windows`` windows of each, chosen by hash from the whole text. All labelled
rows are counted; only the sample's bytes come to the driver.

Defined results: null text, and text without a letter, is ``und`` with score
0, as is every text where nothing could be learned; rows without a ``doc_id``
are predicted but not learned from, rows with a null language neither;
repeated rows are predicted each; with one language learned it is every
text's; equal probabilities go to the language first by name; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import documents, map_arrow

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
#: The symbol after the 256 bytes that fills a short window.
PAD = 256
FIT_ROWS = 400
FIT_WINDOWS = 6
EPOCHS = 5
BATCH = 64
RATE = 0.01
#: Windows of training that lose their end, to learn short texts too.
SHORT = 0.3
UNKNOWN = "und"
#: Bytes laid out at once, a multiple of the window.
SLICE_BYTES = 1 << 20

_ASCII_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    return bool(_ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    #: For each width: weights by place, symbol and filter.
    tables: tuple[np.ndarray, ...] = ()
    bias: np.ndarray | None = None
    out: np.ndarray | None = None
    constant: np.ndarray | None = None


def _convolve(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values of the filters at every place; ``x`` has a column per window."""
    width = len(table)
    n = len(x) - width + 1
    total = table[0][x[:n]]
    for j in range(1, width):
        total += table[j][x[j:j + n]]
    return total


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def probabilities(model: LanguageModel, x: np.ndarray) -> np.ndarray:
    """A row per window (row of ``x``), a column per language."""
    if len(model.languages) < 2:
        return np.ones((len(x), len(model.languages)))
    out = []
    for i in range(0, len(x), BATCH):
        columns = np.ascontiguousarray(x[i:i + BATCH].T)
        pooled = np.concatenate([_convolve(t, columns).max(0) for t in model.tables], 1)
        out.append(_softmax(np.maximum(pooled + model.bias, 0) @ model.out + model.constant))
    return np.concatenate(out) if out else np.zeros((0, len(model.languages)))


class _Adam:
    def __init__(self, params: list[np.ndarray]):
        self.params, self.t = params, 0
        self.m, self.v = ([np.zeros_like(p) for p in params] for _ in range(2))

    def step(self, grads: list[np.ndarray], rate: float) -> None:
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9 ** self.t)) / (np.sqrt(v / (1 - 0.999 ** self.t)) + 1e-8)


def train(x: np.ndarray, y: np.ndarray, languages: tuple[str, ...], epochs: int = EPOCHS, seed: int = 7) -> LanguageModel:
    """``x``: windows as rows of symbols, ``y``: their languages' numbers.
    Each language weighs the same."""
    if len(languages) < 2:
        return LanguageModel(languages)
    rng = np.random.default_rng(seed)
    n_lang, n_all = len(languages), FILTERS * len(WIDTHS)
    tables = [rng.normal(0, 0.3, (w, PAD + 1, FILTERS)).astype(np.float32) for w in WIDTHS]
    bias = np.zeros(n_all, np.float32)
    out = rng.normal(0, 0.1, (n_all, n_lang)).astype(np.float32)
    constant = np.zeros(n_lang, np.float32)
    weight = (len(y) / n_lang / np.maximum(np.bincount(y, minlength=n_lang), 1)).astype(np.float32)
    adam, which = _Adam([*tables, bias, out, constant]), np.arange(FILTERS)
    steps = epochs * -(-len(x) // BATCH)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for i in range(0, len(x), BATCH):
            pick = order[i:i + BATCH]
            rows, n = x[pick].copy(), len(pick)
            for k in np.flatnonzero(rng.random(n) < SHORT):
                rows[k, rng.integers(8, WINDOW):] = PAD
            columns = np.ascontiguousarray(rows.T)
            values = [_convolve(t, columns) for t in tables]
            best = [v.argmax(0) for v in values]
            pooled = np.concatenate([np.take_along_axis(v, b[None], 0)[0] for v, b in zip(values, best, strict=True)], 1) + bias
            hidden = np.maximum(pooled, 0)
            error = _softmax(hidden @ out + constant)
            error[np.arange(n), y[pick]] -= 1
            error *= weight[y[pick], None] / n
            back = (error @ out.T) * (pooled > 0)
            grads = []
            for k, (table, b) in enumerate(zip(tables, best, strict=True)):
                g, own = np.zeros_like(table), back[:, k * FILTERS:(k + 1) * FILTERS]
                for j in range(len(table)):
                    # only the place of the largest value hands its error on
                    np.add.at(g[j], (columns[b + j, np.arange(n)[:, None]], np.broadcast_to(which, b.shape)), own)
                grads.append(g)
            adam.step([*grads, back.sum(0), hidden.T @ error, error.sum(0)], RATE * (1 - adam.t / (steps + 1)))
    return LanguageModel(languages, tuple(tables), bias, out, constant)


def _windows(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of symbols, and how many each piece has; a piece's last one is filled up."""
    n = np.array([-(-len(p) // WINDOW) for p in pieces], np.int64)
    x = np.full(int(n.sum()) * WINDOW, PAD, np.uint16)
    at = (np.cumsum(n) - n) * WINDOW
    for p, a in zip(pieces, at.tolist(), strict=True):
        x[a:a + len(p)] = np.frombuffer(p, np.uint8)
    return x.reshape(-1, WINDOW), n


def _slices(texts: list[str | None]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Whole texts as pieces of bounded length, with the numbers of their texts."""
    owner, pieces, size = [], [], 0
    for i, t in enumerate(texts):
        data = (t or "").encode().lower()
        for a in range(0, len(data), SLICE_BYTES):
            owner.append(i)
            pieces.append(data[a:a + SLICE_BYTES])
            size += len(pieces[-1])
            if size >= SLICE_BYTES:
                yield owner, pieces
                owner, pieces, size = [], [], 0
    if pieces:
        yield owner, pieces


def _letter_bytes(x: np.ndarray) -> np.ndarray:
    low = x | 0x20
    return (((x < 0x80) & (low >= 0x61) & (low <= 0x7A)) | ((x >= 0x80) & (x < PAD))).sum(1)


def predict_texts(model: LanguageModel, texts: list[str | None]) -> tuple[list[str], list[float]]:
    total = np.zeros((len(texts), max(1, len(model.languages))))
    if model.languages:
        for owner, pieces in _slices(texts):
            x, n = _windows(pieces)
            np.add.at(total, np.repeat(owner, n), probabilities(model, x) * _letter_bytes(x)[:, None])
    weight = total.sum(1)
    best = total.argmax(1)
    known = [bool(model.languages) and t is not None and has_letter(t) for t in texts]
    return ([model.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), known, strict=True)],
            [min(1.0, float(total[i, best[i]] / weight[i])) if k else 0.0 for i, k in enumerate(known)])


def _fit_windows(limit: int):
    def run(batches):
        for batch in batches:
            found = []
            for t in batch.column("text").to_pylist():
                data = t.encode().lower()
                at = range(0, len(data), WINDOW)
                at = sorted(at, key=lambda a: xxhash.xxh64_intdigest(data[a:a + WINDOW], a))[:limit]
                found.append([data[a:a + WINDOW] for a in sorted(at)])
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("hash"), pa.array(found, pa.list_(pa.binary()))],
                                             names=["lang", "hash", "windows"])
    return run


def fit(docs: DataFrame, learn: Column, lang: str = "lang", rows: int = FIT_ROWS, windows: int = FIT_WINDOWS, epochs: int = EPOCHS) -> LanguageModel:
    """``learn``: whether a row of ``docs`` may be learned from."""
    known = docs.select(F.col("text").cast("string").alias("text"), F.col(f"`{lang}`").cast("string").alias("lang"), learn.alias("learn")) \
        .filter("learn and text <> '' and lang is not null").select("lang", "text")
    count = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = tuple(sorted(count))
    if len(languages) < 2:
        return LanguageModel(languages)
    hashed = known.withColumn("hash", F.xxhash64("text"))
    # the share of the hashes' range that about so many rows of the language fall into
    share = F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, rows / count[k]))])
    drawn = hashed.filter(F.pmod(F.col("hash"), F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * (1 << 30))
    sample = map_arrow(drawn.select("lang", "hash", "text"), _fit_windows(windows), "lang string, hash bigint, windows array<binary>") \
        .groupBy("lang", "hash").agg(F.first("windows").alias("windows")).collect()
    pieces, y = [], []
    for r in sorted(sample, key=lambda r: (r["lang"], r["hash"])):
        # a window without a letter says nothing
        use = [bytes(w) for w in r["windows"] if _letter_bytes(_windows([bytes(w)])[0])[0]]
        pieces += use
        y += [languages.index(r["lang"])] * len(use)
    return train(_windows(pieces)[0], np.array(y, np.int64), languages, epochs) if pieces else LanguageModel(())


def _predict(model: LanguageModel):
    def run(batches):
        for batch in batches:
            lang, score = predict_texts(model, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])
    return run


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row of ``docs``."""
    return map_arrow(documents(docs), _predict(model), "doc_id bigint, lang_pred string, score double")
