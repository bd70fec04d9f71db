"""Toxicity by compression distance.

Zstandard dictionaries are trained on ordinary and on toxic text, and every
window of a document is compressed with each. The bytes a window saves under a
toxic dictionary are its *gain*; a document's gains (largest, mean, sum and
share of the large ones, for each toxic dictionary) go through thresholds
calibrated on labelled rows that trained no dictionary (a logistic function of
them).

The dictionaries share the trained ordinary content, at the same distances, so
windows without toxic passages compress alike. One toxic dictionary adds what
zstandard trains on the toxic windows, without the word pairs that ordinary
documents have as often; the other, a supplement, adds beginnings of words
that many toxic documents have and ordinary ones lack. On the given tables
the supplement decides most verdicts (the README has the figures of each form). One document of each
group of copies takes part in training, lest a copied document's own words
look like a class.

Bounds, all of the fit alone: at most ``rows`` toxic and twice as many
ordinary labelled rows, chosen by a hash of their id; of a text longer than
``FIT_CHARS`` characters, so many in windows chosen by their hash from the
whole text train the dictionaries. Calibration and scoring read whole texts.

Defined results: null or empty text has no window and gets the score of zero
gains; repeated rows are scored each; a row labelled more than once counts as
toxic if one label says so, null labels are no labels; without labels of both
classes every score is the share of toxic labels (0 without labels); an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quillspark.llm.common import documents, map_arrow, text_or_empty

FIT_ROWS = 1500
FIT_CHARS = 40_000
PIECE_CHARS = 2000
WINDOW_WORDS = 18
DICTIONARY_BYTES = 8192
#: Trained on toxic text, in segments of so many bytes: about a few words.
TOXIC_BYTES = 2048
TOXIC_SEGMENT = 16
#: Beginnings of words looked at for the toxic content, in characters with the space before.
GRAMS = range(5, 13)
LARGE_GAIN = 4
MIN_MATCH = 4
ODDS = 25
#: Added to a byte for each place that it is behind the beginning of its word.
PLACE_STEP = 59
_PER_DICTIONARY = 5
_N_FEATURES = 2 * _PER_DICTIONARY


@dataclass(frozen=True)
class ToxicityModel:
    ordinary: bytes
    #: With the beginnings of words, and with what is trained on toxic windows.
    toxic: tuple[bytes, bytes]
    weights: tuple[float, ...]
    center: tuple[float, ...]
    scale: tuple[float, ...]
    grams: tuple[str, ...] = field(default=())

    def score(self, features: np.ndarray) -> np.ndarray:
        z = (features - np.array(self.center)) / np.array(self.scale)
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + z @ np.array(self.weights[1:]), -50, 50)))


def coded(text: bytes) -> tuple[bytes, np.ndarray]:
    """Bytes shifted by their place in the word, and where spaces are. So the
    end of one word is no match for the beginning of another."""
    raw = np.frombuffer(text, np.uint8)
    at = np.arange(len(raw))
    spaces = np.flatnonzero(raw == 0x20)
    place = at - np.repeat(np.append(0, spaces), np.diff(np.append(np.append(0, spaces), len(raw))))
    return (raw + (PLACE_STEP * place).astype(np.uint8)).tobytes(), spaces


def windows(text: str, size: int = WINDOW_WORDS) -> list[bytes]:
    """Runs of ``size`` lower-case words, each word with a space on both sides, coded."""
    words = text.lower().split()
    if not words:
        return []
    data, spaces = coded(f" {' '.join(words)} ".encode())
    cuts = spaces[:-1:size].tolist()
    return [data[a:b + 1] for a, b in zip(cuts, [*cuts[1:], len(data) - 1], strict=True)]


def _compressor(content):
    """A compressor, or one for each of several contents."""
    if isinstance(content, tuple):
        return tuple(_compressor(c) for c in content)
    params = zstandard.ZstdCompressionParameters(
        window_log=17, chain_log=14, hash_log=14, search_log=4, min_match=MIN_MATCH, target_length=8,
        strategy=zstandard.STRATEGY_GREEDY, write_content_size=False, write_checksum=False, write_dict_id=False)
    data = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
    return zstandard.ZstdCompressor(compression_params=params, dict_data=data)


def gains(text: str, ordinary, toxic) -> np.ndarray:
    """Bytes each window saves, a column for each toxic dictionary."""
    ws = windows(text)
    plain = np.array([len(ordinary.compress(w)) for w in ws], np.float64)
    return np.stack([plain - [len(t.compress(w)) for w in ws] for t in toxic], 1)


def features(gain: np.ndarray) -> list[float]:
    if not len(gain):
        gain = np.zeros((1, gain.shape[1]))
    return [x for g in gain.T for x in (
        float(g.max()), float(g.mean()), math.log1p(float(g[g >= LARGE_GAIN - 1].sum())),
        float((g >= LARGE_GAIN).mean()), math.log(0.02 + max(0.0, float(g.mean()))))]


def training_text(text: str, limit: int = FIT_CHARS) -> str:
    """The text, or windows of it in order, chosen by their hash, of about ``limit`` characters."""
    if len(text) <= limit:
        return text
    words = text.split()
    parts = [" ".join(words[i:i + WINDOW_WORDS]) for i in range(0, len(words), WINDOW_WORDS)]
    # windows of very long words in pieces, lest one of them is all that fits
    parts = [w[i:i + PIECE_CHARS] for w in parts for i in range(0, len(w), PIECE_CHARS)]
    chosen, size = [], 0
    for _, i in sorted((xxhash.xxh64_intdigest(w, i), i) for i, w in enumerate(parts)):
        if size + len(parts[i]) > limit:
            break
        chosen.append(i)
        size += len(parts[i]) + 1
    return "\n".join(parts[i] for i in sorted(chosen))


def _copies_key(text: str) -> int:
    """The smallest hash of three words: near copies mostly share it."""
    w = text.lower().split()
    return min((xxhash.xxh64_intdigest(" ".join(w[i:i + 3])) for i in range(max(1, len(w) - 2))), default=0)


def _one_per_copies(texts: list[str]) -> list[str]:
    return list({_copies_key(t): t for t in texts}.values())


def _word_starts(text: str) -> set[str]:
    return {p[:n] for w in set(text.lower().split()) for p in [f" {w} "] for n in GRAMS if n <= len(p)}


def contrast(toxic: list[str], ordinary: list[str], limit: int = DICTIONARY_BYTES // 4) -> list[str]:
    """Beginnings of words that many toxic documents have and ordinary ones
    lack, most telling first; of related ones the longest that loses little."""
    a, b = Counter(), Counter()
    for t in toxic:
        a.update(_word_starts(t))
    keep = {g for g, n in a.items() if n >= max(5, 0.01 * len(toxic))}
    for t in ordinary:
        b.update(keep & _word_starts(t))
    odds = {g: ((a[g] + 0.5) / (len(toxic) + 1)) / ((b[g] + 0.5) / (len(ordinary) + 1)) for g in keep}
    ranked = sorted((g for g in keep if odds[g] > ODDS), key=lambda g: (-a[g] * math.log(odds[g]), g))
    chosen: list[str] = []
    for g in ranked:
        if any(g in h or h in g for h in chosen):
            continue
        chosen.append(max((h for h in ranked if h.startswith(g) and a[h] >= 0.9 * a[g]), key=len))
        if sum(len(h.encode()) for h in chosen) > limit:
            break
    return chosen


def toxic_passages(toxic: list[str], ordinary: list[str]) -> list[bytes]:
    """The toxic windows without the word pairs that are no more frequent in
    toxic documents than in ordinary ones, coded."""
    a, b = Counter(), Counter()
    for t in toxic:
        w = t.lower().split()
        a.update(set(zip(w, w[1:])))
    for t in ordinary:
        w = t.lower().split()
        b.update(a.keys() & set(zip(w, w[1:])))
    shared = {p for p, n in b.items() if a[p] * len(ordinary) <= n * len(toxic)}
    out = []
    for t in toxic:
        w = t.lower().split()
        for i in range(0, len(w), WINDOW_WORDS):
            runs, at = [[]], w[max(0, i - 1):i + WINDOW_WORDS]
            for x, y in zip(at, at[1:]):
                if (x, y) in shared:
                    runs.append([])
                else:
                    runs[-1] += [y] if runs[-1] else [x, y]
            out += [coded(f" {' '.join(x)} ".encode())[0] for x in runs if x]
    return out or [w for t in toxic for w in windows(t)]


def _train(samples: list[bytes], size: int, segment: int = 64) -> bytes:
    """Content of a trained dictionary; the samples themselves where there are too few to train one."""
    if sum(map(len, samples)) > 20 * size:
        try:
            return zstandard.train_dictionary(size, samples, k=segment, d=8).as_bytes()[-size:]
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:size]


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps (the first weight is the constant)."""
    x = np.column_stack([np.ones(len(x)), x])
    penalty = np.diag([0.0] + [ridge * weight.sum()] * (x.shape[1] - 1)) + 1e-9 * np.eye(x.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _split(rows: list) -> tuple[list, list]:
    """Two of three rows train the dictionaries, the others calibrate."""
    return rows[::3] + rows[1::3], rows[2::3] or rows


def _constant(share: float) -> ToxicityModel:
    nothing = (0.0,) * _N_FEATURES
    w0 = math.log(share / (1 - share)) if 0 < share < 1 else (-50.0 if share == 0 else 50.0)
    return ToxicityModel(b"", (b"", b""), (w0, *nothing), nothing, (1.0,) * _N_FEATURES)


def dictionaries(toxic: list[str], ordinary: list[str]) -> ToxicityModel:
    """A model that is not calibrated."""
    grams = contrast(toxic, ordinary)
    base = _train([w for t in ordinary for w in windows(t)], DICTIONARY_BYTES)
    starts = b"".join(coded(g.encode())[0] for g in reversed(grams))
    trained = _train(toxic_passages(toxic, ordinary), TOXIC_BYTES, TOXIC_SEGMENT)
    return replace(_constant(0.5), ordinary=base, toxic=(starts + base, trained + base), grams=tuple(grams))


def calibrated(model: ToxicityModel, x: np.ndarray, y: np.ndarray, share: float) -> ToxicityModel:
    """``x``: features of rows that trained no dictionary, ``y``: whether they are toxic."""
    center, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    # a missed toxic row weighs more than a rejected clean one: by the root of their odds
    odds = math.sqrt(share / (1 - share)) if share < 1 else 1.0
    share = odds / (1 + odds)
    weight = np.where(y == 1, share / max(y.sum(), 1), (1 - share) / max((1 - y).sum(), 1)) * len(y)
    w = _logistic((x - center) / scale, y, weight)
    return replace(model, weights=tuple(w.tolist()), center=tuple(center.tolist()), scale=tuple(scale.tolist()))


def train(toxic: list[str], ordinary: list[str], share: float) -> ToxicityModel:
    """``share``: how many of all labelled rows are toxic (the samples need not show it)."""
    if not toxic or not ordinary:
        return _constant(share)
    (dict_toxic, held_toxic), (dict_ordinary, held_ordinary) = _split(_one_per_copies(toxic)), _split(_one_per_copies(ordinary))
    model = dictionaries(dict_toxic, dict_ordinary)
    a, b = _compressor(model.ordinary), _compressor(model.toxic)
    x = np.array([features(gains(t, a, b)) for t in held_toxic + held_ordinary])
    return calibrated(model, x, np.repeat([1.0, 0.0], [len(held_toxic), len(held_ordinary)]), share)


def _samples(batches):
    """What a labelled row gives to the fit: a key of its copies and the text to train on."""
    for batch in batches:
        texts = [t.as_py() for t in batch.column("text")]
        key = [_copies_key(t) - (1 << 63) for t in texts]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(key, pa.int64()), pa.array(map(training_text, texts), pa.string())],
                                         names=["doc_id", "hash", "toxic", "copies", "text"])


def _features(model: ToxicityModel):
    def run(batches):
        a, b = _compressor(model.ordinary), _compressor(model.toxic)
        for batch in batches:
            x = [features(gains(t.as_py(), a, b)) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "hash", "toxic", "x"])
    return run


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> ToxicityModel:
    """``labels``: ``doc_id, toxic`` of the rows to learn from. All their
    labels are counted; a bounded sample of their rows trains the model."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")) \
        .filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n, n_toxic = known.agg(F.count("*"), F.sum(F.expr("cast(toxic = 1 as int)"))).first()
    chosen = None
    for label, limit in ((1, rows), (0, 2 * rows)):
        part = known.filter(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
        chosen = part if chosen is None else chosen.unionByName(part)
    texts = documents(docs).select("doc_id", F.xxhash64("text").alias("hash"), "text")
    # at most 3 * rows ids are broadcast and as many samples collected
    drawn = texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "hash", "toxic", "text")
    sample = map_arrow(drawn, _samples, "doc_id bigint, hash bigint, toxic int, copies bigint, text string") \
        .select(F.xxhash64("doc_id"), "doc_id", "hash", "toxic", "copies", "text").collect()
    seen: dict[int, Row] = {}
    for row in sorted(sample):
        seen.setdefault(row["doc_id"], row)
    # one row of each group of copies
    toxic, ordinary = (list({r["copies"]: r for r in seen.values() if (r["toxic"] == 1) == label}.values()) for label in (True, False))
    share = (n_toxic or 0) / n if n else 0.0
    if not toxic or not ordinary:
        return _constant(share)
    (dict_toxic, held_toxic), (dict_ordinary, held_ordinary) = _split(toxic), _split(ordinary)
    model = dictionaries([r["text"] for r in dict_toxic], [r["text"] for r in dict_ordinary])
    # the whole texts of the other rows are read in tasks; their features come to the driver
    held = docs.sparkSession.createDataFrame([(r["doc_id"], r["hash"], r["toxic"]) for r in held_toxic + held_ordinary], "doc_id bigint, hash bigint, toxic int")
    drawn = texts.join(F.broadcast(held), ["doc_id", "hash"]).select("doc_id", "hash", "toxic", "text")
    found = map_arrow(drawn, _features(model), "doc_id bigint, hash bigint, toxic int, x array<double>").dropDuplicates(["doc_id"]).orderBy("doc_id").collect()
    return calibrated(model, np.array([r["x"] for r in found]), np.array([float(r["toxic"] == 1) for r in found]), share)


#: Rows scored at once.
_ROWS = 1000


def _score(model: ToxicityModel, text):
    """``text`` takes the texts out of a batch; its first column stays."""
    def run(batches):
        a, b = _compressor(model.ordinary), _compressor(model.toxic)
        for batch in batches:
            for i in range(0, len(batch), _ROWS):
                part = batch.slice(i, _ROWS)
                x = np.array([features(gains(t or "", a, b)) for t in text(part).to_pylist()]).reshape(-1, _N_FEATURES)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.score(x), pa.float64()), pa.array(x[:, ::_PER_DICTIONARY].max(1))],
                                                 names=[batch.schema.names[0], "score", "largest_gain"])
    return run


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, score, largest_gain`` for every row of ``docs``."""
    return map_arrow(documents(docs), _score(model, lambda batch: batch.column("text")), "doc_id bigint, score double, largest_gain double")


def score_rows(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc`` (the whole row as a struct), ``score, largest_gain``."""
    rows = docs.select(F.struct(*[F.col("text").cast("string").alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    place = docs.columns.index("text")
    return map_arrow(rows, _score(model, lambda batch: batch.column("doc").field(place)),
                     f"doc {rows.schema['doc'].dataType.simpleString()}, score double, largest_gain double")
