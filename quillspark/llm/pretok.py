"""Vectorized pre-tokenization and encoding for the public BPE tokenizers.

The tokenizers library spends most of its time re-normalizing and re-splitting
text, while a corpus repeats the same pre-tokens over and over. Here a slice of
texts is cut into pre-tokens with numpy over its code points, Arrow's hash
encoding finds the distinct ones, and only pre-tokens that a Python worker has
not met yet go through the tokenizers library (or another word encoder, see
``bpe_trie``). Results equal ``Tokenizer.encode(text, add_special_tokens=False)``
for the two shapes of pre-tokenizer in use (byte-level with its regular
expression, and lower-cased words with word ends):

* character classes (letter, number, space, other) are asked of the library's
  own pre-tokenizer, once per code point;
* special tokens' strings become their ids, as in the library;
* NFC and lower-casing are Python's (per character, without the final-sigma
  rule, as in the library).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
# Endings the pre-tokenizers' patterns split after an apostrophe.
SHORT_ENDINGS = "stmd"
LONG_ENDINGS = ("re", "ve", "ll")
#: Characters of text cut at once, and words kept in a worker's cache.
SLICE_CHARS = 1 << 21
CACHE_WORDS = 400_000


def slices(lengths: Sequence[int], limit: int = SLICE_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``limit`` characters (at least one text)."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


class PieceSplitter:
    """Cuts texts into the pre-tokens of a tokenizer.

    ``words=False``: byte-level pre-tokens that keep their spaces;
    ``words=True``: NFC, lower case, spaces dropped, numbers one by one.
    """

    def __init__(self, tokenizer, words: bool):
        self.pre, self.words = tokenizer.pre_tokenizer, words
        self.cls = np.zeros(0x110000, np.uint8)

    def _classify(self, points: np.ndarray) -> None:
        for p in points.tolist():
            c = chr(p)
            joined = lambda a: [q[1] for q in self.pre.pre_tokenize_str(a + c)] == [(0, 2)]
            if joined("a"):
                k = LETTER
            elif joined("!"):
                k = OTHER
            elif self.words:
                k = NUMBER if self.pre.pre_tokenize_str(c) else SPACE
            else:
                k = NUMBER if joined("1") else SPACE
            self.cls[p] = k

    def normalize(self, s: str) -> str:
        if s.isascii():
            return s.lower()
        if not unicodedata.is_normalized("NFC", s):
            s = unicodedata.normalize("NFC", s)
        return s.replace("Σ", "σ").lower()

    def starts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Code points of all texts, their classes, flags of pre-token starts
        and the first position of each text."""
        cp = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
        cls = self.cls[cp]
        if not cls.all():
            self._classify(np.unique(cp[cls == 0]))
            cls = self.cls[cp]
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(lens) - lens
        n = len(cp)
        flag = np.empty(n, bool)
        if not n:
            return cp, cls, flag, first
        flag[0] = True
        np.not_equal(cls[1:], cls[:-1], out=flag[1:])
        doc = np.zeros(n + 1, bool)
        doc[first] = True
        doc[n] = True
        flag |= doc[:-1]
        run = np.flatnonzero(flag)
        end = np.append(run[1:], n)
        kind, last = cls[run], doc[end]
        if self.words:
            flag |= cls == NUMBER
        else:
            # white space before a word: all but its last character is a piece;
            # the last one joins the word if it is a plain space
            sp = (kind == SPACE) & ~last
            tail = end[sp] - 1
            flag[tail] = True
            flag[end[sp][cp[tail] == 0x20]] = False
        # an apostrophe that starts a pre-token, followed by a listed ending
        a = np.flatnonzero((kind == OTHER) & (end - run == 1) & ~last & (cp[run] == 0x27) & flag[run])
        if len(a):
            a = a[kind[a + 1] == LETTER]
            nxt, stop = run[a + 1], end[a + 1]
            c1 = cp[nxt]
            c2 = np.where(stop - nxt > 1, cp[np.minimum(nxt + 1, n - 1)], 0)
            size = np.where(np.isin(c1, [ord(c) for c in SHORT_ENDINGS]), 1, 0)
            for x, y in LONG_ENDINGS:
                size[(c1 == ord(x)) & (c2 == ord(y))] = 2
            hit = size > 0
            flag[nxt[hit]] = False
            more = hit & (nxt + size < stop)
            flag[(nxt + size)[more]] = True
        return cp, cls, flag, first

    def split(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """All pre-tokens of ``texts`` (already normalized), and how many each text has."""
        cp, cls, flag, first = self.starts(texts)
        if not len(cp):
            return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
        if self.words:
            keep = cls != SPACE
            at = np.cumsum(keep, dtype=np.int32)
            begin = at[flag & keep] - 1
            total = int(at[-1])
            at -= keep
            first = np.append(at, total)[first]
            cp = cp[keep]
        else:
            begin, total = np.flatnonzero(flag), len(cp)
        data = cp.tobytes().decode("utf-32-le").encode("utf-8")
        if len(data) == total:
            offs = np.append(begin, total).astype(np.int32)
        else:
            width = 1 + (cp >= 0x80).view(np.int8)
            if len(data) > int(width.sum()):
                width += (cp >= 0x800).view(np.int8) + (cp >= 0x10000).view(np.int8)
            pos = np.zeros(total + 1, np.int32)
            np.cumsum(width, dtype=np.int32, out=pos[1:])
            offs = pos[np.append(begin, total)]
        pieces = pa.StringArray.from_buffers(len(begin), pa.py_buffer(offs), pa.py_buffer(data))
        count = np.diff(np.append(np.searchsorted(begin, first), len(begin)))
        return pieces, count


class CachedEncoder:
    """Encodes texts through their distinct pre-tokens.

    ``encode_words`` maps a list of new pre-tokens to their id lists. The
    cache is emptied when it holds more than ``CACHE_WORDS`` words, so a
    worker's memory stays bounded.
    """

    def __init__(self, tokenizer, encode_words: Callable[[list[str]], list[list[int]]]):
        self.splitter = PieceSplitter(tokenizer, words=tokenizer.normalizer is not None)
        self.encode_words = encode_words
        added = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        self.special_ids = added
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        self._clear()

    def _clear(self):
        self.codes: dict[str, int] = {}
        self.offsets = np.zeros(0, np.int32)
        self.lengths = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.int32)

    def _learn(self, words: list[str]) -> None:
        ids = self.encode_words(words)
        base = len(self.codes)
        self.codes.update(zip(words, range(base, base + len(words)), strict=True))
        lens = np.fromiter(map(len, ids), np.int32, len(ids))
        self.offsets = np.concatenate([self.offsets, len(self.flat) + np.cumsum(lens, dtype=np.int32) - lens])
        self.lengths = np.concatenate([self.lengths, lens])
        self.flat = np.concatenate([self.flat, np.fromiter((x for w in ids for x in w), np.int32, int(lens.sum()))])

    def _look_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each pre-token begin in ``flat``, and how many they are."""
        enc = pieces.dictionary_encode()
        words = enc.dictionary.to_pylist()
        if len(self.codes) + len(words) > CACHE_WORDS:
            self._clear()
        new = [w for w in words if w not in self.codes]
        if new:
            self._learn(new)
        code = np.fromiter(map(self.codes.__getitem__, words), np.int32, len(words))
        here = enc.indices.to_numpy()
        return self.offsets[code][here], self.lengths[code][here]

    def _encode_plain(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and how many each text has."""
        if self.splitter.words:
            texts = [self.splitter.normalize(t) for t in texts]
        pieces, count = self.splitter.split(texts)
        if not len(pieces):
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        start, lens = self._look_up(pieces)
        stop = np.cumsum(lens, dtype=np.int32)
        ids = self.flat[np.repeat(start - (stop - lens), lens) + np.arange(int(stop[-1]), dtype=np.int32)]
        at = np.append(0, stop)[np.append(0, np.cumsum(count))]
        return ids, np.diff(at)

    def pieces_tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters and ids of each pre-token, and how many pre-tokens each
        text has (byte-level pre-tokens; special tokens are ordinary text)."""
        pieces, count = self.splitter.split(texts)
        if not len(pieces):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), count
        chars = pc.utf8_length(pieces).to_numpy().astype(np.int64)
        return chars, self._look_up(pieces)[1].astype(np.int64), count

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As :meth:`_encode_plain`, with special tokens' strings as their ids."""
        hit = [i for i, t in enumerate(texts) if self.special and self.special.search(t)]
        if not hit:
            return self._encode_plain(texts)
        parts, owner, marks = [], [], []
        hits = set(hit)
        for i, t in enumerate(texts):
            at = 0
            for m in self.special.finditer(t) if i in hits else ():
                parts += [t[at:m.start()], ""]
                marks += [-1, self.special_ids[m[0]]]
                owner += [i, i]
                at = m.end()
            parts.append(t[at:])
            marks.append(-1)
            owner.append(i)
        ids, count = self._encode_plain(parts)
        mark = np.array(marks)
        where = np.cumsum(count)[mark >= 0]
        ids = np.insert(ids, where, mark[mark >= 0].astype(np.int32))
        return ids, np.bincount(owner, weights=count + (mark >= 0), minlength=len(texts)).astype(np.int64)


def load_tokenizer(path: str):
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    return Tokenizer.from_file(path)


_ENCODERS: dict = {}


def library_encoder(path: str) -> CachedEncoder:
    """The tokenizers library's encoder, one per worker process and file."""
    if path not in _ENCODERS:
        tok = load_tokenizer(path)
        tokenize = tok.model.tokenize
        _ENCODERS[path] = CachedEncoder(
            tok, lambda words: [[t.id for t in tokenize(byte_chars(w))] for w in words])
    return _ENCODERS[path]


def _byte_table() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies:
    printable Latin-1 characters stand for themselves, the other bytes follow
    from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


BYTE_TABLE = _byte_table()


def byte_chars(word: str) -> str:
    """A pre-token in the characters of a byte-level vocabulary."""
    return word.encode("utf-8").decode("latin-1").translate(BYTE_TABLE)


def encode_in_slices(encoder: CachedEncoder, texts: list, limit: int = SLICE_CHARS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``(start, end, ids, counts)`` for consecutive slices of ``texts``; null is empty."""
    texts = [t or "" for t in texts]
    for a, b in slices(list(map(len, texts)), limit):
        yield a, b, *encoder.encode(texts[a:b])
