"""BPE encoding by prefix-sharing trie traversal, and decoding.

The distinct new words of a slice are walked depth-first along their trie
(sorted words; a word keeps the states of the prefix it shares with the one
before). The state of a prefix is the *last token* of its encoding: the only
token that ends there, starts where another prefix ends, and stands next to
that prefix's last token without a merge between the two. An encoding is read
off by following last tokens backwards; a shared prefix is computed once.

Two neighbouring tokens stay apart if no merge fires across their border. Of
the left token only its right spine (itself, its right part, and so on) and of
the right token only its left spine can touch the border, each part from the
rank that forms it to the rank that absorbs it.

Defined results: null or empty text gives no ids and the empty text; special
tokens' strings become their ids, as in the tokenizers library; repeated rows
are encoded each; an empty table gives no rows; extra columns stay, but for
those that have the name of an output.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import map_arrow
from quillspark.llm.pretok import CachedEncoder, byte_chars, encode_in_slices, load_tokenizer

_NEVER = 1 << 60
#: Neighbouring tokens whose border a worker remembers.
KNOWN_PAIRS = 200_000


class TrieBpe:
    """Encodes words (in the characters of a byte-level vocabulary)."""

    def __init__(self, vocab: dict[str, int], merges: list, suffix: str = ""):
        self.vocab, self.suffix = vocab, suffix
        self.rank = {tuple(m): i for i, m in enumerate(merges)}
        self.made = {a.removesuffix(suffix) + b if suffix else a + b: (a, b, i) for i, (a, b) in enumerate(merges)}
        self.spines: dict[tuple[str, int], list] = {}
        self.apart: dict[tuple[str, str], bool] = {}
        # tokens that merging can reach; others never appear in an encoding
        self.reachable = set()
        self.reachable = {t for t in vocab if t not in self.made or self._first_merge(*self.made[t][:2]) == self.made[t][2]}
        n = len(suffix)
        self.inner = {t for t in self.reachable if not (suffix and t.endswith(suffix))}
        self.final = {t[:len(t) - n]: t for t in self.reachable if not suffix or t.endswith(suffix)}
        self.longest = max(map(len, vocab), default=0)

    def _spine(self, token: str, side: int) -> list[tuple[str, int, int]]:
        """``(part, rank that forms it, rank that absorbs it)`` along a border;
        side 1 is the right end of a token, side 0 its left end."""
        found = self.spines.get((token, side))
        if found is None:
            found, part, until = [], token, _NEVER
            while True:
                made = self.made.get(part)
                found.append((part, made[2] if made else -1, until))
                if not made:
                    break
                part, until = made[side], made[2]
            self.spines[token, side] = found
        return found

    def _first_merge(self, left: str, right: str) -> int:
        """The rank of the first merge across the border, ``_NEVER`` if none.
        Of equal ranks the merge further left comes first."""
        best = _NEVER
        for x, x_from, x_to in self._spine(left, 1):
            for y, y_from, y_to in self._spine(right, 0):
                r = self.rank.get((x, y))
                if r is not None and x_from < r < x_to and y_from < r <= y_to and r < best:
                    best = r
        return best

    def _stay_apart(self, left: str, right: str) -> bool:
        key = (left, right)
        found = self.apart.get(key)
        if found is None:
            if len(self.apart) > KNOWN_PAIRS:
                self.apart.clear()
                self.spines.clear()
            found = self.apart[key] = self._first_merge(left, right) == _NEVER
        return found

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word, in the order given."""
        out: list[list[int]] = [[]] * len(words)
        chars = [byte_chars(w) for w in words]
        last: list[str] = [""]
        before = ""
        inner, final, vocab, longest, stay = self.inner, self.final, self.vocab, self.longest, self._stay_apart
        for k in sorted(range(len(words)), key=chars.__getitem__):
            w = chars[k]
            n = len(w)
            shared = 0
            for a, b in zip(w, before, strict=False):
                if a != b:
                    break
                shared += 1
            # states of the proper prefixes; those shared with the word before stay
            del last[shared + 1:]
            for i in range(len(last), n):
                for size in range(min(i, longest), 0, -1):
                    t = w[i - size:i]
                    if t in inner and (size == i or stay(last[i - size], t)):
                        last.append(t)
                        break
                else:
                    raise ValueError(f"no token for a character of {w!r}")
            ids, at = [], n
            for size in range(min(n, longest), 0, -1):
                t = final.get(w[n - size:])
                if t is not None and (size == n or stay(last[n - size], t)):
                    ids.append(vocab[t])
                    at = n - size
                    break
            else:
                if n:
                    raise ValueError(f"no token for the end of {w!r}")
            while at > 0:
                t = last[at]
                ids.append(vocab[t])
                at -= len(t)
            out[k] = ids[::-1]
            before = w[:-1]
        return out


_TRIES: dict = {}


def trie_encoder(path: str) -> CachedEncoder:
    """One per worker process and file."""
    if path not in _TRIES:
        tok = load_tokenizer(path)
        model = json.loads(tok.to_str())["model"]
        merges = [m.split(" ", 1) if isinstance(m, str) else m for m in model["merges"]]
        bpe = TrieBpe(model["vocab"], merges, model.get("end_of_word_suffix") or "")
        _TRIES[path] = CachedEncoder(tok, bpe.encode)
    return _TRIES[path]


_STRINGS: dict = {}


def _token_strings(path: str):
    if path not in _STRINGS:
        tok = load_tokenizer(path)
        by_id = {i: t for t, i in tok.get_vocab(with_added_tokens=True).items()}
        _STRINGS[path] = pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.string()), tok.decoder is None, tok
    return _STRINGS[path]


def decode_lists(path: str, lists: pa.ListArray) -> pa.Array:
    """The text of each list of ids; ids outside the vocabulary are left out."""
    strings, plain, tok = _token_strings(path)
    if not plain:
        return pa.array(tok.decode_batch([x or [] for x in lists.to_pylist()], skip_special_tokens=False), pa.string())
    # without a decoder the library joins tokens by a space
    ids = lists.flatten()
    known = pc.if_else(pc.and_(pc.greater_equal(ids, 0), pc.less(ids, len(strings))), ids, None)
    tokens = strings.take(known)
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    if tokens.null_count:
        kept = np.append(0, np.cumsum(tokens.is_valid().to_numpy(zero_copy_only=False)))
        offsets, tokens = kept[offsets], tokens.drop_null()
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), tokens), " ")


def _encode(path: str, text: str, decoded: bool):
    def run(batches):
        encoder = trie_encoder(path)
        for batch in batches:
            column = batch.column(text)
            rest = batch.drop_columns([text])
            for a, b, ids, counts in encode_in_slices(encoder, column.to_pylist()):
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))
                part = rest.slice(a, b - a)
                more = [decode_lists(path, lists)] if decoded else []
                yield pa.RecordBatch.from_arrays([*part.columns, lists, *more], names=[*part.schema.names, "ids", *["decoded"] * decoded])
    return run


def _fields(df: DataFrame, *without: str) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if f.name not in without)


def encode(df: DataFrame, tokenizer: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """``df`` without its text column and with ``ids array<int>``, and on
    request with ``decoded``, what :func:`decode` gives for these ids."""
    rest = df.drop("ids", *["decoded"] * decoded).withColumn(text, F.col(text).cast("string"))
    return map_arrow(rest, _encode(tokenizer, text, decoded), _fields(rest, text) + "ids array<int>" + ", decoded string" * decoded)


def _decode(path: str):
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, decode_lists(path, batch.column("ids"))],
                                             names=[*batch.schema.names, "decoded"])
    return run


def decode(df: DataFrame, tokenizer: str) -> DataFrame:
    """``df`` with ``decoded``: the text of its ``ids``, special tokens included
    (null ids: empty text; ids outside the vocabulary are left out)."""
    rest = df.drop("decoded").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    return map_arrow(rest, _decode(tokenizer), _fields(rest) + "decoded string")
