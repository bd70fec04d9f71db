"""Vectorized piece splitting inside Arrow batches (numpy over UTF-8 bytes).

Same pieces as ``PIECE_PATTERN`` (see ``functions/text.py``): every character
is a *word* character (Unicode L, M, N), a *space* (the fixed strip set) or
*other*; a piece is a run of spaces followed by a run of word characters or
by one other character, or a trailing run of spaces. So a new piece starts
at character ``i`` when it begins a row, or

* ``i`` is a space and ``i-1`` is not,
* ``i`` is a word character and ``i-1`` is an other character,
* ``i`` is an other character and ``i-1`` is not a space.

The per-character classes come from a code-point table built once per Python
worker; decoding, classification and cutting are numpy operations on the
whole batch, and the pieces are zero-copy slices of the batch's UTF-8
buffer.
"""

from __future__ import annotations

import numpy as np

from quillspark.functions.text import STRIP_CODEPOINTS

OTHER, WORD, SPACE = 0, 1, 2
_TABLE = None


def class_table() -> np.ndarray:
    global _TABLE
    if _TABLE is None:
        import unicodedata
        t = np.zeros(0x110000, dtype=np.uint8)
        cats = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
        t[np.fromiter((c in "LMN" for c in cats), dtype=bool, count=0x110000)] = WORD
        t[list(STRIP_CODEPOINTS)] = SPACE
        _TABLE = t
    return _TABLE


_LEN = np.array([1] * 0x80 + [1] * 0x40 + [2] * 0x20 + [3] * 0x10 + [4] * 0x10, dtype=np.int8)
_MASK = np.array([0x7F] * 0x80 + [0x3F] * 0x40 + [0x1F] * 0x20 + [0x0F] * 0x10 + [0x07] * 0x10,
                 dtype=np.int32)


def _decode(b: np.ndarray):
    """UTF-8 bytes -> (byte index of each code point start, code points)."""
    starts = np.flatnonzero((b & 0xC0) != 0x80)
    if len(starts) == len(b):  # pure ASCII batch
        return starts, b.astype(np.int32)
    lead = b[starts]
    n = _LEN[lead]
    cp = _MASK[lead] & lead.astype(np.int32)
    last = len(b) - 1
    for k in (1, 2, 3):
        more = np.flatnonzero(n > k)
        if len(more) == 0:
            break
        nxt = b[np.minimum(starts[more] + k, last)].astype(np.int32) & 0x3F
        cp[more] = (cp[more] << 6) | nxt
    return starts, np.minimum(cp, 0x10FFFF)


def split_strings(arr):
    """``string`` array -> ``list<string>`` array of pieces (nulls kept)."""
    import pyarrow as pa
    if not len(arr):  # no buffers to read
        return pa.array([], pa.list_(pa.string()))
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.type != pa.string():
        arr = arr.cast(pa.string())
    n = len(arr)
    bufs = arr.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int32)[arr.offset: arr.offset + n + 1].astype(np.int64)
    base = int(offs[0])
    data = np.frombuffer(bufs[2], dtype=np.uint8)[base: int(offs[-1])] if bufs[2] is not None \
        else np.zeros(0, dtype=np.uint8)
    rel = offs - base
    starts, cp = _decode(data)
    cls = class_table()[cp]
    # first code point of each row (rows may be empty)
    row_cp = np.searchsorted(starts, rel)
    prev = np.empty_like(cls)
    prev[0:1] = 255
    prev[1:] = cls[:-1]
    cut = ((cls == SPACE) & (prev != SPACE)) | ((cls == WORD) & (prev == OTHER)) \
        | ((cls == OTHER) & (prev != SPACE))
    cut[row_cp[:-1][row_cp[:-1] < len(cut)]] = True
    piece_cp = np.flatnonzero(cut)
    piece_bytes = np.concatenate([starts[piece_cp], [len(data)]]).astype(np.int32)
    data_buf = bufs[2].slice(base, len(data)) if bufs[2] is not None else pa.py_buffer(b"")
    pieces = pa.StringArray.from_buffers(len(piece_cp), pa.py_buffer(piece_bytes), data_buf)
    list_offs = np.searchsorted(piece_cp, row_cp).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(list_offs, pa.int32()), pieces,
                                    mask=arr.is_null() if arr.null_count else None)


def is_nested(arr) -> bool:
    import pyarrow as pa
    return pa.types.is_list(arr.type) or pa.types.is_large_list(arr.type)


def own_values(arr):
    """Offsets from 0 on and the values of a list array: of a slice, just its own."""
    import pyarrow as pa
    if not len(arr):  # no offsets to read
        return pa.array([0], pa.int32()), arr.values.slice(0, 0)
    offs = arr.offsets.to_numpy()
    return pa.array(offs - offs[0], pa.int32()), arr.values.slice(int(offs[0]), int(offs[-1] - offs[0]))


def split_nested(arr):
    """``string`` or (nested) ``list<string>`` array -> pieces one level deeper."""
    import pyarrow as pa
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if is_nested(arr):
        offs, values = own_values(arr)
        return pa.ListArray.from_arrays(offs, split_nested(values),
                                        mask=arr.is_null() if arr.null_count else None)
    return split_strings(arr)


#: Bytes of text, or values of id lists, that a worker takes at once: splitting
#: and counting hold some tens of times as much.
SLICE = 1 << 20


def _ends(arr) -> np.ndarray:
    """What lies before each row and behind the last: bytes of (nested)
    strings, values of lists of numbers."""
    import pyarrow as pa
    if not len(arr):
        return np.zeros(1, np.int64)
    if is_nested(arr):
        offs = arr.offsets.to_numpy().astype(np.int64)
        inner = arr.values
        return _ends(inner)[offs] if is_nested(inner) or pa.types.is_string(inner.type) or pa.types.is_large_string(inner.type) else offs
    kind = np.int64 if pa.types.is_large_string(arr.type) else np.int32
    return np.frombuffer(arr.buffers()[1], dtype=kind)[arr.offset: arr.offset + len(arr) + 1].astype(np.int64)


def row_slices(batch, column, most: int = SLICE):
    """The rows of an Arrow batch in slices whose (nested) ``column`` has at
    most ``most`` bytes of text or values, one row at least."""
    ends, at = _ends(batch.column(column)), 0
    while at < len(batch):
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + most, side="right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop
