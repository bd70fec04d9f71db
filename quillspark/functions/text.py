"""Scalar Column helpers shared by all operators (JVM-side, codegen-friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.strip() removes (Unicode
# whitespace). Spark's and DuckDB's plain trim() remove only spaces, so both
# engines trim this explicit set.
STRIP_CODEPOINTS = (
    [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x1680]
    + list(range(0x2000, 0x200B))
    + [0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
STRIP_CHARS = "".join(chr(c) for c in STRIP_CODEPOINTS)

# Whitespace class for the piece pattern, written with escapes that Java regex
# (Spark) and RE2 (DuckDB) read the same way.
_WS_CLASS = (r"\t\n\x0B\f\r \x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
             r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# Built-in encoder pieces (lossless: the pieces concatenate to the text): a
# run of letters/marks/digits or one other character, each with the
# whitespace in front of it, or trailing whitespace on its own.
_WORD = r"[\p{L}\p{M}\p{N}]"
PIECE_PATTERN = (f"[{_WS_CLASS}]*{_WORD}+"
                 f"|[{_WS_CLASS}]*[^\\p{{L}}\\p{{M}}\\p{{N}}{_WS_CLASS}]"
                 f"|[{_WS_CLASS}]+")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()`` semantics on a string column."""
    return F.btrim(_c(c), F.lit(STRIP_CHARS))


def estimate_tokens(c) -> Column:
    """``len(text) // 4`` in code points."""
    return F.floor(F.length(_c(c)) / F.lit(4)).cast("bigint")


def pieces(c) -> Column:
    """Split text into encoder pieces (whole text, all matches, in order)."""
    return F.regexp_extract_all(_c(c), F.lit(PIECE_PATTERN), 0)


def hash64(*parts) -> Column:
    """Deterministic non-negative 60-bit hash of the parts joined by ':'.

    Same value as DuckDB ``('0x' || substr(md5(k), 1, 15))::BIGINT``.
    """
    key = F.concat_ws(":", *[_c(p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("bigint")


def ids_fingerprint(c) -> Column:
    """md5 of the space-joined id list: a compact, exact comparison key."""
    return F.md5(F.array_join(F.transform(_c(c), lambda x: x.cast("string")), " "))


def text_field(dataset: str | Column, text="text", content="content",
               code_datasets=("stack_v2",)) -> Column:
    """B1: the text column by dataset name (code sets read ``content``),
    falling back ``content`` -> ``text`` -> ''."""
    ds = _c(dataset)
    return F.when(ds.isin(*code_datasets), F.coalesce(_c(content), _c(text), F.lit(""))) \
        .otherwise(F.coalesce(_c(text), F.lit("")))
