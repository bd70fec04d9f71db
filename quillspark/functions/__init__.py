from quillspark.functions.text import (  # noqa: F401
    PIECE_PATTERN, STRIP_CHARS, estimate_tokens, hash64, ids_fingerprint,
    pieces, py_strip, text_field,
)
