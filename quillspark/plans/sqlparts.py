"""SQL fragments for the DuckDB oracle queries (the same fixed values as the
Spark Column helpers, written as DuckDB SQL)."""

from quillspark.functions.text import PIECE_PATTERN, STRIP_CODEPOINTS
from quillspark.operators.encode import DEFAULT_VOCAB_SIZE, N_SPECIALS

P = PIECE_PATTERN
STRIP = "(" + "||".join(f"chr({c})" for c in STRIP_CODEPOINTS) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {STRIP})"


def vocab_cte(vocab_size: int = DEFAULT_VOCAB_SIZE) -> str:
    """``vocab(piece, id, cnt)`` fitted on the non-empty documents."""
    return f"""vocab AS (
  SELECT piece, CAST(row_number() OVER (ORDER BY cnt DESC, piece ASC) + {N_SPECIALS - 1} AS INTEGER) AS id, cnt
  FROM (SELECT piece, count(*) AS cnt
        FROM (SELECT unnest(regexp_extract_all(text, '{P}')) AS piece
              FROM documents WHERE length(text) > 0)
        GROUP BY piece)
  QUALIFY row_number() OVER (ORDER BY cnt DESC, piece ASC) <= {vocab_size - N_SPECIALS}
), vmap AS (
  SELECT map_from_entries(list(struct_pack(k := piece, v := id))) AS vm FROM vocab
)"""


def encode(text_sql: str) -> str:
    """Ids of a text expression; needs ``vmap`` joined in as ``vmap``."""
    return (f"list_transform(regexp_extract_all({text_sql}, '{P}'), "
            f"lambda p: coalesce(vmap.vm[p], 0))")


def fingerprint(ids_sql: str) -> str:
    return f"md5(array_to_string({ids_sql}, ' '))"


def hash64(*parts: str) -> str:
    key = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5({key}), 1, 15)) AS BIGINT)"
