"""Small inputs with every kind of odd row."""

import random

import public_tokenizers

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")

SYLLABLES = "ba co di fu ge ha li mo nu ra se to vi wo ze".split()

#: Columns that clash with names the operators use within.
CLASHES = ("ids", "vector", "score", "fp", "key", "text_hash", "n_words", "doc", "stratum", "part", "copy", "_h", "_b", "members")


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(n))


def odd_texts() -> list:
    rng = random.Random(11)
    long = "\n".join(words(rng, 40) + "." for _ in range(120))
    return [None, "", " ", "\n\n", "a", "don't 'tis we'll", long, long, words(rng, 60), "Ünï cödé 日本語 😀", "a<|endoftext|>b",
            "x" * 3000, "tab\tsep\r\nline\x0bvt\x0cff", long + " tail"]


def odd_documents(spark, extra: bool = True):
    """Ties, a null id, repeated rows and clashing columns."""
    texts = odd_texts()
    rows = [(i if i != 9 else None, t) for i, t in enumerate(texts)] + [(3, texts[3]), (8, texts[8]), (8, texts[8])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    if extra:
        from pyspark.sql import functions as F
        df = df.withColumns({c: F.lit("clash") for c in CLASHES})
    return df


def empty_documents(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string")
