"""Corpus: documents -> budget -> encode (+EOS) -> every-Nth split -> stats."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import corpus as C
from quillspark.operators.encode import DEFAULT_VOCAB_SIZE, Encoder
from quillspark.operators.ordered import DEFAULT_BUCKET_WIDTH
from quillspark.operators.pack import stream_offsets
from quillspark.operators.streams import DEFAULT_CHUNK, cut_streams


def corpus_encoder(documents: DataFrame, vocab_size: int = DEFAULT_VOCAB_SIZE) -> Encoder:
    """Vocabulary fitted on the non-empty ``documents`` text."""
    return Encoder.fit(documents.filter(F.length("text") > 0), "text", vocab_size)


def _admitted(docs: DataFrame, max_tokens: int | None, bucket_width: int) -> DataFrame:
    """E1 as a filter: admission keeps a prefix of each dataset, so the narrow
    ``(dataset, pos, est)`` gives one last ``pos`` per dataset, and that row
    per dataset prunes the text scan."""
    if not max_tokens:
        return docs
    narrow = C.token_budget(docs.select("dataset", "pos", "est"), max_tokens, bucket_width=bucket_width)
    last = narrow.groupBy(F.col("dataset").alias("_dataset")).agg(F.max("pos").alias("_last"))
    near = F.broadcast(last)  # one row per dataset of the configuration
    return docs.join(near, docs.dataset.eqNullSafe(last._dataset) & (F.col("pos") <= F.col("_last")), "left_semi")


def _encoded(documents: DataFrame, max_tokens: int | None, encoder: Encoder, bucket_width: int) -> DataFrame:
    """``dataset, pos, ids, n_chars``: one narrow pass over the text."""
    docs = C.with_estimate(C.filter_nonempty(C.corpus_from_documents(documents)))
    docs = _admitted(docs, max_tokens, bucket_width)
    docs = docs.select("dataset", "pos", "text", F.length("text").cast("bigint").alias("n_chars"))
    return encoder.encode(docs, "text", "ids", add_eos=True, drop_text=True)


def token_lengths(documents: DataFrame, encoder: Encoder | None = None, max_tokens: int | None = None,
                  bucket_width: int = DEFAULT_BUCKET_WIDTH) -> DataFrame:
    """``dataset, pos, n_tokens, n_chars`` of the admitted documents: neither
    texts nor ids leave the map task that encodes them."""
    e = _encoded(documents, max_tokens, encoder or corpus_encoder(documents), bucket_width)
    return e.select("dataset", "pos", F.size("ids").cast("bigint").alias("n_tokens"), "n_chars")


def encoded_stage(documents: DataFrame, max_tokens: int | None = None, encoder: Encoder | None = None,
                  bucket_width: int = DEFAULT_BUCKET_WIDTH) -> DataFrame:
    """``dataset, pos, ids (EOS appended), n_tokens, n_chars``: the text is
    encoded in one narrow pass that is written as a stage (like the
    reference's token files)."""
    from quillspark.session import materialize as mat
    e = _encoded(documents, max_tokens, encoder or corpus_encoder(documents), bucket_width)
    return mat(e.select("dataset", "pos", "ids", F.size("ids").cast("bigint").alias("n_tokens"), "n_chars"), "encoded-ids")


def encoded_corpus(documents: DataFrame, max_tokens: int | None = None, val_every: int = 100,
                   encoder: Encoder | None = None,
                   bucket_width: int = DEFAULT_BUCKET_WIDTH) -> DataFrame:
    """:func:`encoded_stage` with ``doc_index`` and ``is_val`` of each document
    (the ids are shuffled for it; streams need it not, see :func:`corpus_streams`)."""
    stage = encoded_stage(documents, max_tokens, encoder, bucket_width)
    return C.val_every_n(stage, val_every, bucket_width=bucket_width).select(
        "dataset", "pos", "doc_index", "is_val", "ids", "n_tokens", "n_chars")


def document_offsets(stage: DataFrame, val_every: int = 100, bucket_width: int = DEFAULT_BUCKET_WIDTH) -> DataFrame:
    """E3 + E5: ``dataset, split, pos, start`` of every document in its packed
    stream, from the lengths alone."""
    d = C.val_every_n(stage.select("dataset", "pos", "n_tokens"), val_every, bucket_width=bucket_width)
    d = d.withColumn("split", F.when(F.col("is_val"), F.lit("val")).otherwise(F.lit("train")))
    return stream_offsets(d, ["dataset", "split"], "pos", "n_tokens", bucket_width=bucket_width).select("dataset", "split", "pos", "start")


def corpus_token_stats(documents: DataFrame, max_tokens: int | None = None,
                       val_every: int = 100, encoder: Encoder | None = None,
                       bucket_width: int = DEFAULT_BUCKET_WIDTH) -> DataFrame:
    """Flagship: per-dataset statistics of the tokenized, split corpus.
    One scan of the text; the split sees only the lengths."""
    from quillspark.session import materialize as mat
    lengths = mat(token_lengths(documents, encoder, max_tokens, bucket_width), "token-lengths")
    return C.token_stats(C.val_every_n(lengths, val_every, bucket_width=bucket_width))


def corpus_streams(stage: DataFrame, chunk_size: int = DEFAULT_CHUNK, val_every: int = 100,
                   bucket_width: int = DEFAULT_BUCKET_WIDTH) -> DataFrame:
    """A10/H9 for the corpus: per ``(dataset, split)`` the packed token stream
    (documents in ``pos`` order, EOS after each) as a chunk table, with one
    exchange of ids. ``stage``: see :func:`encoded_stage`."""
    return cut_streams(stage, ["dataset"], "pos", ("ids",), chunk_size, n_tokens="n_tokens", bucket_width=bucket_width, val_every=val_every)
