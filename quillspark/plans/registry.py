"""Registered queries (Spark) and their DuckDB oracle SQL, keyed by the
operator key of the survey inventory. Every query reads the given tables in
full; parameters are the documented defaults or fixed test settings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import ids_fingerprint
from quillspark.operators import corpus as C
from quillspark.plans import corpus_plan as CP
from quillspark.plans.sqlparts import P, encode, fingerprint, vocab_cte
from quillspark.session import StageStore, scratch_path, table

#: Stages that several queries read: the encoded corpus, its streams, the instruction split and its chunks.
STAGES = StageStore()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Budget of the queries whose feature it is: E1, E2, D1, S1.
BUDGET_PER_SOURCE = 5_000
STATS_VAL_EVERY = 10
#: Rows per bucket of the two-phase ordered operators in the queries.
BUCKET = 256


def register(key: str, sql: str | None = None):
    def deco(fn):
        QUERIES[key] = fn
        if sql is not None:
            SQL[key] = sql
        return fn
    return deco


def _docs(spark, sf):
    from quillspark.session import spread_scan
    return spread_scan(table(spark, sf, "documents"))


def _corpus(spark, sf):
    return C.with_estimate(C.filter_nonempty(C.corpus_from_documents(_docs(spark, sf))))


_NONEMPTY = """SELECT source AS dataset, doc_id AS pos, text, lang,
       CAST(floor(length(text) / 4) AS BIGINT) AS est
FROM documents WHERE length(text) > 0"""

# ---------------------------------------------------------------- 2.2 B*


@register("filter_nonempty", f"""
SELECT dataset, pos, CAST(length(text) AS BIGINT) AS n_chars FROM ({_NONEMPTY})""")
def q_filter_nonempty(spark, sf):
    return _corpus(spark, sf).select("dataset", "pos",
                                     F.length("text").cast("bigint").alias("n_chars"))


@register("filter_min_chars", """
SELECT source AS dataset, doc_id AS pos, CAST(length(text) AS BIGINT) AS n_chars
FROM documents WHERE length(text) >= 50""")
def q_filter_min_chars(spark, sf):
    d = C.filter_min_chars(C.corpus_from_documents(_docs(spark, sf)), 50)
    return d.select("dataset", "pos", F.length("text").cast("bigint").alias("n_chars"))


@register("estimate_tokens", f"SELECT dataset, pos, est FROM ({_NONEMPTY})")
def q_estimate_tokens(spark, sf):
    return _corpus(spark, sf).select("dataset", "pos", "est")


@register("text_field_map", """
SELECT source AS dataset, doc_id AS pos,
       CASE WHEN source = 'src0' THEN md5(coalesce(lang, '')) ELSE md5(coalesce(text, '')) END AS text_md5
FROM documents""")
def q_text_field_map(spark, sf):
    # src0 plays the code dataset whose text lives in ``content`` (here: lang).
    d = C.corpus_from_documents(_docs(spark, sf)).withColumn("content", F.col("lang"))
    d = C.extract_text(d, code_datasets=("src0",))
    return d.select("dataset", "pos", F.md5("text").alias("text_md5"))

# ---------------------------------------------------------------- 2.5 E*


@register("token_budget", f"""
SELECT dataset, pos, est, cum_tokens FROM (
  SELECT *, CAST(sum(est) OVER (PARTITION BY dataset ORDER BY pos
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_tokens
  FROM ({_NONEMPTY})) WHERE cum_tokens <= {BUDGET_PER_SOURCE}""")
def q_token_budget(spark, sf):
    return C.token_budget(_corpus(spark, sf).drop("text"), BUDGET_PER_SOURCE, bucket_width=BUCKET).select(
        "dataset", "pos", "est", "cum_tokens")


@register("collect_counts", f"""
SELECT dataset, CAST(count(*) AS BIGINT) AS docs, CAST(sum(est) AS BIGINT) AS tokens FROM (
  SELECT *, sum(est) OVER (PARTITION BY dataset ORDER BY pos
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum_tokens
  FROM ({_NONEMPTY})) WHERE cum_tokens <= {BUDGET_PER_SOURCE} GROUP BY dataset""")
def q_collect_counts(spark, sf):
    return C.collect_counts(C.token_budget(_corpus(spark, sf).drop("text"), BUDGET_PER_SOURCE, bucket_width=BUCKET))


@register("token_budget_lang", """
SELECT dataset, lang, pos, est, cum_tokens FROM (
  SELECT c.*, CAST(sum(est) OVER (PARTITION BY c.dataset, c.lang ORDER BY pos
                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS cum_tokens,
         CAST(floor(20000 / n.n_langs) AS BIGINT) AS quota
  FROM (""" + _NONEMPTY + """) c
  JOIN (SELECT source AS dataset, count(DISTINCT lang) AS n_langs FROM documents
        WHERE length(text) > 0 GROUP BY source) n ON c.dataset IS NOT DISTINCT FROM n.dataset)
WHERE cum_tokens <= quota""")
def q_token_budget_lang(spark, sf):
    return C.token_budget_lang(_corpus(spark, sf).drop("text"), 20_000, bucket_width=BUCKET).select(
        "dataset", "lang", "pos", "est", "cum_tokens")


@register("val_every_n", f"""
SELECT dataset, pos, doc_index, ((doc_index % 10) = 0) AS is_val FROM (
  SELECT dataset, pos, CAST(row_number() OVER (PARTITION BY dataset ORDER BY pos) - 1 AS BIGINT)
         AS doc_index FROM ({_NONEMPTY}))""")
def q_val_every_n(spark, sf):
    return C.val_every_n(_corpus(spark, sf).drop("text"), 10, bucket_width=BUCKET).select("dataset", "pos", "doc_index", "is_val")

# ---------------------------------------------------------------- 2.9 J*


@register("build_vocab", f"WITH {vocab_cte()} SELECT piece, id, CAST(cnt AS BIGINT) AS count FROM vocab")
def q_build_vocab(spark, sf):
    from quillspark.operators.encode import build_vocab
    return build_vocab(_docs(spark, sf).filter(F.length("text") > 0), "text")


_ENCODED = f"""WITH {vocab_cte()},
enc AS (SELECT c.dataset, c.pos, c.text, list_append({encode('c.text')}, 2) AS ids
        FROM ({_NONEMPTY}) c, vmap)"""


@register("encode_corpus", f"""{_ENCODED}
SELECT dataset, pos, CAST(len(ids) AS BIGINT) AS n_tokens, {fingerprint('ids')} AS ids_md5
FROM enc""")
def q_encode_corpus(spark, sf):
    enc = _encoder(spark, sf)
    e = enc.encode(_corpus(spark, sf), "text", "ids", add_eos=True, drop_text=True)
    return e.select("dataset", "pos", F.size("ids").cast("bigint").alias("n_tokens"),
                    ids_fingerprint("ids").alias("ids_md5"))


_STATS = f"""WITH {vocab_cte()},
adm AS (
  SELECT *, CAST(row_number() OVER w - 1 AS BIGINT) AS doc_index
  FROM ({_NONEMPTY}) WINDOW w AS (PARTITION BY dataset ORDER BY pos)),
enc AS (
  SELECT a.dataset, (a.doc_index % {STATS_VAL_EVERY}) = 0 AS is_val,
         CAST(len({encode('a.text')}) + 1 AS BIGINT) AS n_tokens,
         CAST(length(a.text) AS BIGINT) AS n_chars
  FROM adm a, vmap),
st AS (
  SELECT dataset,
    CAST(sum(CASE WHEN NOT is_val THEN n_tokens ELSE 0 END) AS BIGINT) AS train_tokens,
    CAST(sum(CASE WHEN is_val THEN n_tokens ELSE 0 END) AS BIGINT) AS val_tokens,
    CAST(sum(CASE WHEN NOT is_val THEN 1 ELSE 0 END) AS BIGINT) AS train_docs,
    CAST(sum(CASE WHEN is_val THEN 1 ELSE 0 END) AS BIGINT) AS val_docs,
    CAST(sum(n_chars) AS BIGINT) AS total_chars
  FROM enc GROUP BY dataset)"""


@register("token_stats", f"""{_STATS}
SELECT dataset, train_tokens, val_tokens, train_docs, val_docs, total_chars,
  round(CAST(total_chars AS DOUBLE) / (train_tokens + val_tokens), 6) AS chars_per_token,
  round(train_tokens * 2 / 1048576.0, 6) AS train_size_mb,
  round(val_tokens * 2 / 1048576.0, 6) AS val_size_mb
FROM st""")
def q_token_stats(spark, sf):
    s = CP.corpus_token_stats(_docs(spark, sf), None, STATS_VAL_EVERY, _encoder(spark, sf), BUCKET)
    return s.select("dataset", "train_tokens", "val_tokens", "train_docs", "val_docs",
                    "total_chars", *[F.round(c, 6).alias(c) for c in
                                     ("chars_per_token", "train_size_mb", "val_size_mb")])


@register("totals_rollup", f"""{_STATS}
SELECT CASE WHEN grouping(dataset) = 1 THEN 'TOTAL' ELSE dataset END AS dataset,
       grouping(dataset) = 1 AS is_total,
       CAST(sum(train_tokens) AS BIGINT) AS train_tokens,
       CAST(sum(val_tokens) AS BIGINT) AS val_tokens
FROM st GROUP BY ROLLUP (dataset)""")
def q_totals_rollup(spark, sf):
    return C.totals_rollup(CP.corpus_token_stats(_docs(spark, sf), None, STATS_VAL_EVERY,
                                                 _encoder(spark, sf), BUCKET))


@register("ratio_of_sums", f"""{_STATS}
SELECT dataset, round(coalesce(CAST(total_chars AS DOUBLE) / nullif(train_tokens + val_tokens, 0), 0), 6)
       AS chars_per_token FROM st""")
def q_ratio_of_sums(spark, sf):
    e = CP.token_lengths(_docs(spark, sf), _encoder(spark, sf))
    return e.groupBy("dataset").agg(
        F.round(C.ratio_of_sums("n_chars", "n_tokens"), 6).alias("chars_per_token"))


# ================================================================ 2.8 chat
from quillspark.operators import chat as H  # noqa: E402
from quillspark.plans import sft_plan as SP  # noqa: E402
from quillspark.plans import sqlchat as Q  # noqa: E402
from quillspark.plans.sqlparts import hash64 as sql_hash64  # noqa: E402

#: Rows per dataset of the two queries whose feature the quota is: E4, D5.
SFT_QUOTA = 20
SFT_VAL_FRACTION = 0.02
SFT_CHUNK = 4096
_ENCODERS: dict = {}


def _encoder(spark, sf):
    """The corpus encoder, fitted once per (session, tables)."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _ENCODERS:
        _ENCODERS[key] = CP.corpus_encoder(_docs(spark, sf))
    return _ENCODERS[key]


def _turns(spark, sf):
    return H.collect_turns(table(spark, sf, "conversations"))


def _render(m):
    return F.md5(F.array_join(F.transform(m, lambda x: F.concat(x["role"], F.lit(":"),
                                                                x["content"])), "\n"))


def _conv_out(d, col="messages"):
    m = F.col(col)
    return d.select(F.col("conv_id").alias("pos"), m.isNotNull().alias("ok"),
                    F.size(m).cast("bigint").alias("n_msgs"), _render(m).alias("msgs_md5"))


def _conv_sql(shape_sql):
    return f"""WITH {Q.TURNS}
SELECT pos, m IS NOT NULL AS ok, CAST(len(m) AS BIGINT) AS n_msgs,
       {Q.render('m')} AS msgs_md5
FROM (SELECT pos, {shape_sql} AS m FROM turns)"""


@register("convert_sharegpt", _conv_sql(Q.SHAREGPT_MSGS))
def q_convert_sharegpt(spark, sf):
    return _conv_out(H.as_sharegpt(_turns(spark, sf)).select(
        "conv_id", H.convert_sharegpt().alias("messages")))


@register("convert_messages", _conv_sql(Q.MESSAGES_MSGS))
def q_convert_messages(spark, sf):
    return _conv_out(H.as_messages(_turns(spark, sf)).select(
        "conv_id", H.convert_messages().alias("messages")))


@register("convert_pairs", _conv_sql(Q.PAIRS_MSGS))
def q_convert_pairs(spark, sf):
    return _conv_out(H.as_pairs(_turns(spark, sf)).select(
        "conv_id", H.convert_pairs().alias("messages")))


@register("convert_qa", _conv_sql(Q.QA_MSGS))
def q_convert_qa(spark, sf):
    return _conv_out(H.as_qa(_turns(spark, sf), "problem", "solution").select(
        "conv_id", H.convert_qa("problem", "solution").alias("messages")))


@register("map_roles", f"""WITH {Q.TURNS}
SELECT pos, CASE WHEN list_bool_and(list_transform(t, lambda x: x.role IN ('system','user','assistant')))
                 THEN array_to_string(list_transform(t, lambda x: x.role), ',') END AS roles
FROM turns""")
def q_map_roles(spark, sf):
    # B7 alone: speaker names mapped; an unknown one rejects the conversation.
    sg = H.as_sharegpt(_turns(spark, sf))
    roles = F.create_map(*[x for k, v in H.SHAREGPT_ROLES.items() for x in (F.lit(k), F.lit(v))])
    mapped = F.transform("conversations", lambda t: F.try_element_at(roles, t["from"]))
    return sg.select(F.col("conv_id").alias("pos"), F.when(
        F.forall(mapped, lambda r: r.isNotNull()), F.array_join(mapped, ",")).alias("roles"))


@register("reject_blank_turn", f"""WITH {Q.TURNS}
SELECT pos, list_bool_or(list_transform(t, lambda x: length({Q.s("coalesce(x.text, '')")}) = 0)) AS rejected
FROM turns""")
def q_reject_blank_turn(spark, sf):
    from quillspark.functions.text import py_strip
    t = _turns(spark, sf)
    return t.select(F.col("conv_id").alias("pos"), F.exists(
        "turns", lambda x: F.length(py_strip(F.coalesce(x["text"], F.lit("")))) == 0)
        .alias("rejected"))


_REG = f"WITH {Q.TURNS}, {Q.registry_cte(H.DATASETS)}"


@register("converter_registry", f"""{_REG}
SELECT dataset, CAST(count(m) AS BIGINT) AS converted, CAST(count(*) - count(m) AS BIGINT) AS rejected
FROM reg GROUP BY dataset""")
def q_converter_registry(spark, sf):
    r = H.registry_messages(_turns(spark, sf))
    return r.groupBy("dataset").agg(
        F.count("messages").cast("bigint").alias("converted"),
        (F.count(F.lit(1)) - F.count("messages")).cast("bigint").alias("rejected"))


@register("valid_conversation", f"""{_REG}
SELECT dataset, pos, {Q.valid('m')} AS is_valid FROM reg""")
def q_valid_conversation(spark, sf):
    r = H.registry_messages(_turns(spark, sf))
    return r.select("dataset", "pos", H.valid_conversation("messages").alias("is_valid"))


@register("merge_system", f"""{_REG}
SELECT dataset, pos, {Q.render(Q.merge_system('m'))} AS merged_md5 FROM reg""")
def q_merge_system(spark, sf):
    r = H.registry_messages(_turns(spark, sf))
    return r.select("dataset", "pos", _render(H.merge_system("messages")).alias("merged_md5"))


_PROMPT_SQL = f"""array_to_string(list_transform({Q.merge_system('m')}, lambda x:
    CASE x.role WHEN 'user' THEN '[INST] ' || {Q.s('x.content')} || ' [/INST]'
                WHEN 'assistant' THEN ' ' || {Q.s('x.content')} || '</s>' ELSE '' END), '')"""


@register("format_prompt", f"""{_REG}
SELECT dataset, pos, md5({_PROMPT_SQL}) AS prompt_md5,
       CAST(length({_PROMPT_SQL}) AS BIGINT) AS prompt_chars FROM reg WHERE m IS NOT NULL""")
def q_format_prompt(spark, sf):
    r = H.registry_messages(_turns(spark, sf)).filter(F.col("messages").isNotNull())
    p = H.format_prompt("messages")
    return r.select("dataset", "pos", F.md5(p).alias("prompt_md5"),
                    F.length(p).cast("bigint").alias("prompt_chars"))


_IDS, _MASK = Q.tokenize(Q.merge_system("m"))
_TOK = f"""WITH {vocab_cte()}, {Q.TURNS}, {Q.registry_cte(H.DATASETS)},
tok AS (SELECT dataset, pos, m, {Q.valid('m')} AS is_valid,
               CASE WHEN {Q.valid('m')} THEN {_IDS} END AS ids,
               CASE WHEN {Q.valid('m')} THEN {_MASK} END AS mask
        FROM reg, vmap),
taken AS (SELECT *, {sql_hash64(str(H.SFT_SEED), 'dataset', 'pos')} AS shuffle_key FROM tok WHERE is_valid),
spl AS (SELECT *, CASE WHEN row_number() OVER (ORDER BY shuffle_key) <=
                  greatest(1, CAST(floor(count(*) OVER () * CAST({SFT_VAL_FRACTION} AS DOUBLE)) AS BIGINT))
                  THEN 'val' ELSE 'train' END AS split FROM taken)"""
# The first rows of each dataset that are valid and not too long
_QUOTA = f"""{_TOK},
flag AS (SELECT *, is_valid AND coalesce(len(ids) > 2048, false) AS too_long,
                CAST(is_valid AND NOT coalesce(len(ids) > 2048, false) AS INTEGER) AS pass FROM tok),
fl2 AS (SELECT *, (sum(pass) OVER (PARTITION BY dataset ORDER BY pos
                   ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - pass) < {SFT_QUOTA} AS processed
        FROM flag)"""


def _ids_md5(c):
    return ids_fingerprint(c)


@register("tokenize_conversation", f"""{_TOK}
SELECT dataset, pos, CAST(len(ids) AS BIGINT) AS n_tokens, {fingerprint('ids')} AS ids_md5,
       {fingerprint('mask')} AS mask_md5, CAST(list_sum(mask) AS BIGINT) AS trainable
FROM tok WHERE is_valid""")
def q_tokenize_conversation(spark, sf):
    c = SP.sft_candidates(table(spark, sf, "conversations"), _encoder(spark, sf)) \
        .filter(F.col("ids").isNotNull())
    return c.select("dataset", "pos", F.size("ids").cast("bigint").alias("n_tokens"),
                    _ids_md5("ids").alias("ids_md5"), _ids_md5("mask").alias("mask_md5"),
                    F.aggregate("mask", F.lit(0).cast("bigint"), lambda a, x: a + x)
                    .alias("trainable"))


@register("filter_max_tokens", f"""{_TOK}
SELECT dataset, CAST(count(*) AS BIGINT) AS kept FROM tok
WHERE is_valid AND len(ids) <= 2048 GROUP BY dataset""")
def q_filter_max_tokens(spark, sf):
    c = SP.sft_candidates(table(spark, sf, "conversations"), _encoder(spark, sf)) \
        .filter(F.col("ids").isNotNull())
    return H.filter_max_tokens(c).groupBy("dataset").agg(
        F.count(F.lit(1)).cast("bigint").alias("kept"))


def _flagged(spark, sf):
    return SP.sft_flagged(table(spark, sf, "conversations"), _encoder(spark, sf), limit=SFT_QUOTA)


@register("first_n_valid", f"{_QUOTA}\nSELECT dataset, pos FROM fl2 WHERE processed AND pass = 1")
def q_first_n_valid(spark, sf):
    return _flagged(spark, sf).filter("taken").select("dataset", "pos")


@register("collect_skips", f"""{_QUOTA}
SELECT dataset,
  CAST(sum(CASE WHEN processed AND pass = 1 THEN 1 ELSE 0 END) AS BIGINT) AS collected,
  CAST(sum(CASE WHEN processed AND NOT is_valid THEN 1 ELSE 0 END) AS BIGINT) AS skipped_invalid,
  CAST(sum(CASE WHEN processed AND too_long THEN 1 ELSE 0 END) AS BIGINT) AS skipped_long
FROM fl2 GROUP BY dataset""")
def q_collect_skips(spark, sf):
    return H.collect_skips(_flagged(spark, sf))


def _split(spark, sf):
    return STAGES.get(spark, (sf, SFT_VAL_FRACTION, "sft-split"), lambda: SP.sft_split(
        table(spark, sf, "conversations"), _encoder(spark, sf), val_fraction=SFT_VAL_FRACTION))


def _sft_chunks(spark, sf):
    return STAGES.get(spark, (sf, SFT_VAL_FRACTION, SFT_CHUNK, "sft-chunks"),
                      lambda: SP.sft_stream(_split(spark, sf), SFT_CHUNK))


def _mask_ranks(spark, sf):
    from quillspark.operators.sample import mask_directory
    return STAGES.get(spark, (sf, SFT_VAL_FRACTION, SFT_CHUNK, "mask-ranks"), lambda: mask_directory(_sft_chunks(spark, sf), ["split"]),
                      cluster_by=["split", "chunk_id"])


def _sft_examples(spark, sf):
    return SP.sft_examples(table(spark, sf, "conversations"), _encoder(spark, sf))


@register("concat_datasets", f"""{_TOK}
SELECT dataset, pos, CAST(len(ids) AS BIGINT) AS n_tokens FROM taken""")
def q_concat_datasets(spark, sf):
    # the bag union of the datasets, each prepared on its own
    conv, enc = table(spark, sf, "conversations"), _encoder(spark, sf)
    names, parts = list(H.DATASETS), 3
    out = None
    for i in range(parts):
        ex = SP.sft_examples(conv, enc, names[i::parts])
        out = ex if out is None else out.unionByName(ex)
    return out.select("dataset", "pos", F.size("ids").cast("bigint").alias("n_tokens"))


@register("seeded_shuffle", f"{_TOK}\nSELECT dataset, pos, shuffle_key FROM taken")
def q_seeded_shuffle(spark, sf):
    from quillspark.operators.sample import seeded_shuffle
    return seeded_shuffle(_sft_examples(spark, sf), H.SFT_SEED, "dataset", "pos") \
        .select("dataset", "pos", "shuffle_key")


@register("fraction_split", f"{_TOK}\nSELECT dataset, pos, split FROM spl")
def q_fraction_split(spark, sf):
    return _split(spark, sf).select("dataset", "pos", "split")


@register("split_complement", f"""{_TOK}
SELECT split, CAST(count(*) AS BIGINT) AS examples, CAST(count(*) AS BIGINT) AS only_here FROM spl GROUP BY split""")
def q_split_complement(spark, sf):
    # disjoint and exhaustive: every example is in one split, once
    one = _split(spark, sf).groupBy("dataset", "pos").agg(F.min("split").alias("split"), F.count(F.lit(1)).alias("n"))
    return one.groupBy("split").agg(F.sum("n").cast("bigint").alias("examples"),
                                    F.count(F.when(F.col("n") == 1, 1)).cast("bigint").alias("only_here"))


@register("split_stats", f"""{_TOK}
SELECT split, CAST(sum(len(ids)) AS BIGINT) AS tokens, CAST(sum(list_sum(mask)) AS BIGINT) AS trainable_tokens,
       CAST(count(*) AS BIGINT) AS examples,
       round(CAST(sum(list_sum(mask)) AS DOUBLE) * 100.0 / sum(len(ids)), 6) AS trainable_pct
FROM spl GROUP BY split""")
def q_split_stats(spark, sf):
    return H.split_stats(_split(spark, sf))


_PACK = f"""{_TOK},
offs AS (SELECT split, ids, mask, sum(len(ids)) OVER (PARTITION BY split ORDER BY shuffle_key
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - len(ids) AS start FROM spl),
toks AS (SELECT split, start, unnest(ids) AS tok, unnest(mask) AS mk, unnest(range(len(ids))) AS i FROM offs),
chunks AS (SELECT split, CAST((start + i) // {SFT_CHUNK} AS BIGINT) AS chunk_id,
                  list(tok ORDER BY start + i) AS tokens, list(mk ORDER BY start + i) AS mask
           FROM toks GROUP BY ALL)"""


@register("pack_stream", f"""{_PACK}
SELECT split, chunk_id, CAST(len(tokens) AS BIGINT) AS n_tokens, {fingerprint('tokens')} AS tokens_md5,
       {fingerprint('mask')} AS mask_md5 FROM chunks""")
def q_pack_stream(spark, sf):
    ch = _sft_chunks(spark, sf)
    return ch.select("split", "chunk_id", F.size("tokens").cast("bigint").alias("n_tokens"),
                     _ids_md5("tokens").alias("tokens_md5"), _ids_md5("mask").alias("mask_md5"))


# ================================================================ streams & windows
from quillspark.operators import pack as K  # noqa: E402
from quillspark.operators import sample as S  # noqa: E402
from quillspark.operators import stats as T  # noqa: E402
from quillspark.operators.joins import join_null_safe  # noqa: E402

STREAM_CHUNK = 4096
STREAM_VAL_EVERY = 10
BLOCK = 64
PLAN = dict(world=2, steps=3, micro=2, batch=4)
SEG_LEN, N_SEGMENTS = 256, 3
_PLAN_ROWS = PLAN["world"] * PLAN["steps"] * PLAN["micro"] * PLAN["batch"]


def _encoded(spark, sf):
    return STAGES.get(spark, (sf, "encoded-corpus"), lambda: CP.encoded_stage(_docs(spark, sf), None, _encoder(spark, sf), BUCKET))


def _streams(spark, sf):
    return STAGES.get(spark, (sf, STREAM_VAL_EVERY, STREAM_CHUNK, "corpus-streams"),
                      lambda: CP.corpus_streams(_encoded(spark, sf), STREAM_CHUNK, STREAM_VAL_EVERY, BUCKET))


def _train_lengths(spark, sf):
    ch = _streams(spark, sf).filter(F.col("split") == "train")
    return ch, K.stream_lengths(ch, ["dataset", "split"])


_CSTREAM = f"""WITH {vocab_cte()},
docs AS (SELECT source AS dataset, doc_id AS pos, text FROM documents WHERE length(text) > 0),
idx AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY pos) - 1 AS doc_index FROM docs),
enc AS (SELECT dataset, pos, CASE WHEN doc_index % {STREAM_VAL_EVERY} = 0 THEN 'val' ELSE 'train' END AS split,
               list_append({encode('idx.text')}, 2) AS ids FROM idx, vmap),
streams AS (SELECT dataset, split, flatten(list(ids ORDER BY pos)) AS s FROM enc GROUP BY dataset, split),
files AS (SELECT dataset, split, CAST(len(s) AS BIGINT) AS total,
                 CAST(greatest(len(s) - {BLOCK}, 0) AS BIGINT) AS valid FROM streams WHERE split = 'train'),
franges AS (SELECT *, sum(valid) OVER (ORDER BY dataset, split ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS hi
            FROM files),
plan AS (SELECT CAST(id // {PLAN['batch'] * PLAN['micro'] * PLAN['steps']} AS INTEGER) AS rank,
                CAST((id // {PLAN['batch'] * PLAN['micro']}) % {PLAN['steps']} AS BIGINT) AS step,
                CAST((id // {PLAN['batch']}) % {PLAN['micro']} AS INTEGER) AS micro,
                CAST(id % {PLAN['batch']} AS INTEGER) AS slot
         FROM range({PLAN['world'] * PLAN['steps'] * PLAN['micro'] * PLAN['batch']}) r(id)),
draws AS (SELECT p.*, rank || ':' || step || ':' || micro || ':' || slot AS wid,
                 {sql_hash64("'42'", 'rank', 'step', 'micro', 'slot')} % (SELECT sum(valid) FROM files) AS off
          FROM plan p),
wins AS (SELECT d.*, f.dataset, f.split, d.off - (f.hi - f.valid) AS start
         FROM draws d JOIN franges f ON d.off >= f.hi - f.valid AND d.off < f.hi),
wx AS (SELECT w.*, st.s[w.start + 1 : w.start + {BLOCK}] AS x, st.s[w.start + 2 : w.start + {BLOCK} + 1] AS y
       FROM wins w JOIN streams st USING (dataset, split))"""


@register("stream_offsets", f"""{_CSTREAM}
SELECT dataset, split, pos, CAST(sum(len(ids)) OVER (PARTITION BY dataset, split ORDER BY pos
       ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - len(ids) AS BIGINT) AS start FROM enc""")
def q_stream_offsets(spark, sf):
    return CP.document_offsets(_encoded(spark, sf), STREAM_VAL_EVERY, BUCKET)


@register("sink_token_stream", f"""{_CSTREAM},
ch AS (SELECT dataset, split, CAST(unnest(range(0, (len(s) + {STREAM_CHUNK} - 1) // {STREAM_CHUNK})) AS BIGINT) AS chunk_id, s
       FROM streams)
SELECT dataset, split, chunk_id,
       CAST(len(s[chunk_id * {STREAM_CHUNK} + 1 : (chunk_id + 1) * {STREAM_CHUNK}]) AS BIGINT) AS n_tokens,
       {fingerprint(f's[chunk_id * {STREAM_CHUNK} + 1 : (chunk_id + 1) * {STREAM_CHUNK}]')} AS tokens_md5
FROM ch""")
def q_sink_token_stream(spark, sf):
    from quillspark.sources.sinks import sink_token_stream
    p = sink_token_stream(_streams(spark, sf), scratch_path(spark, "token-stream"))
    ch = spark.read.parquet(p)  # partition columns come back from the directories
    return ch.select("dataset", "split", "chunk_id",
                     F.size("tokens").cast("bigint").alias("n_tokens"),
                     ids_fingerprint("tokens").alias("tokens_md5"))


@register("scan_token_stream", f"""{_CSTREAM}
SELECT dataset, split, CAST(len(s) AS BIGINT) AS total_tokens,
       CAST((len(s) + {STREAM_CHUNK} - 1) // {STREAM_CHUNK} AS BIGINT) AS n_chunks FROM streams""")
def q_scan_token_stream(spark, sf):
    """Written as flat files of two-byte ids and read back by byte ranges."""
    from quillspark.sources import token_files as TF
    p = TF.write_token_files(_streams(spark, sf), scratch_path(spark, "token-files"), chunk_size=STREAM_CHUNK)
    d = TF.read_token_files(spark, p, STREAM_CHUNK).select(TF.stream_key("dataset").alias("dataset"), TF.stream_key("split").alias("split"), "chunk_id", "tokens")
    return d.groupBy("dataset", "split").agg(F.sum(F.size("tokens")).cast("bigint").alias("total_tokens"),
                                             F.countDistinct("chunk_id").cast("bigint").alias("n_chunks"))


@register("valid_starts", f"""{_CSTREAM}
SELECT dataset, split, valid, CAST(hi - valid AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM franges""")
def q_valid_starts(spark, sf):
    _, lengths = _train_lengths(spark, sf)
    return K.valid_starts(lengths, ["dataset", "split"], BLOCK).select(
        "dataset", "split", F.col("valid").cast("bigint").alias("valid"),
        F.col("lo").cast("bigint").alias("lo"), F.col("hi").cast("bigint").alias("hi"))


_EPOCH_TOKENS_PER_STEP = PLAN["world"] * PLAN["micro"] * PLAN["batch"] * BLOCK


@register("step_plan", f"""{_CSTREAM},
nsteps AS (SELECT CAST(greatest(1, ceil(sum(len(s)) / {_EPOCH_TOKENS_PER_STEP})) AS BIGINT) AS n FROM streams WHERE split = 'train'),
eplan AS (SELECT CAST(id // {PLAN['batch'] * PLAN['micro']} // nsteps.n AS INTEGER) AS rank,
                 CAST((id // {PLAN['batch'] * PLAN['micro']}) % nsteps.n AS BIGINT) AS step,
                 CAST((id // {PLAN['batch']}) % {PLAN['micro']} AS INTEGER) AS micro,
                 CAST(id % {PLAN['batch']} AS INTEGER) AS slot
          FROM nsteps, range(nsteps.n * {PLAN['world'] * PLAN['micro'] * PLAN['batch']}) r(id))
SELECT rank, step, micro, slot, {sql_hash64("'42'", 'rank', 'step', 'micro', 'slot')} AS draw FROM eplan""")
def q_step_plan(spark, sf):
    """F7 for one epoch of the train streams: steps = ceil(train tokens /
    tokens per step); every (rank, step, micro, slot) draw is a pure function
    of its coordinates."""
    from quillspark.functions.text import hash64
    ch, lengths = _train_lengths(spark, sf)
    total = lengths.agg(F.sum("total_tokens")).first()[0] or 0  # one scalar
    steps = max(1, -(-int(total) // _EPOCH_TOKENS_PER_STEP))
    p = S.step_plan(spark, PLAN["world"], steps, PLAN["micro"], PLAN["batch"])
    return p.withColumn("draw", hash64(F.lit(S.TRAIN_SEED), "rank", "step", "micro", "slot"))


def _windows(spark, sf):
    ch, lengths = _train_lengths(spark, sf)
    return S.sample_windows(S.step_plan(spark, **PLAN), ch, lengths, ["dataset", "split"],
                            BLOCK, chunk_size=STREAM_CHUNK, plan_rows=_PLAN_ROWS)


@register("join_offset_file", f"{_CSTREAM}\nSELECT wid, dataset, split, start FROM wins")
def q_join_offset_file(spark, sf):
    _, lengths = _train_lengths(spark, sf)
    return S.locate_windows(S.step_plan(spark, **PLAN), lengths, ["dataset", "split"], BLOCK).select("wid", "dataset", "split", "start")


@register("sample_windows", f"""{_CSTREAM}
SELECT wid, dataset, start, {fingerprint('x')} AS x_md5, {fingerprint('y')} AS y_md5 FROM wx""")
def q_sample_windows(spark, sf):
    return _windows(spark, sf).select("wid", "dataset", "start", ids_fingerprint("x").alias("x_md5"),
                                      ids_fingerprint("y").alias("y_md5"))


@register("join_window_chunk", f"""{_CSTREAM}
SELECT wid, {fingerprint(f'list_concat(x, [y[{BLOCK}]])')} AS slice_md5, CAST(len(x) + 1 AS BIGINT) AS n FROM wx""")
def q_join_window_chunk(spark, sf):
    w = _windows(spark, sf)
    s = F.concat("x", F.array(F.element_at("y", BLOCK)))
    return w.select("wid", ids_fingerprint(s).alias("slice_md5"), F.size(s).cast("bigint").alias("n"))


@register("shift_by_one", f"""{_CSTREAM}
SELECT wid, x[2:] = y[1:{BLOCK - 1}] AS shift_ok FROM wx""")
def q_shift_by_one(spark, sf):
    w = _windows(spark, sf)
    return w.select("wid", (F.slice("x", 2, BLOCK - 1) == F.slice("y", 1, BLOCK - 1)).alias("shift_ok"))


def _segment_places(spark, sf):
    lengths = K.stream_lengths(_streams(spark, sf), ["dataset", "split"])
    return S.sample_segments(lengths, ["dataset", "split"], N_SEGMENTS, SEG_LEN)


def _segments(spark, sf):
    ch, seg = _streams(spark, sf), _segment_places(spark, sf)
    seg = seg.withColumn("wid", F.concat_ws(":", "dataset", "split", "sample"))
    n_seg = seg.count()  # samples x streams: one small aggregate pass
    got = K.fetch_windows(seg, ch, ["dataset", "split"], "start", SEG_LEN, STREAM_CHUNK,
                          windows_bound=n_seg)
    return join_null_safe(seg, got.drop("start"), ["dataset", "split", "wid"])


_SEG = f"""{_CSTREAM},
seg AS (SELECT dataset, split, CAST(sample AS INTEGER) AS sample,
               {sql_hash64("'42'", 'dataset', 'split', 'sample')} % (len(s) - {SEG_LEN} + 1) AS start, s
        FROM streams, range(1, {N_SEGMENTS + 1}) r(sample) WHERE len(s) >= {SEG_LEN}),
segt AS (SELECT dataset, split, sample, start, s[start + 1 : start + {SEG_LEN}] AS tokens FROM seg)"""


@register("sample_segments", f"""{_SEG}
SELECT dataset, split, sample, start, {fingerprint('tokens')} AS tokens_md5 FROM segt""")
def q_sample_segments(spark, sf):
    return _segments(spark, sf).select("dataset", "split", "sample", "start",
                                       ids_fingerprint("tokens").alias("tokens_md5"))


@register("samples_per_dataset", f"""{_SEG}
SELECT dataset, split, CAST(count(*) AS BIGINT) AS samples FROM segt GROUP BY dataset, split""")
def q_samples_per_dataset(spark, sf):
    return T.samples_per_dataset(_segment_places(spark, sf))


_INV = """imap AS (SELECT map_from_entries(list(struct_pack(k := id, v := piece))) AS im FROM vocab)"""


@register("segment_quality", f"""{_SEG}, {_INV},
dec AS (SELECT dataset, split, tokens,
               array_to_string(list_transform(tokens, lambda i: CASE i WHEN 0 THEN '<unk>' WHEN 1 THEN '<s>'
                   WHEN 2 THEN '</s>' ELSE coalesce(imap.im[i], '') END), '') AS text
        FROM segt, imap),
m AS (SELECT dataset, split,
             len(list_filter(tokens, lambda t: t = 2)) AS eos, len(list_filter(tokens, lambda t: t = 0)) AS unk,
             len(list_filter(tokens, lambda t: t >= 32000)) AS oov,
             length(text) - length(replace(text, chr(65533), '')) AS rc,
             length(text) / len(tokens) AS cpt FROM dec)
SELECT dataset, split, CAST(count(*) AS BIGINT) AS samples, round(avg(cpt), 6) AS mean_chars_per_token,
       round(avg(eos), 6) AS mean_eos, CAST(sum(unk) AS BIGINT) AS unk_total, CAST(sum(oov) AS BIGINT) AS oov_total,
       CAST(sum(rc) AS BIGINT) AS replacement_total
FROM m GROUP BY dataset, split""")
def q_segment_quality(spark, sf):
    enc = _encoder(spark, sf)
    seg = enc.decode(_segments(spark, sf), "tokens", "text", skip_special=False)
    q = T.segment_quality(T.segment_metrics(seg, enc.vocab_size))
    return q.select("dataset", "split", "samples",
                    F.round("mean_chars_per_token", 6).alias("mean_chars_per_token"),
                    F.round("mean_eos", 6).alias("mean_eos"), "unk_total", "oov_total",
                    "replacement_total")


@register("verify_stream", f"""{_CSTREAM}
SELECT dataset, split, len(s) > 0 AND coalesce(list_bool_and(list_transform(s, lambda t: t < 33000)), true) AS ok
FROM streams""")
def q_verify_stream(spark, sf):
    return K.verify_stream(_streams(spark, sf), ["dataset", "split"], 32_000,
                           chunk_size=STREAM_CHUNK)


# ================================================================ 2.10 evaluation
from quillspark.operators import evalops as V  # noqa: E402
from quillspark.operators.ngram import token_pairs  # noqa: E402
from quillspark.plans import eval_plan as EP  # noqa: E402
from quillspark.plans.sqleval import EVAL_CTE  # noqa: E402

_SCORERS: dict = {}


def _scorer(spark, sf):
    key = (spark.sparkContext.applicationId, sf)
    if key not in _SCORERS:
        _SCORERS[key] = EP.bigram_model(_docs(spark, sf), _encoder(spark, sf))
    return _SCORERS[key]


def _items(spark, sf):
    return V.benchmark_items(table(spark, sf, "benchmark"))


def _mc_items(spark, sf):
    return V.suite_items(_items(spark, sf), V.MC_TASKS)


def _mc_scores(spark, sf):
    return V.choice_scores(_mc_items(spark, sf), _encoder(spark, sf), _scorer(spark, sf))


def _r6(c):
    return F.round(c, 6).alias(c)


@register("fit_ngram", f"{EVAL_CTE}\nSELECT prev, token, CAST(cnt AS BIGINT) AS count FROM bigrams")
def q_fit_ngram(spark, sf):
    return _scorer(spark, sf).bigrams


@register("build_candidates", f"""{EVAL_CTE}
SELECT task, item_id, choice_idx, full_text, gold FROM cfull""")
def q_build_candidates(spark, sf):
    return V.build_candidates(_mc_items(spark, sf)).select("task", "item_id", "choice_idx", "full_text", "gold")


@register("token_logprobs", f"""{EVAL_CTE}
SELECT task, item_id, choice_idx, pos, prev, token, round(logprob, 6) AS logprob, is_top FROM lp""")
def q_token_logprobs(spark, sf):
    e = V.truncate_for_scoring(V.encode_candidates(_mc_items(spark, sf), _encoder(spark, sf)))
    lp = _scorer(spark, sf).token_logprobs(token_pairs(e, "ids", ["task", "item_id", "choice_idx"]))
    return lp.select("task", "item_id", "choice_idx", "pos", "prev", "token", _r6("logprob"), "is_top")


@register("join_token_logprob", f"""{EVAL_CTE}
SELECT prev, token, CAST(coalesce(b.cnt, 0) AS BIGINT) AS count
FROM (SELECT DISTINCT prev, token FROM cpairs) LEFT JOIN bigrams b USING (prev, token)""")
def q_join_token_logprob(spark, sf):
    # The (prev, token) lookup of the model table for every needed pair.
    e = V.truncate_for_scoring(V.encode_candidates(_mc_items(spark, sf), _encoder(spark, sf)))
    need = token_pairs(e, "ids").select("prev", "token").distinct()
    b = _scorer(spark, sf).bigrams
    return need.join(b, ["prev", "token"], "left").select(
        "prev", "token", F.coalesce("count", F.lit(0)).cast("bigint").alias("count"))


@register("score_normalized", f"""{EVAL_CTE}
SELECT task, item_id, choice_idx, n_tokens, ctx_len, n_choice_tokens, round(score, 6) AS score FROM sc""")
def q_score_normalized(spark, sf):
    s = _mc_scores(spark, sf)
    return s.select("task", "item_id", "choice_idx", "n_tokens", "ctx_len", "n_choice_tokens",
                    _r6("score"))


@register("score_sum", f"""{EVAL_CTE}
SELECT task, item_id, choice_idx, round(score_sum, 6) AS score_sum FROM sc""")
def q_score_sum(spark, sf):
    return _mc_scores(spark, sf).select("task", "item_id", "choice_idx", _r6("score_sum"))


@register("is_greedy", f"""{EVAL_CTE}
SELECT task, item_id, choice_idx, is_greedy FROM sc""")
def q_is_greedy(spark, sf):
    return _mc_scores(spark, sf).select("task", "item_id", "choice_idx", "is_greedy")


@register("argmax_first", f"""{EVAL_CTE}
SELECT task, item_id, pred FROM preds""")
def q_argmax_first(spark, sf):
    return _suite_results(spark, sf).select("task", "item_id", "pred")


def _suite_results(spark, sf):
    items = _items(spark, sf)
    return EP.mc_results(items, ["hellaswag", "arc_easy", "arc_challenge", "piqa", "mmlu",
                                 "winogrande"], _encoder(spark, sf), _scorer(spark, sf))


@register("join_pred_gold", f"""{EVAL_CTE}
SELECT task, item_id, pred, gold, pred = gold AS is_correct FROM preds""")
def q_join_pred_gold(spark, sf):
    return _suite_results(spark, sf).select("task", "item_id", "pred", "gold", "is_correct")


@register("fill_blank", f"""{EVAL_CTE}
SELECT item_id, choice_idx, n_tokens, round(logprob_sum, 6) AS logprob_sum, round(score, 6) AS score FROM wsc""")
def q_fill_blank(spark, sf):
    c = V.build_candidates(V.suite_items(_items(spark, sf), ["winogrande"]), V.filled_blanks)
    s = V.fill_blank_scores(c, _encoder(spark, sf), _scorer(spark, sf))
    return s.select("item_id", "choice_idx", "n_tokens", _r6("logprob_sum"), _r6("score"))


@register("score_rolling", f"""{EVAL_CTE},
rt AS (SELECT item_id, list_concat([1], {encode('text')}) AS ids0 FROM benchmark, vmap),
rt2 AS (SELECT item_id, ids0 AS ids FROM rt),
rp AS (SELECT item_id, ids[i] AS prev, ids[i + 1] AS token FROM (SELECT item_id, ids, unnest(range(1, len(ids))) AS i FROM rt2)),
rl AS (SELECT r.item_id, ln((coalesce(b.cnt, 0) + 1.0) / (coalesce(x.ctx_count, 0) + 32000.0)) AS logprob
       FROM rp r LEFT JOIN bigrams b USING (prev, token) LEFT JOIN ctxs x USING (prev))
SELECT r.item_id, CAST(len(r.ids) AS BIGINT) AS n_tokens, round(coalesce(sum(l.logprob), 0), 6) AS logprob_sum
FROM rt2 r LEFT JOIN rl l USING (item_id) GROUP BY r.item_id, r.ids""")
def q_score_rolling(spark, sf):
    b = table(spark, sf, "benchmark").withColumnRenamed("text", "full_text")
    r = V.rolling_scores(b, _encoder(spark, sf), _scorer(spark, sf), ["item_id"])
    return r.select("item_id", "n_tokens", _r6("logprob_sum"))


_PPL = f"""{EVAL_CTE},
pt AS (SELECT item_id, list_concat([1], {encode('text')}) AS ids FROM benchmark, vmap),
pp AS (SELECT ids[i] AS prev, ids[i + 1] AS token FROM (SELECT ids, unnest(range(1, len(ids))) AS i FROM pt)),
pl AS (SELECT ln((coalesce(b.cnt, 0) + 1.0) / (coalesce(x.ctx_count, 0) + 32000.0)) AS logprob
       FROM pp LEFT JOIN bigrams b USING (prev, token) LEFT JOIN ctxs x USING (prev))"""


def _ppl(spark, sf):
    b = table(spark, sf, "benchmark")
    e = _encoder(spark, sf).encode(b, "text", "ids", add_bos=True)
    return V.perplexity(_scorer(spark, sf).token_logprobs(token_pairs(e, "ids")))


@register("corpus_perplexity", f"""{_PPL}
SELECT round(CASE WHEN count(*) > 0 THEN exp(-sum(logprob) / count(*)) ELSE 'inf'::DOUBLE END, 6) AS perplexity,
       CAST(count(*) AS BIGINT) AS tokens FROM pl""")
def q_corpus_perplexity(spark, sf):
    return _ppl(spark, sf).select(_r6("perplexity"), "tokens")


@register("perplexity", f"""{_PPL}
SELECT round(CASE WHEN count(*) > 0 THEN exp(-sum(logprob) / count(*)) ELSE 'inf'::DOUBLE END, 6) AS perplexity FROM pl""")
def q_perplexity(spark, sf):
    return _ppl(spark, sf).select(_r6("perplexity"))


@register("normalize_label", f"""{EVAL_CTE}
SELECT item_id, CASE WHEN item_id % 2 = 0 THEN chr(CAST(65 + gold AS INTEGER)) ELSE CAST(gold + 1 AS VARCHAR) END AS answer_key,
       gold FROM (SELECT DISTINCT item_id, gold FROM c4)""")
def q_normalize_label(spark, sf):
    ch = _items(spark, sf).select("item_id", (F.col("item_id") % 4).cast("int").alias("gold"))
    key = F.when(F.col("item_id") % 2 == 0, F.expr("char(65 + gold)")) \
        .otherwise((F.col("gold") + 1).cast("string"))
    d = ch.withColumn("answer_key", key)
    return d.select("item_id", "answer_key", V.normalize_label("answer_key").alias("gold"))


@register("extract_gold_number", f"""{EVAL_CTE}
SELECT item_id, gold_number FROM gsm2""")
def q_extract_gold_number(spark, sf):
    return V.extract_gold_number(EP.gsm8k_rows(_items(spark, sf))).select("item_id", "gold_number")


@register("extract_pred_number", f"""{EVAL_CTE}
SELECT item_id, pred_number, pred_number = gold_number AND pred_number <> '' AS is_correct FROM gsm2""")
def q_extract_pred_number(spark, sf):
    g = V.extract_pred_number(V.extract_gold_number(EP.gsm8k_rows(_items(spark, sf))))
    return g.select("item_id", "pred_number", "is_correct")


@register("accuracy", f"""{EVAL_CTE}
SELECT task, correct, total, round(accuracy, 6) AS accuracy FROM acc""")
def q_accuracy(spark, sf):
    a = EP.suite_accuracy(table(spark, sf, "benchmark"), "full", _encoder(spark, sf),
                          _scorer(spark, sf))
    return a.select("task", "correct", "total", _r6("accuracy"))


@register("predict_and_score", f"""{EVAL_CTE}
SELECT task, correct, total, round(accuracy, 6) AS accuracy FROM acc""")
def q_predict_and_score(spark, sf):
    return q_accuracy(spark, sf)


@register("macro_average", f"""{EVAL_CTE}
SELECT round(avg(accuracy), 6) AS average_accuracy, CAST(count(accuracy) AS BIGINT) AS tasks FROM acc""")
def q_macro_average(spark, sf):
    a = EP.suite_accuracy(table(spark, sf, "benchmark"), "full", _encoder(spark, sf),
                          _scorer(spark, sf))
    return V.macro_average(a).select(_r6("average_accuracy"), "tasks")


@register("example_number", f"""{EVAL_CTE}
SELECT task, item_id, CAST(row_number() OVER (PARTITION BY task ORDER BY item_id) AS BIGINT) AS example_id
FROM (SELECT DISTINCT task, item_id FROM preds)""")
def q_example_number(spark, sf):
    r = _suite_results(spark, sf).select("task", "item_id")
    return V.example_number(r).select("task", "item_id", "example_id")


@register("collect_completions", """
SELECT 'humaneval' AS task, item_id, text AS completion, CAST(NULL AS DOUBLE) AS accuracy FROM benchmark""")
def q_collect_completions(spark, sf):
    b = table(spark, sf, "benchmark").select(F.lit("humaneval").alias("task"), "item_id",
                                             F.col("text").alias("completion"))
    return V.collect_completions(b)


@register("stop_truncate", """
SELECT conv_id, turn, split_part(split_part(text, chr(10), 1), '. ', 1) AS completion
FROM conversations WHERE role = 'assistant'""")
def q_stop_truncate(spark, sf):
    c = table(spark, sf, "conversations").filter(F.col("role") == "assistant")
    return c.select("conv_id", "turn", V.stop_truncate(F.col("text"), ["\n", ". "]).alias("completion"))


@register("strip_prompt", f"""{EVAL_CTE},
st AS (SELECT b.item_id, b.text, i.context FROM benchmark b JOIN items i USING (item_id))
SELECT item_id, left(replace(CASE WHEN starts_with(text, context) THEN text[length(context) + 1:] ELSE text END,
                             chr(10), '\\n'), 160) AS preview
FROM st""")
def q_strip_prompt(spark, sf):
    b = table(spark, sf, "benchmark").join(_items(spark, sf).select("item_id", "context"), "item_id")
    comp = V.strip_prompt(F.col("text"), F.col("context"))
    return b.select("item_id", V.flat_preview(comp).alias("preview"))


# ================================================================ streaming
from quillspark.session import scratch_path  # noqa: E402
from quillspark.streaming import stateful as SS  # noqa: E402

STREAM_FILES = 4


def _stream_src(spark, sf):
    """The corpus replayed as 4 ordered files (derived from ``documents``)."""
    root = scratch_path(spark, "stream-docs")
    c = _corpus(spark, sf).select("dataset", "pos", "est", F.length("text").cast("bigint")
                                  .alias("n_chars"))
    SS.write_ordered_files(c, root, "pos", STREAM_FILES)
    return SS.read_ordered_files(spark, root, c.schema)


def _budget_stream(spark, sf, budget, val_every):
    return SS.run_steps(spark, _stream_src(spark, sf), SS.budget_step(budget, val_every), SS.BUDGET_OUT, SS.BUDGET_STATE,
                        scratch_path(spark, "stream-budget"))


@register("stream_budget", SQL["token_budget"])
def q_stream_budget(spark, sf):
    return _budget_stream(spark, sf, BUDGET_PER_SOURCE, 100).select(
        "dataset", "pos", "est", "cum_tokens")


@register("stream_val_split", SQL["val_every_n"])
def q_stream_val_split(spark, sf):
    return _budget_stream(spark, sf, None, 10).select("dataset", "pos", "doc_index", "is_val")


@register("stream_token_stats", f"""
SELECT dataset, CAST(count(*) AS BIGINT) AS docs, CAST(sum(est) AS BIGINT) AS tokens,
       CAST(sum(length(text)) AS BIGINT) AS total_chars FROM ({_NONEMPTY}) GROUP BY dataset""")
def q_stream_token_stats(spark, sf):
    out = SS.stream_token_stats(_stream_src(spark, sf))
    return SS.run_to_table(spark, out, scratch_path(spark, "stream-stats"),
                           scratch_path(spark, "stream-ckpt"), mode="complete")


_RUNS = """runs AS (SELECT event_type AS run, event_id, value AS loss,
       CAST(row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS BIGINT) AS step,
       ts FROM events)"""


TOKENS_PER_STEP = 8 * 16 * 2048 * 4
_BEST = f"""WITH {_RUNS}
SELECT run, event_id, step, loss,
       min(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_best,
       coalesce(loss < min(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved"""


@register("stream_run_metrics", f"""{_BEST},
       round({TOKENS_PER_STEP} / ((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY run ORDER BY step))) / 1e6), 6) AS tokens_per_sec,
       CAST(step * {TOKENS_PER_STEP} AS BIGINT) AS tokens_seen
FROM runs""")
def q_stream_run_metrics(spark, sf):
    ev = table(spark, sf, "events")
    root = scratch_path(spark, "stream-events")
    SS.write_ordered_files(ev, root, "event_id", STREAM_FILES)
    d = SS.run_steps(spark, SS.run_events(SS.read_ordered_files(spark, root, ev.schema)), SS.run_step(TOKENS_PER_STEP), SS.RUN_OUT, SS.RUN_STATE,
                     scratch_path(spark, "stream-runs"))
    return d.withColumn("tokens_per_sec", F.round("tokens_per_sec", 6))


# ================================================================ run metrics
@register("best_so_far", f"{_BEST} FROM runs")
def q_best_so_far(spark, sf):
    m = T.run_metrics(table(spark, sf, "events"))
    return T.best_so_far(m).select("run", "event_id", "step", "loss", "prev_best", "improved")


@register("every_n_steps", f"""WITH {_RUNS}
SELECT run, step, loss FROM runs WHERE step % 100 = 0""")
def q_every_n_steps(spark, sf):
    return T.every_n_steps(T.run_metrics(table(spark, sf, "events")), 100).select(
        "run", "step", "loss")


@register("interval_means", f"""WITH {_RUNS}
SELECT run, CAST((step - 1) // 100 AS BIGINT) AS interval, round(avg(loss), 6) AS mean_loss,
       CAST(count(*) AS BIGINT) AS rows FROM runs GROUP BY ALL""")
def q_interval_means(spark, sf):
    d = T.interval_means(T.run_metrics(table(spark, sf, "events")), 100)
    return d.select("run", "interval", _r6("mean_loss"), "rows")




@register("throughput", f"""WITH {_RUNS}
SELECT run, step, round({TOKENS_PER_STEP} / ((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY run ORDER BY step))) / 1e6), 6)
       AS tokens_per_sec, CAST(step * {TOKENS_PER_STEP} AS BIGINT) AS tokens_seen FROM runs""")
def q_throughput(spark, sf):
    d = T.throughput(T.run_metrics(table(spark, sf, "events")), TOKENS_PER_STEP)
    return d.select("run", "step", _r6("tokens_per_sec"), "tokens_seen")


@register("val_loss_ppl", f"""WITH {_RUNS},
b AS (SELECT run, (step - 1) // 20 AS batch, avg(loss) AS batch_loss FROM runs GROUP BY ALL),
v AS (SELECT run, avg(batch_loss) AS val_loss FROM b GROUP BY run)
SELECT run, round(val_loss, 6) AS val_loss,
       round(CASE WHEN val_loss < 10 THEN exp(val_loss) ELSE 'inf'::DOUBLE END, 6) AS val_ppl FROM v""")
def q_val_loss_ppl(spark, sf):
    m = T.run_metrics(table(spark, sf, "events"))
    b = m.groupBy("run", F.floor((F.col("step") - 1) / 20).alias("batch")).agg(
        F.avg("loss").alias("loss"))
    v = T.val_loss_ppl(b, ["run"])
    return v.select("run", _r6("val_loss"), _r6("val_ppl"))


# ================================================================ sources & sinks
from quillspark.sources import scans as A  # noqa: E402
from quillspark.sources import sinks as Z  # noqa: E402

_DOC_KEYS_SQL = "SELECT source AS dataset, doc_id AS pos, CAST(length(text) AS BIGINT) AS n_chars FROM documents"


def _as_jsonl_rows(spark, sf):
    d = _docs(spark, sf)
    return d.select(F.col("source").alias("dataset"), F.col("doc_id").alias("pos"), "text",
                    F.lit(None).cast("string").alias("content"), "lang")


def _doc_keys(d):
    return d.select("dataset", "pos", F.length("text").cast("bigint").alias("n_chars"))


@register("scan_jsonl", _DOC_KEYS_SQL)
def q_scan_jsonl(spark, sf):
    p = Z.sink_jsonl(_as_jsonl_rows(spark, sf), scratch_path(spark, "jsonl"))
    return _doc_keys(A.scan_jsonl(spark, p))


@register("scan_table", _DOC_KEYS_SQL)
def q_scan_table(spark, sf):
    d = A.scan_table(spark, sf, "documents")
    return d.select(F.col("source").alias("dataset"), F.col("doc_id").alias("pos"),
                    F.length("text").cast("bigint").alias("n_chars"))


@register("scan_compressed_glob", _DOC_KEYS_SQL)
def q_scan_compressed_glob(spark, sf):
    # one half in each codec
    root, rows = scratch_path(spark, "compressed"), _as_jsonl_rows(spark, sf)
    even = F.coalesce(F.col("pos") % 2 == 0, F.lit(True))
    Z.sink_jsonl(rows.filter(even), root + "/gz", compression="gzip")
    Z.sink_jsonl(rows.filter(~even), root + "/zst", compression="zst")
    return _doc_keys(A.scan_compressed_glob(spark, root + "/gz/*.json.gz").unionByName(A.scan_compressed_glob(spark, root + "/zst/*.jsonl.zst")))


@register("scan_with_stem", _DOC_KEYS_SQL)
def q_scan_with_stem(spark, sf):
    # one write, a directory per dataset named by its stem
    root = scratch_path(spark, "stems")
    rows = _as_jsonl_rows(spark, sf).withColumn("file", F.concat("dataset", F.lit(".jsonl"))).drop("dataset")
    rows.write.partitionBy("file").json(root)
    return _doc_keys(A.scan_with_stem(spark, root, schema="pos bigint, text string, content string, lang string"))


@register("scan_partitioned", """
SELECT source AS dataset, doc_id AS pos, CAST(length(text) AS BIGINT) AS n_chars FROM documents
WHERE lang IN ('en', 'de')""")
def q_scan_partitioned(spark, sf):
    root = scratch_path(spark, "bylang")
    _as_jsonl_rows(spark, sf).write.partitionBy("lang").json(root)
    d = A.scan_partitioned(spark, root, "dataset string, pos bigint, text string, lang string",
                           lang=["en", "de"])
    return _doc_keys(d)


@register("scan_lines", f"""
SELECT {Q.s('text')} AS line FROM (SELECT unnest(string_split(text, chr(10))) AS text FROM benchmark)
WHERE length({Q.s('text')}) > 0""")
def q_scan_lines(spark, sf):
    root = scratch_path(spark, "lines")
    table(spark, sf, "benchmark").select("text").write.text(root)
    return A.scan_lines(spark, root)


@register("sink_jsonl", "SELECT source AS dataset, doc_id AS pos FROM documents")
def q_sink_jsonl(spark, sf):
    p = Z.sink_jsonl(_as_jsonl_rows(spark, sf), scratch_path(spark, "out-jsonl"))
    return spark.read.schema(A.CORPUS_SCHEMA).json(p).select("dataset", "pos")


@register("sink_atomic", """
SELECT source AS dataset, CAST(count(*) AS BIGINT) AS docs, true AS complete FROM documents GROUP BY source""")
def q_sink_atomic(spark, sf):
    p = Z.sink_jsonl(_as_jsonl_rows(spark, sf), scratch_path(spark, "atomic"))
    ok = Z.is_complete(spark, p)
    return spark.read.schema(A.CORPUS_SCHEMA).json(p).groupBy("dataset").agg(
        F.count(F.lit(1)).cast("bigint").alias("docs")).withColumn("complete", F.lit(ok))


_CONFIG = {f"src{i}": {"name": f"corpus/src{i}", "target_tokens": (i + 1) * 1000,
                       "source": "parquet"} for i in range(0, 20, 2)}
_CONFIG["src99"] = {"name": "corpus/missing", "target_tokens": 500, "source": "parquet"}
_CONFIG_SQL = "(VALUES " + ", ".join(f"('{k}', {v['target_tokens']})" for k, v in _CONFIG.items()) \
    + ") cfg(dataset, target_tokens)"


@register("config_sources", f"""
SELECT cfg.dataset, CASE WHEN d.dataset IS NULL THEN 'unknown' ELSE 'ok' END AS status
FROM {_CONFIG_SQL} LEFT JOIN (SELECT DISTINCT source AS dataset FROM documents) d USING (dataset)""")
def q_config_sources(spark, sf):
    path = Z.sink_manifest(spark, {"datasets": _CONFIG}, scratch_path(spark, "config"))
    cfg = A.config_sources(spark, A.config_from_file(spark, path))
    avail = C.corpus_from_documents(_docs(spark, sf))
    return A.check_sources(cfg.select("dataset"), avail)


_ALL_COUNTS = f"""SELECT dataset, CAST(count(*) AS BIGINT) AS docs, CAST(sum(est) AS BIGINT) AS tokens
FROM ({_NONEMPTY}) GROUP BY dataset"""


@register("join_config", f"""
WITH k AS ({_ALL_COUNTS})
SELECT k.dataset, k.docs, k.tokens, CAST(cfg.target_tokens AS BIGINT) AS target_tokens
FROM k JOIN {_CONFIG_SQL} USING (dataset)""")
def q_join_config(spark, sf):
    from quillspark.operators.joins import join_config
    cfg = A.config_sources(spark, _CONFIG).select("dataset", "target_tokens")
    counts = C.collect_counts(_corpus(spark, sf))
    return join_config(counts, cfg)


@register("mixture_report", f"""
WITH k AS ({_ALL_COUNTS}),
c AS (SELECT * FROM {_CONFIG_SQL})
SELECT c.dataset, CAST(c.target_tokens AS BIGINT) AS target_tokens,
       round(100.0 * c.target_tokens / sum(c.target_tokens) OVER (), 6) AS target_share_pct,
       CAST(coalesce(k.tokens, 0) AS BIGINT) AS available_tokens,
       round(CAST(c.target_tokens AS DOUBLE) / k.tokens, 6) AS repeat_factor
FROM c LEFT JOIN k USING (dataset)""")
def q_mixture_report(spark, sf):
    cfg = A.config_sources(spark, _CONFIG).select("dataset", "target_tokens")
    counts = C.collect_counts(_corpus(spark, sf))
    return C.mixture_report(counts, cfg)


@register("sink_skip_existing", f"""
SELECT dataset FROM {_CONFIG_SQL}
WHERE dataset NOT IN (SELECT source FROM documents WHERE length(text) > 0 GROUP BY source HAVING count(*) % 2 = 0
                      AND max(doc_id) % 4 < 2)""")
def q_sink_skip_existing(spark, sf):
    # A first run has finished some datasets (by their counts) and left that as a durable stage; the next
    # one finds it by its inputs and parameters and only gets the configured datasets not in it.
    from quillspark.sources.stages import DurableStages
    root, made_of, rule = scratch_path(spark, "durable"), [f"{sf.rstrip('/')}/documents.parquet"], {"finished": "docs % 2 = 0 and last % 4 < 2"}

    def build():
        return _corpus(spark, sf).groupBy("dataset").agg(F.count(F.lit(1)).alias("docs"), F.max("pos").alias("last")).filter(rule["finished"])
    DurableStages(root).get(spark, "finished", build, made_of, rule)
    found = DurableStages(root).path(spark, "finished", made_of, rule)
    req = A.config_sources(spark, _CONFIG).select("dataset")
    return Z.pending_work(req, found, spark)


@register("anti_done", f"""
SELECT source AS dataset, doc_id AS pos FROM documents
WHERE length(text) > 0 AND source NOT IN (SELECT dataset FROM {_CONFIG_SQL})""")
def q_anti_done(spark, sf):
    # Rows of the datasets that the configuration has not listed as done
    from quillspark.operators.joins import anti_done
    done = A.config_sources(spark, _CONFIG).select("dataset")
    return anti_done(_corpus(spark, sf).select("dataset", "pos"), done)


@register("select_datasets", """
WITH d AS (SELECT source AS dataset, CAST(count(*) AS BIGINT) AS docs FROM documents GROUP BY source),
r AS (SELECT 'all' AS choice, dataset FROM d
      UNION ALL SELECT 'src1,src3', unnest(['src1', 'src3'])
      UNION ALL SELECT 'src2 nowhere', unnest(['src2', 'nowhere']))
SELECT choice, r.dataset, CASE WHEN d.dataset IS NULL THEN 'unknown' ELSE 'ok' END AS status, docs
FROM r LEFT JOIN d USING (dataset)""")
def q_select_datasets(spark, sf):
    # All, a comma list and a list with an unknown name
    have = C.corpus_from_documents(_docs(spark, sf)).groupBy("dataset").agg(F.count(F.lit(1)).cast("bigint").alias("docs"))
    out = None
    for choice in ("all", "src1,src3", "src2 nowhere"):
        names = have.select("dataset") if choice == "all" else \
            spark.createDataFrame([(n,) for n in choice.replace(",", " ").split()], "dataset string")
        part = A.check_sources(names, have).select(F.lit(choice).alias("choice"), "dataset", "status")
        out = part if out is None else out.unionByName(part)
    return out.join(have, "dataset", "left").select("choice", "dataset", "status", "docs")


@register("stringify_nested_ts", """
SELECT event_id, CAST(ts AS VARCHAR) AS meta_timestamp, user_id AS meta_user FROM events""")
def q_stringify_nested_ts(spark, sf):
    ev = table(spark, sf, "events").select(
        "event_id", F.struct(F.col("ts").alias("timestamp"), "user_id").alias("meta"))
    d = C.stringify_nested_ts(ev)
    return d.select("event_id", F.col("meta.timestamp").alias("meta_timestamp"),
                    F.col("meta.user_id").alias("meta_user"))


@register("sink_packed_masked", f"""{_PACK}
SELECT split, CAST(sum(len(tokens)) AS BIGINT) AS tokens, CAST(sum(list_sum(mask)) AS BIGINT) AS trainable_tokens
FROM chunks GROUP BY split""")
def q_sink_packed_masked(spark, sf):
    p = Z.sink_packed_masked(_sft_chunks(spark, sf),
                             scratch_path(spark, "sft-stream"))
    ch = spark.read.parquet(p)
    return K.stream_lengths(ch, ["split"], "tokens", "mask").select(
        "split", F.col("total_tokens").alias("tokens"), "trainable_tokens")


@register("sink_manifest", f"""{_TOK},
st AS (SELECT split, CAST(sum(len(ids)) AS BIGINT) AS tokens, CAST(sum(list_sum(mask)) AS BIGINT) AS trainable_tokens,
              CAST(count(*) AS BIGINT) AS examples FROM spl GROUP BY split)
SELECT split, tokens, trainable_tokens, examples, CAST({H.SFT_SEED} AS BIGINT) AS seed,
       CAST({H.MAX_TOKENS_PER_CONVERSATION} AS BIGINT) AS max_tokens, CAST({len(H.DATASETS)} AS BIGINT) AS datasets FROM st""")
def q_sink_manifest(spark, sf):
    st = H.split_stats(_split(spark, sf))
    rows = {r["split"]: {"tokens": r["tokens"], "trainable_tokens": r["trainable_tokens"],
                         "examples": r["examples"]} for r in st.collect()}  # 2 rows
    man = {"tokenizer": "built-in pieces", "chat_format": "inst_tags",
           "max_tokens_per_conversation": H.MAX_TOKENS_PER_CONVERSATION, "seed": H.SFT_SEED,
           "datasets": H.dataset_counts(None), **rows}
    p = Z.sink_manifest(spark, man, scratch_path(spark, "manifest-json"))
    part = "struct<tokens:bigint,trainable_tokens:bigint,examples:bigint>"
    m = spark.read.text(p).select(F.from_json("value", f"train {part}, val {part}, seed bigint, "
                                              "max_tokens_per_conversation bigint, datasets map<string,bigint>").alias("m"))
    splits = F.explode(F.array(*[F.struct(F.lit(x).alias("split"), F.col(f"m.{x}").alias("s")) for x in ("train", "val")]))
    return m.select("m", splits.alias("x")).filter("x.s is not null").select(
        "x.split", "x.s.tokens", "x.s.trainable_tokens", "x.s.examples", "m.seed",
        F.col("m.max_tokens_per_conversation").alias("max_tokens"), F.size("m.datasets").cast("bigint").alias("datasets"))


@register("sink_samples", f"""{_SEG}, {_INV},
dec AS (SELECT dataset, split, sample, start, tokens,
               array_to_string(list_transform(tokens, lambda i: CASE i WHEN 0 THEN '<unk>' WHEN 1 THEN '<s>'
                   WHEN 2 THEN '</s>' ELSE coalesce(imap.im[i], '') END), '') AS text
        FROM segt, imap)
SELECT dataset, split, sample, start, md5(text) AS text_md5, CAST(len(list_filter(tokens, lambda t: t = 2)) AS BIGINT) AS eos,
       CAST(len(list_filter(tokens, lambda t: t = 0)) AS BIGINT) AS unk, round(length(text) / len(tokens), 6) AS chars_per_token FROM dec""")
def q_sink_samples(spark, sf):
    enc = _encoder(spark, sf)
    seg = enc.decode(_segments(spark, sf), "tokens", "text", skip_special=False)
    m = T.segment_metrics(seg, enc.vocab_size).drop("tokens", "wid")
    p = Z.sink_samples(m, scratch_path(spark, "samples"))
    d = spark.read.schema("sample int, start long, text string, eos long, unk long, oov long, "
                          "replacement_chars long, chars_per_token double, dataset string, "
                          "split string").json(p)
    return d.select("dataset", "split", "sample", "start", F.md5("text").alias("text_md5"), "eos", "unk", _r6("chars_per_token"))


@register("sink_eval", f"""{EVAL_CTE}
SELECT task, correct, total, round(accuracy, 6) AS accuracy, total AS examples
FROM acc WHERE task IN ({", ".join(f"'{t}'" for t in [*V.TASK_SUITES["default"], "gsm8k"])})""")
def q_sink_eval(spark, sf):
    tasks = [*V.TASK_SUITES["default"], "gsm8k"]
    a = EP.suite_accuracy(table(spark, sf, "benchmark"), ",".join(tasks), _encoder(spark, sf), _scorer(spark, sf))
    p = Z.sink_eval(a, scratch_path(spark, "eval"), _details(spark, sf, [t for t in tasks if t in V.MC_TASKS]))
    done = spark.read.schema("task string, item_id bigint").json(p + "/examples/*").groupBy("task").agg(F.count(F.lit(1)).alias("examples"))
    d = spark.read.schema("task string, correct long, total long, accuracy double, timestamp string").json(p + "/summary")
    return d.join(done, "task", "left").select("task", "correct", "total", _r6("accuracy"),
                                               F.coalesce("examples", F.lit(0)).cast("bigint").alias("examples"))


@register("sink_metrics", f"""WITH {_RUNS}
SELECT run, event_id, step, loss FROM runs WHERE step % 100 = 0
UNION ALL SELECT run, event_id, step, loss FROM runs WHERE step % 250 = 0""")
def q_sink_metrics(spark, sf):
    m = T.run_metrics(table(spark, sf, "events"))
    p = scratch_path(spark, "metrics")
    Z.sink_metrics(T.every_n_steps(m, 100), p)
    Z.sink_metrics(T.every_n_steps(m, 250), p)  # a second append
    return spark.read.parquet(p).select("run", "event_id", "step", "loss")


def _details(spark, sf, tasks=V.MC_TASKS):
    """The records of each shape."""
    enc, scorer, base = _encoder(spark, sf), _scorer(spark, sf), _items(spark, sf)
    made = V.suite_items(base, [*tasks, "winogrande"])
    items, blanks = made.filter("task <> 'winogrande'"), made.filter("task = 'winogrande'")
    s = V.choice_scores(items, enc, scorer)
    w = V.fill_blank_scores(V.build_candidates(blanks, V.filled_blanks), enc, scorer)
    return {"choices": V.example_details(s, V.build_candidates(items), V.predict_and_score(s)),
            "blanks": V.winogrande_details(blanks, w, V.predict_and_score(w, one_based=True)),
            "numbers": V.number_details(V.extract_pred_number(V.extract_gold_number(EP.gsm8k_rows(base))))}


_SCALED = "array_to_string(list_transform(scores, lambda x: CAST(CAST(round(x * 1000000) AS BIGINT) AS VARCHAR)), ',')"


@register("example_details", f"""{EVAL_CTE},
g AS (SELECT task, item_id, list(choice ORDER BY choice_idx) AS choices, list(full_text ORDER BY choice_idx) AS inputs,
             list(score ORDER BY choice_idx) AS scores
      FROM cfull JOIN sc USING (task, item_id, choice_idx, gold) GROUP BY task, item_id
      UNION ALL SELECT 'winogrande', item_id, list(full_text ORDER BY choice_idx), list(full_text ORDER BY choice_idx), list(score ORDER BY choice_idx)
      FROM wcands JOIN wsc USING (item_id, choice_idx, gold) GROUP BY item_id),
n AS (SELECT task, item_id, CAST(row_number() OVER (PARTITION BY task ORDER BY item_id) AS BIGINT) AS example_id FROM g),
b AS (SELECT *, CASE WHEN task = 'winogrande' THEN 0 ELSE 1 END AS base FROM g JOIN n USING (task, item_id) JOIN preds USING (task, item_id))
SELECT task, example_id, item_id, CAST(pred AS VARCHAR) AS model_prediction, choices[pred + base] AS model_choice, CAST(gold AS VARCHAR) AS correct_label,
       choices[gold + base] AS correct_choice, pred = gold AS is_correct, md5(array_to_string(choices, chr(10))) AS choices_md5,
       md5(array_to_string(inputs, chr(10))) AS inputs_md5, {_SCALED} AS scores FROM b
UNION ALL
SELECT 'gsm8k', row_number() OVER (ORDER BY item_id), item_id, pred_number, completion, gold_number, NULL, pred_number = gold_number AND pred_number <> '',
       NULL, md5(i.context), NULL FROM gsm2 JOIN items i USING (item_id)""")
def q_example_details(spark, sf):
    """Records of all tasks, score values too; number answers have no choices."""
    own = _details(spark, sf)
    joined = lambda c: F.md5(F.array_join(c, "\n"))
    scaled = F.array_join(F.transform("model_scores", lambda x: F.round(x * 1000000).cast("bigint").cast("string")), ",")
    shapes = [own[k].select("task", "example_id", "item_id", F.col("model_prediction").cast("string").alias("model_prediction"), "model_choice",
                            F.col("correct_label").cast("string").alias("correct_label"), "correct_choice", "is_correct", joined("choices").alias("choices_md5"),
                            joined("model_input_strings").alias("inputs_md5"), scaled.alias("scores")) for k in ("choices", "blanks")]
    none = F.lit(None).cast("string")
    numbers = own["numbers"].select("task", "example_id", "item_id", F.col("model_answer").alias("model_prediction"), F.col("model_generation").alias("model_choice"),
                                    F.col("correct_answer").alias("correct_label"), none.alias("correct_choice"), "is_correct", none.alias("choices_md5"),
                                    F.md5("question").alias("inputs_md5"), none.alias("scores"))
    return shapes[0].unionByName(shapes[1]).unionByName(numbers)


@register("sink_sample_rows", """
SELECT step, prompt, substr(text, length(prompt) + 1) AS completion FROM (
  SELECT (item_id // 5) * 100 AS step, array_to_string(w[1:len(w) // 2], ' ') AS prompt, text
  FROM (SELECT item_id, text, string_split(text, ' ') AS w FROM benchmark))""")
def q_sink_sample_rows(spark, sf):
    """A17's table of (step, prompt, completion), appended in two parts."""
    rows = table(spark, sf, "benchmark").select("text", F.expr("item_id div 5 * 100").alias("step"), F.expr(
        "array_join(slice(split(text, ' '), 1, int(size(split(text, ' ')) div 2)), ' ')").alias("prompt"))
    rows, p = Z.sample_rows(rows, "step"), scratch_path(spark, "samples")
    for part in (rows.filter("step % 200 = 0"), rows.filter("step % 200 <> 0")):
        Z.sink_metrics(part, p)
    return spark.read.parquet(p).select("step", "prompt", "completion")


# ================================================================ remaining scalar / array ops
@register("truncate_right", f"""{_TOK}
SELECT dataset, pos, {fingerprint('ids[1:128]')} AS ids_md5, {fingerprint('mask[1:128]')} AS mask_md5 FROM taken""")
def q_truncate_right(spark, sf):
    d = H.truncate_right(H.truncate_right(_sft_examples(spark, sf), 128, "ids"), 128, "mask")
    return d.select("dataset", "pos", ids_fingerprint("ids").alias("ids_md5"),
                    ids_fingerprint("mask").alias("mask_md5"))


@register("truncate_left", f"""{_TOK}
SELECT dataset, pos, {fingerprint('CASE WHEN len(ids) > 128 THEN ids[-128:] ELSE ids END')} AS ids_md5 FROM taken""")
def q_truncate_left(spark, sf):
    d = H.truncate_left(_sft_examples(spark, sf), 128, "ids")
    return d.select("dataset", "pos", ids_fingerprint("ids").alias("ids_md5"))


@register("mask_targets", f"""{_TOK}
SELECT dataset, pos, {fingerprint("list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN i = len(ids) THEN -1 WHEN mask[i + 1] = 0 THEN -1 ELSE ids[i + 1] END)")} AS y_md5
FROM taken""")
def q_mask_targets(spark, sf):
    d = _sft_examples(spark, sf)
    y = F.concat(F.slice("ids", 2, F.size("ids") - 1), F.array(F.lit(-1)))
    m = F.concat(F.slice("mask", 2, F.size("mask") - 1), F.array(F.lit(0).cast("tinyint")))
    return d.select("dataset", "pos", ids_fingerprint(H.mask_targets(y, m)).alias("y_md5"))


@register("shift_targets", f"""{_PPL}
SELECT item_id, {fingerprint("list_concat(ids[2:], [-1])")} AS y_md5 FROM pt""")
def q_shift_targets(spark, sf):
    b = table(spark, sf, "benchmark")
    e = _encoder(spark, sf).encode(b, "text", "ids", add_bos=True)
    y = F.concat(F.slice("ids", 2, F.size("ids") - 1), F.array(F.lit(-1)))
    return e.select("item_id", ids_fingerprint(y).alias("y_md5"))


@register("zip_tokens_mask", f"""{_PACK}
SELECT split, chunk_id, CAST(list_sum(mask) AS BIGINT) AS trainable, CAST(len(tokens) AS BIGINT) AS n
FROM chunks""")
def q_zip_tokens_mask(spark, sf):
    ch = _sft_chunks(spark, sf)
    z = F.arrays_zip("tokens", "mask")
    return ch.select("split", "chunk_id", F.size(F.filter(z, lambda p: p["mask"] == 1))
                     .cast("bigint").alias("trainable"), F.size(z).cast("bigint").alias("n"))


@register("mean_of_ratios", f"""{_CSTREAM}
SELECT e.dataset, round(avg(length(d.text) / len(e.ids)), 6) AS mean_ratio
FROM enc e JOIN docs d USING (dataset, pos) GROUP BY e.dataset""")
def q_mean_of_ratios(spark, sf):
    e = _encoded(spark, sf)
    return T.mean_of_ratios(e, ["dataset"], "n_chars", "n_tokens").select(
        "dataset", _r6("mean_ratio"))


@register("tokenizer_compare", f"""WITH {vocab_cte()},
t AS (SELECT lang AS text_type, length(text) AS n_chars, len({encode('text')}) AS pieces,
             len(list_filter(string_split_regex(text, '[\\t\\n\\x0B\\f\\r ]+'), lambda w: w <> '')) AS words,
             octet_length(encode(text)) AS bytes
      FROM documents, vmap WHERE length(text) > 0),
u AS (SELECT 'pieces' AS tokenizer, text_type, n_chars, pieces AS n_tokens FROM t
      UNION ALL SELECT 'words', text_type, n_chars, words FROM t
      UNION ALL SELECT 'bytes', text_type, n_chars, bytes FROM t),
per AS (SELECT tokenizer, text_type, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(n_tokens) AS BIGINT) AS tokens,
               sum(n_chars) / sum(n_tokens) AS cpt FROM u GROUP BY ALL)
SELECT tokenizer, text_type, chars, tokens, round(cpt, 6) AS chars_per_token FROM per
UNION ALL
SELECT tokenizer, 'ALL', CAST(sum(chars) AS BIGINT), CAST(sum(tokens) AS BIGINT), round(avg(cpt), 6) FROM per GROUP BY tokenizer""")
def q_tokenizer_compare(spark, sf):
    d = _docs(spark, sf).filter(F.length("text") > 0)
    e = _encoder(spark, sf).encode(d, "text", "ids")
    words = F.size(F.filter(F.split("text", "[\\t\\n\\x0B\\f\\r ]+"), lambda w: w != ""))
    base = e.select(F.col("lang").alias("text_type"), F.length("text").alias("n_chars"),
                    F.size("ids").alias("pieces"), words.alias("words"),
                    F.octet_length("text").alias("bytes"))
    u = None
    for name in ("pieces", "words", "bytes"):
        p = base.select(F.lit(name).alias("tokenizer"), "text_type", "n_chars",
                        F.col(name).alias("n_tokens"))
        u = p if u is None else u.unionByName(p)
    return T.tokenizer_compare(u).select("tokenizer", "text_type", "chars", "tokens",
                                         _r6("chars_per_token"))


@register("steps_for_epochs", f"""{_TOK}
SELECT split, CAST(greatest(1, ceil(3.0 * sum(len(ids)) / (8 * 16 * 4 * 2048))) AS BIGINT) AS steps,
       CAST(floor(sum(len(ids)) / (8 * 16 * 4 * 2048)) AS BIGINT) AS steps_floor
FROM spl GROUP BY split""")
def q_steps_for_epochs(spark, sf):
    st = H.split_stats(_split(spark, sf))
    return st.select("split", T.steps_for_epochs_col("tokens", 3.0, 8, 16, 2048, 4).alias("steps"),
                     T.steps_for_tokens_col("tokens", 8, 16, 2048, 4).alias("steps_floor"))


@register("head_n", """
SELECT task, item_id FROM (SELECT t.task, item_id, row_number() OVER (PARTITION BY t.task ORDER BY item_id) AS rn
  FROM benchmark, (VALUES ('hellaswag'), ('piqa')) t(task)) WHERE rn <= 25""")
def q_head_n(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id")
    d = b.withColumn("task", F.explode(F.array(F.lit("hellaswag"), F.lit("piqa"))))
    return S.head_n(d, 25, ["task"], "item_id").select("task", "item_id")


@register("decode_stream", f"""{_CSTREAM}, {_INV}
SELECT dataset, pos, md5(array_to_string(list_transform(ids, lambda i: CASE WHEN i < 3 THEN ''
       ELSE coalesce(imap.im[i], '') END), '')) AS text_md5 FROM enc, imap""")
def q_decode_stream(spark, sf):
    enc = _encoder(spark, sf)
    e = enc.encode(_corpus(spark, sf), "text", "ids", add_eos=True)
    d = enc.decode(e, "ids", "decoded", skip_special=True)
    return d.select("dataset", "pos", F.md5("decoded").alias("text_md5"))


@register("roundtrip_check", f"""WITH {vocab_cte()},
r AS (SELECT source AS dataset, length(text) AS n_chars, len({encode('text')}) AS n_tokens,
             list_contains({encode('text')}, 0) AS has_unk FROM documents, vmap WHERE length(text) > 0)
SELECT dataset, CAST(sum(CASE WHEN has_unk THEN 0 ELSE 1 END) AS BIGINT) AS roundtrip_ok,
       CAST(sum(CASE WHEN n_chars / n_tokens > 3.0 THEN 1 ELSE 0 END) AS BIGINT) AS compression_ok
FROM r GROUP BY dataset""")
def q_roundtrip_check(spark, sf):
    from quillspark.operators.encode import roundtrip_check
    d = C.corpus_from_documents(_docs(spark, sf)).filter(F.length("text") > 0)
    r = roundtrip_check(_encoder(spark, sf), d)
    return r.groupBy("dataset").agg(
        F.sum(F.col("roundtrip_ok").cast("int")).cast("bigint").alias("roundtrip_ok"),
        F.sum(F.col("compression_ok").cast("int")).cast("bigint").alias("compression_ok"))


@register("append_eos", f"""{_CSTREAM}
SELECT dataset, pos, ids[-1] AS last_id, CAST(len(ids) AS BIGINT) AS n_tokens FROM enc""")
def q_append_eos(spark, sf):
    e = _encoded(spark, sf)
    return e.select("dataset", "pos", F.element_at("ids", -1).alias("last_id"), "n_tokens")


@register("token_lengths", f"""{_CSTREAM}
SELECT dataset, pos, CAST(len(ids) AS BIGINT) AS n_tokens FROM enc""")
def q_token_lengths(spark, sf):
    from quillspark.operators.encode import token_lengths
    return token_lengths(_encoded(spark, sf)).select("dataset", "pos", "n_tokens")


# ================================================================ F6 on the packed SFT stream
@register("sample_windows_masked", f"""{_PACK},
st AS (SELECT flatten(list(tokens ORDER BY chunk_id)) AS s, flatten(list(mask ORDER BY chunk_id)) AS m
       FROM chunks WHERE split = 'train'),
plan AS (SELECT CAST(id // {PLAN['batch'] * PLAN['micro'] * PLAN['steps']} AS INTEGER) AS rank,
                CAST((id // {PLAN['batch'] * PLAN['micro']}) % {PLAN['steps']} AS BIGINT) AS step,
                CAST((id // {PLAN['batch']}) % {PLAN['micro']} AS INTEGER) AS micro,
                CAST(id % {PLAN['batch']} AS INTEGER) AS slot
         FROM range({_PLAN_ROWS}) r(id)),
cand AS (SELECT p.*, CAST(c AS INTEGER) AS cand,
                {sql_hash64("'42'", 'rank', 'step', 'micro', 'slot', 'c')} % (len(st.s) - {BLOCK}) AS i
         FROM plan p, range(0, 11) r(c), st),
tr AS (SELECT c.*, list_sum(st.m[i + 2 : i + {BLOCK} + 1]) AS trainable FROM cand c, st),
firstok AS (SELECT rank, step, micro, slot, min(cand) AS k FROM tr WHERE trainable > 0 AND cand < 10
            GROUP BY ALL),
pick AS (SELECT tr.*, f.k IS NULL AS fully_masked FROM tr LEFT JOIN firstok f USING (rank, step, micro, slot)
         WHERE tr.cand = coalesce(f.k, 10))
SELECT rank || ':' || step || ':' || micro || ':' || slot AS wid, CAST(i AS BIGINT) AS start, fully_masked,
       CAST(trainable AS BIGINT) AS trainable, {fingerprint(f'st.s[i + 1 : i + {BLOCK}]')} AS x_md5,
       {fingerprint(f"CASE WHEN fully_masked THEN list_transform(range({BLOCK}), lambda j: -1) ELSE list_transform(range(1, {BLOCK} + 1), lambda j: CASE WHEN st.m[i + 1 + j] = 0 THEN -1 ELSE st.s[i + 1 + j] END) END")} AS y_md5
FROM pick, st""")
def q_sample_windows_masked(spark, sf):
    ch = _sft_chunks(spark, sf)
    w = S.sample_windows_masked(S.step_plan(spark, **PLAN), ch, {"split": "train"}, BLOCK,
                                chunk_size=SFT_CHUNK, plan_rows=_PLAN_ROWS, directory=_mask_ranks(spark, sf))
    return w.select("wid", "start", "fully_masked", F.col("trainable").cast("bigint").alias("trainable"),
                    ids_fingerprint("x").alias("x_md5"), ids_fingerprint("y").alias("y_md5"))
