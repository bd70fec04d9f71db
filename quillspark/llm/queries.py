"""Registered queries of the subpackage: each applies one operator with its
production parameters to its whole table. ``SQL`` has the DuckDB statement
where SQL can express the result."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import (alignment, bpe_trie, chat_format, dac, filter_audit, fingerprints, language_id, packing, quality, simhash, token_counts,
                            toxicity, url_filter)
from quillspark.functions.text import hash64
from quillspark.llm.common import documents, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")

QUERIES: dict = {}
SQL: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


_URL_SQL = r"""
with url as (select page_id, coalesce(url, '') as url, regexp_extract(url, '{U}', ['host', 'path', 'query']) as u,
                    date '2024-01-01' + (abs(page_id) * 37 % 360)::int as fetched from pages),
captures as (select page_id, url, fetched, lower(u.host) as host, u.path as path, u.query as query from url),
sites as (select distinct host, ('0x' || substr(md5(host), 1, 15))::bigint as h, array_to_string(string_split(host, '.')[2:], '.') as domain from captures where host <> ''),
domains as (select distinct domain, ('0x' || substr(md5(domain), 1, 15))::bigint as h from sites where domain <> ''),
entries as (
  select 'host' as kind, host as key, 'spam' as category, 'block' as verdict, date '2024-01-01' + (h % 200)::int as listed, 'add' as action from sites where h % 3 = 0
  union all select 'host', host, 'spam', 'block', date '2024-01-01' + (h % 200 + 30 + h % 90)::int, 'remove' from sites where h % 6 = 0
  union all select 'host', host, 'spam', 'block', date '2024-01-01' + (h % 200 + 150)::int, 'add' from sites where h % 12 = 0
  union all select 'domain', domain, 'adult', 'block', date '2024-01-01' + (h % 300)::int, 'add' from domains where h % 5 = 0
  union all select 'url', host || path || query, 'reviewed', 'allow', fetched - (page_id % 60)::int, 'add' from captures where host <> '' and page_id % 11 = 0
  union all select 'url', host || path || query, 'reviewed', 'allow', fetched + (page_id % 3)::int, 'remove' from captures where host <> '' and page_id % 22 = 0
  union all select 'prefix', host || '/' || string_split(path, '/')[2] || '/', 'section', 'block', date '2024-03-01' + (page_id % 90)::int, 'add'
    from captures where host <> '' and page_id % 17 = 0 and len(string_split(path, '/')) > 2),
days as (select kind, key, category, listed, min((action = 'add')::int) as added, max(verdict) filter (where action = 'add') as verdict
         from entries where key is not null and listed is not null group by all),
valid as (select kind, key, category, verdict, listed as valid_from, valid_to from (
            select *, lead(listed) over (partition by kind, key, category order by listed) as valid_to from days) where added = 1),
keys as (
  select page_id, url, fetched, 'url' as kind, case when host = '' then url else host || path || query end as key from captures
  union all select page_id, url, fetched, 'host', host from captures where host <> ''
  union all select page_id, url, fetched, 'domain', unnest(list_transform(range(1, len(string_split(host, '.')) + 1), lambda i: array_to_string(string_split(host, '.')[i:], '.'))) from captures where host <> ''
  union all select page_id, url, fetched, 'prefix', unnest(list_transform(range(1, len(string_split(path, '/'))), lambda i: host || array_to_string(string_split(path, '/')[1:i], '/') || '/')) from captures where host <> ''),
hits as (select k.*, v.category, v.verdict, v.valid_from, case k.kind when 'url' then 3 when 'prefix' then 2 when 'host' then 1 else 0 end as r
         from keys k join valid v on k.kind = v.kind and k.key = v.key and v.valid_from <= k.fetched and (v.valid_to is null or k.fetched < v.valid_to)),
best as (select *, count(*) over (partition by page_id, url, fetched) as n,
                row_number() over (partition by page_id, url, fetched order by r desc, length(key) desc, valid_from desc, category) as i from hits)
select c.page_id, c.fetched, coalesce(b.verdict, 'none') as decision, b.kind, b.key, b.category, b.valid_from as since, coalesce(b.n, 0)::bigint as n_active
from captures c left join best b on c.page_id = b.page_id and c.url = b.url and c.fetched = b.fetched and b.i = 1"""


@query("op1_url_filter", _URL_SQL.replace("{U}", url_filter.URL))
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures are the pages, fetched on a day that their id gives. The list
    is drawn from their own hosts, domains, sections and URLs, by hash."""
    day = lambda n, start="2024-01-01": F.date_add(F.lit(start).cast("date"), n.cast("int"))
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url", day(F.abs("page_id") * 37 % 360).alias("fetched"))
    split = pages.select("id", "fetched", F.lower(F.regexp_extract("url", url_filter.URL, 1)).alias("host"),
                         F.regexp_extract("url", url_filter.URL, 2).alias("path"), F.regexp_extract("url", url_filter.URL, 3).alias("query")) \
        .filter("host <> ''")
    sites = split.select("host").distinct().withColumn("h", hash64("host")).withColumn("domain", F.regexp_extract("host", r"^[^.]*\.(.*)$", 1))
    domains = sites.select("domain").filter("domain <> ''").distinct().withColumn("h", hash64("domain"))
    page_key = F.concat("host", "path", "query")

    def entry(df, kind, key, category, verdict, listed, action):
        return df.select(F.lit(kind).alias("kind"), key.alias("key"), F.lit(category).alias("category"), F.lit(verdict).alias("verdict"),
                         listed.alias("listed"), F.lit(action).alias("action"))

    h, host = F.col("h"), F.col("host")
    parts = F.split("path", "/")
    entries = [
        entry(sites.filter("h % 3 = 0"), "host", host, "spam", "block", day(h % 200), "add"),
        entry(sites.filter("h % 6 = 0"), "host", host, "spam", "block", day(h % 200 + 30 + h % 90), "remove"),
        entry(sites.filter("h % 12 = 0"), "host", host, "spam", "block", day(h % 200 + 150), "add"),
        entry(domains.filter("h % 5 = 0"), "domain", F.col("domain"), "adult", "block", day(h % 300), "add"),
        entry(split.filter("id % 11 = 0"), "url", page_key, "reviewed", "allow", F.date_sub("fetched", (F.col("id") % 60).cast("int")), "add"),
        entry(split.filter("id % 22 = 0"), "url", page_key, "reviewed", "allow", F.date_add("fetched", (F.col("id") % 3).cast("int")), "remove"),
        entry(split.filter((F.col("id") % 17 == 0) & (F.size(parts) > 2)), "prefix", F.concat(host, F.lit("/"), F.get(parts, F.lit(1)), F.lit("/")),
              "section", "block", day(F.col("id") % 90, "2024-03-01"), "add"),
    ]
    log = entries[0]
    for e in entries[1:]:
        log = log.unionByName(e)
    out = url_filter.evaluate(pages, log)
    return out.select(F.col("id").alias("page_id"), "fetched", "decision", "kind", "key", "category", "since", "n_active")


def _chat_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def escaped(x: str) -> str:
        x = f"replace({x}, {quote(chat_format.ESCAPE)}, {quote(chat_format.ESCAPE + '0')})"
        for mark, code in zip(chat_format.CONTROL, "abcdefghijkl", strict=True):
            x = f"replace({x}, {quote(mark)}, {quote(chat_format.ESCAPE + code)})"
        return x

    marks = len(chat_format.TURN) + 1 + len(chat_format.END)
    return f"""
with t as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]')
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(length(replace({escaped("role")}, chr(10), {quote(chat_format.ESCAPE + "n")})) + length({escaped("text")}) + {marks})::bigint as formatted_chars
from t group by conv_id"""


@query("op2_chat_formatting", _chat_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.sql("""select * from values (-7L, 0L, 'user', '</s>[INST] ok [/INST]'),
                       (-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') as t(conv_id, turn, role, text)""")
    log = chat_format.conversation_log(conversations.unionByName(own))
    return chat_format.digests(chat_format.format_conversations(log))


@query("op3_best_fit_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), BYTE_BPE, end_id=2, max_tokens=1024)


@query("op7_token_files")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = dac.write_token_files(table(spark, sf_dir, "documents"), WORD_BPE, end_id=1)
    return dac.read_documents(spark, path)


@query("op9_bpe_trie")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_trie.encode(documents(table(spark, sf_dir, "documents")), WORD_BPE, decoded=True)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))


def document_edits():
    """Two edits of every document, placed by a hash of its id: a stretch
    gives way to the document's beginning, then its end is put in elsewhere."""
    place = lambda salt: F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.length(F.coalesce("text", F.lit(""))) + 1)
    edit = lambda start, length, text: F.struct(start.alias("start"), length.alias("length"), text.alias("replacement"))
    return F.array(edit(place(1), F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(60)), F.left("text", F.lit(40))),
                   edit(place(3), F.lit(0).cast("bigint"), F.right("text", F.lit(25))))


@query("op4_token_counts")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = token_counts.build(table(spark, sf_dir, "documents"), BYTE_BPE)
    before = state.withColumn("n_tokens", token_counts.n_tokens())
    out = token_counts.apply_edits(before, document_edits(), BYTE_BPE, keep=["n_tokens"])
    return out.select("doc_id", "n_tokens", token_counts.n_tokens().alias("n_tokens_edited"), F.length("text").cast("bigint").alias("n_chars_edited"),
                      "edits", "reencoded_chars", F.size("leaf_chars").cast("bigint").alias("n_leaves"))


@query("op5_multiset_fingerprints")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op6_simhash_near_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_distance=3)
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def held_out(doc_id: str = "doc_id"):
    """Every fifth document by a checksum of its id is held out of learning."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(~held_out())
    out = toxicity.score(docs, toxicity.fit(docs, labels))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score",
                      F.expr("cast(score >= 0.5 as int)").alias("predicted"))


def _quality_sql() -> str:
    case = "case " + " ".join(f"when n_words < {n} then {i}" for i, n in enumerate(quality.STRATA)) + f" else {len(quality.STRATA)} end"
    n_tests = len(quality.RULES) * (len(quality.STRATA) + 1)
    rate = f"({quality.MAX_RATE}::double / {len(quality.RULES)})"
    steps = []
    for i, (r, (value, cuts)) in enumerate(quality.RULES.items()):
        v = value.replace("/", "::double /")
        places = ", ".join(f"({j + 1}, {c}::double)" for j, c in enumerate(cuts))
        steps.append(f"""
tests{i} as (select stratum, place, cutoff, count(*) filter (where good = 1) as n, count(*) filter (where {v} >= cutoff and good = 1) as k,
                count(*) filter (where {v} >= cutoff and good = 1 and remains) as k_left,
                count(*) filter (where {v} >= cutoff and good <> 1 and remains) as bad_left
            from left{i} cross join (values {places}) c(place, cutoff) group by all),
passed{i} as (select *, case when k < n * {rate} then list_sum(list_transform(range(0, k + 1), lambda i: exp(
                 lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rate}) + (n - i) * ln(1 - {rate})))) <= {quality.ERROR} / {n_tests}
                 else false end as ok from tests{i}),
chosen{i} as (select stratum, arg_max(cutoff, (gain, -place)) as _{r} from (
                select *, min(ok::int) over (partition by stratum order by place) as all_ok, bad_left - {quality.GOOD_COST} * k_left as gain from passed{i})
              where all_ok = 1 and gain > 0 group by stratum),
left{i + 1} as (select l.* replace (remains and coalesce({v} < _{r}, true) as remains) from left{i} l left join chosen{i} using (stratum)),""")
    joins = " ".join(f"left join chosen{i} using (stratum)" for i in range(len(quality.RULES)))
    broken = " or ".join(f"coalesce(({v.replace('/', '::double /')}) >= _{r}, false)" for r, (v, _) in quality.RULES.items())
    return f"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w, coalesce(text, '') as text,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from documents),
grams as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
places as (select doc_id, i, count(*) over (partition by doc_id, g) as c from grams),
rep as (select doc_id, sum(least(3, coalesce(i - before, 3))) as n from (
          select doc_id, i, lag(i) over (partition by doc_id order by i) as before from places where c > 1) group by doc_id),
counts as (select w.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
                  len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols, len(l)::bigint as n_lines,
                  (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words
           from w left join rep on w.doc_id = rep.doc_id),
stats as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words as base_failed, {case} as stratum from counts),
lab as (select doc_id, max(quality) as good from labels where quality is not null group by doc_id),
left0 as (select s.*, lab.good, true as remains from stats s join lab on s.doc_id = lab.doc_id where not base_failed),
{"".join(steps).rstrip(",")}
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       case when base_failed then false else not ({broken}) end as kept from stats {joins}"""


@query("op8_quality_rules", _quality_sql())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_AUDIT_SQL = f"""
with t as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text,
                  regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
f as (select doc_id, part, if(len(w) < {filter_audit.MIN_WORDS}, 'A', '')
             || if(100 * list_unique(w) < {filter_audit.DISTINCT_PERCENT} * len(w), 'B', '')
             || if(100 * len(regexp_extract_all(text, '[A-Z]')) > {filter_audit.UPPER_PERCENT} * length(text), 'C', '')
             || if(regexp_matches(text, '[#$%&*|]'), 'D', '')
             || if(doc_id > min(doc_id) over (partition by text), 'E', '') as fails from t),
lab as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as toxic from labels group by doc_id),
m as (select part, fails, count(*) as n, sum(coalesce(good, 0)) as good, sum(coalesce(toxic, 0)) as toxic
      from f left join lab on f.doc_id = lab.doc_id group by all),
l as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
orders as (select a.x || b.x || c.x || d.x || e.x as filter_order from l a, l b, l c, l d, l e
           where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps as (select filter_order, step::int as step, filter_order[step] as x, filter_order[:step] as upto, filter_order[:step - 1] as before
          from orders, range(1, 6) r(step)),
s as (select part, filter_order, step, x,
             coalesce(sum(n) filter (where translate(upto, fails, '') = upto), 0) as kept,
             coalesce(sum(n) filter (where contains(fails, x) and translate(before, fails, '') = before), 0) as removed,
             coalesce(sum(n) filter (where contains(fails, x) and translate(before, fails, '') <> before), 0) as redundant,
             coalesce(sum(n) filter (where fails = x), 0) as unique_fails,
             coalesce(sum(good) filter (where contains(fails, x) and translate(before, fails, '') = before), 0) as good_lost,
             coalesce(sum(toxic) filter (where contains(fails, x) and translate(before, fails, '') = before), 0) as toxic_lost
      from m, steps group by all)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant,
       unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
       (sum(removed) over (partition by part, x))::bigint as shapley from s"""


@query("op13_filter_audit", _AUDIT_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _third(doc_id: str = "doc_id"):
    """Every third document by a checksum of its id is held out of learning its language."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


@query("op12_language_id")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = language_id.predict(docs, language_id.fit(docs, ~_third()))
    return out.select("doc_id", F.coalesce(_third(), F.lit(False)).alias("held_out"), "lang_pred", "score")


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_BPE)
