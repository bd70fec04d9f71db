"""DuckDB oracle CTEs for the evaluation queries."""

from quillspark.plans.sqlparts import encode, vocab_cte

NL = "chr(10)"


def _choices(nch: int) -> str:
    return f"""SELECT i.item_id, CAST(j AS INTEGER) AS choice_idx, CAST(i.item_id % {nch} AS INTEGER) AS gold,
       s.gold_text AS choice, i.context
FROM items i, range(0, {nch}) r(j), nitems
JOIN items s ON s.item_id = (i.item_id + ((j - i.item_id % {nch} + {nch}) % {nch})) % nitems.n"""


def mmlu_ctx() -> str:
    parts = [f"'Question: ' || context || {NL} || 'Choices:'"]
    for i, L in enumerate("ABCD"):
        parts.append(f"{NL} || '{L}. ' || list_extract(allc, {i + 1})")
    return " || ".join(parts) + f" || {NL} || 'Answer:'"


EVAL_CTE = f"""WITH {vocab_cte()},
items AS (SELECT item_id, array_to_string(w[1:len(w) // 2], ' ') AS context,
                 array_to_string(w[len(w) // 2 + 1:], ' ') AS gold_text
          FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)),
nitems AS (SELECT count(*) AS n FROM items),
c4 AS ({_choices(4)}),
c2 AS ({_choices(2)}),
c4all AS (SELECT item_id, list(choice ORDER BY choice_idx) AS allc FROM c4 GROUP BY item_id),
cands AS (
  SELECT 'hellaswag' AS task, item_id, choice_idx, gold, context, choice FROM c4
  UNION ALL SELECT 'arc_easy', item_id, choice_idx, gold, context, choice FROM c4
  UNION ALL SELECT 'arc_challenge', item_id, choice_idx, gold, context, choice FROM c4
  UNION ALL SELECT 'piqa', item_id, choice_idx, gold, 'Question: ' || context || {NL} || 'Answer:', choice FROM c2
  UNION ALL SELECT 'mmlu', c4.item_id, choice_idx, gold, {mmlu_ctx()}, choice FROM c4 JOIN c4all USING (item_id)),
cfull AS (SELECT *, context || ' ' || choice AS full_text FROM cands),
enc0 AS (SELECT task, item_id, choice_idx, gold, full_text,
                list_concat([1], {encode('full_text')}) AS ids0,
                len({encode('context')}) + 1 AS nctx FROM cfull, vmap),
enc AS (SELECT task, item_id, choice_idx, gold, full_text,
               ids0 AS ids, CAST(nctx AS INTEGER) AS ctx_len
        FROM enc0),
corpus AS (SELECT list_concat([1], {encode('text')}, [2]) AS ids FROM documents, vmap WHERE length(text) > 0),
bigrams AS (SELECT prev, token, count(*) AS cnt FROM (
              SELECT ids[i] AS prev, ids[i + 1] AS token FROM (SELECT ids, unnest(range(1, len(ids))) AS i FROM corpus))
            GROUP BY prev, token),
ctxs AS (SELECT prev, sum(cnt) AS ctx_count, first(token ORDER BY cnt DESC, token ASC) AS top_token
         FROM bigrams GROUP BY prev),
cpairs AS (SELECT task, item_id, choice_idx, CAST(i AS INTEGER) AS pos, ids[i] AS prev, ids[i + 1] AS token
           FROM (SELECT task, item_id, choice_idx, ids, unnest(range(1, len(ids))) AS i FROM enc)),
lp AS (SELECT c.*, ln((coalesce(b.cnt, 0) + 1.0) / (coalesce(x.ctx_count, 0) + 32000.0)) AS logprob,
              c.token = coalesce(x.top_token, 0) AS is_top
       FROM cpairs c LEFT JOIN bigrams b USING (prev, token) LEFT JOIN ctxs x USING (prev)),
sc0 AS (SELECT e.task, e.item_id, e.choice_idx, e.gold, CAST(len(e.ids) AS BIGINT) AS n_tokens, e.ctx_len,
               coalesce(sum(l.logprob) FILTER (WHERE l.pos >= e.ctx_len), 0) AS score_sum,
               coalesce(bool_and(l.is_top) FILTER (WHERE l.pos >= e.ctx_len), true) AS is_greedy
        FROM enc e LEFT JOIN lp l USING (task, item_id, choice_idx)
        GROUP BY e.task, e.item_id, e.choice_idx, e.gold, e.ids, e.ctx_len),
sc AS (SELECT *, CAST(n_tokens - ctx_len AS BIGINT) AS n_choice_tokens,
              CASE WHEN n_tokens - ctx_len > 0 THEN score_sum / (n_tokens - ctx_len) ELSE score_sum END AS score
       FROM sc0),
wcands AS (SELECT item_id, choice_idx, gold, replace(context || ' _', '_', choice) AS full_text FROM c2),
wenc AS (SELECT item_id, choice_idx, gold, list_concat([1], {encode('full_text')}) AS ids0 FROM wcands, vmap),
wenc2 AS (SELECT item_id, choice_idx, gold, ids0 AS ids FROM wenc),
wpairs AS (SELECT item_id, choice_idx, ids[i] AS prev, ids[i + 1] AS token
           FROM (SELECT item_id, choice_idx, ids, unnest(range(1, len(ids))) AS i FROM wenc2)),
wlp AS (SELECT w.*, ln((coalesce(b.cnt, 0) + 1.0) / (coalesce(x.ctx_count, 0) + 32000.0)) AS logprob
        FROM wpairs w LEFT JOIN bigrams b USING (prev, token) LEFT JOIN ctxs x USING (prev)),
wsc AS (SELECT e.item_id, e.choice_idx, e.gold, CAST(len(e.ids) AS BIGINT) AS n_tokens,
               coalesce(sum(l.logprob), 0) AS logprob_sum,
               coalesce(sum(l.logprob), 0) / len(e.ids) AS score
        FROM wenc2 e LEFT JOIN wlp l USING (item_id, choice_idx) GROUP BY e.item_id, e.choice_idx, e.gold, e.ids),
preds AS (SELECT task, item_id, first(choice_idx ORDER BY score DESC, choice_idx ASC) AS pred, any_value(gold) AS gold
          FROM sc GROUP BY task, item_id
          UNION ALL
          SELECT 'winogrande', item_id, first(choice_idx ORDER BY score DESC, choice_idx ASC) + 1, any_value(gold) + 1
          FROM wsc GROUP BY item_id),
gsm AS (SELECT 'gsm8k' AS task, item_id,
               context || ' #### ' || format('{{:,}}', item_id * 1234) AS answer,
               'The answer is ' || format('{{:,}}', CASE WHEN item_id % 2 = 0 THEN item_id * 1234 ELSE item_id * 1234 + 1 END) || '.' AS completion
        FROM items),
gsm2 AS (SELECT *, replace(regexp_extract(answer, '####\\s*(-?[0-9]+(?:,?[0-9]+)*)', 1), ',', '') AS gold_number,
                replace(regexp_extract(completion, '(-?[0-9]+(?:,?[0-9]+)*)', 1), ',', '') AS pred_number
         FROM gsm WHERE regexp_matches(answer, '####\\s*(-?[0-9]+(?:,?[0-9]+)*)')),
acc AS (SELECT task, CAST(sum(CASE WHEN pred = gold THEN 1 ELSE 0 END) AS BIGINT) AS correct,
               CAST(count(*) AS BIGINT) AS total,
               sum(CASE WHEN pred = gold THEN 1 ELSE 0 END) * 100.0 / count(*) AS accuracy
        FROM preds GROUP BY task
        UNION ALL
        SELECT 'gsm8k', CAST(sum(CASE WHEN pred_number = gold_number AND pred_number <> '' THEN 1 ELSE 0 END) AS BIGINT),
               CAST(count(*) AS BIGINT),
               sum(CASE WHEN pred_number = gold_number AND pred_number <> '' THEN 1 ELSE 0 END) * 100.0 / count(*)
        FROM gsm2
        UNION ALL
        SELECT 'humaneval', CAST(0 AS BIGINT), CAST(count(*) AS BIGINT), CAST(NULL AS DOUBLE) FROM items)"""
