"""DuckDB oracle fragments for the instruction-data queries."""

from quillspark.plans.sqlparts import P, STRIP

NL2 = "chr(10) || chr(10)"


def s(x: str) -> str:
    return f"trim({x}, {STRIP})"


TURNS = """turns AS (
  SELECT conv_id AS pos, list(struct_pack(turn := turn, role := role, text := text) ORDER BY turn) AS t
  FROM conversations GROUP BY conv_id)"""

# Raw shapes rendered from turns (same rule as the Spark side).
SHAREGPT_MSGS = f"""CASE WHEN coalesce(list_bool_and(list_transform(t, lambda x:
      (CASE CASE x.role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE x.role END
         WHEN 'system' THEN 'system' WHEN 'human' THEN 'user' WHEN 'user' THEN 'user'
         WHEN 'gpt' THEN 'assistant' WHEN 'assistant' THEN 'assistant' END) IS NOT NULL
      AND length({s("coalesce(x.text, '')")}) > 0)), true)
  THEN list_transform(t, lambda x: struct_pack(
      role := CASE CASE x.role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE x.role END
         WHEN 'system' THEN 'system' WHEN 'human' THEN 'user' WHEN 'user' THEN 'user'
         WHEN 'gpt' THEN 'assistant' WHEN 'assistant' THEN 'assistant' END,
      content := {s("coalesce(x.text, '')")})) END"""

MESSAGES_MSGS = f"""CASE WHEN coalesce(list_bool_and(list_transform(t, lambda x:
      coalesce(x.role IN ('system', 'user', 'assistant'), false)
      AND length({s("coalesce(x.text, '')")}) > 0)), true)
  THEN list_transform(t, lambda x: struct_pack(role := x.role, content := {s("coalesce(x.text, '')")})) END"""

# pairs: k-th pair = turns (2k+1, 2k+2) 1-based
PAIRS_MSGS = f"""CASE WHEN coalesce(list_bool_and(list_transform(range(0, CAST((len(t) + 1) // 2 AS BIGINT)), lambda k:
      length({s("coalesce(t[2*k+1].text, '')")}) > 0 AND length({s("coalesce(t[2*k+2].text, '')")}) > 0)), true)
  THEN flatten(list_transform(range(0, CAST((len(t) + 1) // 2 AS BIGINT)), lambda k: [
      struct_pack(role := 'user', content := {s("coalesce(t[2*k+1].text, '')")}),
      struct_pack(role := 'assistant', content := {s("coalesce(t[2*k+2].text, '')")})])) END"""

QA_MSGS = """CASE WHEN t[1].text IS NOT NULL AND t[2].text IS NOT NULL
  THEN [struct_pack(role := 'user', content := t[1].text),
        struct_pack(role := 'assistant', content := t[2].text)] END"""

SHAPES = {"sharegpt": SHAREGPT_MSGS, "messages": MESSAGES_MSGS, "pairs": PAIRS_MSGS,
          "qa": QA_MSGS}


def registry_cte(datasets: dict) -> str:
    parts = []
    for name, (shape, _) in datasets.items():
        key = "qa" if shape.startswith("qa_") else shape
        parts.append(f"SELECT '{name}' AS dataset, pos, {SHAPES[key]} AS m FROM turns")
    return "reg AS (\n" + "\n  UNION ALL ".join(parts) + ")"


def valid(m: str = "m") -> str:
    return (f"coalesce(len({m}) >= 2 AND list_filter({m}, lambda x: x.role <> 'system')[-1].role = 'assistant'"
            f" AND list_contains(list_transform({m}, lambda x: x.role), 'user'), false)")


def merge_system(m: str = "m") -> str:
    return f"""(CASE WHEN {m} IS NULL THEN NULL
  WHEN len({m}) > 0 AND {m}[1].role = 'system' THEN
    CASE WHEN length({s(f"{m}[1].content")}) > 0 AND len({m}) > 1 AND {m}[2].role = 'user'
      THEN list_concat([struct_pack(role := 'user',
                                    content := {s(f"{m}[1].content")} || {NL2} || {m}[2].content)],
                       {m}[3:])
      ELSE {m}[2:] END
  ELSE {m} END)"""


def render(m: str) -> str:
    return f"md5(array_to_string(list_transform({m}, lambda x: x.role || ':' || x.content), chr(10)))"


def enc(text_sql: str) -> str:
    return f"list_transform(regexp_extract_all({text_sql}, '{P}'), lambda p: coalesce(vmap.vm[p], 0))"


def tokenize(mm: str) -> tuple[str, str]:
    """(ids, mask) SQL of merged messages ``mm``."""
    ids = f"""list_concat([1], flatten(list_transform({mm}, lambda x:
      CASE x.role WHEN 'assistant' THEN list_append({enc(s('x.content'))}, 2)
                  WHEN 'user' THEN {enc("'[INST] ' || " + s('x.content') + " || ' [/INST]'")}
                  ELSE [] END)))"""
    mask = f"""list_concat([0], flatten(list_transform({mm}, lambda x:
      CASE x.role WHEN 'assistant' THEN list_transform(range(len({enc(s('x.content'))}) + 1), lambda i: 1)
                  WHEN 'user' THEN list_transform(range(len({enc("'[INST] ' || " + s('x.content') + " || ' [/INST]'")})), lambda i: 0)
                  ELSE [] END)))"""
    return ids, mask
