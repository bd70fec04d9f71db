"""Chat formatting of event-sourced conversations.

A log has one row per event: ``conv_id, turn, copy, seq, role, op, text``. The
events of a message (``conv_id, turn, copy``; ``copy`` tells messages with the
same turn apart) are folded in ``seq`` order: a ``delta`` appends its text, an
``edit`` replaces what stands, a ``regenerate`` discards it and goes on with
its own text, if any. The messages of a conversation are rendered by turn.

A conversation may be of any length: messages are rendered in parts of
``PART_TURNS`` turns, one row each (``conv_id, part``), and a conversation's
text is its parts in order. Each part carries its loss mask as spans.

Template: ``<|turn|>`` role, line feed, text, ``<|end|>``. Control strings in a
role or text are replaced by an escape sign and a code letter (the sign itself
likewise), which ``unescape`` reverts; so no text can look like a mark.

Everything is DataFrame expressions.

Defined results: null text is empty; null role is the empty role, a message
takes the first role its events name; null turn comes first; events equal in
``seq`` are ordered by op, role and text; messages without events do not exist;
an empty log gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART_TURNS = 64
TURN, END = "<|turn|>", "<|end|>"
#: Strings that mark something in this or another common template.
CONTROL = (TURN, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
           "<|startoftext|>", "<|endoftext|>")
ESCAPE = "␛"
_CODES = "abcdefghijkl"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0"))
    for mark, code in zip(CONTROL, _CODES, strict=True):
        out = F.replace(out, F.lit(mark), F.lit(ESCAPE + code))
    return out


def unescape(text: Column) -> Column:
    # the sign is always followed by its code, so the order does not matter but for the sign itself
    for mark, code in zip(CONTROL, _CODES, strict=True):
        text = F.replace(text, F.lit(ESCAPE + code), F.lit(mark))
    return F.replace(text, F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(ESCAPE + "n"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit(ESCAPE + "n"), F.lit("\n")))


def part_of(turn: str = "turn") -> Column:
    return F.expr(f"`{turn}` div {PART_TURNS}").alias("part")


def conversation_log(conversations: DataFrame) -> DataFrame:
    """A log of stored conversations (``conv_id, turn, role, text``) as a chat
    application would have written it: a draft that is edited, for the trained
    role a draft that is regenerated and streamed in two deltas.

    Rows are dealt once by conversation and part; numbering repeated turns and
    all later steps keep that distribution."""
    rows = conversations.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"),
                                F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("part", part_of()).repartition("conv_id", "part")
    again = Window.partitionBy("conv_id", "part", "turn").orderBy("role", "text")
    rows = rows.withColumn("copy", F.row_number().over(again))

    def event(i: int, op: str, text) -> Column:
        return F.struct(F.lit(i).alias("seq"), F.lit(op).alias("op"), text.alias("text"))

    draft, half = F.left("text", F.lit(16)), F.floor(F.length("text") / 2).cast("int")
    streamed = F.array(event(0, "delta", draft), event(1, "regenerate", F.lit("")), event(2, "delta", F.left("text", half)),
                       event(3, "delta", F.substr("text", half + 1)))
    edited = F.array(event(0, "delta", draft), event(1, "edit", F.col("text")))
    return rows.select("conv_id", "part", "turn", "copy", "role",
                       F.explode(F.when(F.col("role") == TRAINED_ROLE, streamed).otherwise(edited)).alias("e")) \
        .select("conv_id", "part", "turn", "copy", "role", "e.seq", "e.op", "e.text")


def messages(log: DataFrame) -> DataFrame:
    """Fold a log: ``conv_id, part, turn, copy, role, text``."""
    if "part" not in log.columns:
        log = log.withColumn("part", part_of())
    if "copy" not in log.columns:
        log = log.withColumn("copy", F.lit(1))
    events = F.array_sort(F.collect_list(F.struct("seq", "op", "role", "text")))
    df = log.groupBy("conv_id", "part", "turn", "copy").agg(events.alias("e"))
    # the last event that does not append, and what follows it
    df = df.withColumn("last", F.array_max(F.transform("e", lambda e, i: F.when(e["op"] == "delta", 0).otherwise(i))))
    live = F.transform(F.slice("e", F.col("last") + 1, F.size("e")), lambda e: F.coalesce(e["text"], F.lit("")))
    role = F.coalesce(F.get(F.filter("e", lambda e: e["role"].isNotNull()), F.lit(0))["role"], F.lit(""))
    return df.select("conv_id", "part", "turn", "copy", role.alias("role"), F.array_join(live, "").alias("text"))


def render(folded: DataFrame) -> DataFrame:
    """``conv_id, part, n_turns, formatted, loss``: the text of each part, and
    the spans (code points) of the trained role's texts in it."""
    turns = F.array_sort(F.collect_list(F.struct("turn", "copy", "role", "text")))
    df = folded.groupBy("conv_id", "part").agg(turns.alias("m"))
    df = df.withColumn("r", F.transform("m", lambda m: F.struct(
        F.concat(F.lit(TURN), _escape_role(m["role"]), F.lit("\n")).alias("head"), escape(m["text"]).alias("body"), (m["role"] == TRAINED_ROLE).alias("trained"))))
    df = df.withColumn("heads", F.transform("r", lambda x: F.length(x["head"]))) \
        .withColumn("sizes", F.transform("r", lambda x: F.length(x["head"]) + F.length(x["body"]) + len(END)))
    spans = F.transform("r", lambda x, i: F.struct(
        (F.aggregate(F.slice("sizes", F.lit(1), i), F.lit(0), lambda a, n: a + n) + F.get("heads", i)).alias("start"),
        F.length(x["body"]).alias("length"), x["trained"].alias("trained")))
    loss = F.transform(F.filter(spans, lambda s: s["trained"]), lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    return df.select("conv_id", "part", F.size("m").alias("n_turns"),
                     F.array_join(F.transform("r", lambda x: F.concat(x["head"], x["body"], F.lit(END))), "").alias("formatted"), loss.alias("loss"))


def format_conversations(log: DataFrame) -> DataFrame:
    return render(messages(log))


def read_back(parts: DataFrame) -> DataFrame:
    """From the rendered text and its mask alone: ``turns array<struct<role,
    text>>`` and ``trained array<string>``, unescaped, for each part."""
    turns = F.transform(F.filter(F.split("formatted", rf"\Q{END}\E"), lambda t: t != ""), lambda t: F.substr(t, F.lit(len(TURN) + 1)))
    turns = F.transform(turns, lambda t: F.struct(
        _unescape_role(F.substring_index(t, "\n", 1)).alias("role"),
        unescape(F.substr(t, F.length(F.substring_index(t, "\n", 1)) + 2)).alias("text")))
    trained = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return parts.select("conv_id", "part", "formatted", turns.alias("turns"), trained.alias("trained"))


def digests(parts: DataFrame) -> DataFrame:
    """Per conversation: checksums of all turns and of all trained text, read back."""
    back = read_back(parts).select(
        "conv_id", "part", F.size("turns").alias("n"), F.length("formatted").alias("chars"),
        F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
        F.array_join("trained", "").alias("trained"))
    df = back.groupBy("conv_id").agg(
        F.sum("n").cast("bigint").alias("n_turns"), F.sum("chars").cast("bigint").alias("formatted_chars"),
        F.sum(F.length("trained")).cast("bigint").alias("loss_chars"), F.array_sort(F.collect_list(F.struct("part", "turns", "trained"))).alias("p"))
    joined = lambda name: F.sha2(F.array_join(F.transform("p", lambda x: x[name]), ""), 256)
    return df.select("conv_id", "n_turns", joined("turns").alias("turns_sha256"), "loss_chars", joined("trained").alias("loss_sha256"), "formatted_chars")
