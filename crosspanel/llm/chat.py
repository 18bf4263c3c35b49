"""Chat formatting from an event log, in DataFrame functions only.

Events of a conversation are folded into its final messages: a ``message`` opens a message with its text, a ``delta`` appends to it, an
``edit`` replaces its text so far, a ``regenerate`` discards it and starts again with its own text, a ``retract`` removes it.
Messages are first folded one by one, keyed by (conversation, message), so the pieces of a streamed answer meet
before the messages of its conversation do. Then the conversation is rendered:

    <|role|>newline text </s>newline      for every message

Control strings in roles and texts are escaped with a backslash, backslashes doubled, so the output can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.common import col

#: Fixed control strings of the template and of common others; none survives unescaped inside a text.
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "|>"]
END = "</s>\n"
LOSS_ROLE = "assistant"
KINDS = ["message", "delta", "edit", "regenerate", "retract"]


def escape(text: Column) -> Column:
    """Backslashes doubled, and one put behind the first character of every control string."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(c[0] + "\\" + c[1:]))
    return out


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message_id, place, role, text) of events (conv_id, seq, kind, message_id, role, text).

    Events apply in the order of seq, ties by kind (in the order above), then text. A message stands at the seq of its
    first event and has the last role given. Null texts are empty; an event of another kind or with a null kind counts as a
    message event. Null conversation and message ids are keys like any other. A retracted message leaves no row, unless later events
    regenerate it.
    """
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.lower("kind")), F.lit(0)).cast("int")
    kind = F.when(kind == 0, 1).otherwise(kind)
    rows = events.select("conv_id", "message_id", F.struct(F.col("seq"), kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"), "role").alias("e"))
    folded = rows.groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_list("e")).alias("es"))
    # only what follows the last event that sets the text counts; deltas come after it
    last = F.array_max(F.transform("es", lambda e, i: F.when(e["kind"] != 2, i)))
    folded = folded.withColumn("last", F.coalesce(last, F.lit(0)))
    live = F.slice("es", F.col("last") + 1, F.size("es") - F.col("last"))
    roles = F.filter("es", lambda e: e["role"].isNotNull())
    return folded.filter(F.get("es", "last")["kind"] != 5).select(
        "conv_id", "message_id", F.get("es", F.lit(0))["seq"].alias("place"),
        F.when(F.size(roles) > 0, F.element_at(roles, -1)["role"]).alias("role"),
        F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, formatted, and loss_spans, the [start, end) characters to learn from.

    Messages are ordered by place, ties by role and text; a null role is an empty one.
    """
    turn = F.struct("place", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    head = lambda t: F.concat(F.lit("<|"), escape(t["role"]), F.lit("|>\n"))
    rows = rows.withColumn("turns", F.transform("turns", lambda t: F.struct((t["role"] == LOSS_ROLE).alias("loss"), head(t).alias("head"), escape(t["text"]).alias("body"))))
    sizes = F.transform("turns", lambda t: F.struct(t["loss"].alias("loss"), F.length(t["head"]).alias("h"), F.length(t["body"]).alias("b")))
    rows = rows.withColumn("sizes", sizes)
    at = F.aggregate("sizes", F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")), lambda s, z: F.struct(
        (s["at"] + z["h"] + z["b"] + len(END)).alias("at"),
        F.when(z["loss"], F.concat(s["spans"], F.array(F.struct((s["at"] + z["h"]).alias("start"), (s["at"] + z["h"] + z["b"]).alias("end"))))).otherwise(s["spans"]).alias("spans")),
        lambda s: s["spans"])
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "")
    return rows.select("conv_id", text.alias("formatted"), at.alias("loss_spans"))


def format_chat(events: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans from an event log; extra columns are not read, an empty log gives an empty table."""
    return render(fold(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns array<struct<role, text>> and the text under the loss mask, taken from formatted conversations."""
    blocks = F.slice(F.split("formatted", "</s>\n", -1), 1, F.size(F.split("formatted", "</s>\n", -1)) - 1)
    rows = formatted.withColumn("blocks", blocks)
    turns = F.transform("blocks", lambda b: F.struct(
        unescape(F.substring_index(F.substring(b, 3, F.length(b)), "|>\n", 1)).alias("role"),
        unescape(F.substring(b, F.instr(b, F.lit("|>\n")) + 3, F.length(b))).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    return rows.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_text"))


def events_of(conversations: DataFrame) -> DataFrame:
    """A table of turns (conv_id, turn, role, text) as the event log that leads to it.

    A user's turn is sent reversed and then edited. An assistant's is streamed in two pieces if it has an even number of characters; if not, a first
    answer is thrown away and generated anew. Other turns, and null texts, are one message each. Rows with one turn number stay apart:
    they are numbered by role and text within it.
    """
    size, text = F.length("text"), F.col("text")
    event = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("text"))
    half = F.floor(size / 2).cast("int")
    streamed = F.array(event("message", F.substring(text, F.lit(1), half)), event("delta", F.substring(text, half + 1, size)))
    again = F.array(event("message", F.reverse(text)), event("delta", F.lit(" and so on")), event("regenerate", text))
    edited = F.array(event("message", F.reverse(text)), event("edit", text))
    events = F.when(text.isNull(), F.array(event("message", text))).when((F.col("role") == LOSS_ROLE) & (size % 2 == 0), streamed).when(
        F.col("role") == LOSS_ROLE, again).when(F.col("role") == "user", edited).otherwise(F.array(event("message", text)))
    rows = conversations.groupBy("conv_id", "turn", "role", "text").count().select(
        "conv_id", "turn", "role", "text", F.explode(F.sequence(F.lit(1).cast("long"), F.col("count"))).alias("copy"))
    rows = rows.select("conv_id", "turn", "role", F.struct("turn", "role", F.md5("text").alias("digest"), "copy").alias("message_id"), F.explode(events).alias("e"))
    return rows.select("conv_id", F.col("turn").alias("seq"), "e.kind", "message_id", "role", "e.text")


def digests(formatted: DataFrame) -> DataFrame:
    """What the output holds, by its length and digests."""
    rows = read_back(formatted)
    flat = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(flat, 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


#: A conversation of control strings, formatted beside the given ones.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def _sql_escape(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


DIGEST_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES {", ".join(f"({a}, {b}, '{c}', '{d}')" for a, b, c, d in PROBE)})
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = '{LOSS_ROLE}' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = '{LOSS_ROLE}' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       sum(length({_sql_escape("role")}) + length({_sql_escape("text")}) + 10)::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
