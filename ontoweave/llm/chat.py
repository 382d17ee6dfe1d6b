"""Chat formatting: one training string a conversation with a loss mask, in Spark expressions only.

Turns are collected as structs and sorted; an array aggregation merges adjacent turns of one role into a block:

    <s>[INST]role[/INST]text[TURN]text</s>

Inside roles and texts a backslash is doubled and a control string gets a backslash after its first character, so the
controls of the output are those of the template only and every text can be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

# The control strings of the template.
BEGIN, END, HEAD, HEAD_END, NEXT = "<s>", "</s>", "[INST]", "[/INST]", "[TURN]"
_CONTROL = r"<(?=/?s>)|\[(?=/?INST\]|TURN\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), _CONTROL, r"$0\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _split(text: Column, control: str) -> Column:
    return F.split(text, rf"\Q{control}\E", -1)


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) of turns (conv_id, turn, role, text).

    ``loss_spans`` are (start, bytes) of each learnt text in the UTF-8 form of ``formatted``, in order. Null roles and
    texts count as empty; turns with equal or null numbers are ordered by role and text, nulls first; repeated rows stay;
    rows with a null conv_id form one conversation; no turns give no row. A conversation is one output string, so it
    must fit in a task; that bound is Spark's for any string.
    """
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    sorted_turns = F.array_sort(F.collect_list(turn))
    start = F.struct(
        F.lit(None).cast("string").alias("role"), F.array().cast("array<string>").alias("parts"),
        F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,bytes:long>>").alias("spans"),
    )

    def add(state: Column, t: Column) -> Column:
        body = escape(t["text"])
        opening = F.concat(F.when(state["role"].isNull(), F.lit("")).otherwise(F.lit(END)), F.lit(BEGIN + HEAD), escape(t["role"]), F.lit(HEAD_END))
        marker = F.when(state["role"] == t["role"], F.lit(NEXT)).otherwise(opening)
        starts = state["at"] + F.octet_length(marker)
        span = F.struct(starts.alias("start"), F.octet_length(body).cast("long").alias("bytes"))
        return F.struct(
            t["role"].alias("role"), F.concat(state["parts"], F.array(marker, body)).alias("parts"),
            (starts + F.octet_length(body)).alias("at"),
            F.when(t["role"] == F.lit(loss_role), F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"),
        )

    return (
        turns.groupBy("conv_id").agg(sorted_turns.alias("turns"))
        .select("conv_id", F.aggregate("turns", start, add).alias("made"))
        .select("conv_id", F.concat(F.array_join("made.parts", ""), F.lit(END)).alias("formatted"), F.col("made.spans").alias("loss_spans"))
    )


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> of the turns that ``formatted`` was made from."""
    blocks = _split(formatted, END)
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(block: Column) -> Column:
        halves = F.split(F.substr(block, F.lit(len(BEGIN + HEAD) + 1)), rf"\Q{HEAD_END}\E", 2)
        role = unescape(halves[0])
        return F.transform(_split(halves[1], NEXT), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def read_loss(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    data = formatted.cast("binary")
    # Byte spans make each cut cost its own length, not the distance from the start.
    cut = lambda s: unescape(F.decode(F.substr(data, (s["start"] + 1).cast("int"), s["bytes"].cast("int")), "UTF-8"))
    return F.array_join(F.transform(spans, cut), "")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"),
    )
    made = format_conversations(turns.unionByName(extra))
    back = made.select("conv_id", read_turns(F.col("formatted")).alias("turns"), read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss"), "formatted")
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (
  select *, length(regexp_replace(replace(text, '\', '\\'), '(</?s>|\[/?INST\]|\[TURN\])', '\1+', 'g')) as size,
    length(regexp_replace(replace(role, '\', '\\'), '(</?s>|\[/?INST\]|\[TURN\])', '\1+', 'g')) as role_size,
    lag(role) over (partition by conv_id order by turn, role, text) as before from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(size + case when before = role then 6 else 20 + role_size end)::bigint as formatted_chars
from e group by conv_id
"""
