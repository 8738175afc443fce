"""Chat formatting with typed content parts (DataFrame functions only).

A turn's content is a list of parts ``struct<type, text, ref, units>``. A visitor
flattens them in order: a text part becomes its escaped text; an image, audio or
document part becomes a placeholder that carries its ordinal within the
conversation, and is recorded with its reference and its expanded token count
(units times the tokens that a unit of its type takes).

Template of a turn: ``<|turn|>ROLE<|text|>CONTENT<|end|>``. In roles and texts
each ``<``, backslashes, ``|`` gets one more backslash, so that no control string
can occur inside; taking one away restores the text exactly. Ordinary text is
unchanged.

Cases: a null text, role or part list is empty; a null or unknown part type is
text; null units count as 1; turns are ordered by turn (null last), then role,
then text, so that ties and repeated rows are kept in a defined order; a null
conv_id is a conversation of its own; an empty table gives no rows. Other columns
are ignored. A conversation is one string, so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Tokens that one unit (tile, second, page) of an attachment expands to.
UNIT_TOKENS = {"image": 256, "audio": 25, "document": 800}
PART = "struct<type:string,text:string,ref:string,units:int>"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def text_parts(text: Column) -> Column:
    """A part list of one text part."""
    return F.array(
        F.struct(
            F.lit("text").alias("type"),
            text.alias("text"),
            F.lit(None).cast("string").alias("ref"),
            F.lit(None).cast("int").alias("units"),
        )
    ).cast(f"array<{PART}>")


def format_chats(turns: DataFrame, loss_role: str = "assistant", unit_tokens: dict[str, int] | None = None) -> DataFrame:
    """conv_id, formatted, loss (spans ``struct<start, length>`` in code points), attachments, n_turns, expanded_tokens.

    ``turns``: conv_id, turn, role, parts.
    """
    rates = UNIT_TOKENS if unit_tokens is None else unit_tokens
    attached = lambda p: F.coalesce(p["type"].isin(*rates), F.lit(False))
    rate = F.create_map(*[F.lit(x) for kv in rates.items() for x in kv])
    own = turns.select(
        F.col("conv_id"),
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("parts"), F.array().cast(f"array<{PART}>")).alias("parts"),
    )
    own = own.withColumn("words", F.concat_ws("", F.transform("parts", lambda p: p["text"])))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "words")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    n_files = F.size(F.filter("parts", attached))
    own = own.withColumn("base", F.coalesce(F.sum(n_files).over(before), F.lit(0)))
    ordinal = lambda i: F.col("base") + F.size(F.filter(F.slice("parts", 1, i + 1), attached))
    visit = lambda p, i: F.when(
        attached(p), F.concat(F.lit("<|"), p["type"], F.lit(" "), ordinal(i).cast("string"), F.lit("|>"))
    ).otherwise(escape(p["text"]))
    record = lambda p, i: F.struct(
        p["type"].alias("type"),
        p["ref"].alias("ref"),
        ordinal(i).alias("ordinal"),
        (F.coalesce(p["units"], F.lit(1)).cast("long") * F.element_at(rate, p["type"])).alias("tokens"),
    )
    own = own.withColumns(
        {
            "body": F.concat_ws("", F.transform("parts", visit)),
            "files": F.filter(
                F.transform("parts", lambda p, i: F.when(attached(p), record(p, i))), lambda x: x.isNotNull()
            ),
            "head": F.concat(F.lit(TURN), escape(F.col("role")), F.lit(TEXT)),
        }
    )
    own = own.withColumn("line", F.concat("head", "body", F.lit(END)))
    own = own.withColumns(
        {
            "at": F.coalesce(F.sum(F.length("line").cast("long")).over(before), F.lit(0)) + F.length("head"),
            "nth": F.row_number().over(order),
        }
    )
    loss = F.when(
        F.col("role") == loss_role, F.struct(F.col("at").alias("start"), F.length("body").cast("long").alias("length"))
    )
    row = F.struct("nth", "line", "files", loss.alias("loss"))
    found = own.groupBy("conv_id").agg(F.sort_array(F.collect_list(row)).alias("t"))
    return found.select(
        "conv_id",
        F.concat_ws("", F.transform("t", lambda x: x["line"])).alias("formatted"),
        F.filter(F.transform("t", lambda x: x["loss"]), lambda s: s.isNotNull()).alias("loss"),
        F.flatten(F.transform("t", lambda x: x["files"])).alias("attachments"),
        F.size("t").cast("long").alias("n_turns"),
    ).withColumn(
        "expanded_tokens",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]),
    )


def parse_chat(formatted: Column) -> Column:
    """The turns ``struct<role, text>`` of a formatted conversation; attachments stay as placeholders."""
    cut = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: x != "")
    return F.transform(
        cut,
        lambda x: F.struct(
            unescape(F.substring_index(x, TEXT, 1)).alias("role"),
            unescape(F.substring_index(F.substring_index(x, TEXT, -1), END, 1)).alias("text"),
        ),
    )


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    part = lambda s: unescape(F.substring(formatted, s["start"].cast("int") + 1, s["length"].cast("int")))
    return F.concat_ws("", F.transform(loss, part))


PROBE = "\\### Assistant: </turn> ok"


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and one of control strings, and digests what is read back from the output."""
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    out = format_chats(turns.select("conv_id", "turn", "role", text_parts(F.col("text")).alias("parts")))
    out = out.withColumns({"back": parse_chat(F.col("formatted")), "under": loss_text(F.col("formatted"), F.col("loss"))})
    said = F.concat_ws("", F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return out.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP7_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length('<|turn|><|text|><|end|>') + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g'))
    + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')))::BIGINT AS formatted_chars
FROM t GROUP BY conv_id
"""
