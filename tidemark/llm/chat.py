r"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own, with all turns before it as context.

Template: each turn is ``<turn>role<text>text</turn>`` and a line feed. Inside roles and texts ``\`` is written ``\e`` and ``<`` is written
``\l``, so a raw ``<`` only ever opens a mark and each backslash starts one of two codes: reading back is exact whatever the text holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import table

OPEN, BODY, CLOSE = "<turn>", "<text>", "</turn>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\e"), F.lit("\\"))


def expand_turns(turns: DataFrame) -> DataFrame:
    """conv_id, example, formatted, loss_start, loss_chars: the trainable span in code points of formatted.

    Rows of a conversation go by turn (null first), then role and text; null roles and texts are empty. One example per assistant
    turn; turns after the last one (or a conversation without any) make a final example with an empty span, so nothing is lost. An
    example is one string by nature, so one conversation's turns meet in one row; rows of different conversations spread by conv_id.
    Null conv_id is one conversation; other columns are ignored; an empty table gives no rows."""
    t = turns.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    convs = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    marked = convs.select("conv_id", F.transform("turns", lambda x: F.concat(F.lit(OPEN), escape(x["role"]), F.lit(BODY), escape(x["text"]), F.lit(CLOSE))).alias("marked"), F.transform("turns", lambda x: F.when(x["role"] == "assistant", F.length(escape(x["text"])))).alias("span"))
    ends = F.filter(F.sequence(F.lit(1), F.size("marked")), lambda i: F.get(F.col("span"), i - 1).isNotNull() | (i == F.size("marked")))
    rows = marked.select("conv_id", "marked", "span", F.posexplode(ends).alias("example", "end"))
    out = rows.select("conv_id", "example", F.array_join(F.slice("marked", 1, F.col("end")), "").alias("formatted"), F.get(F.col("span"), F.col("end") - 1).alias("n"))
    return out.select("conv_id", "example", "formatted", F.when(F.col("n").isNotNull(), F.length("formatted") - F.length(F.lit(CLOSE)) - F.col("n")).otherwise(0).alias("loss_start"), F.coalesce("n", F.lit(0)).alias("loss_chars"))


def read_examples(examples: DataFrame) -> DataFrame:
    """conv_id, turns (array of role and text, read from the longest example), losses (text under each example's mask, in order), formatted_chars.
    conv_id still partitions the rows, so this adds no shuffle."""
    got = examples.select("conv_id", "example", "formatted", unescape(F.substring(F.col("formatted"), F.col("loss_start") + 1, F.col("loss_chars"))).alias("loss"))
    by = got.groupBy("conv_id").agg(F.max_by("formatted", "example").alias("last"), F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("l"), F.sum(F.length("formatted").cast("long")).alias("formatted_chars"))
    parts = F.split(F.col("last"), CLOSE)
    turns = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.struct(unescape(F.substring_index(F.substring(p, len(OPEN) + 1, 1 << 30), BODY, 1)).alias("role"), unescape(F.substring_index(p, BODY, -1)).alias("text")))
    return by.select("conv_id", turns.alias("turns"), F.transform("l", lambda x: x["loss"]).alias("losses"), "formatted_chars")


def op2_chat_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    back = read_examples(expand_turns(turns.unionByName(extra)))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("losses", "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")


OP2_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
n AS (
  SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(length(replace(replace(role, '\', '\e'), '<', '\l')) + length(replace(replace(text, '\', '\e'), '<', '\l')) + 20) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(upto) FILTER (role = 'assistant' OR k = n)::BIGINT AS formatted_chars
FROM n GROUP BY conv_id
"""
