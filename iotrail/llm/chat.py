r"""Operator 7: chat turns as training examples by prefix-target expansion.

formatted(conversations) -> conv_id, n_turns, text, examples: each conversation once, with its examples as
(position, upto, mask_start, mask_end, last) over its text. This is what is written, so files and shuffles grow with the
turns, not with their square. examples(stored) -> conv_id, position, n_turns, text, mask_start, mask_end, last expands
it on reading: every assistant turn is an example of its own, all turns before it as context (the first `upto` code
points of the conversation) and that reply alone trainable. A conversation that ends with another role gives one more
row, all its turns with nothing trainable, so that no turn is lost. expand(conversations) does both. A turn is written
[INST]role[/INST]text</s> and a row begins with <s>. Inside roles and texts a backslash is doubled, and one is
put after the first character of each control string, so no control string is left in them; `plain` reverses it.

The mask counts code points of `text`, end exclusive. Turns are ordered by turn (null first), then role, then text (so
repeated rows and ties have one order, each kept). Null texts and roles are empty; a null conv_id is a
conversation of its own. Other columns are not read. An empty table gives an empty result. The turns of a conversation
are put in order in one task, which sorts and spills; its text is one value, as its last example is, so a conversation
of 2 GB or more once formatted is an error of Spark's, not a wrong result. Expansion holds one example at a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise, table

CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
TARGET = "assistant"


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROL:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def plain(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def formatted(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")),
    )
    ahead = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    upto = ahead.rowsBetween(W.unboundedPreceding, 0)
    turns = rows.repartition("conv_id").withColumn("body", escaped("text"))
    turns = turns.withColumn("piece", F.concat(F.lit("[INST]"), escaped("role"), F.lit("[/INST]"), F.col("body"), F.lit("</s>")))
    placed = turns.select(
        "conv_id",
        F.row_number().over(ahead).cast("long").alias("position"),
        (F.sum(F.char_length("piece")).over(upto) + len("<s>")).alias("upto"),
        F.char_length("body").cast("long").alias("size"),
        (F.col("role") == TARGET).alias("target"),
        F.lead(F.lit(False), 1, True).over(ahead).alias("last"),
        "piece",
    )
    per = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("position", "upto", "size", "target", "last", "piece"))).alias("turns"))

    def example(t: Column) -> Column:
        end = t["upto"] - len("</s>")
        start = F.when(t["target"], end - t["size"]).otherwise(F.lit(0).cast("long"))
        return F.struct(t["position"].alias("position"), t["upto"].alias("upto"), start.alias("mask_start"), F.when(t["target"], end).otherwise(F.lit(0).cast("long")).alias("mask_end"), t["last"].alias("last"))

    return per.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.concat(F.lit("<s>"), F.array_join(F.transform("turns", lambda t: t["piece"]), "")).alias("text"),
        F.transform(F.filter("turns", lambda t: t["target"] | t["last"]), example).alias("examples"),
    )


def prefix(text: Column, example: Column) -> Column:
    """Text of one example of a conversation."""
    return F.substring(text, F.lit(1), example["upto"].cast("int"))


def examples(stored: DataFrame) -> DataFrame:
    each = stored.select("conv_id", F.col("text").alias("whole"), F.explode("examples").alias("x"))
    return each.select("conv_id", "x.position", F.col("x.position").alias("n_turns"), prefix(F.col("whole"), F.col("x")).alias("text"), "x.mask_start", "x.mask_end", "x.last")


def expand(conversations: DataFrame) -> DataFrame:
    return examples(formatted(conversations))


def turns_of(text: Column) -> Column:
    """Array of (role, text) read back from a row."""
    parts = F.split(F.substring(text, F.lit(len("<s>") + 1), F.char_length(text)), "</s>")

    def one(p: Column) -> Column:
        at = F.instr(p, "[/INST]")
        role = F.substring(p, F.lit(len("[INST]") + 1), at - len("[INST]") - 1)
        return F.struct(plain(role).alias("role"), plain(F.substring(p, at + len("[/INST]"), F.char_length(p))).alias("text"))

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), one)


def digests(stored: DataFrame) -> DataFrame:
    """One row per conversation: its turns as read back, and its examples, each of which is expanded to its text and
    read by its mask within the row, so nothing is shuffled."""

    def read(x: Column) -> Column:
        text = prefix(F.col("text"), x)
        loss = F.substring(text, (x["mask_start"] + 1).cast("int"), (x["mask_end"] - x["mask_start"]).cast("int"))
        return F.struct(F.char_length(text).cast("long").alias("chars"), plain(loss).alias("loss"))

    turns = F.array_join(F.transform(turns_of(F.col("text")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    seen = stored.select("conv_id", "n_turns", F.sha2(turns.cast("binary"), 256).alias("turns_sha256"), F.transform("examples", read).alias("read"))
    loss = F.array_join("read.loss", "")
    return seen.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.aggregate("read.chars", F.lit(0).cast("long"), lambda a, n: a + n).alias("formatted_chars"),
    )


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return digests(materialise(formatted(rows), "op7-chat", compression="zstd"))


def _sql_escaped(x: str) -> str:
    out = f"replace({x}, '\\', '\\\\')"
    for c in CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


OP7_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), p AS (
  SELECT *, row_number() OVER w AS position, count(*) OVER (PARTITION BY conv_id) AS n,
         3 + sum(17 + length({_sql_escaped("role")}) + length({_sql_escaped("text")})) OVER w AS chars
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY position)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY position) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) FILTER (role = 'assistant' OR position = n) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""
