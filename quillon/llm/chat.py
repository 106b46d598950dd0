"""Chat formatting by perspective rotation.

For every participant of a conversation its dialogue is rendered once with that speaker as the
assistant and all others as users under their names. Turns become

    <|start|>assistant\\n{text}<|end|>\\n      for the speaker (trained on)
    <|start|>user name={name}\\n{text}<|end|>\\n   for the others (masked out)

A dialogue comes in parts of `part_turns` turns, so that a conversation of any length is never gathered in one
task; its parts, in order, put together are the whole. Turns are numbered within their conversation over one
distributed sort (no task sees a whole conversation), so a part's number of rows is bounded whatever turn numbers
there are. Each part has the places (code points within the part's text, end excluded) that are trained on: the
speaker's texts with their end marker; first_turn is the number of its first turn in the whole.

Defined results: turns go in order of turn, then role, then text; null turns come last, negative ones in their
place; a null role is the participant "unknown"; a null text is an empty one; rows with a null
conv_id form the conversation null; repeated rows each are a turn. A speaker without a turn in a part
has the part rendered with an empty mask. Further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.table import ORD, Table

PART_TURNS = 256
START, END, NOBODY = "<|start|>", "<|end|>", "unknown"


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, name, text, n): the turns with their numbers, from 0, within their conversation."""
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(NOBODY)).alias("name"), F.coalesce("text", F.lit("")).alias("text"))
    # equal rows are told apart, so that they needn't go to one task
    t = t.withColumn("tie", F.monotonically_increasing_id()).orderBy("conv_id", F.col("turn").asc_nulls_last(), "name", "text", "tie").select("conv_id", "name", "text")
    t = Table(t)._numbered()
    first = t.groupBy("conv_id").agg(F.min(ORD).alias("first"))
    first = first.withColumnRenamed("conv_id", "__conv")
    return t.join(first, t["conv_id"].eqNullSafe(first["__conv"])).select("conv_id", "name", "text", (F.col(ORD) - F.col("first")).alias("n"))


def rotated(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, speaker, part, first_turn, n_turns, text, n_chars, mask): mask is an array of (start, end)."""
    t = numbered(turns).select("conv_id", F.expr(f"n div {part_turns}").alias("part"), F.struct("n", "name", "text").alias("t"))
    speakers = t.groupBy(F.col("conv_id").alias("__conv"), F.col("t.name").alias("speaker")).agg(F.count(F.lit(1)).alias("__n"))
    parts = t.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("turns"))  # at most part_turns of them
    d = parts.join(speakers, parts["conv_id"].eqNullSafe(speakers["__conv"]))

    def head(x: Column) -> Column:
        return F.when(x["name"] == F.col("speaker"), F.lit(f"{START}assistant\n")).otherwise(F.concat(F.lit(f"{START}user name="), x["name"], F.lit("\n")))

    rendered = F.transform("turns", lambda x: F.struct((x["name"] == F.col("speaker")).alias("own"), F.length(head(x)).alias("skip"), F.concat(head(x), x["text"], F.lit(f"{END}\n")).alias("text")))
    first = (F.col("part") * part_turns).alias("first_turn")
    d = d.select("conv_id", "speaker", "part", first, F.size("turns").cast("long").alias("n_turns"), rendered.alias("r"))
    # places by a running sum over at most a part's turns
    steps = F.aggregate(
        "r",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("mask")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["text"])).cast("long").alias("at"),
            F.when(x["own"], F.array_append(a["mask"], F.struct((a["at"] + x["skip"]).cast("long").alias("start"), (a["at"] + F.length(x["text"]) - 1).cast("long").alias("end")))).otherwise(a["mask"]).alias("mask"),
        ),
        lambda a: a["mask"],
    )
    text = F.array_join(F.transform("r", lambda x: x["text"]), "")
    return d.select("conv_id", "speaker", "part", "first_turn", "n_turns", text.alias("text"), F.length(text).cast("long").alias("n_chars"), steps.alias("mask"))


def op3_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = rotated(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return d.withColumn("mask", F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"], m["end"])), ","))


ORACLE = f"""
WITH t AS (
  SELECT conv_id, coalesce(role, '{NOBODY}') AS name, coalesce(text, '') AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, '{NOBODY}'), coalesce(text, '')) - 1 AS n FROM conversations
), s AS (SELECT DISTINCT conv_id, name AS speaker FROM t),
r AS (
  SELECT t.conv_id, s.speaker, n // {PART_TURNS} AS part, n AS i, name = speaker AS own,
    CASE WHEN name = speaker THEN '{START}assistant' || chr(10) ELSE '{START}user name=' || name || chr(10) END AS head, body || '{END}' || chr(10) AS rest
  FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
), p AS (
  SELECT *, coalesce(sum(length(head) + length(rest)) OVER (PARTITION BY conv_id, speaker, part ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reached FROM r
)
SELECT conv_id, speaker, part, part * {PART_TURNS} AS first_turn, count(*) AS n_turns, string_agg(head || rest, '' ORDER BY i) AS text, CAST(sum(length(head) + length(rest)) AS BIGINT) AS n_chars,
  coalesce(string_agg(CAST(CAST(reached + length(head) AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(reached + length(head) + length(rest) - 1 AS BIGINT) AS VARCHAR), ',' ORDER BY i) FILTER (WHERE own), '') AS mask
FROM p GROUP BY conv_id, speaker, part
"""
