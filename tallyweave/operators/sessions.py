"""Conversations: what of a history fits a budget, token use, lists of sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_TOKENS, MOST_TURNS = 20_000, 30


def tokens(text: Column) -> Column:
    """An estimate: four characters each."""
    return F.floor(F.length(F.coalesce(text, F.lit(""))) / 4)


def compacted(messages: DataFrame, key: str = "conv_id", order: str = "turn", text: str = "text", most_tokens: int = MOST_TOKENS, most_turns: int = MOST_TURNS) -> DataFrame:
    """The latest messages of each conversation within both budgets, the very latest always."""
    back = Window.partitionBy(key).orderBy(F.desc(order))
    spent = F.sum(tokens(F.col(text))).over(back.rowsBetween(Window.unboundedPreceding, 0))
    placed = messages.withColumns({"age": F.row_number().over(back), "spent": spent})
    return placed.where((F.col("age") == 1) | ((F.col("age") <= most_turns) & (F.col("spent") <= most_tokens)))


def transcripts(messages: DataFrame, key: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each conversation as lines `Role: text`."""
    held = messages.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, role, text))).alias("m"), F.count("*").alias("messages"))
    return held.select(key, "messages", F.array_join(F.transform("m", lambda x: F.concat(F.initcap(x[role]), F.lit(": "), F.coalesce(x[text], F.lit("")))), "\n").alias("transcript"))


def listed(sessions: DataFrame) -> DataFrame:
    """Readable sessions, the latest change first."""
    return sessions.where("_corrupt_record IS NULL AND id IS NOT NULL").select("id", "title", "created_at", "updated_at", F.size("messages").alias("messages")).orderBy(F.desc("updated_at"), "id")


def usage(responses: DataFrame, column: str = "usage") -> DataFrame:
    """Token use out of JSON, totals filled from their parts."""
    parsed = F.from_json(column, "input_tokens bigint, output_tokens bigint, total_tokens bigint")
    u = responses.withColumn("_u", parsed)
    zero = F.lit(0)
    return u.select(*responses.columns, F.coalesce("_u.input_tokens", zero).alias("input_tokens"), F.coalesce("_u.output_tokens", zero).alias("output_tokens"), F.coalesce("_u.total_tokens", F.coalesce("_u.input_tokens", zero) + F.coalesce("_u.output_tokens", zero)).alias("total_tokens"))


def context_size(docs: DataFrame, threshold: int, text: str = "text") -> DataFrame:
    return docs.agg(F.coalesce(F.sum(F.length(text)), F.lit(0)).alias("characters")).withColumn("over", F.col("characters") > threshold)
