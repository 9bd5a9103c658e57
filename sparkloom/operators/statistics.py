"""Aggregates over blocks, messages and calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Characters below which a block is short; when blocks are merged.
SHORT_BLOCK = 4000 // 3
MANY_BLOCKS, SHORT_SHARE, LEAST_AVERAGE = 80, 0.6, 1000


def block_statistics(blocks: DataFrame, by: str, text: str = "content") -> DataFrame:
    """num, total_len, avg_len, min_len, max_len, short_ratio and whether the blocks are to be merged."""
    n = F.length(text)
    short = F.avg((n < SHORT_BLOCK).cast("double"))
    merge = (F.count("*") > MANY_BLOCKS) | (short > SHORT_SHARE) | (F.avg(n) < LEAST_AVERAGE)
    return blocks.groupBy(by).agg(
        F.count("*").alias("num"), F.sum(n).alias("total_len"), F.avg(n).alias("avg_len"),
        F.min(n).alias("min_len"), F.max(n).alias("max_len"), short.alias("short_ratio"), merge.alias("merge"),
    )


def joined_by(rows: DataFrame, by: list[str], text: str, order: str, separator: str = "\n") -> DataFrame:
    """Texts of each key in order, joined."""
    return rows.groupBy(*by).agg(F.expr(f"listagg({text}, '{separator}') WITHIN GROUP (ORDER BY {order})").alias(text))


def metered(calls: DataFrame, by: str) -> DataFrame:
    """prompt and completion totals of (prompt_tokens, completion_tokens, prompt_text, completion_text); one call without counters makes the sum an estimate."""

    def tokens(kind: str) -> Column:
        return F.coalesce(F.col(f"{kind}_tokens"), F.greatest(F.lit(1), F.floor(F.length(f"{kind}_text") / 4)).cast("long"))

    unmeasured = F.col("prompt_tokens").isNull() | F.col("completion_tokens").isNull()
    sums = [F.sum(tokens(k)).alias(f"{k}_tokens") for k in ("prompt", "completion")]
    return calls.groupBy(by).agg(*sums, F.max(unmeasured).alias("estimated"))


def image_counts(images: DataFrame, by: str, meaningful: Column) -> DataFrame:
    """Images of each group with and without readable text."""
    return images.groupBy(by).agg(F.count_if(meaningful).alias("with_text"), F.count_if(~meaningful).alias("without_text"))


def table_names(chunks: DataFrame, document: str, stem: str, order: str) -> DataFrame:
    """Name each document's unnamed tables by their ordinals; other rows keep what they have."""
    unnamed = (F.col("kind") == "TABLE") & F.col("table_name").isNull()
    number = F.sum(unnamed.cast("int")).over(Window.partitionBy(document).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - 1
    name = F.concat(F.col(stem), F.lit("__table_"), number.cast("string"))
    return chunks.withColumn("table_name", F.when(unnamed, name).otherwise(F.col("table_name")))


def appended(messages: DataFrame, stored: DataFrame, conversation: str, order: str) -> DataFrame:
    """Number new messages on from the largest stored number of their conversation."""
    last = stored.groupBy(conversation).agg(F.max("seq").alias("__last"))
    line = F.row_number().over(Window.partitionBy(conversation).orderBy(order))
    rows = messages.withColumn("__n", line).join(last, conversation, "left")
    return rows.withColumn("seq", (F.coalesce("__last", F.lit(0)) + F.col("__n")).cast("long")).drop("__n", "__last")
