"""Map-reduce summaries with an injected function: batches are mapped, notes folded level by level, the last one reduced."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.operators.chunking import batched, even_sample

# Chunks read, folds, chunks of an overview and the mark of a gap.
WINDOW, FOLDS, OVERVIEW, GAP = 240, 3, 8, "[…]"
BATCH_ITEMS, BATCH_CHARS = 6, 24_000
Summarizer = Callable[[str], str]


def first_sentences(text: str, most: int = 400) -> str:
    """A stand-in for a language model: the text's beginning, up to its last sentence end."""
    head = text[:most]
    cut = max(head.rfind(c) for c in ".!?")
    return head[: cut + 1] if cut > 0 else head


def _said(summarize: Summarizer, text: str) -> Column:
    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(lambda t: summarize(t or ""))

    return run(F.col(text))


def _window(chunks: DataFrame, key: str, window: int) -> tuple[DataFrame, DataFrame]:
    """(key, pos, note) of a document's first readable chunks, and (key, truncated)."""
    solid = chunks.where(F.trim("text") != "")
    pos = F.row_number().over(Window.partitionBy(key).orderBy("seq")) - 1
    rows = solid.select(key, pos.alias("pos"), F.col("text").alias("note"))
    return rows.where(F.col("pos") < window), rows.groupBy(key).agg((F.count("*") > window).alias("truncated"))


def _batched(rows: DataFrame, key: str, text: str = "note") -> DataFrame:
    """Append ``batch`` to (key, pos, text), by a fold over each document's rows in order."""
    sized = rows.withColumn("__size", F.length(text))
    return batched(sized, [key], ["pos"], {"batch": ("__size", BATCH_ITEMS, BATCH_CHARS)}).drop("__size")


def _joined(column: str, order: str = "pos") -> Column:
    return F.expr(f"listagg({column}, '\n\n') WITHIN GROUP (ORDER BY {order})")


def summaries(chunks: DataFrame, summarize: Summarizer = first_sentences, key: str = "doc_id", window: int = WINDOW, folds: int = FOLDS) -> DataFrame:
    """(key, summary, truncated) of chunks (key, seq, text): the first ``window`` readable chunks count, and truncated says if there are more.

    A document of one batch is summarised by one call.  Of others each batch is
    mapped to a note.  Notes that fit one batch are reduced; more are folded, a
    note for each batch of them, and so on; what the last of ``folds`` levels has
    is reduced as it is.  The plan has all levels, each document's notes leave it
    at theirs.
    """
    rows, more = _window(chunks, key, window)
    parts = _batched(rows, key).groupBy(key, "batch").agg(_joined("note").alias("text"))
    parts = parts.withColumn("n", F.count("*").over(Window.partitionBy(key)))
    short = parts.where("n = 1").select(key, _said(summarize, "text").alias("summary"))
    number = (F.col("batch") + 1).cast("string")
    asked = F.concat(F.lit("Part "), number, F.lit(" of "), F.col("n").cast("string"), F.lit(".\n\n"), F.col("text"))
    notes = parts.where("n > 1").withColumn("__asked", asked).select(key, F.col("batch").alias("pos"), number.alias("__number"), _said(summarize, "__asked").alias("note"))
    notes = notes.select(key, "pos", F.concat(F.lit("## Part "), "__number", F.lit("\n"), "note").alias("note"))
    last = None
    for level in range(folds):
        done = notes
        if level < folds - 1:
            placed = _batched(notes, key).withColumn("__batches", F.max("batch").over(Window.partitionBy(key)) + 1)
            done = placed.where("__batches = 1").select(notes.columns)
            grouped = placed.where("__batches > 1").groupBy(key, "batch").agg(_joined("note").alias("text"))
            notes = grouped.select(key, F.col("batch").alias("pos"), _said(summarize, "text").alias("note"))
        last = done if last is None else last.unionByName(done)
    reduced = last.groupBy(key).agg(_joined("note").alias("text")).select(key, _said(summarize, "text").alias("summary"))
    return short.unionByName(reduced).join(more, key)


def overviews(chunks: DataFrame, summarize: Summarizer = first_sentences, key: str = "doc_id", sampled: int = OVERVIEW, marker: str = GAP) -> DataFrame:
    """(key, summary, truncated) from chunks at even distances, with a mark where some are left out."""
    picked = even_sample(chunks.where(F.trim("text") != "").select(key, "seq", "text"), key, "seq", sampled)
    line = F.when(F.col("gap"), F.concat(F.lit(marker + "\n"), F.col("text"))).otherwise(F.col("text"))
    joined = picked.withColumn("line", line).groupBy(key).agg(F.expr("listagg(line, '\n') WITHIN GROUP (ORDER BY seq)").alias("text"), F.max("gap").alias("truncated"))
    return joined.select(key, _said(summarize, "text").alias("summary"), "truncated")


def refined(chunks: DataFrame, summarize: Summarizer = first_sentences, key: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """(key, summary, truncated): batches are read in order, each with the summary so far; a document's batches go to one task, ``window`` chunks at most."""
    rows, more = _window(chunks, key, window)
    parts = _batched(rows, key).groupBy(key, "batch").agg(F.expr("listagg(note, '\n') WITHIN GROUP (ORDER BY pos)").alias("text"))

    def read(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("batch")
        running, n = "", len(own)
        for k, text in enumerate(own["text"]):
            running = summarize(text if k == 0 else f"Summary so far:\n{running}\n\nPart {k + 1} of {n}:\n{text}")
        return pd.DataFrame({key: [own[key].iloc[0]], "summary": [running]})

    kind = f"{key} {chunks.schema[key].dataType.simpleString()}, summary string"
    return parts.groupBy(key).applyInPandas(read, kind).join(more, key)


def reusable(stored: DataFrame, lang: str, key: str = "doc_id") -> DataFrame:
    """The newest summary of each document in another language, to be translated instead of made anew."""
    order = F.struct("built_at", "id")
    return stored.where(F.col("lang") != lang).groupBy(key).agg(F.max_by(F.struct("lang", "summary"), order).alias("s")).select(key, "s.*")
