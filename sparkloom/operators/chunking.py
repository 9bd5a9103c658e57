"""Word windows, merging, first-occurrence dedup, semantic boundaries and run collapse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.functions.text import words
from sparkloom.functions.vectors import cosine_distance
from sparkloom.operators.folds import Fold, folded, greedy

MIN_CHARS, MIN_NODE_CHARS = 24, 15
ORDER_KEYS = ("page_number", "position_in_doc", "paragraph_number", "chunk_index")


def raw_windows(w: Column, span: int, overlap: int) -> Column:
    """Array of (text, token_count) of an array of words: windows of ``span`` words, the last one clipped; no words, no windows."""
    span, step = max(span, 1), max(span - overlap, 1)
    n = F.size(w)
    count = F.when(n <= span, F.least(n, F.lit(1))).otherwise(1 + F.ceil((n - span) / step)).cast("int")
    return F.transform(
        F.filter(F.sequence(F.lit(0), count), lambda i: i < count),
        lambda i: F.struct(
            F.array_join(F.slice(w, i * step + 1, F.lit(span)), " ").alias("text"),
            F.least(F.lit(span), n - i * step).cast("long").alias("token_count"),
        ),
    )


def merged_tail(made: Column, min_chars: int = MIN_CHARS) -> Column:
    """Windows of which a last one of fewer than ``min_chars`` characters is appended to the one before, so the words that overlap are there twice."""
    last, before = F.try_element_at(made, F.lit(-1)), F.try_element_at(made, F.lit(-2))
    merged = F.struct(
        F.concat_ws(" ", before["text"], last["text"]).alias("text"), (before["token_count"] + last["token_count"]).alias("token_count")
    )
    short = (F.size(made) > 1) & (F.length(last["text"]) < min_chars)
    return F.when(short, F.concat(F.slice(made, 1, F.greatest(F.size(made) - 2, F.lit(0))), F.array(merged))).otherwise(made)


def windows(w: Column, span: int, overlap: int, min_chars: int = MIN_CHARS) -> Column:
    return merged_tail(raw_windows(w, span, overlap), min_chars)


def with_windows(df: DataFrame, text: str, span: int, overlap: int, name: str = "__windows") -> DataFrame:
    """Append the windows of a text.

    Words and raw windows are rows of a generator of one row each: Catalyst
    doesn't merge across it, so neither is computed once for every mention.
    """
    made = df.select("*", F.explode(F.array(words(F.col(text)))).alias("__words"))
    made = made.select("*", F.explode(F.array(raw_windows(F.col("__words"), span, overlap))).alias("__raw")).drop("__words")
    return made.withColumn(name, merged_tail(F.col("__raw"))).drop("__raw")


def chunk_documents(docs: DataFrame, span: int, overlap: int, text: str = "text", min_node: int = MIN_NODE_CHARS) -> DataFrame:
    """Chunks of documents of one segment each, within the row: no shuffle.

    Appends seq, chunk and token_count; a chunk equal to an earlier one of its
    document goes, as does one of fewer than ``min_node`` characters.
    """
    kept = F.filter(F.col("__windows"), lambda c: F.length(c["text"]) >= min_node)
    made = with_windows(docs, text, span, overlap)
    exploded = made.select(*[c for c in docs.columns if c != text], F.posexplode(F.array_distinct(kept)).alias("seq", "c"))
    return exploded.withColumns(
        {"seq": F.col("seq").cast("long"), "chunk": F.col("c.text"), "token_count": F.col("c.token_count")}
    ).drop("c")


def chunk_segments(segments: DataFrame, span: int, overlap: int, doc: str = "doc_id", min_node: int = MIN_NODE_CHARS) -> DataFrame:
    """Chunks of documents of many segments, numbered without gaps in the order of the segments' keys (nulls last)."""
    order = [F.asc_nulls_last(c) for c in ORDER_KEYS] + [F.asc("ord"), F.asc("sub_order"), F.asc("part")]
    parts = with_windows(segments, "text", span, overlap)
    parts = parts.select("*", F.posexplode("__windows").alias("part", "c")).drop("__windows")
    parts = parts.withColumns({"chunk": F.col("c.text"), "token_count": F.col("c.token_count")}).drop("c", "text")
    parts = parts.where(F.length("chunk") >= min_node)
    first = F.row_number().over(Window.partitionBy(doc, F.sha2("chunk", 256)).orderBy(*order))
    parts = parts.withColumn("__n", first).where("__n = 1").drop("__n")
    seq = F.row_number().over(Window.partitionBy(doc).orderBy(*order)) - 1
    return parts.withColumn("seq", seq.cast("long"))


def semantic_parts(sentences: DataFrame, segment: str = "segment_id", order: str = "sentence_no", vector: str = "vector") -> DataFrame:
    """Append distance (to the next sentence, of vectors averaged with their neighbours) and part.

    A part ends where the distance exceeds the 95th percentile of its segment.
    """
    by = Window.partitionBy(segment).orderBy(order)
    near = F.collect_list(F.transform(F.col(vector), lambda x: x.cast("double"))).over(by.rowsBetween(-1, 1))
    size = F.size("__near")
    summed = F.aggregate(
        F.slice("__near", 2, F.greatest(size - 1, F.lit(0))),
        F.element_at("__near", 1),
        lambda total, v: F.zip_with(total, v, lambda x, y: x + y),
    )
    smooth = F.transform(summed, lambda x: x / size)
    rows = sentences.withColumn("__near", near).withColumn("__smooth", smooth)
    rows = rows.withColumn("distance", cosine_distance(F.col("__smooth"), F.lead("__smooth").over(by)))
    rows = rows.withColumn("__limit", F.percentile("distance", F.lit(0.95)).over(Window.partitionBy(segment)))
    ends = F.coalesce(F.col("distance") > F.col("__limit"), F.lit(False)).cast("long")
    before = F.sum(ends).over(by.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("part", F.coalesce(before, F.lit(0))).drop("__near", "__smooth", "__limit")


def joined_parts(rows: DataFrame, by: str, order: str, part: str = "part", text: str = "text", separator: str = " ") -> DataFrame:
    """(by, part, text, n): the texts of each part in order, joined."""
    joined = F.expr(f"listagg(`{text}`, '{separator}') WITHIN GROUP (ORDER BY `{order}`)")
    return rows.groupBy(by, part).agg(joined.alias(text), F.count("*").alias("n"))


def collapse_runs(rows: DataFrame, by: str, order: str, parent: str = "parent_id", complete: str = "parent_is_complete") -> DataFrame:
    """Of consecutive rows with the same complete parent the first stays; other rows stay as they are."""
    key = F.when(F.col(complete), F.col(parent))
    same = F.coalesce(key == F.lag(key).over(Window.partitionBy(by).orderBy(order)), F.lit(False))
    return rows.withColumn("__same", same).where(~F.col("__same")).drop("__same")


def even_sample(rows: DataFrame, by: str, order: str, k: int = 8) -> DataFrame:
    """At most k rows of each group at even distances, the first and last among them, with ``gap`` before a skip."""
    ordered = Window.partitionBy(by).orderBy(order)
    last = F.count("*").over(Window.partitionBy(by)) - 1
    pos = F.row_number().over(ordered) - 1
    spots = F.when(last < k, F.sequence(F.lit(0).cast("long"), last)).otherwise(
        F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda i: F.floor((i * last + (k - 1) // 2) / (k - 1)))
    )
    picked = rows.withColumns({"pos": pos.cast("long"), "__spots": spots}).where(F.array_contains("__spots", F.col("pos")))
    gap = F.coalesce(F.col("pos") - F.lag("pos").over(ordered) > 1, F.lit(False))
    return picked.withColumn("gap", gap).drop("__spots")


def batched(rows: DataFrame, by: list[str], order: list[str], limits: dict[str, tuple[str, int, int]]) -> DataFrame:
    """Append batch numbers to the rows of each key in order: ``limits`` has, for each new column, the column of sizes, the most items and the most size of a batch."""
    folds = [Fold(name, T.IntegerType(), (size,), greedy(items, most)) for name, (size, items, most) in limits.items()]
    return folded(rows, by, order, folds)


def greedy_batches(sizes: Column, most_items: int = 6, most_size: int = 24_000) -> Column:
    """Batch number of each size in a short array: a new batch at ``most_items`` items or beyond ``most_size``; ``batched`` takes rows without a bound."""
    zero = F.struct(F.lit(0).alias("batch"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("size"), F.array().cast("array<int>").alias("out"))

    def step(state: Column, size: Column) -> Column:
        new = (state["n"] > 0) & ((state["n"] >= most_items) | (state["size"] + size > most_size))
        batch = F.when(new, state["batch"] + 1).otherwise(state["batch"])
        return F.struct(
            batch.alias("batch"),
            F.when(new, 1).otherwise(state["n"] + 1).alias("n"),
            F.when(new, size).otherwise(state["size"] + size).cast("long").alias("size"),
            F.concat(state["out"], F.array(batch)).alias("out"),
        )

    return F.aggregate(sizes, zero, step, lambda state: state["out"])
