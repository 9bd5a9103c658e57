"""Tables as text: rows become sentences under one parent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.functions.text import header_line, row_sentence

#: Rows up to which a table is its own parent, and rows that are exploded at most.
PARENT_ROWS, MOST_ROWS = 20, 2000


def explode_tables(tables: DataFrame, parent_rows: int = PARENT_ROWS, most_rows: int = MOST_ROWS) -> DataFrame:
    """table_id, sentences, parent_text, parent_is_complete, truncated, overflow_text of (table_id, headers, rows).

    ``rows`` is an array of rows, a row an array of (k, v).  What exceeds
    ``most_rows`` is kept as one overflow text.
    """
    said = F.transform("rows", row_sentence)
    n = F.size("rows")
    return tables.withColumns({"__said": said, "__n": n}).select(
        "table_id",
        F.slice("__said", 1, most_rows).alias("sentences"),
        F.when(F.col("__n") == 0, "")
        .when(F.col("__n") <= parent_rows, F.array_join("__said", "\n"))
        .otherwise(header_line(F.col("headers")))
        .alias("parent_text"),
        F.col("__n").between(1, parent_rows).alias("parent_is_complete"),
        (F.col("__n") > most_rows).alias("truncated"),
        F.when(F.col("__n") > most_rows, F.array_join(F.expr(f"slice(__said, {most_rows + 1}, greatest(__n - {most_rows}, 0))"), " "))
        .otherwise("")
        .alias("overflow_text"),
    )


def kind_counts(chunks: DataFrame, by: str = "doc_id") -> DataFrame:
    """Table, image-text and other chunks of each document."""
    kind = F.upper("kind")
    return chunks.groupBy(by).agg(
        F.count_if(kind == "TABLE").alias("table_chunks"),
        F.count_if(kind == "OCR").alias("ocr_chunks"),
        F.count_if(~kind.isin("TABLE", "OCR")).alias("text_chunks"),
    )


def table_segments(chunks: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, sub_order, kind, text, parent_text) of table chunks, JSON texts of {headers, rows}.

    Each row becomes a sentence under the table's parent; a chunk of another
    shape, or without a sentence, stays as it is.
    """
    shape = F.from_json(text, "headers array<string>, rows array<map<string,string>>")
    rows = F.transform("__t.rows", lambda r: F.transform(F.col("__t.headers"), lambda h: F.struct(h.alias("k"), F.try_element_at(r, h).alias("v"))))
    made = chunks.withColumn("__t", shape).withColumn("rows", rows)
    fits = F.coalesce(F.size("rows") > 0, F.lit(False)) & F.col("__t.headers").isNotNull()
    good = made.where(fits).select(F.col(key).alias("table_id"), F.col("__t.headers").alias("headers"), "rows")
    said = explode_tables(good).select(F.col("table_id").alias(key), "parent_text", F.posexplode(F.when(F.col("overflow_text") == "", F.col("sentences")).otherwise(F.concat("sentences", F.array("overflow_text")))).alias("sub_order", "text"))
    exploded = said.where(F.col("text") != "").select(key, "sub_order", F.lit("exploded").alias("kind"), "text", "parent_text")
    plain = made.where(~fits).select(key, F.lit(0).alias("sub_order"), F.lit("plain").alias("kind"), F.col(text).alias("text"), F.lit(None).cast("string").alias("parent_text"))
    return exploded.unionByName(plain)
