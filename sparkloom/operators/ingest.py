"""Files to numbered chunks: what the readers find, with one shape, then segments, then word windows.

``files`` are routed files (path, ext, kind, error, content), from
``sources.files.routed_files`` or a table of that shape.  Each file is read in
its own row; everything after the readers is windows, joins and groups on the
path.  An unreadable file gives no chunk but its error: a row of ``outcomes``,
and of ``file_errors``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.functions import text as tx
from sparkloom.operators import chunking, documents, statistics, structure
from sparkloom.operators.tables import explode_tables
from sparkloom.sources import files as readers

#: Words of a window and words that two of them share.
SPAN, OVERLAP = 512, 64
#: Segments of a sheet; and of a file's tables before its texts.
SHEET_STRIDE, TEXTS_FROM = 100_000, 1_000_000
_ROWS = "array<array<struct<k:string,v:string>>>"
#: Kind of the row of a file that was refused or could not be read.
ERROR = "error"


def _shaped(rows: DataFrame, kind: str, order: Column, text: Column | None = None, title: Column | None = None, tabular: bool = False) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select(
        "path", F.lit(kind).alias("kind"), order.cast("long").alias("ord"), (none if title is None else title).alias("title"), (none if text is None else text).alias("text"),
        (F.col("headers") if tabular else F.lit(None).cast("array<string>")).alias("headers"), (F.col("rows") if tabular else F.lit(None).cast(_ROWS)).alias("rows"),
    )


def records(headers: Column, row: Column) -> Column:
    """A row's cells as (k, v) by header, padded and cut to the headers; of equal headers the last cell counts."""
    last = lambda h: F.size(headers) - F.array_position(F.reverse(headers), h) + 1
    return F.transform(F.array_distinct(headers), lambda h: F.struct(h.alias("k"), F.coalesce(F.try_element_at(row, last(h).cast("int")), F.lit("")).alias("v")))


def parsed_chunks(files: DataFrame, block_chars: int | None = documents.BLOCK_CHARS) -> DataFrame:
    """``outcomes`` without the files that were refused or could not be read."""
    return outcomes(files, block_chars).where(F.col("kind") != ERROR)


def _word_chunks(files: DataFrame) -> DataFrame:
    """Sections, titled tables and errors of Word files, each of which is read once."""
    items = readers.docx_files(files, refused=True)
    # a file with an error has no items; a condition on the error alone would have the file read twice
    kind = F.when(F.col("error").isNotNull(), ERROR).otherwise(F.col("kind"))
    items = items.select("path", F.coalesce("pos", F.lit(0)).alias("pos"), kind.alias("kind"), "style", F.coalesce("error", "text").alias("text"), "rows").where("kind IS NOT NULL")
    paragraph, table = F.col("kind") == "paragraph", F.col("kind") == "table"
    made = structure.headed_tables(structure.outline(items, "path", style="style"), others=~table)
    said = F.when(paragraph, F.concat_ws("\n", "title", F.nullif("content", F.lit("")))).when(~table, F.col("content"))
    kind = F.when(paragraph, "TEXT").when(table, "TABLE").otherwise(F.col("kind"))
    rows = F.transform("rows", lambda r: records(F.col("headers"), r))
    return made.select("path", kind.alias("kind"), F.col("pos").cast("long").alias("ord"), "title", said.alias("text"), "headers", rows.alias("rows")).where("kind <> 'TEXT' OR text <> ''")


def outcomes(files: DataFrame, block_chars: int | None = documents.BLOCK_CHARS) -> DataFrame:
    """(path, kind, ord, title, text, headers, rows, file_name, source_ext, table_name) of what is found in files, and a row of kind ``ERROR``
    with the error as its text for each file that was refused or could not be read.

    Prose comes in blocks of at most ``block_chars`` (None: whole), JSON as its tables and the texts outside them, a Word
    file as its sections and titled tables, a workbook as the tables of its
    sheets.  Unnamed tables are named by their file and number.
    """
    prose = readers.text_files(files).select("path", "text")
    if block_chars is None:
        prose = prose.select("path", F.lit(0).alias("block_no"), F.col("text").alias("block"))
    else:
        prose = documents.text_blocks(prose, most=block_chars)
    found = [_shaped(prose, "TEXT", F.col("block_no"), F.col("block"))]

    json = files.where("kind = 'json' AND error IS NULL").select("path", documents.decoded(F.col("content")).alias("text"))
    found.append(_shaped(documents.tables_of_json(json, key="path", pos="pos"), "TABLE", F.col("pos"), tabular=True))
    found.append(_shaped(documents.texts_of_json(json, key="path", pos="pos"), "JSON", F.col("pos") + TEXTS_FROM, F.col("content")))

    found.append(_word_chunks(files))

    cells = readers.xlsx_files(files, refused=True).where("sheet IS NOT NULL")
    sheets = structure.sheet_tables(cells, by=("path", "sheet_no", "sheet"))
    place = F.row_number().over(Window.partitionBy("path", "sheet_no").orderBy("block_no", "part")) - 1
    sheets = sheets.withColumns({"ord": F.col("sheet_no") * SHEET_STRIDE + place, "rows": F.transform("rows", lambda r: records(F.col("headers"), r))})
    found.append(_shaped(sheets, "TABLE", F.col("ord"), title=F.col("sheet"), tabular=True))
    found.append(_shaped(_other_errors(files), ERROR, F.lit(0), F.col("error")))

    every = found[0]
    for one in found[1:]:
        every = every.unionByName(one)
    name = F.element_at(F.split("path", "/"), -1)
    every = every.withColumns({"file_name": name, "source_ext": F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)), "table_name": F.lit(None).cast("string")})
    every = every.withColumn("__stem", F.regexp_replace("file_name", r"\.[^.]*$", ""))
    return statistics.table_names(every, "path", "__stem", "ord").drop("__stem")


def _other_errors(files: DataFrame) -> DataFrame:
    """(path, error) of files other than Word files."""
    plain = files.where(~F.coalesce(F.col("kind").isin("docx", "xlsx"), F.lit(False))).select("path", "error")
    return plain.unionByName(readers.xlsx_files(files, refused=True).select("path", "error")).where("error IS NOT NULL")


def file_errors(files: DataFrame) -> DataFrame:
    """(path, error) of files that were refused or could not be read; ``outcomes`` tells them with what was found, where both are wanted."""
    return _other_errors(files).unionByName(readers.docx_files(files, refused=True).select("path", "error").where("error IS NOT NULL"))


_KEPT = ("path", "kind", "ord", "title", "file_name", "source_ext", "table_name")


def segments(chunks: DataFrame) -> DataFrame:
    """Chunks as texts with ``sub_order`` and ``parent_text``: a table's rows become sentences under their parent, what exceeds the most rows one more; other chunks stay whole."""
    said = explode_tables(chunks.select(F.struct(*_KEPT, "text").alias("table_id"), "headers", "rows"))
    table = F.col("table_id.kind") == "TABLE"
    sentences = F.when(F.col("overflow_text") == "", F.col("sentences")).otherwise(F.concat("sentences", F.array("overflow_text")))
    every = F.when(table, sentences).otherwise(F.array("table_id.text"))
    kept = [F.col(f"table_id.{c}").alias(c) for c in _KEPT]
    rows = said.select(*kept, F.when(table, F.col("parent_text")).alias("parent_text"), F.posexplode_outer(every).alias("sub_order", "text"))
    return rows.where("kind <> 'TABLE' OR trim(text) <> ''")


def indexed_chunks(files: DataFrame, span: int = SPAN, overlap: int = OVERLAP, block_chars: int | None = documents.BLOCK_CHARS) -> DataFrame:
    """(path, file_name, source_ext, kind, table_name, title, parent_text, seq, chunk, token_count): a file's chunks numbered without gaps, equal ones once."""
    blank = {c: F.lit(None).cast("int") for c in chunking.ORDER_KEYS}
    made = chunking.chunk_segments(segments(parsed_chunks(files, block_chars)).withColumns(blank), span, overlap, "path")
    return made.select("path", "file_name", "source_ext", "kind", "table_name", "title", "parent_text", "seq", "chunk", "token_count")
