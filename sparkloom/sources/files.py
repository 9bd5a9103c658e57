"""Office and text files as rows: a router by extension, a guard against hostile archives, small readers of zipped XML."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as tx
from sparkloom.operators.documents import decode_bytes

# Fixed values.
UNCOMPRESSED_BYTES, COMPRESSION = 512 << 20, 100
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
ROUTES = {".txt": "text", ".md": "text", ".csv": "text", ".json": "json", ".jsonl": "json", ".docx": "docx", ".xlsx": "xlsx"}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def routed_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, ext, kind, error, content) of files: an unknown extension, an empty file and a hostile archive are errors, told row by row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return routed(files.unionByName(empty_files(spark, path)))


def empty_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files without a byte, which Spark's reader leaves out; their names alone pass through the driver, as all names do there when a folder is read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    found, names = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True), []
    while found.hasNext():
        status = found.next()
        if status.getLen() == 0 and not status.getPath().getName().startswith(("_", ".")):
            names.append(status.getPath().toString())
    return spark.createDataFrame([(n, b"") for n in names], "path string, content binary")


def routed(files: DataFrame) -> DataFrame:
    """``routed_files`` of a table (path, content)."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    kind = F.create_map(*[F.lit(x) for pair in ROUTES.items() for x in pair])
    rows = files.select("path", ext.alias("ext"), "content").withColumn("kind", F.try_element_at(kind, F.col("ext")))
    error = F.when(F.col("kind").isNull(), "unsupported_type").when(F.coalesce(F.octet_length("content"), F.lit(0)) == 0, "empty_content")
    rows = rows.withColumn("error", error)
    # archives alone meet Python; they are told by name, as a condition on the content would have it made once more
    archives = F.coalesce(F.col("kind").isin("docx", "xlsx"), F.lit(False))
    fault = archive_fault(F.when(F.col("error").isNull(), F.col("content")))
    return rows.where(~archives).unionByName(rows.where(archives).withColumn("error", F.coalesce("error", fault)))


def fault_of_archive(raw: bytes) -> str | None:
    """Why a zip archive isn't opened: it is none, unpacks to too much, or by too much."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as archive:
            infos = archive.infolist()
    except zipfile.BadZipFile:
        return "not_an_archive"
    unpacked, packed = sum(i.file_size for i in infos), sum(i.compress_size for i in infos)
    if unpacked > UNCOMPRESSED_BYTES:
        return "too_large"
    return "compression_ratio" if unpacked > COMPRESSION * packed else None


def archive_fault(content: Column) -> Column:
    @F.pandas_udf("string")
    def fault(values: pd.Series) -> pd.Series:
        return values.map(lambda raw: None if raw is None else fault_of_archive(raw))

    return fault(content)


def text_files(files: DataFrame) -> DataFrame:
    """(path, ext, text) of routed prose: decoded and cleaned; a table in one of these files is prose too."""

    @F.pandas_udf("string")
    def decoded(content: pd.Series) -> pd.Series:
        return content.map(lambda raw: decode_bytes(raw or b""))

    rows = files.where("kind = 'text' AND error IS NULL")
    return rows.select("path", "ext", tx.clean_text(decoded(F.col("content"))).alias("text")).where(F.length("text") > 0)


def _style_names(archive: zipfile.ZipFile) -> dict[str, str]:
    """What the styles that paragraphs refer to are called."""
    if "word/styles.xml" not in archive.namelist():
        return {}
    styles = ElementTree.fromstring(archive.read("word/styles.xml")).iter(f"{_W}style")
    return {s.get(f"{_W}styleId"): n.get(f"{_W}val") for s in styles if (n := s.find(f"{_W}name")) is not None}


def docx_items(raw: bytes) -> list[dict]:
    """Paragraphs and tables of a document in their order: (pos, kind, style, text, rows)."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
        names = _style_names(archive)
    said = lambda node: "".join((t.text or "") if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "" for t in node.iter()).strip()
    items = []
    for node in body if body is not None else ():
        if node.tag == f"{_W}p":
            style = node.find(f"{_W}pPr/{_W}pStyle")
            own = style.get(f"{_W}val") if style is not None else None
            items.append({"kind": "paragraph", "style": names.get(own, own), "text": said(node), "rows": None})
        elif node.tag == f"{_W}tbl":
            rows = [[said(cell) for cell in row.findall(f"{_W}tc")] for row in node.findall(f"{_W}tr")]
            items.append({"kind": "table", "style": None, "text": "", "rows": rows})
    return [{"pos": k, **x} for k, x in enumerate(items)]


def is_date_format(code: str) -> bool:
    """Whether a number format shows a date or a time: a letter of one outside quotes, brackets and escapes."""
    return bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.|General', "", code, flags=re.I), re.I))


def _date_styles(archive: zipfile.ZipFile) -> list[bool]:
    """For each cell style of a workbook whether it shows a date."""
    if "xl/styles.xml" not in archive.namelist():
        return []
    root = ElementTree.fromstring(archive.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): f.get("formatCode") or "" for f in root.iter(f"{_S}numFmt")}
    styles = root.find(f"{_S}cellXfs")
    ids = [int(x.get("numFmtId") or 0) for x in styles] if styles is not None else []
    return [is_date_format(own[i]) if i in own else i in DATE_FORMATS for i in ids]


def iso_date(serial: float, from_1904: bool = False) -> str:
    """A workbook's day number in ISO form; a time alone where it is less than a day."""
    moment = (datetime(1904, 1, 1) if from_1904 else datetime(1899, 12, 30)) + timedelta(milliseconds=round(serial * 86_400_000))
    return moment.time().isoformat() if 0 <= serial < 1 else moment.isoformat()


def xlsx_cells(raw: bytes) -> list[dict]:
    """Cells of all sheets: (sheet_no, sheet, row, col, value), rows and columns counted from 0, dates in ISO form."""
    with zipfile.ZipFile(io.BytesIO(raw)) as archive:
        names = set(archive.namelist())
        read = lambda name: ElementTree.fromstring(archive.read(name))
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in item.iter(f"{_S}t")) for item in read("xl/sharedStrings.xml").findall(f"{_S}si")]
        targets = {r.get("Id"): r.get("Target") for r in read("xl/_rels/workbook.xml.rels")}
        out, dates, book = [], _date_styles(archive), read("xl/workbook.xml")
        about = book.find(f"{_S}workbookPr")
        from_1904 = about is not None and about.get("date1904") in ("1", "true")
        for number, sheet in enumerate(book.iter(f"{_S}sheet")):
            target = targets[sheet.get(f"{_R}id")].lstrip("/")
            for cell in read(target if target.startswith("xl/") else f"xl/{target}").iter(f"{_S}c"):
                letters, digits = re.match(r"([A-Z]+)([0-9]+)", cell.get("r")).groups()
                column = 0
                for c in letters:
                    column = column * 26 + ord(c) - 64
                kind, v = cell.get("t"), cell.find(f"{_S}v")
                value = "".join(t.text or "" for t in cell.iter(f"{_S}t")) if kind == "inlineStr" else None if v is None else v.text
                style = int(cell.get("s") or 0)
                if kind == "s" and value is not None:
                    value = shared[int(value)]
                elif kind in (None, "n") and value is not None and style < len(dates) and dates[style]:
                    value = iso_date(float(value), from_1904)
                if value is not None:
                    out.append({"sheet_no": number, "sheet": sheet.get("name"), "row": int(digits) - 1, "col": column - 1, "value": value})
    return out


def _exploded(files: DataFrame, kind: str, reader: Callable[[bytes], list[dict]], item: str, refused: bool) -> DataFrame:
    """A row for each item that a reader finds; a file that it can't read gives one row with its error, and so does a refused one if ``refused``.

    A condition on the error has the file checked and read twice; with ``refused`` none stands below the items.
    """
    shape = f"struct<items:array<struct<{item}>>,error:string>"

    @F.pandas_udf(shape)
    def read(content: pd.Series) -> pd.DataFrame:
        def one(raw: bytes | None) -> tuple[list[dict], str | None]:
            try:
                return [] if raw is None else reader(raw), None
            except Exception as error:  # whatever a broken file makes the reader do is that file's own fault
                return [], f"parse_failed: {type(error).__name__}"

        return pd.DataFrame([one(raw) for raw in content], columns=["items", "error"])

    rows = files.where(F.col("kind") == kind)
    if not refused:
        rows = rows.where("error IS NULL")
    rows = rows.select("path", "error", read(F.when(F.col("error").isNull(), F.col("content"))).alias("__found"))
    error = F.coalesce("error", "__found.error").alias("error")
    return rows.select("path", error, F.explode_outer("__found.items").alias("__item")).select("path", "error", "__item.*")


def docx_files(files: DataFrame, refused: bool = False) -> DataFrame:
    return _exploded(files, "docx", docx_items, "pos:int,kind:string,style:string,text:string,rows:array<array<string>>", refused)


def xlsx_files(files: DataFrame, refused: bool = False) -> DataFrame:
    return _exploded(files, "xlsx", xlsx_cells, "sheet_no:int,sheet:string,row:int,col:int,value:string", refused)
