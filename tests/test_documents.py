"""Parsing, structure and summaries on small inputs."""

from __future__ import annotations

import io
import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import scalars as sc
from sparkloom.functions import text as tx
from sparkloom.operators import documents, embedding, structure, summarize, tables
from sparkloom.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_decoding_ladder(spark):
    cases = {
        "héllo".encode(): "héllo", b"\xef\xbb\xbfx": "x", "مرحبا".encode("utf-16"): "مرحبا", "مرحبا".encode("cp1256")[:3]: "مرح", b"": "",
        b"\xd8\x00": b"\xd8\x00".decode("utf-16"),
    }
    frame = spark.createDataFrame([(bytearray(k),) for k in cases], "content binary")
    assert [r[0] for r in frame.select(documents.decoded(F.col("content"))).collect()] == list(cases.values())


def test_text_blocks(spark):
    text = "First sentence. Second sentence. " * 200
    frame = spark.createDataFrame([(1, text.strip()), (2, ""), (4, "x" * 4500)], "doc_id int, text string")
    got = documents.text_blocks(frame).orderBy("doc_id", "block_no").collect()
    assert all(len(r["block"]) <= 2000 for r in got)
    assert " ".join(r["block"] for r in got if r["doc_id"] == 1).split() == text.split()
    assert [len(r["block"]) for r in got if r["doc_id"] == 4] == [2000, 2000, 500]


def test_split_text_rules():
    words = "word " * 600
    # a run without marks is cut hard, blanks or not
    assert [len(x) for x in documents.split_text(words.strip())] == [2000, 999]
    assert documents.split_text("short") == ["short"]
    lines = "\n".join(["a" * 900] * 3)
    assert documents.split_text(lines) == ["a" * 900 + "\n" + "a" * 900, "a" * 900]
    arabic = ("كلمة " * 150 + "، ") * 4
    assert len(documents.split_text(arabic)) > 1 and all(len(x) <= 2000 for x in documents.split_text(arabic))


def test_split_oversized():
    text = " ".join(f"Sentence number {k} has some words." for k in range(400))
    parts = documents.split_oversized(text)
    assert " ".join(parts) == text and all(1000 <= len(p) <= 4000 for p in parts[:-1])
    assert documents.split_oversized("a\nb\n\nc") == ["a b c"] and documents.split_oversized("") == []


def cells(rows):
    return [("s", r, c, v) for r, row in enumerate(rows) if row for c, v in enumerate(row)]


def test_sheet_tables(spark):
    rows = [["name", "size"], ["a", "1"], ["b", "2"], None, ["kind", "n"], ["x", "3"], ["y", "4"], ["label", "count"], ["z", "5"], ["w", "6"], None, ["alone", "row"]]
    frame = spark.createDataFrame(cells(rows), "sheet string, row int, col int, value string")
    got = structure.sheet_tables(frame).orderBy("block_no", "part").collect()
    assert [(r["headers"], r["rows"]) for r in got] == [
        (["name", "size"], [["a", "1"], ["b", "2"]]),
        (["kind", "n"], [["x", "3"], ["y", "4"]]),
        (["label", "count"], [["z", "5"], ["w", "6"]]),
    ]
    long = [("t", i, c, "h" if i == 0 else str(i)) for i in range(1201) for c in range(2)]
    got = structure.sheet_tables(spark.createDataFrame(long, "sheet string, row int, col int, value string"))
    assert sorted(len(r["rows"]) for r in got.collect()) == [200, 500, 500]
    assert structure.sheet_tables(frame.limit(0)).count() == 0
    # two files with a sheet of one name
    twice = frame.withColumn("path", F.lit("a")).unionByName(frame.where("row < 3").withColumn("path", F.lit("b")))
    got = structure.sheet_tables(twice, by=("path", "sheet")).groupBy("path").count().collect()
    assert {r["path"]: r["count"] for r in got} == {"a": 3, "b": 1}


def test_json_shapes(spark):
    deep = "[" * 400 + "1" + "]" * 400
    texts = [
        (1, '{"a": [{"x": 1, "y": 2}, {"y": "z"}], "b": 3}'), (2, '{"q": 1}\nnot json\n[{"k": null, "l": 1}, {"k": 2}]'), (3, None),
        (4, '["a\\tb", "1\\t2"]'), (5, '{"k": "v", "x": 1, "y": null, "z": true}'), (6, '{"body": "a  b\\n1  2\\n3  4", "note": "plain"}'), (7, deep),
        (8, '[{"only": 1}, {"only": 2}]'), (9, '{"p": {"t": "one"}, "l": ["x", {"t": "y"}]}'),
    ]
    frame = spark.createDataFrame(texts, "doc_id int, text string")
    got = {(r["doc_id"], r["table_id"]): r for r in documents.tables_of_json(frame).collect()}
    assert sorted(got) == [(1, "$.a"), (2, "$"), (4, "$"), (5, "$"), (6, "$.body")]
    assert got[1, "$.a"]["headers"] == ["x", "y"] and [tuple(c) for c in got[1, "$.a"]["rows"][1]] == [("y", "z")]
    assert got[4, "$"]["headers"] == ["Column_1", "Column_2"] and got[5, "$"]["headers"] == ["Key", "Value"] and len(got[6, "$.body"]["rows"]) == 3
    said = {(r["doc_id"], r["path"]): r["content"] for r in documents.texts_of_json(frame).collect()}
    assert said == {(6, "$.note"): "plain", (9, "$.p.t"): "one", (9, "$.l"): "x", (9, "$.l.t"): "y"}


def test_json_lines_and_streams():
    assert documents.json_values('{"a":1}\n{"b":2}') == [{"a": 1}, {"b": 2}]
    assert documents.json_values('{"a":1}{"b":2} junk [3]') == [{"a": 1}, {"b": 2}, [3]]
    assert documents.json_values("") == [] and documents.json_values("no json") == []


def test_redaction(spark):
    deep = value = {}
    for _ in range(9):
        value["a"] = {}
        value = value["a"]
    value["password"] = "p"
    rows = ['{"user": {"Password": "p", "n": 1}}', "plain", json.dumps(deep)]
    frame = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [r[0] for r in frame.select(documents.redacted(F.col("t"))).collect()]
    # beyond the depth values stay as they are
    assert got == ['{"user": {"Password": "***", "n": 1}}', "plain", json.dumps(deep)]


def test_continued_tables(spark):
    rows = [(1, 0, 1, 2, 10.0, 210.0), (1, 1, 2, 2, 15.0, 216.0), (1, 2, 3, 2, 12.0, 212.0), (1, 3, 3, 3, 12.0, 212.0), (1, 4, 5, 2, 12.0, 212.0), (2, 0, 2, 2, 12.0, 212.0)]
    frame = spark.createDataFrame(rows, "doc_id int, table_no int, page int, n_columns int, x0 double, x1 double")
    got = {(r["doc_id"], r["table_no"]): r["first"] for r in structure.continued_groups(frame).collect()}
    assert got == {(1, 0): 0, (1, 1): 0, (1, 2): 0, (1, 3): 3, (1, 4): 4, (2, 0): 0}
    # two chains side by side, of which one ends; a table that both could take goes to the one that began first
    pages = [(1, 0, 1, 2, 0.0, 100.0), (1, 1, 1, 2, 20.0, 120.0), (1, 2, 2, 2, 10.0, 110.0), (1, 3, 3, 2, 12.0, 112.0), (1, 4, 3, 2, 300.0, 400.0), (1, 5, 4, 2, 290.0, 390.0)]
    frame = spark.createDataFrame(pages, "doc_id int, table_no int, page int, n_columns int, x0 double, x1 double")
    assert {r["table_no"]: r["first"] for r in structure.continued_groups(frame).collect()} == {0: 0, 1: 1, 2: 0, 3: 0, 4: 4, 5: 4}
    parts = [
        (1, 0, 0, ["Name", "Size"], [["a", "1"]]), (1, 1, 0, None, [["name ", "size"], ["b", "2"], ["", " "]]), (1, 2, 0, None, [["c", "3"]]), (1, 3, 3, ["X"], [["x"]]),
    ]
    frame = spark.createDataFrame(parts, "doc_id int, table_no int, first int, headers array<string>, rows array<array<string>>")
    got = {r["first"]: (r["headers"], r["rows"]) for r in structure.merged_tables(frame).collect()}
    assert got == {0: (["Name", "Size"], [["a", "1"], ["b", "2"], ["c", "3"]]), 3: (["X"], [["x"]])}


def test_image_budget(spark):
    rows = [(1, 1, k, f"h{k % 10}", 300, 300) for k in range(12)] + [(1, 2, 20 + k, f"g{k}", 300, 100 if k == 0 else 300) for k in range(12)]
    frame = spark.createDataFrame(rows, "doc int, page int, pos int, sha1 string, width int, height int")
    read = structure.images_to_read(frame, "doc", "page", "pos", most_page=8, most=12).where("read").orderBy("page", "pos").collect()
    assert [(r["page"], r["pos"]) for r in read] == [(1, k) for k in range(8)] + [(2, 21 + k) for k in range(4)]


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_file_router_and_office_files(spark, tmp_path):
    w, s = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    p = lambda t, style="": f'<w:p>{style}<w:r><w:t>{t}</w:t></w:r></w:p>'
    body = p("Policy", '<w:pPr><w:pStyle w:val="Heading1"/></w:pPr>') + p("Some words.") + f'<w:tbl><w:tr><w:tc>{p("a")}</w:tc><w:tc>{p("b")}</w:tc></w:tr></w:tbl>'
    made = {
        "x.docx": archive({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>'}),
        "y.xlsx": archive({
            "xl/workbook.xml": f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f'<sst xmlns="{s}"><si><t>name</t></si></sst>',
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{s}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="AB1"><v>7</v></c></row><row r="3"><c r="B3" t="inlineStr"><is><t>in</t></is></c></row></sheetData></worksheet>',
        }),
        "bomb.docx": archive({"word/document.xml": "0" * 3_000_000}), "fake.docx": b"no zip", "broken.docx": archive({"other.xml": "<a/>"}),
        "z.TXT": "Page 3 hello — wörld".encode(), "empty.md": b"", "odd.exe": b"x", "t.json": b'{"a": 1}',
    }
    for name, raw in made.items():
        (tmp_path / name).write_bytes(raw)
    routed = files.routed_files(spark, str(tmp_path))
    told = {r["path"].rsplit("/", 1)[1]: (r["kind"], r["error"]) for r in routed.collect()}
    assert told["x.docx"] == ("docx", None) and told["z.TXT"] == ("text", None) and told["t.json"] == ("json", None)
    assert told["bomb.docx"][1] == "compression_ratio" and told["fake.docx"][1] == "not_an_archive"
    assert told["empty.md"] == ("text", "empty_content")
    assert told["odd.exe"] == (None, "unsupported_type")
    items = files.docx_files(routed).where("path LIKE '%x.docx'").orderBy("pos").collect()
    assert [(r["kind"], r["style"], r["text"], r["rows"]) for r in items] == [
        ("paragraph", "Heading1", "Policy", None), ("paragraph", None, "Some words.", None), ("table", None, "", [["a", "b"]]),
    ]
    assert files.docx_files(routed).where("error IS NOT NULL").count() == 1
    got = files.xlsx_files(routed).orderBy("row", "col").collect()
    assert {r["sheet_no"] for r in got} == {0}
    assert [(r["sheet"], r["row"], r["col"], r["value"]) for r in got] == [("One", 0, 0, "name"), ("One", 0, 27, "7"), ("One", 2, 1, "in")]
    assert [r["text"] for r in files.text_files(routed).collect()] == ["hello w rld"]


def test_dates_and_styles_of_office_files():
    s, w = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    row = "".join(f'<c r="{c}1" s="{k}"><v>{v}</v></c>' for c, k, v in (("A", 0, "45292"), ("B", 1, "45292"), ("C", 2, "45292.5"), ("D", 3, "0.25"), ("E", 4, "7")))
    book = archive({
        "xl/workbook.xml": f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": f"""<styleSheet xmlns="{s}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode='0 "days"'/></numFmts>
            <cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="20"/><xf numFmtId="171"/></cellXfs></styleSheet>""",
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{s}"><sheetData><row r="1">{row}</row></sheetData></worksheet>',
    })
    assert [x["value"] for x in files.xlsx_cells(book)] == ["45292", "2024-01-01T00:00:00", "2024-01-01T12:00:00", "06:00:00", "7"]
    assert files.iso_date(0.5, True) == "12:00:00" and files.iso_date(1, True) == "1904-01-02T00:00:00"
    word = archive({
        "word/document.xml": f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="x1"/></w:pPr><w:r><w:t>It is so.</w:t></w:r></w:p></w:body></w:document>',
        "word/styles.xml": f'<w:styles xmlns:w="{w}"><w:style w:styleId="x1"><w:name w:val="heading 2"/></w:style></w:styles>',
    })
    assert files.docx_items(word) == [{"pos": 0, "kind": "paragraph", "style": "heading 2", "text": "It is so.", "rows": None}]


def test_headings_by_style_and_headed_tables(spark):
    rows = [(1, 0, "It is so.", "Heading 2"), (1, 1, "words of it.", None), (1, 2, "and it ends.", "Title"), (1, 3, "more words.", "Normal")]
    frame = spark.createDataFrame(rows, "doc_id int, pos int, text string, style string")
    got = structure.sections(frame, style="style").orderBy("pos").collect()
    assert [(r["title"], r["content"]) for r in got] == [("It is so.", "words of it."), ("and it ends.", "more words.")]
    assert structure.sections(frame).where("title IS NOT NULL").count() == 0
    made = [(1, [["a", " ", "c"], ["1"], ["", None], ["x", "y", "z", "cut"]]), (2, [["only", "head"], [" ", ""]]), (3, [])]
    got = structure.headed_tables(spark.createDataFrame(made, "k int, rows array<array<string>>")).collect()
    assert [(r["k"], r["headers"], r["rows"]) for r in got] == [(1, ["a", "Column_2", "c"], [["1", "", ""], ["x", "y", "z"]])]


def test_word_tables_across_columns_and_pages(spark):
    word = lambda page, x0, y, text, wide=20.0: (page, float(x0), float(y), float(x0) + wide, float(y) + 8, text)
    rows = [word(1, 10, 0, "Title", 150.0)]
    rows += [word(1, x, y, f"r{y}c{x}") for y in (20, 31, 42) for x in (10, 100, 200) if (y, x) != (31, 100)]
    rows += [word(1, 10, 70, "between", 150.0)] + [word(1, x, y, t) for y, x, t in ((90, 10, "k"), (90, 50, "v"), (101, 12, "k2"), (102, 50, "v2"))]
    rows += [word(2, 10, 0, "lone"), word(2, 90, 0, "line"), word(3, 10, 0, " ")]
    frame = spark.createDataFrame(rows, "page int, x0 double, top double, x1 double, bottom double, text string")
    got = structure.word_tables(frame, ("page",)).orderBy("page", "table_no").collect()
    assert [(r["page"], r["table_no"], r["n_columns"], r["rows"]) for r in got] == [
        (1, 0, 3, [["r20c10", "r20c100", "r20c200"], ["r31c10", "", "r31c200"], ["r42c10", "r42c100", "r42c200"]]),
        (1, 1, 2, [["k", "v"], ["k2", "v2"]]),
    ]
    assert (got[0]["x0"], got[0]["top"], got[0]["x1"], got[0]["bottom"]) == (10.0, 20.0, 220.0, 50.0)
    assert structure.word_tables(frame.limit(0), ("page",)).count() == 0


def test_files_to_chunks(spark, tmp_path):
    """Long prose in blocks and windows, a workbook's sheets, JSON outside tables; equal chunks once, numbers without gaps, broken files told."""
    from sparkloom.operators import ingest

    s, r = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = "".join(f'<row r="{k + 1}">' + "".join(f'<c r="{c}{k + 1}" t="inlineStr"><is><t>{t}</t></is></c>' for c, t in zip("AB", row, strict=True)) + "</row>" for k, row in enumerate([["city", "people"], ["Aden town", "12"], ["Basra town", "15"]]))
    book = {
        "xl/workbook.xml": f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="S" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{s}"><sheetData>{sheet}</sheetData></worksheet>',
    }
    prose = " ".join(f"word{k} stands here." for k in range(900))
    made = {"a.txt": prose.encode(), "b.xlsx": archive(book), "c.xlsx": archive(book), "d.json": b'{"note": "a note of its own here", "again": "a note of its own here"}', "e.md": b"", "f.docx": archive({"other.xml": "<a/>"})}
    for name, raw in made.items():
        (tmp_path / name).write_bytes(raw)
    routed = files.routed_files(spark, str(tmp_path))
    got = ingest.indexed_chunks(routed, 100, 10).orderBy("file_name", "seq").collect()
    by = {n: [x for x in got if x["file_name"] == n] for n in made}
    assert all([x["seq"] for x in rows] == list(range(len(rows))) for rows in by.values())
    said = " ".join(x["chunk"] for x in by["a.txt"])
    assert all(f"word{k} stands here." in said for k in range(0, 900, 50)) and max(x["token_count"] for x in by["a.txt"]) <= 110
    for n in ("b", "c"):
        assert [(x["chunk"], x["table_name"], x["parent_text"]) for x in by[f"{n}.xlsx"]] == [
            ("city: Aden town; people: 12", f"{n}__table_0", "city: Aden town; people: 12\ncity: Basra town; people: 15"), ("city: Basra town; people: 15", f"{n}__table_0", "city: Aden town; people: 12\ncity: Basra town; people: 15"),
        ]
    assert [x["chunk"] for x in by["d.json"]] == ["a note of its own here"]
    assert {r["path"].rsplit("/", 1)[1]: r["error"] for r in ingest.file_errors(routed).collect()} == {"e.md": "empty_content", "f.docx": "parse_failed: KeyError"}


def test_windows_run_over_a_whole_text_or_its_blocks(spark):
    from sparkloom.operators import ingest

    text = " ".join(f"word{k} stands here." for k in range(200))
    routed = files.routed(spark.createDataFrame([("in/a.txt", bytearray(text.encode()))], "path string, content binary"))
    whole = [r["chunk"] for r in ingest.indexed_chunks(routed, 40, 8, block_chars=None).orderBy("seq").collect()]
    words = text.split()
    assert whole == [" ".join(words[i : i + 40]) for i in range(0, len(words) - 8, 32)]
    assert [r["chunk"] for r in ingest.indexed_chunks(routed, 40, 8).collect()] != whole


def word_file(*body):
    """Bytes of a Word file of (style, text) and tables (rows of cells)."""
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda style, t: f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p>'
    table = lambda rows: "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc>{p('', c)}</w:tc>" for c in r) + "</w:tr>" for r in rows) + "</w:tbl>"
    parts = "".join(p(*x) if isinstance(x, tuple) else table(x) for x in body)
    return archive({"word/document.xml": f'<w:document xmlns:w="{w}"><w:body>{parts}</w:body></w:document>'})


def test_a_word_file_is_made_and_read_once(spark):
    """Sections, tables and errors of Word files come from one reading; each is checked and made once however often its chunks are used."""
    from sparkloom.operators import ingest

    made = {
        "a.docx": word_file(("", "- before it."), ("", ""), ("heading 1", "It is so."), [["k", ""], ["x", "1"], ["y", "2"]], ("", "words of it."), [["only", "head"]]),
        "b.docx": word_file(("", "alone."), [["k", "n"], ["z", "3"]]),
        "c.docx": word_file(), "d.docx": b"no archive", "e.docx": archive({"other.xml": "<a/>"}), "f.docx": b"", "g.md": b"", "h.exe": b"x", "i.txt": b"plain words here", "j.xlsx": b"no archive",
    }
    seen = spark.sparkContext.accumulator(0)

    @F.pandas_udf("binary")
    def counted(path: pd.Series, content: pd.Series) -> pd.Series:
        seen.add(int(path.str.endswith(".docx").sum()))
        return content

    rows = spark.createDataFrame([(p, bytearray(c)) for p, c in made.items()], "path string, content binary")
    routed = files.routed(rows.select("path", counted("path", "content").alias("content")))
    plain = [("a.docx", "TABLE", "It is so.", "k: x; Column_2: 1"), ("a.docx", "TABLE", "It is so.", "k: y; Column_2: 2"), ("a.docx", "TEXT", None, "- before it."), ("a.docx", "TEXT", "It is so.", "It is so.\nwords of it.")]
    plain += [("b.docx", "TABLE", "", "k: z; n: 3"), ("b.docx", "TEXT", None, "alone."), ("i.txt", "TEXT", None, "plain words here")]
    said = lambda chunks: sorted(((r["file_name"], r["kind"], r["title"], r["text"]) for r in ingest.segments(chunks).collect()), key=repr)
    assert said(ingest.parsed_chunks(routed)) == sorted(plain, key=repr)
    assert seen.value == 6
    errors = {"d.docx": "not_an_archive", "e.docx": "parse_failed: KeyError", "f.docx": "empty_content", "g.md": "empty_content", "h.exe": "unsupported_type", "j.xlsx": "not_an_archive"}
    assert said(ingest.outcomes(routed)) == sorted([*plain, *((p, ingest.ERROR, None, e) for p, e in errors.items())], key=repr)
    assert seen.value == 12
    assert sorted(tuple(r) for r in ingest.file_errors(routed).collect()) == sorted(errors.items())


def test_outline_is_sections_and_titled_tables(spark):
    lines = ["- one.", "words of it.", "|", "Scope", "Sizes:", "a | b", "Sizes:", "|", "plain words.", " ", "Sizes:", "|", "|", "1.2 More of it", "|", "", "Names:", "x | y"]
    rows = [(d, k, "table" if t == "|" else "paragraph", t, "heading 2" if (d + k) % 11 == 0 else None, [["c", str(k)]] if t == "|" else None) for d in range(3) for k, t in enumerate(lines[d:])]
    rows.append((9, 0, "error", "not_an_archive", None, None))
    items = spark.createDataFrame(rows, "doc_id int, pos int, kind string, text string, style string, rows array<array<string>>")
    got = structure.outline(items, style="style")
    of = lambda frame, *columns: sorted((tuple(r) for r in frame.select("doc_id", "pos", *columns).collect()), key=repr)
    assert of(got.where("kind = 'paragraph'"), "title", "content") == of(structure.sections(items.where("kind = 'paragraph'"), style="style"), "title", "content")
    tables = structure.with_breadcrumbs(items.where("kind <> 'error'"), F.col("kind") == "table", style="style")
    assert of(got.where("kind = 'table'"), "title", "rows") == of(tables, "title", "rows")
    assert of(got.where("kind = 'error'"), "title", "content") == [(9, 0, None, "not_an_archive")]


def test_table_segments(spark):
    rows = [(1, '{"headers":["id","n"],"rows":[{"id":"1","n":"x"},{"id":"2","n":"y"}]}'), (2, "prose"), (3, '{"headers":["a"],"rows":[]}'), (4, '{"rows":[{"a":"b"}]}')]
    got = tables.table_segments(spark.createDataFrame(rows, "k int, text string"), "k").orderBy("k", "sub_order").collect()
    assert [(r["k"], r["kind"], r["text"]) for r in got] == [(1, "exploded", "n: x"), (1, "exploded", "n: y")] + [(k, "plain", t) for k, t in rows[1:]]


def test_embedding_falls_back_to_single_items(spark):
    calls = []

    def embed(texts):
        calls.append(len(texts))
        if any("bad" in t for t in texts):
            raise ValueError("bad text")
        return embedding.hash_embedding(3)(texts)

    frame = spark.createDataFrame([(i, "bad" if i == 3 else f"t{i}") for i in range(10)], "id int, text string").coalesce(1)
    got = {r["id"]: r for r in embedding.embedded(frame, embed, 3, batch=4).collect()}
    assert all(len(got[i]["vector"]) == 3 and got[i]["error"] is None for i in got if i != 3)
    assert got[3]["vector"] is None and got[3]["error"] == "ValueError: bad text"
    wrong = embedding.embedded(frame, embedding.hash_embedding(2), 3).collect()
    assert all(r["vector"] is None for r in wrong)


def test_embedding_waits_for_a_busy_service(monkeypatch):
    """A transient failure is tried again after doubling waits, another one at once given up, the last one raised."""
    waits, calls = [], []
    monkeypatch.setattr(embedding.time, "sleep", waits.append)

    def busy(times, error=embedding.Transient):
        def embed(texts):
            calls.append(texts)
            if len(calls) <= times:
                raise error("503")
            return [[1.0]] * len(texts)

        return embed

    assert embedding.patient(busy(3), 4, 0.5, 1.5)(["a", "b"]) == [[1.0], [1.0]] and waits == [0.5, 1.0, 1.5] and len(calls) == 4
    calls.clear()
    with pytest.raises(embedding.Transient):
        embedding.patient(busy(9), 2, 0.5)(["a"])
    assert len(calls) == 3
    calls.clear()
    with pytest.raises(ValueError):
        embedding.patient(busy(9, ValueError), 2, 0.5)(["a"])
    assert len(calls) == 1


def test_summaries(spark):
    rows = [(1, i, f"Chunk {i}. Rest") for i in range(20)] + [(2, i, "A.") for i in range(300)] + [(3, 0, "Whole."), (3, 1, " ")]
    chunks = spark.createDataFrame(rows, "doc_id int, seq int, text string")
    got = {r["doc_id"]: r for r in summarize.summaries(chunks).collect()}
    assert "Chunk 0." in got[1]["summary"] and not got[1]["truncated"] and got[2]["truncated"]
    # a document of one batch is summarised by one call, not by notes of notes
    said = {r["doc_id"]: r["summary"] for r in summarize.summaries(chunks, lambda t: f"<{t}>").collect()}
    assert said[3] == "<Whole.>" and said[1].startswith("<## Part 1\n<Part 1 of 4.\n\nChunk 0. Rest\n\nChunk 1.") and said[1].count("## Part") == 4
    # 240 chunks are 40 notes, 7 of the next level, 2 of the one after
    calls = {r["doc_id"]: r["summary"] for r in summarize.summaries(chunks, lambda t: "f" if t == "f\n\nf" else "x" if "##" in t or set(t) <= {"x", "\n"} and t.count("x") < 7 and len(t) > 1 else t[:6]).collect()}
    assert calls[2] == "x"
    refined = {r["doc_id"]: r["summary"] for r in summarize.refined(chunks, lambda t: f"{len(t)}").collect()}
    assert set(refined) == {1, 2, 3} and refined[3] == str(len("Whole."))


def test_overview(spark):
    rows = [(1, i, f"c{i}") for i in range(30)] + [(2, 0, "only")]
    got = {r["doc_id"]: r for r in summarize.overviews(spark.createDataFrame(rows, "doc_id int, seq int, text string"), lambda t: t).collect()}
    assert got[2]["summary"] == "only" and not got[2]["truncated"]
    assert got[1]["summary"].split("\n")[0] == "c0" and got[1]["summary"].split("\n")[-1] == "c29" and got[1]["summary"].count("[…]") == 7


def test_reusable_summary(spark):
    rows = [("i1", 1, "en", "old", 1), ("i2", 1, "en", "new", 2), ("i3", 1, "ar", "x", 3)]
    frame = spark.createDataFrame(rows, "id string, doc_id int, lang string, summary string, built_at int")
    assert [tuple(r) for r in summarize.reusable(frame, "ar").collect()] == [(1, "en", "new")]


def test_headings(spark):
    cases = {
        "Purpose:": True, "HR & Admin: the team is responsible for:": False, "5.1 Internal rules": True, "Section IV of it": True, "scope": True, "Short Title": True, "ends here.": False,
        "a | b": False, "ALL CAPITALS IN A LONGER LINE": True, "The Rules of the House and Garden": True, "the rules of the house and garden": False, "": False,
    }
    frame = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["h"] for r in frame.select("t", sc.is_heading(F.col("t")).alias("h")).collect()} == cases


def test_scalars(spark):
    import uuid

    ns = "5561cc57-1a7e-43a9-81de-1c93c6192ccf"
    assert one(spark, sc.uuid5(ns, F.lit("doc:7"))) == str(uuid.uuid5(uuid.UUID(ns), "doc:7"))
    assert one(spark, sc.term_id(F.lit("قلم"))) == int.from_bytes(__import__("hashlib").blake2b("قلم".encode(), digest_size=4).digest(), "big")
    assert one(spark, sc.file_name(F.lit("a\\b/ c.pdf "))) == "c.pdf" and one(spark, sc.file_name(F.lit("dir/"))) is None
    assert [one(spark, sc.extension(F.lit(x))) for x in (".env", "a.b.pdf", "report.", "x")] == ["", ".pdf", "", ""]
    assert one(spark, sc.transit_version(F.lit("vault:v12:abc"))) == 12 and one(spark, sc.transit_version(F.lit("v12"))) is None
    assert one(spark, sc.snippet(F.lit("short"), F.array(F.lit("x")))) is None
    assert one(spark, tx.header_line(F.array(F.lit("10"), F.lit(" 20 "), F.lit("id")))) == "10; 20"
    assert one(spark, tx.is_rtl(F.lit("abc"), F.lit("ar"))) and not one(spark, tx.is_rtl(F.lit("قلم"), F.lit("en"))) and one(spark, tx.is_rtl(F.lit("قلم a"), F.lit("auto")))
    assert one(spark, tx.sentences(F.lit("a\n \nb"))) == ["a\n \nb"] and one(spark, tx.sentences(F.lit("a\n\nb"))) == ["a", "b"]
