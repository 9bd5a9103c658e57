"""Queries over document structure, folds and injected functions, with SQL.

Lines of documents stand in for paragraphs, parts and line items for tables,
blocks and images.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import scalars as sc
from sparkloom.functions import text as tx
from sparkloom.operators import chunking, embedding, structure, summarize, tables
from sparkloom.operators import documents as parsing
from sparkloom.plans.registry import query
from sparkloom.sources import documents, table

_KEYWORDS = ", ".join(f"'{w}'" for w in sc.HEADING_KEYWORDS)
_STOP = ", ".join(f"'{w}'" for w in sc.TITLE_STOP_WORDS)
_HEADING = f"""(t <> '' AND NOT regexp_matches(t, '[{sc.SENTENCE_ENDINGS}]$') AND NOT contains(t, '|') AND (
    (ends_with(t, ':') AND len(t) <= {sc.LABEL_CHARS} AND NOT regexp_matches(t, ':\\s+\\S')) OR regexp_matches(t, '{sc.NUMBERED}') OR regexp_matches(t, '{sc.SECTIONED}')
    OR lower(trim(regexp_replace(regexp_replace(t, '{sc.LEADING_NUMBER}', ''), ':+$', ''))) IN ({_KEYWORDS})
    OR (len(string_split(t, ' ')) <= {sc.SHORT_HEADING_WORDS} AND regexp_matches(t, '^\\p{{Lu}}'))
    OR (len(string_split(t, ' ')) BETWEEN {sc.TITLE_WORDS[0]} AND {sc.TITLE_WORDS[1]} AND ((regexp_matches(t, '\\p{{L}}') AND NOT regexp_matches(t, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]'))
        OR (regexp_matches(t, '^\\p{{Lu}}') AND len(list_filter(string_split(t, ' '), lambda x: regexp_matches(x, '\\p{{L}}') AND NOT list_contains([{_STOP}], lower(x)))) > 0
            AND len(list_filter(string_split(t, ' '), lambda x: regexp_matches(x, '\\p{{L}}') AND NOT list_contains([{_STOP}], lower(x)) AND NOT regexp_matches(x, '^\\p{{Lu}}'))) = 0)))))"""
_LINES = f"""
r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, CAST(generate_subscripts(string_split(text, chr(10)), 1) - 1 AS INTEGER) AS pos FROM documents),
l AS (SELECT doc_id, pos, CASE pos % 7 WHEN 3 THEN 'Scope ' || pos || ':' WHEN 4 THEN raw || ' | x | y' WHEN 5 THEN '- ' || raw WHEN 6 THEN '2.' || pos || ' Heading' ELSE raw END AS text FROM r),
n AS (SELECT *, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM l WHERE trim(text) <> '')
"""


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    lines = documents(spark, folder).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    k, raw, pos = F.col("pos") % 7, F.col("raw"), F.col("pos").cast("string")
    text = (
        F.when(k == 3, F.concat(F.lit("Scope "), pos, F.lit(":"))).when(k == 4, F.concat(raw, F.lit(" | x | y")))
        .when(k == 5, F.concat(F.lit("- "), raw)).when(k == 6, F.concat(F.lit("2."), pos, F.lit(" Heading"))).otherwise(raw)
    )
    return lines.select("doc_id", "pos", text.alias("text"))


@query(f"""
WITH {_LINES},
h AS (SELECT *, {_HEADING} AS title, lead(text) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM n),
o AS (SELECT *, title AND NOT (ends_with(t, ':') AND contains(coalesce(next, ''), '|') AND len(list_filter(string_split(coalesce(next, ''), '|'), lambda x: trim(x) <> '')) >= 2) AS opens FROM h),
s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM o),
p AS (SELECT *, CASE WHEN section = 0 AND NOT regexp_matches(text, '^\\s*([-•*▪–—]|\\d+[.\\)])') THEN pos ELSE -1 END AS part FROM s)
SELECT doc_id, min(pos) AS pos, max(CASE WHEN opens THEN text END) AS title, sha256(coalesce(string_agg(CASE WHEN NOT opens THEN text END, chr(10) ORDER BY pos), '')) AS content_sha256
FROM p GROUP BY doc_id, section, part
""")
def m7_sections(spark: SparkSession, folder: str) -> DataFrame:
    return structure.sections(_lines(spark, folder)).select("doc_id", "pos", "title", F.sha2("content", 256).alias("content_sha256"))


@query(f"""
WITH {_LINES}, h AS (SELECT *, pos % 7 = 4 AS is_table, {_HEADING} AND pos % 7 <> 4 AS title FROM n),
w AS (SELECT *, max(CASE WHEN title AND NOT ends_with(t, ':') THEN (pos, text) END) OVER o AS sec, max(CASE WHEN title AND ends_with(t, ':') THEN (pos, text) END) OVER o AS cap FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY pos))
SELECT doc_id, pos, CASE WHEN sec IS NULL AND cap IS NULL THEN '' WHEN cap IS NULL OR cap[1] < sec[1] THEN sec[2] WHEN sec IS NULL OR sec[2] = cap[2] THEN cap[2] ELSE sec[2] || ' — ' || cap[2] END AS title FROM w WHERE is_table
""")
def m8_table_titles(spark: SparkSession, folder: str) -> DataFrame:
    lines = _lines(spark, folder).where(F.trim("text") != "")
    return structure.with_breadcrumbs(lines, F.col("pos") % 7 == 4).select("doc_id", "pos", "title")


@query("""
WITH r AS (SELECT p_partkey // 60 AS sheet, CAST(p_partkey % 60 AS INTEGER) AS i, p_name, CAST(p_size AS VARCHAR) AS size FROM part),
d AS (SELECT sheet, i // 12 AS block, i, p_name, size FROM r WHERE i % 12 BETWEEN 1 AND 10 AND NOT (sheet = 0 AND i < 12))
SELECT CAST(sheet AS VARCHAR) AS sheet, CAST(dense_rank() OVER (PARTITION BY sheet ORDER BY block) - 1 AS INTEGER) AS block_no, CAST(0 AS INTEGER) AS part, 'name,size' AS headers, n_rows, rows_sha256 FROM (
    SELECT sheet, block, CAST(count(*) AS INTEGER) AS n_rows, sha256(string_agg(p_name || '=' || size, ';' ORDER BY i)) AS rows_sha256 FROM d
    WHERE (sheet, block) IN (SELECT (sheet, i // 12) FROM r WHERE i % 12 = 0) GROUP BY ALL HAVING count(*) >= 2)
""")
def m1_sheet_tables(spark: SparkSession, folder: str) -> DataFrame:
    i = (F.col("p_partkey") % 60).cast("int")
    kind = i % 12
    first = F.when(kind == 0, "name").when(kind < 11, F.col("p_name"))
    second = F.when(kind == 0, "size").when(kind < 11, F.col("p_size").cast("string"))
    rows = table(spark, folder, "part").select(F.floor(F.col("p_partkey") / 60).cast("string").alias("sheet"), i.alias("row"), F.posexplode(F.array(first, second)).alias("col", "value"))
    # the first sheet lacks its first row, and so the header of its first block
    found = structure.sheet_tables(rows.where("NOT (sheet = '0' AND row < 12)"))
    text = F.array_join(F.transform("rows", lambda r: F.array_join(r, "=")), ";")
    return found.select("sheet", "block_no", "part", F.array_join("headers", ",").alias("headers"), F.size("rows").alias("n_rows"), F.sha2(text, 256).alias("rows_sha256"))


@query(f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_linenumber >= 2 AND coalesce(CASE WHEN l_partkey % 5 <> 0 THEN l_quantity * 2 END, 100) >= {structure.LEAST_ACCURACY}
""")
def m11_solid_tables(spark: SparkSession, folder: str) -> DataFrame:
    made = table(spark, folder, "lineitem").withColumns({"n_columns": F.col("l_linenumber"), "accuracy": F.when(F.col("l_partkey") % 5 != 0, F.col("l_quantity") * 2)})
    return structure.solid_tables(made).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(f"""
WITH i AS (SELECT o_custkey AS doc, o_orderkey AS pos, CAST(o_orderkey // 8 AS BIGINT) AS page, substr(sha1(CAST(o_orderkey % 23 AS VARCHAR)), 1, 8) AS h, o_orderkey % 13 > 2 AS large FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY page, pos) AS k FROM i),
f AS (SELECT doc, pos, h, k, large AS read FROM n WHERE k = 1),
x AS (SELECT a.doc, a.pos, a.page, a.k, a.large AND NOT EXISTS (SELECT 1 FROM n b WHERE b.doc = a.doc AND b.k < a.k AND b.h = a.h) AS good FROM n a),
c AS (SELECT *, sum(good::INT) OVER (PARTITION BY doc ORDER BY k) AS total FROM x)
SELECT doc, pos, good AND total <= 5 AS read FROM c
""")
def m13_images_to_read(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("o_orderkey")
    digest = F.substring(F.sha1((key % 23).cast("string")), 1, 8)
    images = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("doc"), F.floor(key / 8).alias("page"), key.alias("pos"), digest.alias("sha1"), F.lit(400).alias("width"), F.when(key % 13 > 2, 300).otherwise(90).alias("height")
    )
    # pages are too small here to meet their own cap; the document's is met
    return structure.images_to_read(images, "doc", "page", "pos", most=5).select("doc", "pos", "read")


@query(f"""
WITH t AS (SELECT o_orderkey AS page, CAST(1 AS INTEGER) AS table_no, o_custkey % 40 AS x0, 400 AS top, o_custkey % 40 + 60 AS x1 FROM orders),
b AS (SELECT l_orderkey AS page, l_partkey % 90 AS x0, l_partkey % 90 + 20 AS x1, l_suppkey * 5 AS bottom, 'T' || l_partkey || CASE WHEN l_partkey % 3 = 0 THEN ':' ELSE '' END AS text FROM lineitem),
a AS (SELECT t.page, b.text, row_number() OVER (PARTITION BY t.page ORDER BY b.bottom DESC, b.text DESC) AS k FROM t JOIN b USING (page) WHERE b.bottom <= t.top + {structure.ABOVE} AND b.x1 >= t.x0 AND b.x0 <= t.x1),
n AS (SELECT page, max(CASE WHEN k = 1 THEN text END) AS near, max(CASE WHEN k = 2 THEN text END) AS outer_text FROM a WHERE k <= 2 GROUP BY page)
SELECT t.page, table_no, CASE WHEN near IS NULL THEN '' WHEN ends_with(near, ':') AND outer_text IS NOT NULL AND NOT ends_with(outer_text, ':') THEN outer_text || ' — ' || near ELSE near END AS caption
FROM t LEFT JOIN n USING (page)
""")
def m12_captions(spark: SparkSession, folder: str) -> DataFrame:
    left = F.col("o_custkey") % 40
    made = table(spark, folder, "orders").select(F.col("o_orderkey").alias("page"), F.lit(1).alias("table_no"), left.alias("x0"), F.lit(400).alias("top"), (left + 60).alias("x1"))
    x = F.col("l_partkey") % 90
    said = F.concat(F.lit("T"), F.col("l_partkey").cast("string"), F.when(F.col("l_partkey") % 3 == 0, ":").otherwise(""))
    blocks = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("page"), x.alias("x0"), (x + 20).alias("x1"), (F.col("l_suppkey") * 5).alias("bottom"), said.alias("text"))
    return structure.captions(made, blocks)


@query("""
SELECT conv_id, turn, md5(text) AS digest, round(CAST(CAST('0x' || substr(md5(text), 1, 4) AS INTEGER) AS DOUBLE) / 65535, 9) AS first,
    round(CAST(CAST('0x' || substr(md5(text), 13, 4) AS INTEGER) AS DOUBLE) / 65535, 9) AS last FROM conversations
""")
def m17_embedded_turns(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    vectors = embedding.embedded(turns, embedding.hash_embedding(4), 4)
    return vectors.select("conv_id", "turn", F.md5("text").alias("digest"), F.round(F.col("vector")[0], 9).alias("first"), F.round(F.col("vector")[3], 9).alias("last"))


_SENTENCES = f"list_filter(list_transform(string_split_regex(text, '{tx.SENTENCE_SPLIT}'), lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')"


@query(f"""
WITH RECURSIVE s AS (SELECT conv_id, turn, len({_SENTENCES}) AS n, len(text) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
f AS (SELECT conv_id, turn, i, 0 AS g, n AS held, 0 AS b, 1 AS items, c AS chars FROM s WHERE i = 1
    UNION ALL SELECT s.conv_id, s.turn, s.i, CASE WHEN f.held + s.n > 8 THEN f.g + 1 ELSE f.g END, CASE WHEN f.held + s.n > 8 THEN s.n ELSE f.held + s.n END,
        CASE WHEN f.items >= 3 OR f.chars + s.c > 600 THEN f.b + 1 ELSE f.b END, CASE WHEN f.items >= 3 OR f.chars + s.c > 600 THEN 1 ELSE f.items + 1 END,
        CASE WHEN f.items >= 3 OR f.chars + s.c > 600 THEN s.c ELSE f.chars + s.c END
    FROM f JOIN s ON s.conv_id = f.conv_id AND s.i = f.i + 1)
SELECT conv_id, turn, CAST(g AS INTEGER) AS sentence_group, CAST(b AS INTEGER) AS batch FROM f
""")
def e11_packed_turns(spark: SparkSession, folder: str) -> DataFrame:
    sizes = table(spark, folder, "conversations").select("conv_id", "turn", F.size(tx.sentences(F.col("text"))).alias("n"), F.length("text").alias("c"))
    return chunking.batched(sizes, ["conv_id"], ["turn"], {"sentence_group": ("n", 1 << 30, 8), "batch": ("c", 3, 600)}).drop("n", "c")


@query("""
WITH v AS (SELECT vec_id AS i, vec_id // 20 AS seg, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
e AS (SELECT a.seg, a.i, d, sum(b.v[d]) / count(*) AS x FROM v a JOIN v b ON a.seg = b.seg AND b.i BETWEEN a.i - 1 AND a.i + 1, range(1, 65) AS r(d) GROUP BY ALL),
s AS (SELECT seg, i, list(x ORDER BY d) AS sm FROM e GROUP BY ALL),
g AS (SELECT seg, i, 1 - list_cosine_similarity(sm, lead(sm) OVER (PARTITION BY seg ORDER BY i)) AS distance FROM s),
q AS (SELECT *, quantile_cont(distance, 0.95) OVER (PARTITION BY seg) AS cut FROM g)
SELECT seg AS segment_id, i AS sentence_no, round(distance, 6) AS distance, CAST(coalesce(sum(coalesce(distance > cut, false)::INT) OVER (PARTITION BY seg ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS part FROM q
""")
def e8_semantic_parts(spark: SparkSession, folder: str) -> DataFrame:
    segment = F.floor(F.col("vec_id") / 20)
    rows = table(spark, folder, "embeddings").select(segment.alias("segment_id"), F.col("vec_id").alias("sentence_no"), F.col("embedding").alias("vector"))
    return chunking.semantic_parts(rows).select("segment_id", "sentence_no", F.round("distance", 6).alias("distance"), "part")


@query("""
WITH t AS (SELECT conv_id, turn, turn // 4 AS part, text FROM conversations)
SELECT conv_id, part, sha256(string_agg(text, ' ' ORDER BY turn)) AS text_sha256, count(*) AS n FROM t GROUP BY ALL
""")
def e9_joined_parts(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.floor(F.col("turn") / 4).alias("part"), "text")
    return chunking.joined_parts(rows, "conv_id", "turn").select("conv_id", "part", F.sha2("text", 256).alias("text_sha256"), "n")


@query("""
WITH s AS (SELECT conv_id AS doc, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id) - 1 AS last FROM conversations WHERE trim(text) <> ''),
k AS (SELECT * FROM s WHERE last < 8 OR list_contains(list_transform(range(8), lambda i: (i * last + 3) // 7), pos)),
g AS (SELECT *, coalesce(pos - lag(pos) OVER (PARTITION BY doc ORDER BY pos) > 1, false) AS gap FROM k)
SELECT doc AS conv_id, md5(string_agg(CASE WHEN gap THEN '[…]' || chr(10) ELSE '' END || text, chr(10) ORDER BY pos)) AS summary, bool_or(gap) AS truncated FROM g GROUP BY doc
""")
def n1_overviews(spark: SparkSession, folder: str) -> DataFrame:
    chunks = table(spark, folder, "conversations").select("conv_id", F.col("turn").alias("seq"), "text")
    return summarize.overviews(chunks, _digest, "conv_id")


def _digest(text: str) -> str:
    import hashlib

    return hashlib.md5(text.encode()).hexdigest()


_NOTES = "string_agg(note, chr(10) || chr(10) ORDER BY b)"


@query(f"""
WITH s AS (SELECT conv_id // 10 AS doc, text, row_number() OVER (PARTITION BY conv_id // 10 ORDER BY conv_id, turn) - 1 AS pos, count(*) OVER (PARTITION BY conv_id // 10) > {summarize.WINDOW} AS truncated FROM conversations WHERE trim(text) <> ''),
b AS (SELECT doc, truncated, pos // 6 AS b, string_agg(text, chr(10) || chr(10) ORDER BY pos) AS t FROM s WHERE pos < {summarize.WINDOW} GROUP BY ALL),
n AS (SELECT *, count(*) OVER (PARTITION BY doc) AS n FROM b),
l0 AS (SELECT doc, truncated, b, n, '## Part ' || (b + 1) || chr(10) || md5('Part ' || (b + 1) || ' of ' || n || '.' || chr(10) || chr(10) || t) AS note FROM n WHERE n > 1),
l1 AS (SELECT doc, truncated, b // 6 AS b, (n + 5) // 6 AS n, md5({_NOTES}) AS note FROM l0 WHERE n > 6 GROUP BY doc, truncated, b // 6, n),
l2 AS (SELECT doc, truncated, b // 6 AS b, (n + 5) // 6 AS n, md5({_NOTES}) AS note FROM l1 WHERE n > 6 GROUP BY doc, truncated, b // 6, n)
SELECT doc, md5(t) AS summary, truncated FROM n WHERE n = 1
UNION ALL SELECT doc, md5({_NOTES}), truncated FROM (SELECT * FROM l0 WHERE n <= 6 UNION ALL SELECT doc, truncated, b, n, note FROM l1 WHERE n <= 6 UNION ALL SELECT doc, truncated, b, n, note FROM l2) GROUP BY doc, truncated
""")
def n1_summaries(spark: SparkSession, folder: str) -> DataFrame:
    """Map, fold and reduce over ten conversations at a time; no batch of six messages reaches the characters of a batch."""
    place = (F.col("conv_id") * 1000 + F.col("turn")).alias("seq")
    chunks = table(spark, folder, "conversations").select(F.floor(F.col("conv_id") / 10).alias("doc"), place, "text")
    return summarize.summaries(chunks, _digest, "doc")


@query("""
WITH RECURSIVE s AS (SELECT conv_id, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations WHERE trim(text) <> ''),
w AS (SELECT conv_id, pos // 6 AS b, string_agg(text, chr(10) ORDER BY pos) AS t FROM s GROUP BY ALL), n AS (SELECT conv_id, max(b) + 1 AS n FROM w GROUP BY conv_id),
r AS (SELECT conv_id, b, md5(t) AS running FROM w WHERE b = 0
    UNION ALL SELECT w.conv_id, w.b, md5('Summary so far:' || chr(10) || running || chr(10) || chr(10) || 'Part ' || (w.b + 1) || ' of ' || n || ':' || chr(10) || t) FROM r JOIN w ON w.conv_id = r.conv_id AND w.b = r.b + 1 JOIN n ON n.conv_id = w.conv_id)
SELECT conv_id, running AS summary, false AS truncated FROM r JOIN n USING (conv_id) WHERE b = n - 1
""")
def n2_refined(spark: SparkSession, folder: str) -> DataFrame:
    # no batch of six messages exceeds the characters of a batch here
    chunks = table(spark, folder, "conversations").select("conv_id", F.col("turn").alias("seq"), "text")
    return summarize.refined(chunks, _digest, "conv_id")


@query("""
WITH d AS (SELECT doc_id, lang, chr(97 + CAST(doc_id % 5 AS INTEGER)) AS id, doc_id // 3 AS doc FROM documents)
SELECT doc, max_by(lang, (doc_id, id)) AS lang, max_by(doc_id, (doc_id, id)) AS summary FROM d WHERE lang <> 'en' GROUP BY doc
""")
def n3_reusable_summaries(spark: SparkSession, folder: str) -> DataFrame:
    letter = F.char(97 + F.col("doc_id") % 5)
    stored = documents(spark, folder).select(F.floor(F.col("doc_id") / 3).alias("doc"), "lang", F.col("doc_id").alias("built_at"), letter.alias("id"), F.col("doc_id").alias("summary"))
    return summarize.reusable(stored, "en", "doc")


@query("""
SELECT p_partkey AS doc_id, '$' AS table_id, 'Key,Value' AS headers, CAST(4 AS INTEGER) AS n_rows, '{"size":' || p_size || '}' AS first FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, '$.rows', 'brand,n', CAST(2 AS INTEGER), '{"size":' || p_size || '}' FROM part WHERE p_partkey % 3 = 1
UNION ALL SELECT p_partkey, '$[0].grid', 'Column_1,Column_2', CAST(2 AS INTEGER), '{"size":' || p_size || '}' FROM part WHERE p_partkey % 3 = 2
""")
def m4_json_tables(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    pair = F.concat(F.lit('{"size":'), size, F.lit("}"))
    shapes = (
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit('{"size":'), size, F.lit(',"a":1,"b":null,"c":"x"}')))
        .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit('{"note":"one","rows":[{"brand":"x"},{"n":'), size, F.lit("}]}")))
        .otherwise(F.concat(F.lit('[{"grid":["a\\tb","'), size, F.lit('  2"],"said":"words"}]')))
    )
    docs = table(spark, folder, "part").select(F.col("p_partkey").alias("doc_id"), shapes.alias("text"), pair.alias("first"))
    found = parsing.tables_of_json(docs).join(docs.select("doc_id", "first"), "doc_id")
    return found.select("doc_id", "table_id", F.array_join("headers", ",").alias("headers"), F.size("rows").alias("n_rows"), "first")


@query("""
SELECT p_partkey AS doc_id, '$.a.note' AS path, p_name || chr(10) || p_brand AS content FROM part UNION ALL SELECT p_partkey, '$.b', p_type FROM part
""")
def m5_json_texts(spark: SparkSession, folder: str) -> DataFrame:
    inner = F.array(F.struct(F.col("p_name").alias("note")), F.struct(F.col("p_brand").alias("note")))
    body = F.to_json(F.struct(inner.alias("a"), F.col("p_type").alias("b"), F.lit(3).alias("k")))
    return parsing.texts_of_json(table(spark, folder, "part").select(F.col("p_partkey").alias("doc_id"), body.alias("text")))


@query("""
WITH c AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_custkey AS c FROM orders)
SELECT k, CASE WHEN c % 4 = 0 THEN 'plain' ELSE 'exploded' END AS kind, CASE WHEN c % 4 = 0 THEN 'not json' ELSE 'status: ' || s || '; cust: ' || c END AS text FROM c
""")
def m16_table_segments(spark: SparkSession, folder: str) -> DataFrame:
    row = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").cast("string").alias("cust"), F.lit("1").alias("id"))
    body = F.to_json(F.struct(F.array(F.lit("status"), F.lit("id"), F.lit("cust")).alias("headers"), F.array(row).alias("rows")))
    chunks = table(spark, folder, "orders").select(F.col("o_orderkey").alias("k"), F.when(F.col("o_custkey") % 4 == 0, "not json").otherwise(body).alias("text"))
    return tables.table_segments(chunks, "k").select("k", "kind", "text")
