"""Queries over text and scalar functions, with SQL.

The tables hold no Arabic, so Arabic and mixed texts are made of the documents'
own by mapping letters: of every three documents one becomes Arabic, one mixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import scalars as sc
from sparkloom.functions import text as tx
from sparkloom.operators import usage
from sparkloom.plans.registry import query
from sparkloom.sources import documents, table

LATIN = "abcdefghijklmnopqrstuvwxyz"
SCRIPT = "ابتثجحخدذرزسشصضطفعغيإقكلمنه"[: len(LATIN)]
MIXED_LATIN, MIXED_SCRIPT = "aeinrstuy", "اأفيةىؤئه"
TASHKEEL = "ً"

_VARIED = (
    f"CASE doc_id % 3 WHEN 0 THEN replace(translate(lower(text), '{LATIN}', '{SCRIPT}'), 'ا', 'ا{TASHKEEL}')"
    f" WHEN 1 THEN translate(text, '{MIXED_LATIN}', '{MIXED_SCRIPT}') ELSE text END"
)


def varied(text: Column) -> Column:
    """Arabic, mixed and plain texts by document id."""
    arabic = F.replace(F.translate(F.lower(text), LATIN, SCRIPT), F.lit("ا"), F.lit("ا" + TASHKEEL))
    return F.when(F.col("doc_id") % 3 == 0, arabic).when(F.col("doc_id") % 3 == 1, F.translate(text, MIXED_LATIN, MIXED_SCRIPT)).otherwise(text)


_ENGLISH_STOP = ", ".join(f"'{w}'" for w in tx.ENGLISH_STOP_WORDS)
_ARABIC_STOP = ", ".join(f"'{w}'" for w in tx.ARABIC_STOP_WORDS)
_NORMAL = "regexp_replace(translate(t, 'إأآؤئةى', 'اااءءهي'), '[\\x{064B}-\\x{065F}\\x{0670}]', '', 'g')"
_TEXTS = f"""
d AS (SELECT doc_id, {_VARIED} AS t FROM documents),
n AS (SELECT doc_id, t, {_NORMAL} AS normal, len(regexp_replace(t, '[^\\x{{0600}}-\\x{{06FF}}]+', '', 'g')) AS arabic,
    len(regexp_replace(t, '[^a-zA-Z]+', '', 'g')) AS latin FROM d),
k AS (SELECT *, CASE WHEN coalesce(arabic + latin, 0) = 0 THEN 'unknown' WHEN arabic / (arabic + latin) > 0.6 THEN 'arabic'
    WHEN arabic / (arabic + latin) < 0.3 THEN 'english' ELSE 'mixed' END AS language FROM n)
"""


@query(f"WITH {_TEXTS} SELECT doc_id, sha256(normal) AS normal_sha256, language, 2 * arabic > len(regexp_replace(t, '[^\\p{{L}}]+', '', 'g')) AS rtl FROM k")
def h1_normalized_texts(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", varied(F.col("text")).alias("t"))
    t = F.col("t")
    return docs.select("doc_id", F.sha2(tx.normalize_arabic(t), 256).alias("normal_sha256"), tx.detect_language(t).alias("language"), tx.is_rtl(t).alias("rtl"))


@query(f"""
WITH {_TEXTS},
a AS (SELECT *, list_filter(regexp_extract_all(lower(normal), '[\\x{{0600}}-\\x{{06FF}}\\p{{L}}\\p{{N}}\\p{{M}}_]+'),
        lambda x: len(x) >= 2 AND NOT list_contains([{_ARABIC_STOP}], x)) AS ar,
    list_filter(string_split_regex(regexp_replace(lower(t), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+'),
        lambda x: len(x) >= 2 AND NOT list_contains([{_ENGLISH_STOP}], x)) AS en FROM k),
x AS (SELECT doc_id, language, unnest(ar) AS w, generate_subscripts(ar, 1) AS i, 0 AS part FROM a WHERE language NOT IN ('english', 'arabic') AND trim(t) <> ''
    UNION ALL SELECT doc_id, language, unnest(en), generate_subscripts(en, 1), 1 FROM a WHERE language NOT IN ('english', 'arabic') AND trim(t) <> ''),
first AS (SELECT doc_id, w FROM x QUALIFY row_number() OVER (PARTITION BY doc_id, w ORDER BY part, i) = 1),
both_kinds AS (SELECT doc_id, count(*) AS n, sum(len(w)) AS chars FROM first GROUP BY doc_id)
SELECT a.doc_id, language, CAST(CASE language WHEN 'arabic' THEN len(ar) WHEN 'english' THEN len(en) ELSE coalesce(n, 0) END AS BIGINT) AS n_tokens,
    CAST(CASE language WHEN 'arabic' THEN len(array_to_string(ar, '')) WHEN 'english' THEN len(array_to_string(en, '')) ELSE coalesce(chars, 0) END AS BIGINT) AS token_chars
FROM a LEFT JOIN both_kinds b USING (doc_id)
""")
def h3_tokens_by_language(spark: SparkSession, folder: str) -> DataFrame:
    # the join of an array is a barrier: texts, letter counts, languages and tokens are made once for the columns that follow
    docs = documents(spark, folder).select("doc_id", F.explode(F.array(varied(F.col("text")))).alias("t"))
    docs = docs.select("doc_id", "t", F.explode(F.array(tx.detect_language(F.col("t")))).alias("language"))
    said = docs.select("doc_id", "language", F.explode(F.array(tx.tokenize(F.col("t"), kind=F.col("language")))).alias("tokens"))
    return said.select("doc_id", "language", F.size("tokens").cast("long").alias("n_tokens"), F.length(F.array_join("tokens", "")).cast("long").alias("token_chars"))


_QUESTIONS = ("How many files about ", "list the docs ", "summarise ", "What is the file ", "tell me ", "how many documents ")
_METADATA = "|".join(p for p in tx.METADATA_PATTERNS if p.isascii())
_TOPICAL = "|".join(p for p in tx.TOPICAL_PATTERNS if p.isascii())
_SUMMARIZE = "|".join(p for p in tx.SUMMARIZE_PATTERNS if p.isascii())


@query(f"""
WITH q AS (SELECT conv_id, turn, CASE turn % {len(_QUESTIONS)} {' '.join(f"WHEN {i} THEN '{q}'" for i, q in enumerate(_QUESTIONS))} END || text AS q FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(q, '(?i){_METADATA}') THEN CASE WHEN regexp_matches(q, '(?i){_TOPICAL}') THEN 'content' ELSE 'metadata' END
    WHEN regexp_matches(q, '(?i){_SUMMARIZE}') THEN 'summarize_doc' ELSE 'content' END AS intent FROM q
""")
def h8_intents(spark: SparkSession, folder: str) -> DataFrame:
    lead = F.element_at(F.array(*map(F.lit, _QUESTIONS)), (F.col("turn") % len(_QUESTIONS) + 1).cast("int"))
    turns = table(spark, folder, "conversations").withColumn("q", F.concat(lead, F.col("text")))
    return turns.select("conv_id", "turn", tx.classify_intent(F.col("q")).alias("intent"))


@query("""
WITH t AS (SELECT doc_id, 'page  12 ' || text || ' ~~~~ x == {{{ y Page 3, [---] Pages 4' AS t FROM documents),
a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\\bPage\\s*\\d+\\b', ' ', 'gi'), '[~_*={}\\[\\]\\-]{3,}', ' ', 'g'),
    '[^\\x09\\x0A\\x0D\\x20-\\x7E\\x{0600}-\\x{06FF}]', ' ', 'g') AS t FROM t),
b AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(t, '\\s{3,}', ' ', 'g'), '\\n{2,}', chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM a)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_chars, sha256(t) AS clean_sha256 FROM b
""")
def h12_clean_texts(spark: SparkSession, folder: str) -> DataFrame:
    dirty = F.concat(F.lit("page  12 "), F.col("text"), F.lit(" ~~~~ x == {{{ y Page 3, [---] Pages 4"))
    docs = documents(spark, folder).select("doc_id", tx.clean_text(dirty).alias("t"))
    return docs.select("doc_id", F.length("t").cast("long").alias("n_chars"), F.sha2("t", 256).alias("clean_sha256"))


@query("""
WITH s AS (SELECT doc_id, string_split_regex(regexp_replace(text, '([.!?؟])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS parts,
    list_filter(string_split_regex(text, '\\r\\n|[\\n\\r]'), lambda x: trim(x) <> '') AS lines FROM documents)
SELECT doc_id, CAST(CASE WHEN len(parts) > 1 THEN len(parts) ELSE len(lines) END AS BIGINT) AS n_sentences,
    sha256(array_to_string(CASE WHEN len(parts) > 1 THEN parts ELSE lines END, '|')) AS sentences_sha256 FROM s
""")
def h14_json_sentences(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", F.explode(F.array(sc.json_sentences(F.col("text")))).alias("s"))
    return docs.select("doc_id", F.size("s").cast("long").alias("n_sentences"), F.sha2(F.array_join("s", "|"), 256).alias("sentences_sha256"))


@query(f"""
WITH t AS (SELECT page_id, regexp_replace(regexp_replace(html, '<[^>]*>', '    ', 'g'), 'e', '______', 'g') AS t FROM pages),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '\\n{{3,}}', chr(10) || chr(10), 'g'), ' {{2,}}', ' ', 'g'), '[_\\-]{{5,}}', '', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM t)
SELECT page_id, sha256(t) AS clean_sha256, len(t) >= {tx.MEANINGFUL_LENGTH} AND len(translate(t, ' ' || chr(10), '')) > 0
    AND len(regexp_replace(t, '[^\\p{{L}}\\p{{N}}\\x{{0600}}-\\x{{06FF}}]+', '', 'g')) / len(translate(t, ' ' || chr(10), '')) >= {tx.MEANINGFUL_RATIO} AS meaningful FROM c
""")
def h17_ocr_texts(spark: SparkSession, folder: str) -> DataFrame:
    raw = F.regexp_replace(F.regexp_replace("html", "<[^>]*>", "    "), "e", "______")
    pages = table(spark, folder, "pages").select("page_id", sc.clean_ocr_text(raw).alias("t"))
    return pages.select("page_id", F.sha2("t", 256).alias("clean_sha256"), tx.is_meaningful(F.col("t")).alias("meaningful"))


@query(f"""
WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(lower(p_type) || ' ' || p_brand, ' ') AS b FROM part),
m AS (SELECT p_partkey, a[1:2] AS a, [a[1], b[1]] AS b FROM p),
s AS (SELECT p_partkey, a, b, list_sum(list_transform(range(1, 3), lambda i: CASE WHEN lower(trim(a[i])) = lower(trim(b[i])) THEN CAST(1 AS DOUBLE)
    WHEN contains(lower(a[i]), lower(b[i])) OR contains(lower(b[i]), lower(a[i])) THEN CAST({sc.PARTIAL_MATCH} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)) AS total FROM m)
SELECT p_partkey, CASE WHEN len(a) = len(b) THEN total / len(b) ELSE 0 END AS similarity FROM s
""")
def h20_header_likeness(spark: SparkSession, folder: str) -> DataFrame:
    words = F.split("p_name", " ")
    other = F.array(words[0], F.split(F.lower("p_type"), " ")[0])
    return table(spark, folder, "part").select("p_partkey", sc.column_similarity(F.slice(words, 1, 2), other).alias("similarity"))


@query(f"""
WITH u AS (SELECT page_id, url, regexp_extract(url, '([^/\\\\]*)$', 1) AS name FROM pages),
v AS (SELECT page_id, url, CASE WHEN len(trim(name)) BETWEEN 1 AND {sc.MOST_NAME} THEN trim(name) END AS name FROM u)
SELECT page_id, name, CASE WHEN name IS NULL THEN '' WHEN regexp_matches(name, '^.+\\.[^.]+$') THEN regexp_extract(name, '(\\.[^.]+)$', 1) ELSE '' END AS ext,
    coalesce(regexp_matches(name, '^[a-z0-9][a-z0-9_-]*$') AND len(name) <= {sc.MOST_AGENT_KEY}, false) AS agent_key,
    CASE WHEN regexp_matches('text/' || lower(name), '{sc.MIME}') THEN 'text/' || lower(name) END AS mime, false AS digest FROM v
""")
def h33_file_names(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", sc.file_name(F.col("url")).alias("name"))
    name = F.col("name")
    return pages.select(
        "page_id", "name", F.coalesce(sc.extension(name), F.lit("")).alias("ext"), sc.is_agent_key(name).alias("agent_key"),
        sc.content_type(F.concat(F.lit("Text/"), name)).alias("mime"), sc.is_sha256(name).alias("digest"),
    )


NAMESPACE = "5561cc57-1a7e-43a9-81de-1c93c6192ccf"  # a fixed value: the namespace of chunk points


@query(f"""
WITH c AS (SELECT conv_id, turn, text, conv_id || ':' || turn AS name FROM conversations),
h AS (SELECT *, left(sha1(from_hex('{NAMESPACE.replace('-', '')}') || encode(name)), 32) AS h FROM c)
SELECT conv_id, turn, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' ||
    substr('89ab89ab89ab89ab', strpos('0123456789abcdef', substr(h, 17, 1)), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id,
    sha1(text) AS text_sha1, sha256('{{"conv":' || conv_id || ',"text":"x","turn":' || turn || '}}') AS request_hash
FROM h
""")
def h30_point_ids(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return table(spark, folder, "conversations").select(
        "conv_id", "turn", sc.uuid5(NAMESPACE, name).alias("point_id"), F.sha1("text").alias("text_sha1"),
        sc.canonical_hash(turn=F.col("turn"), text=F.lit("x"), conv=F.col("conv_id")).alias("request_hash"),
    )


@query("""
WITH e AS (SELECT event_id, user_id, ts, epoch_ms(ts) || '-' || (event_id % 7) AS entry_id, 'vault:v' || (event_id % 5) || ':abc' AS cipher,
    'media.' || event_type || '.done.v' || (event_id % 3) AS kind, (SELECT max(ts) FROM events) AS now FROM events)
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 5 AS INTEGER) END AS key_version,
    round((epoch_us(now) // 1000 - epoch_us(ts) // 1000) / 1000.0, 3) AS age, CAST(greatest(1, ceil((epoch_us(now) - epoch_us(ts)) / 1e6)) AS BIGINT) AS wait,
    regexp_matches(kind, '^[a-z]+\\.[a-z_]+\\.[a-z_]+\\.v[0-9]+$') AS valid_type, event_id % 4 = 1 AS unchanged,
    'deleted+' || user_id || '@removed.invalid' AS email,
    CAST(date_trunc('month', ts) + INTERVAL 1 MONTH AS DATE) AS month_reset, CAST(ts AS DATE) + 1 AS day_reset
FROM e
""")
def h35_event_scalars(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    now = F.lit(events.agg(F.max("ts")).first()[0]).cast("timestamp")
    at = F.col("ts").cast("timestamp")
    events = events.withColumns({
        "entry_id": F.concat(F.unix_millis(at).cast("string"), F.lit("-"), (F.col("event_id") % 7).cast("string")),
        "cipher": F.concat(F.when(F.col("event_id") % 2 == 0, "vault:v").otherwise("plain:v"), (F.col("event_id") % 5).cast("string"), F.lit(":abc")),
        "kind": F.concat(F.lit("media."), "event_type", F.lit(".done.v"), (F.col("event_id") % 3).cast("string")),
        "stored_hash": F.when(F.col("event_id") % 4 == 1, "h").when(F.col("event_id") % 4 == 2, "other"),
    })
    from sparkloom.operators.mutation import redacted_email
    from sparkloom.streaming import is_event_type

    return events.select(
        "event_id", sc.transit_version(F.col("cipher")).alias("key_version"), F.round(sc.entry_age(F.col("entry_id"), now), 3).alias("age"),
        sc.seconds_until(now, at).alias("wait"), is_event_type(F.col("kind")).alias("valid_type"),
        sc.unchanged(F.col("stored_hash"), F.lit(2), F.lit("h"), F.lit(2)).alias("unchanged"), redacted_email(F.col("user_id")).alias("email"),
        usage.reset_at("month", at).cast("date").alias("month_reset"), usage.reset_at("day", at).cast("date").alias("day_reset"),
    )


_KEYWORDS = ", ".join(f"'{w}'" for w in sc.HEADING_KEYWORDS)
_TITLE_STOP = ", ".join(f"'{w}'" for w in sc.TITLE_STOP_WORDS)


@query(f"""
WITH r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
l AS (SELECT doc_id, pos, CASE pos % 6 WHEN 1 THEN '2.1 ' || raw WHEN 2 THEN upper(raw) WHEN 3 THEN 'Scope:' WHEN 4 THEN '- ' || raw
    WHEN 5 THEN raw || ' | x' ELSE raw END AS raw FROM r),
n AS (SELECT doc_id, pos, raw, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS t FROM l),
w AS (SELECT *, string_split(t, ' ') AS ws, regexp_matches(t, '^\\p{{Lu}}') AS capital FROM n),
s AS (SELECT *, list_filter(ws, lambda x: regexp_matches(x, '\\p{{L}}') AND NOT list_contains([{_TITLE_STOP}], lower(x))) AS sig FROM w)
SELECT doc_id, CAST(pos AS INTEGER) AS pos,
    t <> '' AND NOT regexp_matches(t, '[{sc.SENTENCE_ENDINGS}]$') AND NOT contains(t, '|') AND (
        (ends_with(t, ':') AND len(t) <= {sc.LABEL_CHARS} AND NOT regexp_matches(t, ':\\s+\\S'))
        OR regexp_matches(t, '{sc.NUMBERED}') OR regexp_matches(t, '{sc.SECTIONED}')
        OR lower(trim(regexp_replace(regexp_replace(t, '{sc.LEADING_NUMBER}', ''), ':+$', ''))) IN ({_KEYWORDS})
        OR (len(ws) <= {sc.SHORT_HEADING_WORDS} AND capital)
        OR (len(ws) BETWEEN {sc.TITLE_WORDS[0]} AND {sc.TITLE_WORDS[1]} AND ((regexp_matches(t, '\\p{{L}}') AND NOT regexp_matches(t, '[\\p{{Ll}}\\p{{Lt}}\\p{{Lm}}\\p{{Lo}}]'))
            OR (len(sig) > 0 AND capital AND len(list_filter(sig, lambda x: NOT regexp_matches(x, '^\\p{{Lu}}'))) = 0)))) AS heading,
    ends_with(t, ':') AS weak, regexp_matches(raw, '^\\s*([-•*▪–—]|\\d+[.\\)])') AS bullet,
    contains(raw, '|') AND len(list_filter(string_split(raw, '|'), lambda x: trim(x) <> '')) >= 2 AS tabular
FROM s
""")
def h37_line_kinds(spark: SparkSession, folder: str) -> DataFrame:
    lines = documents(spark, folder).select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    kind, raw = F.col("pos") % 6, F.col("raw")
    raw = (
        F.when(kind == 1, F.concat(F.lit("2.1 "), raw)).when(kind == 2, F.upper(raw)).when(kind == 3, "Scope:")
        .when(kind == 4, F.concat(F.lit("- "), raw)).when(kind == 5, F.concat(raw, F.lit(" | x"))).otherwise(raw)
    )
    line = F.col("line")
    return lines.select("doc_id", "pos", raw.alias("line")).select(
        "doc_id", "pos", sc.is_heading(line).alias("heading"), sc.is_weak_heading(line).alias("weak"), sc.is_bullet(line).alias("bullet"), sc.looks_tabular(line).alias("tabular")
    )


@query("""
WITH c AS (SELECT l_orderkey, count(*) FILTER (WHERE l_returnflag = 'R') AS t, count(*) FILTER (WHERE l_returnflag = 'N') AS x, count(*) FILTER (WHERE l_returnflag = 'A') AS i
    FROM lineitem GROUP BY l_orderkey),
r AS (SELECT *, t / greatest(t + x, 1) AS ratio FROM c),
k AS (SELECT *, CASE WHEN t = 0 AND x = 0 THEN 'empty' WHEN x = 0 OR ratio > 0.6 THEN 'structured' WHEN t > 0 AND ratio > 0.2 THEN 'semi_structured' ELSE 'unstructured' END AS k FROM r)
SELECT l_orderkey, k || '_json' AS json_class, CASE WHEN k = 'empty' THEN CASE WHEN i > 0 THEN 'docx_images' ELSE 'docx_empty' END ELSE 'docx_' || k || '_text' END AS docx_class,
    CASE WHEN t > 0 AND x > 0 THEN 'pdf_mixed' WHEN t > 0 THEN 'pdf_tables' WHEN x > 0 THEN 'pdf_text' WHEN i > 0 THEN 'pdf_images' ELSE 'pdf_empty' END AS pdf_class FROM k
""")
def h39_document_classes(spark: SparkSession, folder: str) -> DataFrame:
    flag = F.col("l_returnflag")
    counts = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(*[F.count_if(flag == k).alias(n) for k, n in (("R", "t"), ("N", "x"), ("A", "i"))])
    t, x, i = (F.col(c) for c in "txi")
    return counts.select("l_orderkey", sc.json_class(t, x).alias("json_class"), sc.docx_class(t, x, i).alias("docx_class"), sc.pdf_class(t, x, i).alias("pdf_class"))


@query(f"""
WITH s AS (SELECT doc_id, text, list_filter(string_split_regex(text, '[.؟!؛۔]+|\\n{{2,}}'), lambda s: len(s) > 20) AS hl FROM documents),
f AS (SELECT doc_id, text, CASE WHEN len(hl) > 0 THEN array_to_string(hl[1:{sc.HIGHLIGHTS}], '{sc.HIGHLIGHT_JOIN}') ELSE left(text, {sc.SNIPPET_TEXT}) END AS first FROM s),
c AS (SELECT doc_id, CASE WHEN len(first) >= {sc.SNIPPET_LEAST} THEN first WHEN len(left(text, {sc.SNIPPET_TEXT})) >= {sc.SNIPPET_LEAST} THEN left(text, {sc.SNIPPET_TEXT}) END AS chosen FROM f)
SELECT doc_id, sha256(left(chosen, {sc.SNIPPET_MOST})) AS snippet_sha256, CAST(len(left(chosen, {sc.SNIPPET_MOST})) AS INTEGER) AS n_chars FROM c
""")
def h22_snippets(spark: SparkSession, folder: str) -> DataFrame:
    highlights = F.filter(F.split("text", tx.SENTENCE_SPLIT), lambda s: F.length(s) > 20)
    docs = documents(spark, folder).select("doc_id", sc.snippet(F.col("text"), highlights).alias("s"))
    return docs.select("doc_id", F.sha2("s", 256).alias("snippet_sha256"), F.length("s").alias("n_chars"))


@query("""
WITH p AS (SELECT p_partkey, '$.' || replace(p_name, ' ', '.') || '.x' AS path, [p_brand, p_name, ' ', p_brand, p_type] AS parts,
    [p_type, 'a' || p_size, ''] AS vals, CASE WHEN p_size % 3 = 0 THEN ' ' ELSE p_name END AS t, CASE WHEN p_size % 2 = 0 THEN ['f'] ELSE [] END AS files FROM part)
SELECT p_partkey, '$.' || array_to_string(string_split(path[3:], '.')[1:2], '.') AS section,
    parts[1] || ' — ' || parts[2] || ' — ' || parts[5] AS crumbs, CAST(1 AS DOUBLE) / 3 + CASE WHEN regexp_matches(vals[1], '[0-9]') THEN CAST(1 AS DOUBLE) / 3 ELSE 0 END AS numeric,
    CASE WHEN trim(t) <> '' THEN t WHEN len(files) > 0 THEN '' ELSE '{"k":1}' END AS said
FROM p
""")
def h40_part_labels(spark: SparkSession, folder: str) -> DataFrame:
    path = F.concat(F.lit("$."), F.replace("p_name", F.lit(" "), F.lit(".")), F.lit(".x"))
    values = F.array("p_type", F.concat(F.lit("a"), F.col("p_size").cast("string")), F.lit(""))
    said = F.when(F.col("p_size") % 3 == 0, " ").otherwise(F.col("p_name"))
    files = F.when(F.col("p_size") % 2 == 0, F.array(F.lit("f"))).otherwise(F.array().cast("array<string>"))
    return table(spark, folder, "part").select(
        "p_partkey", sc.section_key(path).alias("section"), tx.breadcrumb(F.array("p_brand", "p_name", F.lit(" "), "p_brand", "p_type")).alias("crumbs"),
        sc.numeric_ratio(values).alias("numeric"), sc.turn_content(said, files, F.lit('{"k":1}')).alias("said"),
    )
