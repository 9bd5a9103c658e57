"""Queries over relational, aggregating and numbering operators, with SQL.

Orders stand in for files (workspace ``o_custkey % 7``), customers for users,
line items for chunks, conversations for messages, parts for tools and blocks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.functions import text as tx
from sparkloom.operators import relational, statistics, usage
from sparkloom.plans.registry import query
from sparkloom.sources import documents, table


def files(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    deleted = F.when(F.col("o_orderstatus") == "P", F.col("o_orderdate"))
    return orders.select(
        (F.col("o_custkey") % 7).alias("workspace_id"), F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("kind"),
        F.floor("o_totalprice").cast("long").alias("size"), "o_orderdate", deleted.alias("deleted_at"),
    )


_FILES = """
f AS (SELECT o_custkey % 7 AS workspace_id, o_orderkey AS id, o_orderpriority AS kind, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderdate,
    CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS deleted_at FROM orders)
"""


@query(f"WITH {_FILES} SELECT workspace_id, id, kind FROM f WHERE workspace_id = (SELECT workspace_id FROM f WHERE id = 5) AND id = 5")
def a1_file_by_key(spark: SparkSession, folder: str) -> DataFrame:
    rows = files(spark, folder)
    workspace = rows.where("id = 5").select("workspace_id").first()[0]
    return relational.get(rows, workspace, 5).select("workspace_id", "id", "kind")


@query(f"WITH {_FILES} SELECT id, kind, size FROM f WHERE workspace_id = 3 AND deleted_at IS NULL")
def b1_live_files_of_tenant(spark: SparkSession, folder: str) -> DataFrame:
    rows = files(spark, folder)
    nobody = relational.scoped(rows, None)
    return relational.soft_deleted(relational.scoped(rows, 3)).unionByName(nobody).select("id", "kind", "size")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%')")
def b5_chunks_in_space(spark: SparkSession, folder: str) -> DataFrame:
    urgent = table(spark, folder, "orders").where(F.col("o_orderpriority").startswith("1")).select("o_orderkey")
    return relational.within(table(spark, folder, "lineitem"), "l_orderkey", urgent).select("l_orderkey", "l_linenumber")


@query("SELECT doc_id FROM documents WHERE lang IN ('en', 'de') AND source IN ('src0', 'src3', 'src5') AND doc_id % 2 = 0")
def b7_documents_by_payload(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    payload = F.struct("lang", "source", (F.col("doc_id") % 2 == 0).alias("even"), F.lit(None).cast("string").alias("space"))
    rows = docs.select("doc_id", payload.alias("payload"))
    found = rows.where(relational.payload_filter({"lang": ["en", "de"], "source": ["src0", "src3", "src5"], "even": True}))
    # a key that no row has matches nothing
    return found.unionByName(rows.where(relational.payload_filter({"space": "s"}))).select("doc_id")


@query("""
WITH u AS (SELECT user_id, max(ts) AS seen FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events)
SELECT user_id, coalesce(seen >= now - INTERVAL 2 HOUR, false) AND user_id % 3 <> 0 AS online FROM u, n
""")
def b9_online_users(spark: SparkSession, folder: str) -> DataFrame:
    seen = table(spark, folder, "events").groupBy("user_id").agg(F.max("ts").cast("timestamp").alias("seen"))
    now = F.lit(seen.agg(F.max("seen")).first()[0])
    return seen.select("user_id", (relational.seen_recently("seen", now, 7200) & (F.col("user_id") % 3 != 0)).alias("online"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN p_brand ELSE p_name END AS section, p_name AS file_name, p_brand AS title, p_type AS kind FROM part
""")
def b10_citations(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    section = F.when(F.col("p_size") % 3 != 0, F.col("p_name"))
    metadata = parts.select("p_partkey", section.alias("section"), F.col("p_brand").alias("title"), F.col("p_name").alias("file_name"), "p_type", "p_size")
    cited = metadata.withColumn("section", F.coalesce("section", "title"))
    return relational.remapped(cited, {"p_partkey": "p_partkey", "section": "section", "file_name": "file_name", "title": "title", "kind": "p_type"})


#: role, permission
GRANTS = [("AUTOMOBILE", "write"), ("AUTOMOBILE", "read"), ("BUILDING", "read"), ("MACHINERY", "write"), ("FURNITURE", "none")]


@query("SELECT DISTINCT c_nationkey AS workspace_id, c_custkey AS user_id FROM customer WHERE c_mktsegment IN ('AUTOMOBILE', 'MACHINERY')")
def b13_permitted_users(spark: SparkSession, folder: str) -> DataFrame:
    users = table(spark, folder, "customer").select(F.col("c_nationkey").alias("workspace_id"), F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("role"))
    return relational.permitted(users, spark.createDataFrame(GRANTS, "role string, permission string"), "write")


@query("SELECT c_custkey FROM customer WHERE c_acctbal > 0 AND c_custkey % 4 <> 0")
def b14_indexed_points(spark: SparkSession, folder: str) -> DataFrame:
    collection = F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment"))
    point = F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_name"))
    rows = table(spark, folder, "customer").select("c_custkey", collection.alias("collection"), point.alias("point_id"))
    return relational.complete_pairs(rows, "collection", "point_id").select("c_custkey")


@query("""
SELECT l_orderkey, l_linenumber, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_suppkey % 3 = o_custkey % 3
""")
def c2_items_with_status(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem").select((F.col("l_suppkey") % 3).alias("workspace_id"), F.col("l_orderkey").alias("document_id"), "l_linenumber")
    docs = table(spark, folder, "orders").select((F.col("o_custkey") % 3).alias("workspace_id"), F.col("o_orderkey").alias("document_id"), "o_orderstatus")
    return relational.same_tenant(items, docs, "document_id").select(F.col("document_id").alias("l_orderkey"), "l_linenumber", "o_orderstatus")


@query("""
WITH st AS (SELECT p_brand || '.' || (p_size % 10) AS name, 'static' AS origin, min(p_partkey) AS id FROM part WHERE p_size <= 25 GROUP BY 1),
dy AS (SELECT p_brand || '.' || (p_size % 10) AS name, 'dynamic' AS origin, max(p_partkey) AS id FROM part WHERE p_size > 20 GROUP BY 1)
SELECT * FROM st UNION ALL SELECT * FROM dy ANTI JOIN st USING (name) ORDER BY name LIMIT 200
""")
def c11_tool_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part").withColumn("name", F.concat("p_brand", F.lit("."), (F.col("p_size") % 10).cast("string")))
    static = parts.where("p_size <= 25").groupBy("name").agg(F.lit("static").alias("origin"), F.min("p_partkey").alias("id"))
    dynamic = parts.where("p_size > 20").groupBy("name").agg(F.lit("dynamic").alias("origin"), F.max("p_partkey").alias("id"))
    return relational.with_defaults(static, dynamic, ["name"]).orderBy("name").limit(200)


@query("""
WITH b AS (SELECT l_orderkey AS page, l_linenumber AS n, l_partkey % 50 AS x0, l_suppkey % 40 AS y0, l_partkey % 50 + 10 + l_linenumber AS x1, l_suppkey % 40 + 8 AS y1 FROM lineitem),
a AS (SELECT o_orderkey AS page, o_custkey % 30 AS x0, o_custkey % 20 AS y0, o_custkey % 30 + 30 AS x1, o_custkey % 20 + 20 AS y1 FROM orders)
SELECT b.page, n, coalesce(greatest(0, least(b.x1, a.x1) - greatest(b.x0, a.x0)) * greatest(0, least(b.y1, a.y1) - greatest(b.y0, a.y0)) >= 0.5 * (b.x1 - b.x0) * (b.y1 - b.y0), false) AS covered
FROM b LEFT JOIN a ON a.page = b.page
""")
def c12_covered_blocks(spark: SparkSession, folder: str) -> DataFrame:
    left, top = F.col("l_partkey") % 50, F.col("l_suppkey") % 40
    blocks = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("n"), left.alias("x0"), top.alias("y0"), (left + 10 + F.col("l_linenumber")).alias("x1"), (top + 8).alias("y1")
    )
    x, y = F.col("o_custkey") % 30, F.col("o_custkey") % 20
    areas = table(spark, folder, "orders").select(F.col("o_orderkey").alias("page"), x.alias("x0"), y.alias("y0"), (x + 30).alias("x1"), (y + 20).alias("y1"))
    return relational.overlapping(blocks, areas, "page").select("page", "n", "covered")


@query("""
WITH c AS (SELECT doc_id, count(*) AS chunk_count, count(*) FILTER (WHERE s = '') AS blank FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents) GROUP BY doc_id)
SELECT d.doc_id, coalesce(chunk_count, 0) AS chunk_count FROM documents d LEFT JOIN c USING (doc_id)
""")
def d6_chunk_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    chunks = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("chunk"))
    counts = chunks.groupBy("doc_id").agg(F.count("*").alias("chunk_count"))
    return docs.join(counts, "doc_id", "left").select("doc_id", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


@query("SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL")
def d27_users_by_role(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))


@query("""
WITH k AS (SELECT l_orderkey, CASE l_partkey % 4 WHEN 0 THEN 'table' WHEN 1 THEN 'OCR' WHEN 2 THEN 'TEXT' ELSE 'note' END AS kind FROM lineitem)
SELECT l_orderkey, count(*) FILTER (WHERE upper(kind) = 'TABLE') AS table_chunks, count(*) FILTER (WHERE upper(kind) = 'OCR') AS ocr_chunks,
    count(*) FILTER (WHERE upper(kind) NOT IN ('TABLE', 'OCR')) AS text_chunks FROM k GROUP BY l_orderkey
""")
def d18_chunk_kinds(spark: SparkSession, folder: str) -> DataFrame:
    from sparkloom.operators.tables import kind_counts

    k = F.col("l_partkey") % 4
    kind = F.when(k == 0, "table").when(k == 1, "OCR").when(k == 2, "TEXT").otherwise("note")
    return kind_counts(table(spark, folder, "lineitem").select("l_orderkey", kind.alias("kind")), "l_orderkey")


@query(f"""
WITH b AS (SELECT doc_id % 50 AS path, doc_id, text AS content FROM documents)
SELECT path, count(*) AS num, CAST(sum(len(content)) AS BIGINT) AS total_len, avg(len(content)) AS avg_len, CAST(min(len(content)) AS INTEGER) AS min_len, CAST(max(len(content)) AS INTEGER) AS max_len,
    round(avg(CASE WHEN len(content) < {statistics.SHORT_BLOCK} THEN 1.0 ELSE 0 END), 9) AS short_ratio,
    count(*) > {statistics.MANY_BLOCKS} OR avg(CASE WHEN len(content) < {statistics.SHORT_BLOCK} THEN 1.0 ELSE 0 END) > {statistics.SHORT_SHARE} OR avg(len(content)) < {statistics.LEAST_AVERAGE} AS merge
FROM b GROUP BY path
""")
def d21_block_statistics(spark: SparkSession, folder: str) -> DataFrame:
    blocks = documents(spark, folder).select((F.col("doc_id") % 50).alias("path"), F.col("text").alias("content"))
    return statistics.block_statistics(blocks, "path").withColumn("short_ratio", F.round("short_ratio", 9))


@query("""
SELECT conv_id, role, sha256(string_agg(text, chr(10) ORDER BY turn)) AS text_sha256 FROM conversations GROUP BY conv_id, role
""")
def d22_texts_by_role(spark: SparkSession, folder: str) -> DataFrame:
    joined = statistics.joined_by(table(spark, folder, "conversations"), ["conv_id", "role"], "text", "turn")
    return joined.select("conv_id", "role", F.sha2("text", 256).alias("text_sha256"))


@query("""
WITH c AS (SELECT conv_id, CASE WHEN turn % 4 <> 1 THEN turn * 10 END AS p, CASE WHEN turn % 5 <> 2 THEN turn * 7 END AS c, text FROM conversations)
SELECT conv_id, CAST(sum(coalesce(p, greatest(1, len(text) // 4))) AS BIGINT) AS prompt_tokens, CAST(sum(coalesce(c, greatest(1, len(text) // 4))) AS BIGINT) AS completion_tokens,
    bool_or(p IS NULL OR c IS NULL) AS estimated FROM c GROUP BY conv_id
""")
def d23_metered_turns(spark: SparkSession, folder: str) -> DataFrame:
    calls = table(spark, folder, "conversations").select(
        "conv_id", F.when(F.col("turn") % 4 != 1, F.col("turn") * 10).alias("prompt_tokens"), F.when(F.col("turn") % 5 != 2, F.col("turn") * 7).alias("completion_tokens"),
        F.col("text").alias("prompt_text"), F.col("text").alias("completion_text"),
    )
    return statistics.metered(calls, "conv_id")


@query("""
SELECT l_orderkey, CASE WHEN count(*) = 0 THEN 100 ELSE CAST(floor(count(*) FILTER (WHERE l_linestatus = 'F') * 100 / count(*)) AS BIGINT) END AS finished,
    CAST(CASE WHEN max(l_linenumber) > 5 THEN 100 ELSE least(floor(min(l_linenumber) * 100 / max(l_linenumber)), 99) END AS BIGINT) AS built FROM lineitem GROUP BY l_orderkey
""")
def d24_progress(spark: SparkSession, folder: str) -> DataFrame:
    from sparkloom.operators.mutation import finished_percent, percent

    jobs = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.count_if(F.col("l_linestatus") == "F").alias("ended"), F.count("*").alias("items"), F.min("l_linenumber").alias("done"), F.max("l_linenumber").alias("total")
    )
    status = F.when(F.col("total") > 5, "succeeded").otherwise("running")
    return jobs.select("l_orderkey", finished_percent(F.col("ended"), F.col("items")).alias("finished"), percent(status, F.col("done"), F.col("total")).alias("built"))


@query(f"""
WITH t AS (SELECT page_id % 20 AS page, regexp_replace(html, '<[^>]*>', '', 'g') AS t FROM pages),
m AS (SELECT page, len(trim(t, chr(10) || ' ')) >= {tx.MEANINGFUL_LENGTH} AND len(translate(trim(t, chr(10) || ' '), ' ' || chr(10), '')) > 0
    AND len(regexp_replace(t, '[^\\p{{L}}\\p{{N}}\\x{{0600}}-\\x{{06FF}}]+', '', 'g')) / len(translate(t, ' ' || chr(10), '')) >= {tx.MEANINGFUL_RATIO} AS good FROM t)
SELECT page, count(*) FILTER (WHERE good) AS with_text, count(*) FILTER (WHERE NOT good) AS without_text FROM m GROUP BY page
""")
def d25_image_counts(spark: SparkSession, folder: str) -> DataFrame:
    images = table(spark, folder, "pages").select((F.col("page_id") % 20).alias("page"), F.regexp_replace("html", "<[^>]*>", "").alias("t"))
    return statistics.image_counts(images, "page", tx.is_meaningful(F.col("t")))


@query("""
WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 <> 0 THEN 'TABLE' ELSE 'TEXT' END AS kind, CASE WHEN turn = 4 THEN 'given' END AS table_name FROM conversations)
SELECT conv_id, turn, kind, CASE WHEN kind = 'TABLE' AND table_name IS NULL
    THEN 'doc' || conv_id || '__table_' || (sum(CASE WHEN kind = 'TABLE' AND table_name IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) - 1)
    ELSE table_name END AS table_name FROM c
""")
def e14_table_names(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("turn") % 3 != 0, "TABLE").otherwise("TEXT")
    chunks = table(spark, folder, "conversations").select(
        "conv_id", "turn", kind.alias("kind"), F.when(F.col("turn") == 4, "given").alias("table_name"), F.concat(F.lit("doc"), F.col("conv_id").cast("string")).alias("stem")
    )
    return statistics.table_names(chunks, "conv_id", "stem", "turn").drop("stem")


@query("""
WITH s AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq FROM conversations),
cut AS (SELECT conv_id, max(seq) // 2 AS half FROM s GROUP BY conv_id)
SELECT conv_id, turn, seq FROM s JOIN cut USING (conv_id) WHERE seq > half
""")
def e15_message_numbers(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    line, group = Window.partitionBy("conv_id").orderBy("turn"), Window.partitionBy("conv_id")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", F.row_number().over(line).alias("seq"), F.floor(F.count("*").over(group) / 2).alias("half"))
    stored, new = rows.where("seq <= half").select("conv_id", "seq"), rows.where("seq > half").select("conv_id", "turn")
    return statistics.appended(new, stored, "conv_id", "turn")


@query("SELECT turn, role FROM conversations WHERE conv_id = (SELECT min(conv_id) FROM conversations) AND turn > 1 ORDER BY turn LIMIT 4")
def f2_messages_page(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    first = turns.agg(F.min("conv_id")).first()[0]
    return relational.keyset(relational.scoped(turns, first, "conv_id").select("turn", "role"), "turn", 3, after=1, descending=False)


@query("""
WITH p AS (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS n FROM customer WHERE c_custkey > 40)
SELECT c_custkey, replace(replace(rtrim(to_base64(encode(CAST((SELECT c_custkey FROM p WHERE n = 10) AS VARCHAR))), '='), '+', '-'), '/', '_') AS next_cursor FROM p WHERE n <= 10
""")
def f4_page_and_cursor(spark: SparkSession, folder: str) -> DataFrame:
    page = relational.page(table(spark, folder, "customer").select("c_custkey"), "c_custkey", 10, relational.encode_cursor(40), descending=False)
    return spark.createDataFrame([(r["c_custkey"], page.next_cursor) for r in page.rows], "c_custkey long, next_cursor string")


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 25 OFFSET 50")
def f6_offset_page(spark: SparkSession, folder: str) -> DataFrame:
    return relational.offset_page(table(spark, folder, "orders").select("o_orderkey", "o_orderdate"), 25, 50, F.desc("o_orderdate"), F.desc("o_orderkey"))


@query("""
WITH d AS (SELECT conv_id, turn, lower(role) || ' ' || lower(text) AS t FROM conversations),
w AS (SELECT conv_id, turn, i, x FROM (SELECT conv_id, turn, unnest(list_filter(string_split_regex(t, '\\s+'), lambda y: y <> '')) AS x, generate_subscripts(list_filter(string_split_regex(t, '\\s+'), lambda y: y <> ''), 1) AS i FROM d)),
f AS (SELECT conv_id, x, min((turn, i)) AS place FROM w GROUP BY conv_id, x)
SELECT conv_id, count(*) AS n_keys, sha256(string_agg(x, ',' ORDER BY place)) AS keys_sha256 FROM f GROUP BY conv_id
""")
def g5_keys_in_first_seen_order(spark: SparkSession, folder: str) -> DataFrame:
    said = tx.words(F.concat(F.lower("role"), F.lit(" "), F.lower("text")))
    words = table(spark, folder, "conversations").select("conv_id", "turn", F.posexplode(said).alias("i", "x"))
    # the first place of each key is known before the keys of a conversation meet
    first = words.groupBy("conv_id", "x").agg(F.min(F.struct("turn", "i")).alias("at"))
    keys = F.transform(F.sort_array(F.collect_list(F.struct("at", "x"))), lambda k: k["x"])
    return first.groupBy("conv_id").agg(F.count("*").alias("n_keys"), F.sha2(F.array_join(keys, ","), 256).alias("keys_sha256"))


@query("""
SELECT p_partkey, list_sort(list_filter(list_distinct(string_split(p_name, ' ')), lambda x: x NOT IN ('red', 'blue', 'green')))::VARCHAR AS unknown FROM part
""")
def g4_unknown_parameters(spark: SparkSession, folder: str) -> DataFrame:
    known = F.array(*map(F.lit, ("red", "blue", "green")))
    unknown = F.array_sort(F.array_except(F.split("p_name", " "), known))
    return table(spark, folder, "part").select("p_partkey", F.concat(F.lit("["), F.array_join(unknown, ", "), F.lit("]")).alias("unknown"))


@query("""
WITH s AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations)
SELECT conv_id, string_agg(role, ',' ORDER BY turn) AS ids FROM s WHERE n = 1 GROUP BY conv_id
""")
def g6_distinct_ids(spark: SparkSession, folder: str) -> DataFrame:
    asked = F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"])
    return table(spark, folder, "conversations").groupBy("conv_id").agg(F.array_join(F.array_distinct(asked), ",").alias("ids"))


@query("""
WITH conf AS (SELECT c_nationkey AS workspace_id, CASE c_custkey % 2 WHEN 0 THEN 'tokens' ELSE 'cost_micros' END AS metric, 'month' AS period, max(c_custkey) AS limit_value
    FROM customer WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 9000 GROUP BY ALL),
def AS (SELECT n_nationkey AS workspace_id, metric, 'month' AS period, limit_value FROM nation, (VALUES ('tokens', 5000000), ('cost_micros', 50000000)) AS v(metric, limit_value))
SELECT workspace_id, metric, period, limit_value FROM conf UNION ALL SELECT def.* FROM def ANTI JOIN conf USING (workspace_id, metric, period)
""")
def g7_limits_with_defaults(spark: SparkSession, folder: str) -> DataFrame:
    metric = F.when(F.col("c_custkey") % 2 == 0, "tokens").otherwise("cost_micros")
    users = table(spark, folder, "customer").where("c_mktsegment = 'MACHINERY' AND c_acctbal > 9000")
    configured = users.groupBy(F.col("c_nationkey").alias("workspace_id"), metric.alias("metric"), F.lit("month").alias("period")).agg(F.max("c_custkey").alias("limit_value"))
    given = spark.createDataFrame(usage.DEFAULT_LIMITS, "metric string, period string, limit_value long")
    defaults = table(spark, folder, "nation").select(F.col("n_nationkey").alias("workspace_id")).crossJoin(F.broadcast(given))  # two limits
    return relational.with_defaults(configured, defaults, ["workspace_id", "metric", "period"])
