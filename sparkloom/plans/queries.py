"""Named queries over the tables of a folder, and their SQL for DuckDB.

How the tables stand in for the operators' inputs: documents are documents,
``conversations`` are messages, ``orders``/``customer`` are files and spaces or
users, ``embeddings`` are points whose id is a document's, and ``events`` are a
usage ledger (workspace user_id, agent event_type, provider ``p{k % 3}``,
tokens floor(value), operation event_id) or a stream of envelopes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import streaming
from sparkloom.functions import text as tx
from sparkloom.operators import chunking, mutation, relational, retrieval, tables, usage
from sparkloom.plans.registry import QUERIES, SQL, query  # noqa: F401
from sparkloom.sources import documents, spread, table

SPAN, OVERLAP = 354, 35

# ---------------------------------------------------------------- documents

_STOP = ", ".join(f"'{w}'" for w in tx.ENGLISH_STOP_WORDS)
_WORDS = "list_filter(string_split_regex(text, '[\\s]+'), lambda x: x <> '')"
_TOKENS = (
    "list_filter(string_split_regex(regexp_replace(lower(text), '[!-/:-@\\[-`{-~]', '', 'g'), '\\s+'),"
    f" lambda x: len(x) >= 2 AND NOT list_contains([{_STOP}], x))"
)


@query(f"""
WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
k AS (SELECT doc_id, ws, CASE WHEN len(ws) <= {SPAN} THEN 1
        ELSE 1 + CAST(ceil((len(ws) - {SPAN}) / {SPAN - OVERLAP}.0) AS BIGINT) END AS k FROM w WHERE len(ws) > 0),
win AS (SELECT doc_id, k, i, ws[i * {SPAN - OVERLAP} + 1 : i * {SPAN - OVERLAP} + {SPAN}] AS win
        FROM (SELECT *, unnest(range(k)) AS i FROM k)),
t AS (SELECT doc_id, k, i, array_to_string(win, ' ') AS chunk, len(win) AS n FROM win),
l AS (SELECT *, lead(chunk) OVER w AS next, lead(n) OVER w AS next_n FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
m AS (SELECT doc_id, i, CASE WHEN i = k - 2 AND len(next) < {chunking.MIN_CHARS} THEN chunk || ' ' || next ELSE chunk END AS chunk,
        CASE WHEN i = k - 2 AND len(next) < {chunking.MIN_CHARS} THEN n + next_n ELSE n END AS n
        FROM l WHERE NOT (k > 1 AND i = k - 1 AND len(chunk) < {chunking.MIN_CHARS})),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, chunk ORDER BY i) AS nth FROM m WHERE len(chunk) >= {chunking.MIN_NODE_CHARS})
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS seq,
    CAST(n AS BIGINT) AS token_count, sha256(chunk) AS chunk_sha256
FROM f WHERE nth = 1
""")
def e3_chunk_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    return chunking.chunk_documents(docs, SPAN, OVERLAP).select("doc_id", "seq", "token_count", F.sha2("chunk", 256).alias("chunk_sha256"))


@query(f"""
SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({_TOKENS})) AS BIGINT) AS n_distinct,
    CAST(greatest(1, len(text) // 4) AS BIGINT) AS estimated_tokens,
    CASE WHEN regexp_matches(text, '[a-zA-Z]') THEN 'english' ELSE 'unknown' END AS language,
    CAST(len(list_filter(list_transform(string_split_regex(text, '[.؟!؛۔]+|\\n{{2,}}'),
        lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g')), lambda s: s <> '')) AS BIGINT) AS n_sentences
FROM documents
""")
def h5_text_features(spark: SparkSession, folder: str) -> DataFrame:
    text = F.col("text")
    tokens = F.col("tokens")
    docs = documents(spark, folder)
    return docs.select("doc_id", "text", F.explode(F.array(tx.english_tokens(text))).alias("tokens")).select(
        "doc_id",
        F.size(tokens).cast("long").alias("n_tokens"),
        F.size(F.array_distinct(tokens)).cast("long").alias("n_distinct"),
        tx.estimate_tokens(text).alias("estimated_tokens"),
        tx.detect_language(text).alias("language"),
        F.size(tx.sentences(text)).cast("long").alias("n_sentences"),
    )


@query(f"""
WITH t AS (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents)
SELECT term, CAST(sum(tf) AS BIGINT) AS total, count(*) AS documents,
    round(ln((any_value(n) - count(*) + 0.5) / (count(*) + 0.5) + 1), 6) AS idf
FROM tf, n GROUP BY term
""")
def d17_term_statistics(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    terms = retrieval.term_statistics(docs.select(F.explode(F.array(tx.english_tokens(F.col("text")))).alias("tokens")), table(spark, folder, "documents").count())
    return terms.withColumn("idf", F.round("idf", 6))


# ---------------------------------------------------------------- retrieval

DEPTH = retrieval.search_depth(10)


def _points(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    points = spread(table(spark, folder, "embeddings")).select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return points, points.where("chunk_id % 100 = 0").select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query"))


_DENSE_SQL = f"""
q AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS query FROM embeddings WHERE vec_id % 100 = 0),
p AS (SELECT vec_id AS chunk_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS vector FROM embeddings),
ds AS (SELECT query_id, chunk_id, list_cosine_similarity(query, vector) AS score FROM q, p),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM ds) WHERE rank < {DEPTH})
"""
_SPARSE_SQL = f"""
t AS (SELECT doc_id AS chunk_id, unnest({_TOKENS}) AS term FROM documents),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM t GROUP BY ALL),
idf AS (SELECT term, ln(((SELECT count(*) FROM documents) - CAST(count(*) AS DOUBLE) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM tf GROUP BY term),
qt AS (SELECT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark WHERE item_id % 100 = 0),
qtf AS (SELECT query_id, term, count(*) AS q_tf FROM qt GROUP BY ALL),
ss AS (SELECT query_id, chunk_id, round(sum(q_tf * tf * idf), 6) AS score FROM qtf JOIN idf USING (term) JOIN tf USING (term) GROUP BY ALL),
sparse AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) - 1 AS rank FROM ss) WHERE rank < {DEPTH})
"""


@query(f"WITH {_DENSE_SQL} SELECT query_id, chunk_id, CAST(rank AS BIGINT) AS rank, round(score, 6) AS score FROM dense")
def i3_dense_search(spark: SparkSession, folder: str) -> DataFrame:
    points, queries = _points(spark, folder)
    found = retrieval.dense_search(points, queries, DEPTH)
    return found.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def _sparse(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), tx.english_words(F.col("text")).alias("tokens"))
    asked = table(spark, folder, "benchmark").where("item_id % 100 = 0")
    asked = asked.select(F.col("item_id").alias("query_id"), tx.english_tokens(F.col("text")).alias("tokens"))
    return retrieval.sparse_search(chunks, asked, DEPTH, table(spark, folder, "documents").count())


@query(f"WITH {_SPARSE_SQL} SELECT query_id, chunk_id, CAST(rank AS BIGINT) AS rank, score FROM sparse")
def i4_sparse_search(spark: SparkSession, folder: str) -> DataFrame:
    return _sparse(spark, folder).select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), "score")


@query(f"""
WITH {_DENSE_SQL}, {_SPARSE_SQL},
b AS (SELECT query_id, chunk_id, d.rank AS dense_rank, s.rank AS sparse_rank
      FROM dense d FULL OUTER JOIN sparse s USING (query_id, chunk_id)),
c AS (SELECT *, coalesce(CAST(0.5 AS DOUBLE) * (CAST(1 AS DOUBLE) / (60 + dense_rank + 1)), 0)
      + coalesce(CAST(0.5 AS DOUBLE) * (CAST(1 AS DOUBLE) / (60 + sparse_rank + 1)), 0) AS score FROM b)
SELECT query_id, chunk_id, round(score, 9) AS score,
    row_number() OVER (PARTITION BY query_id ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST) - 1 AS pos
FROM c QUALIFY pos < {DEPTH}
""")
def i5_fused_ranking(spark: SparkSession, folder: str) -> DataFrame:
    points, queries = _points(spark, folder)
    fused = retrieval.fuse(retrieval.dense_search(points, queries, DEPTH), _sparse(spark, folder), DEPTH)
    return fused.select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.col("pos").cast("long").alias("pos"))


@query(f"""
WITH {_SPARSE_SQL},
c AS (SELECT query_id, chunk_id, rank AS pos, score, list_distinct({_TOKENS}) AS tokens
      FROM sparse JOIN documents ON doc_id = chunk_id),
f AS (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM c),
k AS (SELECT * FROM f WHERE score >= CAST(0.2 AS DOUBLE) * best),
lost AS (SELECT a.query_id, CASE WHEN a.score >= b.score THEN b.pos ELSE a.pos END AS pos
    FROM k a JOIN k b ON a.query_id = b.query_id AND a.pos < b.pos
    WHERE len(list_intersect(a.tokens, b.tokens)) >= CAST({retrieval.NEAR_DUPLICATE} AS DOUBLE) * len(list_distinct(list_concat(a.tokens, b.tokens)))
      AND len(a.tokens) + len(b.tokens) > 0)
SELECT query_id, chunk_id, CAST(pos AS BIGINT) AS pos, score FROM k ANTI JOIN lost USING (query_id, pos)
""")
def i7_relevant(spark: SparkSession, folder: str) -> DataFrame:
    found = _sparse(spark, folder).withColumnRenamed("rank", "pos")
    # only candidates are tokenised, once: the join of an array is a barrier
    docs = documents(spark, folder).select(F.col("doc_id").alias("chunk_id"), "text").join(found, "chunk_id")
    found = docs.select("query_id", "chunk_id", "pos", "score", F.explode(F.array(tx.english_tokens(F.col("text")))).alias("tokens"))
    kept = retrieval.drop_near_duplicates(retrieval.floors(found, share=0.2))
    return kept.select("query_id", "chunk_id", F.col("pos").cast("long").alias("pos"), "score")


# ---------------------------------------------------------------- messages and tables


@query("""
SELECT conv_id, turn, role FROM conversations
QUALIFY NOT coalesce(role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn), false)
""")
def e10_collapsed_turns(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").withColumns({"parent_id": F.col("role"), "parent_is_complete": F.lit(True)})
    return chunking.collapse_runs(turns, "conv_id", "turn").select("conv_id", "turn", "role")


@query("""
SELECT conv_id, CAST(coalesce(max(turn), 0) AS BIGINT) AS message_count, count(*) AS messages,
    count(*) FILTER (WHERE role = 'user') AS from_user,
    list_sort(list_distinct(list(role)))::VARCHAR AS roles, max_by(role, turn) AS last_role
FROM conversations GROUP BY conv_id
""")
def d5_conversation_stats(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    roles = F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_set("role")), ", "), F.lit("]"))
    return turns.groupBy("conv_id").agg(
        F.coalesce(F.max("turn"), F.lit(0)).alias("message_count"),
        F.count("*").alias("messages"),
        F.count_if(F.col("role") == "user").alias("from_user"),
        roles.alias("roles"),
        F.max_by("role", "turn").alias("last_role"),
    )


@query("""
WITH n AS (SELECT conv_id, turn, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY conv_id) - 1 AS last
           FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT * FROM n WHERE last < 8 OR list_contains(list_transform(range(8), lambda i: (i * last + 3) // 7), pos))
SELECT conv_id, turn, CAST(pos AS BIGINT) AS pos, coalesce(pos - lag(pos) OVER (PARTITION BY conv_id ORDER BY turn) > 1, false) AS gap FROM s
""")
def e13_sampled_turns(spark: SparkSession, folder: str) -> DataFrame:
    return chunking.even_sample(table(spark, folder, "conversations"), "conv_id", "turn").select("conv_id", "turn", "pos", "gap")


@query(f"""
WITH s AS (SELECT CASE WHEN p_size < 5 THEN 'small' || (p_partkey // 200) ELSE 'big' || (p_partkey // 5000) END AS table_id, p_partkey,
        'name: ' || p_name || '; type: ' || p_type || '; size: ' || p_size AS said FROM part),
t AS (SELECT table_id, list(said ORDER BY p_partkey) AS said FROM s GROUP BY table_id)
SELECT table_id, CAST(least(len(said), {tables.MOST_ROWS}) AS BIGINT) AS n_sentences, sha256(array_to_string(said[1:{tables.MOST_ROWS}], chr(10))) AS sentences_sha256,
    CASE WHEN len(said) <= {tables.PARENT_ROWS} THEN array_to_string(said, chr(10)) ELSE 'name; type; size' END AS parent_text,
    len(said) BETWEEN 1 AND {tables.PARENT_ROWS} AS parent_is_complete, len(said) > {tables.MOST_ROWS} AS truncated,
    CASE WHEN len(said) > {tables.MOST_ROWS} THEN array_to_string(said[{tables.MOST_ROWS + 1}:], ' ') ELSE '' END AS overflow_text
FROM t
""")
def i11_exploded_tables(spark: SparkSession, folder: str) -> DataFrame:
    cell = lambda k, c: F.struct(F.lit(k).alias("k"), F.col(c).cast("string").alias("v"))
    row = F.array(cell("id", "p_partkey"), cell("name", "p_name"), cell("type", "p_type"), cell("size", "p_size"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", row.alias("row")))), lambda x: x["row"])
    # a table has 5,000 parts at most, whatever the scale
    part_of = lambda name, n: F.concat(F.lit(name), F.floor(F.col("p_partkey") / n).cast("string"))
    table_id = F.when(F.col("p_size") < 5, part_of("small", 200)).otherwise(part_of("big", 5000))
    made = table(spark, folder, "part").groupBy(table_id.alias("table_id")).agg(rows.alias("rows"))
    headers = F.array(*map(F.lit, ("id", "name", "type", "size")))
    out = tables.explode_tables(made.withColumn("headers", headers))
    said = F.sha2(F.array_join("sentences", "\n"), 256)
    return out.select(
        "table_id", F.size("sentences").cast("long").alias("n_sentences"), said.alias("sentences_sha256"),
        "parent_text", "parent_is_complete", "truncated", "overflow_text",
    )


# ---------------------------------------------------------------- relational


@query("""
SELECT c_custkey, c_name, n_name, coalesce(n, 0) AS n, coalesce(total, 0) AS total
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey
LEFT JOIN (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS total FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey
""")
def c7_space_totals(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select(F.col("o_custkey").alias("c_custkey"), F.floor("o_totalprice").cast("long").alias("size"))
    sums = relational.totals(orders, ["c_custkey"], "size")
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    joined = table(spark, folder, "customer").join(nations, "c_nationkey", "left").join(sums, "c_custkey", "left")
    return joined.select("c_custkey", "c_name", "n_name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "total")])


@query("""
SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)
    AND contains(lower(c_name), lower('CUSTOMER#')) AND c_mktsegment IN ('BUILDING', 'MACHINERY')
""")
def b6_idle_customers(spark: SparkSession, folder: str) -> DataFrame:
    idle = table(spark, folder, "customer").join(table(spark, folder, "orders").where("o_totalprice > 450000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")
    idle = relational.narrowed(idle, c_mktsegment=["BUILDING", "MACHINERY"], c_nationkey=None)
    return idle.where(relational.contains("CUSTOMER#", "c_name")).select("c_custkey", "c_name")


@query("""
SELECT o_custkey, o_orderkey, o_orderdate FROM orders
QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1
""")
def e1_latest_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return relational.latest(orders, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey < 5000 ORDER BY o_orderkey DESC LIMIT 21")
def f1_keyset_page(spark: SparkSession, folder: str) -> DataFrame:
    return relational.keyset(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey", 20, after=5000)


@query("""
SELECT c_mktsegment, count(*) AS total, count(*) FILTER (WHERE c_acctbal >= 0) AS active,
    count(*) FILTER (WHERE c_acctbal < 0) AS disabled FROM customer GROUP BY c_mktsegment
""")
def d7_user_counts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").groupBy("c_mktsegment").agg(
        F.count("*").alias("total"), F.count_if(F.col("c_acctbal") >= 0).alias("active"), F.count_if(F.col("c_acctbal") < 0).alias("disabled")
    )


@query("""
WITH last AS (SELECT c_nationkey AS workspace_id, c_custkey AS user_id FROM customer WHERE c_acctbal < 9000
    QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey DESC) = 1)
SELECT workspace_id, user_id, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS actor_user_id
FROM nation JOIN last ON workspace_id = n_nationkey LEFT JOIN orders ON o_custkey = user_id
WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_nationkey = n_nationkey AND c.c_acctbal >= 9950)
GROUP BY ALL
""")
def l20_purge_candidates(spark: SparkSession, folder: str) -> DataFrame:
    customer = table(spark, folder, "customer")
    status = F.when(F.col("c_acctbal") >= 9950, "active").when(F.col("c_acctbal") < 9000, "deleted").otherwise("invited")
    users = customer.select(F.col("c_nationkey").alias("workspace_id"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("deleted_at"), status.alias("status"))
    # an invited user is no live one here
    users = users.where("status <> 'invited'")
    audit = table(spark, folder, "orders").select(
        F.lit("delete").alias("action"), F.col("o_custkey").alias("target_user_id"), F.col("o_orderkey").alias("actor_user_id"),
        F.struct("o_orderdate", "o_orderkey").alias("created_at"),
    )
    nations = table(spark, folder, "nation").select(F.col("n_nationkey").alias("id"), F.lit(None).cast("timestamp").alias("purged_at"))
    return relational.purge_candidates(nations, users, audit).select("workspace_id", "user_id", "actor_user_id")


# ---------------------------------------------------------------- usage


def ledger(spark: SparkSession, folder: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    tokens = F.floor("value").cast("long")
    return usage.deduplicated(
        table(spark, folder, "events").select(
            F.col("user_id").alias("workspace_id"), F.col("event_type").alias("agent_key"), F.concat(F.lit("p"), (k % 3).cast("string")).alias("provider"),
            F.col("event_id").alias("operation_id"), tokens.alias("tokens"), (tokens * 3).alias("cost_micros"), F.col("ts").alias("created_at"),
        )
    )


_ROLLUP_SQL = """
led AS (SELECT user_id AS workspace_id, event_type AS agent_key, 'p' || (CAST(json_extract(props, '$.k') AS BIGINT) % 3) AS provider,
        CAST(floor(value) AS BIGINT) AS tokens, 3 * CAST(floor(value) AS BIGINT) AS cost_micros, ts FROM events),
per AS (SELECT *, 'day' AS period, CAST(ts AS DATE) AS period_start FROM led
        UNION ALL SELECT *, 'month', CAST(date_trunc('month', ts) AS DATE) FROM led),
roll AS (SELECT workspace_id, period, period_start, coalesce(agent_key, '*') AS agent_key, coalesce(provider, '*') AS provider,
        CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(cost_micros) AS BIGINT) AS cost_micros
        FROM per GROUP BY workspace_id, period, period_start, GROUPING SETS ((), (agent_key), (provider)))
"""


@query(f"WITH {_ROLLUP_SQL} SELECT * FROM roll")
def d9_usage_rollups(spark: SparkSession, folder: str) -> DataFrame:
    return usage.rollups(ledger(spark, folder))


@query(f"WITH {_ROLLUP_SQL} SELECT * FROM roll")
def d10_incremental_rollups(spark: SparkSession, folder: str) -> DataFrame:
    """Two batches that overlap by a third give what all charges give at once."""
    charges = ledger(spark, folder)
    known = charges.where("operation_id % 3 <> 0")
    arriving = charges.where("operation_id % 3 <> 1")
    return usage.captured(known, usage.rollups(known), arriving.unionByName(arriving))[1]


@query(f"""
WITH {_ROLLUP_SQL}
SELECT workspace_id, period_start, agent_key, provider, tokens, cost_micros,
    CASE WHEN agent_key = '*' AND provider = '*' THEN 'total' WHEN provider = '*' THEN 'agent' ELSE 'provider' END AS line
FROM roll WHERE period = 'month'
QUALIFY period_start = max(period_start) OVER (PARTITION BY workspace_id)
""")
def d12_usage_summary(spark: SparkSession, folder: str) -> DataFrame:
    return usage.summary(usage.rollups(ledger(spark, folder))).drop("period")


#: scope, scope_key, metric, period, limit_value
RULES = [
    ("workspace", "*", "tokens", "month", 5000),
    ("workspace", "*", "tokens", "day", 400),
    ("agent", "click", "tokens", "day", 60),
    ("provider", "p1", "tokens", "month", 800),
    ("workspace", "*", "cost_micros", "month", 12000),
]
_RULE_ROWS = ", ".join(str((i, *r)) for i, r in enumerate(RULES))


@query(f"""
WITH {_ROLLUP_SQL},
rules(rule_no, scope, scope_key, metric, period, limit_value) AS (VALUES {_RULE_ROWS}),
at_time AS (SELECT max(ts) AS t FROM events),
req AS (SELECT DISTINCT workspace_id, agent_key AS r_agent, provider AS r_provider FROM led),
chk AS (SELECT req.*, rules.*, CASE WHEN scope = 'agent' THEN r_agent ELSE '*' END AS agent_key,
        CASE WHEN scope = 'provider' THEN r_provider ELSE '*' END AS provider,
        CASE WHEN period = 'month' THEN CAST(date_trunc('month', t) AS DATE) ELSE CAST(t AS DATE) END AS period_start
        FROM req, rules, at_time WHERE scope = 'workspace' OR (scope = 'agent' AND scope_key = r_agent) OR (scope = 'provider' AND scope_key = r_provider)),
cur AS (SELECT chk.*, coalesce(CASE WHEN metric = 'tokens' THEN tokens ELSE cost_micros END, 0) AS current
        FROM chk LEFT JOIN roll USING (workspace_id, period, period_start, agent_key, provider)),
v AS (SELECT *, current >= limit_value OR (metric = 'tokens' AND current + 10 > limit_value) AS violated FROM cur),
agg AS (SELECT workspace_id, r_agent, r_provider, NOT bool_or(violated) AS allowed,
        CAST(min(greatest(limit_value - current, 0)) FILTER (WHERE metric = 'tokens') AS BIGINT) AS remaining,
        min_by(metric || '/' || scope || '/' || period, (list_position(['tokens', 'cost_micros'], metric), list_position(['workspace', 'agent', 'provider'], scope), rule_no))
            FILTER (WHERE violated) AS binding FROM v GROUP BY ALL)
SELECT *, CASE WHEN NOT allowed THEN CASE WHEN starts_with(binding, 'tokens') THEN 'quota_exceeded' ELSE 'budget_exceeded' END END AS reason FROM agg
""")
def n4_quota_decisions(spark: SparkSession, folder: str) -> DataFrame:
    charges = ledger(spark, folder)
    rules = spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], "rule_no int, scope string, scope_key string, metric string, period string, limit_value bigint")
    asked = charges.select("workspace_id", "agent_key", "provider", F.lit(10).alias("estimated")).distinct()
    as_of = table(spark, folder, "events").agg(F.max("ts")).first()[0]
    checked = usage.checks(asked, F.broadcast(rules), usage.rollups(charges), F.lit(as_of))
    return usage.decisions(checked)


@query(f"""
WITH {_ROLLUP_SQL}, cut AS (SELECT median(ts) AS t FROM events),
h AS (SELECT workspace_id, agent_key, CAST(sum(tokens) AS BIGINT) AS tokens FROM led GROUP BY ALL)
SELECT workspace_id, agent_key, tokens FROM h
""")
def l2_additive_upsert(spark: SparkSession, folder: str) -> DataFrame:
    rows = ledger(spark, folder)
    middle = rows.agg(F.percentile_approx(F.unix_micros(F.col("created_at").cast("timestamp")), 0.5)).first()[0]
    early = F.unix_micros(F.col("created_at").cast("timestamp")) < middle
    keys = ["workspace_id", "agent_key"]
    current = rows.where(early).groupBy(*keys).agg(F.sum("tokens").alias("tokens"))
    return mutation.add_upsert(current, rows.where(~early).select(*keys, "tokens"), keys, ["tokens"])


# ---------------------------------------------------------------- events


@query("""
WITH e AS (SELECT event_id, event_type, user_id, 1 + event_id % 6 AS delivery_count, event_type = 'error' AS failed FROM events)
SELECT CAST(event_id AS VARCHAR) AS id, event_type AS type,
    CASE WHEN event_type = 'view' THEN 'skipped' WHEN failed AND delivery_count >= 5 THEN 'dead_letter' WHEN failed THEN 'redeliver' ELSE 'handled' END AS outcome,
    CASE WHEN event_type <> 'view' AND failed AND delivery_count >= 5 THEN 'retries' END AS reason
FROM e
""")
def j5_dispatched(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    ce = streaming.envelope(F.col("event_id").cast("string"), F.col("event_type"), F.col("user_id").cast("string"), F.col("ts").cast("timestamp"), F.col("props"))
    entries = events.select(ce.alias("ce"), (1 + F.col("event_id") % 6).alias("delivery_count"), (F.col("event_type") == "error").alias("failed"), "event_type")
    return streaming.dispatched(entries.drop("event_type"), F.col("type") != "view").select("id", "type", "outcome", "reason")


@query("""
SELECT event_type AS stream, count(*) AS depth, CAST(min_by(event_id, (ts, event_id)) AS VARCHAR) AS oldest_id,
    CAST(floor(epoch(date_trunc('second', (SELECT max(ts) FROM events))) - epoch(date_trunc('second', min(ts)))) AS BIGINT) AS oldest_age
FROM events GROUP BY event_type
""")
def j13_dead_letter_report(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    as_of = F.lit(events.agg(F.max("ts")).first()[0])
    letters = events.select(F.col("event_type").alias("stream"), F.col("event_id").cast("string").alias("entry_id"), F.col("ts").alias("at"), F.lit("retries").alias("reason"))
    return streaming.dead_letter_report(letters, as_of).drop("oldest_reason")


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def j20_hourly_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = streaming.windowed_counts(table(spark, folder, "events"), "ts", ["event_type"], "1 hour")
    return counts.select("event_type", F.col("window.start").cast("timestamp_ntz").alias("start"), "n")


@query("""
WITH e AS (SELECT user_id, event_id, ts, coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 12 HOUR, true) AS opens FROM events),
s AS (SELECT *, sum(opens::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 12 HOUR AS "end", count(*) AS n FROM s GROUP BY user_id, k
""")
def j20_sessions(spark: SparkSession, folder: str) -> DataFrame:
    found = streaming.session_counts(table(spark, folder, "events"), "ts", ["user_id"], "12 hours")
    return found.select("user_id", F.col("session.start").cast("timestamp_ntz").alias("start"), F.col("session.end").cast("timestamp_ntz").alias("end"), "n")


# the other modules register theirs in the same place
from sparkloom.plans import change_queries, ingest_queries, relational_queries, retrieval_queries, structure_queries, text_queries  # noqa: E402, F401
