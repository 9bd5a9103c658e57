"""Queries over changes of state and over event delivery, with SQL.

Customers stand in for users and documents, orders for requests and audit rows,
events for deliveries.  What is there already and what arrives are told apart by
the parity of a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom import streaming
from sparkloom.operators import mutation
from sparkloom.plans.registry import query
from sparkloom.sources import table


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("workspace_id"), F.col("c_name").alias("v"), F.col("c_acctbal").alias("x"))


_CUSTOMERS = "c AS (SELECT c_custkey AS id, c_nationkey AS workspace_id, c_name AS v, c_acctbal AS x FROM customer)"


@query(f"""
WITH {_CUSTOMERS}, cur AS (SELECT id % 500 AS k, min(id) AS id FROM c WHERE id % 2 = 0 GROUP BY 1), new AS (SELECT id % 700 AS k, min(id) AS id FROM c WHERE id % 2 = 1 GROUP BY 1)
SELECT * FROM cur UNION ALL SELECT * FROM new ANTI JOIN cur USING (k)
""")
def l1_insert_ignore(spark: SparkSession, folder: str) -> DataFrame:
    rows = _customers(spark, folder)
    current = rows.where("id % 2 = 0").groupBy((F.col("id") % 500).alias("k")).agg(F.min("id").alias("id"))
    return mutation.insert_ignore(current, rows.where("id % 2 = 1").select((F.col("id") % 700).alias("k"), "id"), ["k"], ["id"])


@query(f"""
WITH {_CUSTOMERS}, cur AS (SELECT id, v, 3 AS version FROM c WHERE id % 3 <> 0), new AS (SELECT id, 'new ' || v AS v FROM c WHERE id % 5 = 0)
SELECT coalesce(new.id, cur.id) AS id, coalesce(new.v, cur.v) AS v, CAST(coalesce(version, 0) + CASE WHEN new.id IS NULL THEN 0 ELSE 1 END AS INTEGER) AS version FROM cur FULL OUTER JOIN new ON cur.id = new.id
""")
def l3_replace_upsert(spark: SparkSession, folder: str) -> DataFrame:
    rows = _customers(spark, folder)
    current = rows.where("id % 3 <> 0").select("id", "v", F.lit(3).alias("version"))
    return mutation.replace_upsert(current, rows.where("id % 5 = 0").select("id", F.concat(F.lit("new "), "v").alias("v")), ["id"])


@query(f"WITH {_CUSTOMERS} SELECT workspace_id, id FROM c WHERE workspace_id NOT IN (SELECT workspace_id FROM c WHERE workspace_id % 4 = 1 AND id % 10 = 0) UNION ALL SELECT workspace_id, -id FROM c WHERE workspace_id % 4 = 1 AND id % 10 = 0")
def l4_replace_set(spark: SparkSession, folder: str) -> DataFrame:
    rows = _customers(spark, folder).select("workspace_id", "id")
    new = rows.where("workspace_id % 4 = 1 AND id % 10 = 0").select("workspace_id", (-F.col("id")).alias("id"))
    return mutation.replace_set(rows, new, ["workspace_id"])


@query(f"""
WITH {_CUSTOMERS}, cur AS (SELECT id, v, CAST(id % 3 AS INTEGER) AS version FROM c),
up AS (SELECT o_custkey AS id, 'u' || o_orderkey AS v, CAST(o_orderkey % 3 AS INTEGER) AS version, o_orderkey AS n FROM orders),
win AS (SELECT up.* FROM up JOIN cur ON up.id = cur.id AND up.version = cur.version QUALIFY row_number() OVER (PARTITION BY up.id ORDER BY up.n) = 1)
SELECT 'row' AS kind, id, v, version FROM cur ANTI JOIN win USING (id) UNION ALL SELECT 'row', id, v, version + 1 FROM win
UNION ALL SELECT 'conflict', id, v, version FROM up ANTI JOIN win USING (n)
""")
def l5_optimistic_update(spark: SparkSession, folder: str) -> DataFrame:
    current = _customers(spark, folder).select("id", "v", (F.col("id") % 3).cast("int").alias("version"))
    updates = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("id"), F.concat(F.lit("u"), F.col("o_orderkey").cast("string")).alias("v"), (F.col("o_orderkey") % 3).cast("int").alias("version"), F.col("o_orderkey").alias("n")
    )
    state, conflicts = mutation.optimistic_update(current, updates, "id", ["n"])
    return state.select(F.lit("row").alias("kind"), "id", "v", "version").unionByName(conflicts.select(F.lit("conflict").alias("kind"), "id", "v", "version"))


@query(f"""
WITH {_CUSTOMERS} SELECT id, CASE WHEN id % 4 = 0 AND x > 0 THEN id * 2 ELSE id END AS done, x > 0 AS running FROM c
""")
def l6_guarded_update(spark: SparkSession, folder: str) -> DataFrame:
    jobs = _customers(spark, folder).select("id", F.col("id").alias("done"), (F.col("x") > 0).alias("running"))
    return mutation.guarded_update(jobs, jobs.where("id % 4 = 0").select("id", (F.col("id") * 2).alias("done")), "id", F.col("running"))


@query("""
WITH p AS (SELECT DISTINCT l_orderkey AS thread, l_partkey % 100 AS file FROM lineitem WHERE l_linenumber = 1),
n AS (SELECT l_orderkey AS thread, l_partkey % 100 AS file FROM lineitem WHERE l_linenumber = 2 AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O'))
SELECT * FROM p UNION ALL SELECT DISTINCT * FROM n ANTI JOIN p USING (thread, file)
""")
def l7_pinned_files(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("thread"), (F.col("l_partkey") % 100).alias("file"), "l_linenumber")
    pins = items.where("l_linenumber = 1").select("thread", "file").distinct()
    threads = table(spark, folder, "orders").where("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("thread"))
    return mutation.insert_where_exists(pins, items.where("l_linenumber = 2").select("thread", "file"), ["thread", "file"], threads, ["thread"], ["file"])


@query("""
WITH d AS (SELECT o_orderkey FROM orders WHERE o_totalprice < 100000)
SELECT 'lineitem' AS "table", count(*) AS deleted FROM lineitem WHERE l_orderkey IN (FROM d)
UNION ALL SELECT 'parents', count(*) FROM orders WHERE o_orderkey IN (FROM d) UNION ALL SELECT 'left', count(*) FROM lineitem WHERE l_orderkey NOT IN (FROM d)
""")
def l8_cascade_delete(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    left, counts = mutation.delete_cascade(orders, {"lineitem": (items, "l_orderkey")}, orders.where("o_totalprice < 100000"), "o_orderkey")
    return counts.unionByName(left["lineitem"].agg(F.count("*").alias("deleted")).select(F.lit("left").alias("table"), "deleted"))


@query("""
WITH o AS (SELECT o_custkey % 25 AS w FROM orders), c AS (SELECT c_nationkey AS w FROM customer)
SELECT 'files' AS "table", count(*) AS deleted FROM o WHERE w < 3 UNION ALL SELECT 'users', count(*) FROM c WHERE w < 3
""")
def l9_workspace_purge(spark: SparkSession, folder: str) -> DataFrame:
    files = table(spark, folder, "orders").select((F.col("o_custkey") % 25).cast("int").alias("workspace_id"), "o_orderkey")
    users = table(spark, folder, "customer").select(F.col("c_nationkey").alias("workspace_id"), "c_custkey")
    doomed = table(spark, folder, "nation").where("n_nationkey < 3").select(F.col("n_nationkey").alias("workspace_id"))
    return mutation.purge({"files": files, "users": users}, doomed)[1]


@query(f"""
WITH {_CUSTOMERS} SELECT id, CASE WHEN id % 6 = 0 THEN 'deleted' ELSE 'active' END AS status, CASE WHEN id % 6 = 0 THEN 'deleted+' || id || '@removed.invalid' ELSE v || '@x' END AS email,
    CASE WHEN id % 6 <> 0 THEN v END AS name, CASE WHEN id % 6 = 0 THEN DATE '2024-05-01' END AS deleted_at FROM c
""")
def l10_tombstones(spark: SparkSession, folder: str) -> DataFrame:
    import datetime as dt

    users = _customers(spark, folder).select("id", F.lit("active").alias("status"), F.concat("v", F.lit("@x")).alias("email"), F.col("v").alias("name"), F.lit(None).cast("date").alias("deleted_at"))
    return mutation.tombstone(users, users.where("id % 6 = 0"), dt.date(2024, 5, 1)).select("id", "status", "email", "name", "deleted_at")


@query("SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id")
def l11_presence(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select("user_id", F.col("ts").alias("last_seen"), "event_id")
    # a user's last beat of the first half is there; those of the second arrive
    newest = lambda df: df.groupBy("user_id").agg(F.max("last_seen").alias("last_seen"))
    current = newest(events.where("event_id % 2 = 0")).withColumn("version", F.lit(1))
    arriving = newest(events.where("event_id % 2 = 1"))
    later = arriving.join(current.select("user_id", F.col("last_seen").alias("was")), "user_id", "left").where("was IS NULL OR last_seen > was").drop("was")
    return mutation.replace_upsert(current, later, ["user_id"]).drop("version")


@query("""
WITH RECURSIVE r AS (SELECT o_custkey AS space, o_orderkey AS n, CAST(floor(o_totalprice) AS BIGINT) AS size, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
f AS (SELECT space, n, i, (size > 400000 OR 50000 + size <= 900000) AS accepted, 50000 + CASE WHEN size > 400000 OR 50000 + size <= 900000 THEN size ELSE 0 END AS used FROM r WHERE i = 1
    UNION ALL SELECT r.space, r.n, r.i, (r.size > 400000 OR f.used + r.size <= 900000), f.used + CASE WHEN r.size > 400000 OR f.used + r.size <= 900000 THEN r.size ELSE 0 END
    FROM f JOIN r ON r.space = f.space AND r.i = f.i + 1)
SELECT space, n, accepted FROM f
""")
def l13_admitted_uploads(spark: SparkSession, folder: str) -> DataFrame:
    requests = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("space"), F.col("o_orderkey").alias("n"), F.floor("o_totalprice").cast("long").alias("size"), F.lit(50_000).cast("long").alias("used")
    )
    return mutation.admitted(requests, "space", ["n"], "size", "used", 900_000, 400_000).select("space", "n", "accepted")


@query("""
WITH q AS (SELECT o_orderkey AS n, o_custkey AS k, o_orderkey % 3 AS h FROM orders), s AS (SELECT c_custkey AS k, c_custkey % 3 AS h, CASE WHEN c_acctbal > 0 THEN 'done' END AS resp FROM customer WHERE c_custkey % 2 = 0)
SELECT n, CASE WHEN s.h IS NULL THEN 'claimed' WHEN s.h <> q.h THEN 'mismatch' WHEN resp IS NOT NULL THEN 'replay' ELSE 'in_progress' END AS outcome FROM q LEFT JOIN s USING (k)
""")
def l14_idempotency(spark: SparkSession, folder: str) -> DataFrame:
    requests = table(spark, folder, "orders").select(F.col("o_orderkey").alias("n"), F.col("o_custkey").alias("k"), (F.col("o_orderkey") % 3).cast("string").alias("request_hash"))
    store = table(spark, folder, "customer").where("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("k"), (F.col("c_custkey") % 3).cast("string").alias("request_hash"), F.when(F.col("c_acctbal") > 0, "done").alias("response")
    )
    return mutation.idempotency_outcomes(requests, store, ["k"]).select("n", "outcome")


@query("""
WITH k AS (SELECT s_suppkey AS id, s_suppkey AS provider, CASE WHEN s_acctbal > 0 THEN 'active' ELSE 'revoked' END AS status FROM supplier),
n AS (SELECT o_orderkey + 1000000 AS id, o_custkey % 200 AS provider, row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderkey) AS i, row_number() OVER (PARTITION BY o_custkey % 200 ORDER BY o_orderkey DESC) AS j FROM orders)
SELECT 'key' AS kind, id, provider, CASE WHEN status = 'active' AND provider IN (SELECT provider FROM n) THEN 'revoked' ELSE status END AS status,
    CAST(CASE WHEN status = 'active' AND provider IN (SELECT provider FROM n) THEN 2 ELSE 1 END AS INTEGER) AS version FROM k
UNION ALL SELECT 'key', id, provider, CASE WHEN j = 1 THEN 'active' ELSE 'revoked' END, CAST(CASE WHEN j = 1 THEN 1 ELSE 2 END AS INTEGER) FROM n
UNION ALL SELECT 'audit', id, provider, CASE WHEN i > 1 OR provider IN (SELECT provider FROM k WHERE status = 'active') THEN 'active' ELSE 'absent' END, CAST(0 AS INTEGER) FROM n
""")
def l15_rotated_keys(spark: SparkSession, folder: str) -> DataFrame:
    keys = table(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_suppkey").alias("provider"), F.when(F.col("s_acctbal") > 0, "active").otherwise("revoked").alias("status"), F.lit(1).alias("version")
    )
    new = table(spark, folder, "orders").select((F.col("o_orderkey") + 1_000_000).alias("id"), (F.col("o_custkey") % 200).alias("provider"), F.lit(7).alias("actor"))
    state, audit = mutation.rotate_keys(keys, new, "provider", F.lit("2024-05-01"), ["id"])
    said = audit.select(F.lit("audit").alias("kind"), F.col("credential_id").alias("id"), "provider", F.col("previous_status").alias("status"), F.lit(0).alias("version"))
    return state.select(F.lit("key").alias("kind"), "id", "provider", "status", "version").unionByName(said)


@query("""
WITH a AS (SELECT c_nationkey AS w, c_custkey AS u FROM customer WHERE c_mktsegment = 'BUILDING' AND (c_nationkey % 2 = 0 OR c_acctbal > 9000)),
g AS (SELECT c_nationkey AS w, c_custkey AS u, c_nationkey % 3 = 0 OR c_custkey % 2 = 0 AS enabled FROM customer WHERE c_custkey % 3 <> 1 OR c_nationkey = 5),
h AS (SELECT g.*, a.u IS NOT NULL AS has FROM g LEFT JOIN a USING (w, u)),
o AS (SELECT h.*, (SELECT count(*) FROM a WHERE a.w = h.w) + count(*) FILTER (WHERE NOT has AND enabled) OVER (PARTITION BY w) - count(*) FILTER (WHERE has AND NOT enabled) OVER (PARTITION BY w) AS l FROM h)
SELECT w AS workspace_id, u AS user_id, CASE WHEN has = enabled THEN 'unchanged' WHEN NOT enabled AND l < 1 THEN 'last_owner' ELSE 'changed' END AS outcome FROM o
""")
def l16_role_toggles(spark: SparkSession, folder: str) -> DataFrame:
    users = table(spark, folder, "customer").select(F.col("c_nationkey").alias("workspace_id"), F.col("c_custkey").alias("user_id"), F.lit("owner").alias("role"), "c_mktsegment", "c_acctbal")
    assigned = users.where("c_mktsegment = 'BUILDING' AND (workspace_id % 2 = 0 OR c_acctbal > 9000)").select("workspace_id", "user_id", "role")
    changes = users.where("user_id % 3 <> 1 OR workspace_id = 5").select("workspace_id", "user_id", "role", ((F.col("workspace_id") % 3 == 0) | (F.col("user_id") % 2 == 0)).alias("enabled"))
    return mutation.toggle_roles(assigned, changes).select("workspace_id", "user_id", "outcome")


@query("""
SELECT 'chunk' AS kind, l_orderkey AS document_id, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 10 <> 3 GROUP BY ALL
UNION ALL SELECT 'document', -o_custkey, 1 FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey % 10 = 3)
""")
def l18_reindexed(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    documents = orders.select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("document_id"), F.lit("indexed").alias("status"))
    files = orders.where("o_custkey % 10 = 3").select(F.col("o_custkey").alias("file_id"), (-F.col("o_custkey")).alias("document_id")).distinct()
    chunks, registered = mutation.reindexed(table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("document_id"), "l_linenumber"), documents, files)
    kept = chunks.groupBy("document_id").agg(F.count("*").alias("n")).select(F.lit("chunk").alias("kind"), "document_id", "n")
    return kept.unionByName(registered.where("status = 'pending'").select(F.lit("document").alias("kind"), "document_id", F.lit(1).cast("long").alias("n")))


@query("""
SELECT l_orderkey AS id, CASE WHEN count(*) FILTER (WHERE l_linenumber = 5) > 0 THEN 'succeeded' WHEN count(*) > 0 THEN 'running' END AS status FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) GROUP BY 1
""")
def l19_moved_jobs(spark: SparkSession, folder: str) -> DataFrame:
    items = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    n = F.col("l_linenumber")
    first = n == F.min("l_linenumber").over(_by_order())
    move = F.when(first & (n == 5), "start").when(first, "start").when(n == 5, "succeed").otherwise("advance")
    moves = items.withColumn("move", move)
    # a job whose only start is line 5 is started and then completed
    extra = moves.where("move = 'start' AND l_linenumber = 5").select(F.col("l_orderkey").alias("id"), F.lit(99).cast("long").alias("pos"), F.lit("succeed").alias("move"), F.lit(0).cast("long").alias("n"))
    moves = moves.select(F.col("l_orderkey").alias("id"), n.cast("long").alias("pos"), "move", n.cast("long").alias("n")).unionByName(extra)
    jobs = items.select(F.col("l_orderkey").alias("id")).distinct().select("id", F.lit("queued").alias("status"), F.lit(0).alias("total_chunks"), F.lit(0).alias("done_chunks"))
    return mutation.move_jobs(jobs, moves).select("id", "status")


def _by_order():
    from pyspark.sql import Window

    return Window.partitionBy("l_orderkey")


# ---------------------------------------------------------------- delivery


@query("""
SELECT CAST(event_id AS VARCHAR) AS id, event_type AS type, CAST(user_id AS VARCHAR) AS workspace, 0 AS attempts, true AS unpublished FROM events WHERE event_type = 'purchase'
""")
def j1_outbox_rows(spark: SparkSession, folder: str) -> DataFrame:
    effects = table(spark, folder, "events").where("event_type = 'purchase'").select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("workspace_id"), F.col("props").alias("data"), "event_type", "ts"
    )
    rows = streaming.outbox_rows(effects, F.col("event_type"), F.col("ts").cast("timestamp"))
    ce = F.from_json("ce", streaming.ENVELOPE)
    return rows.select("id", ce["type"].alias("type"), ce["workspaceid"].alias("workspace"), "attempts", F.isnull("published_at").alias("unpublished"))


@query("""
WITH o AS (SELECT event_id AS id, ts AS created_at, CASE WHEN event_id % 3 = 0 THEN ts END AS p FROM events),
due AS (SELECT id, created_at FROM o WHERE p IS NULL ORDER BY created_at, id LIMIT 256),
stop AS (SELECT min((created_at, id)) AS s FROM due WHERE id % 97 = 0)
SELECT o.id, p IS NOT NULL OR (due.id IS NOT NULL AND coalesce((due.created_at, due.id) < s, true)) AS published, CAST(coalesce((due.created_at, due.id) = s, false) AS INTEGER) AS attempts
FROM o LEFT JOIN due USING (id), stop
""")
def j2_relayed(spark: SparkSession, folder: str) -> DataFrame:
    at = F.col("ts").cast("timestamp")
    outbox = table(spark, folder, "events").select(F.col("event_id").alias("id"), at.alias("created_at"), F.when(F.col("event_id") % 3 == 0, at).alias("published_at"), F.lit(0).alias("attempts"))
    results = outbox.select("id", (F.col("id") % 97 != 0).alias("ok"))
    return streaming.relayed(outbox, results, 256, F.lit("2024-06-01").cast("timestamp")).select("id", F.isnotnull("published_at").alias("published"), "attempts")


@query("""
WITH e AS (SELECT event_type AS stream, event_id AS entry_id FROM events), d AS (SELECT event_type AS stream, event_id AS entry_id, event_id % 4 AS consumer, event_id % 8 < 4 AS pending FROM events WHERE event_id % 2 = 0),
r AS (SELECT stream, entry_id, 0 AS fresh FROM d WHERE consumer = 2 AND pending UNION ALL SELECT stream, entry_id, 1 FROM e ANTI JOIN d USING (stream, entry_id))
SELECT * FROM r ORDER BY fresh, entry_id LIMIT 2000
""")
def j4_next_reads(spark: SparkSession, folder: str) -> DataFrame:
    entries = table(spark, folder, "events").select(F.col("event_type").alias("stream"), F.col("event_id").alias("entry_id"))
    had = entries.where("entry_id % 2 = 0").withColumns({"consumer": (F.col("entry_id") % 4).cast("string"), "pending": F.col("entry_id") % 8 < 4})
    return streaming.next_reads(entries, had, "2", ["stream"], 2000)


@query("SELECT user_id AS consumer_group, CAST(floor(value) AS BIGINT) AS event_id, count(*) AS n FROM (SELECT DISTINCT user_id, floor(value) AS value FROM events) GROUP BY ALL")
def j6_claimed(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(F.col("user_id").alias("consumer_group"), F.floor("value").cast("long").alias("event_id"), "ts")
    claimed = streaming.claimed(events, "ts", ["consumer_group", "event_id"])
    return claimed.groupBy("consumer_group", "event_id").agg(F.count("*").alias("n"))


def _letters(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events")
    rows = events.select(
        F.col("event_type").alias("stream"), F.col("event_id").alias("entry_id"), F.when(F.col("event_id") % 11 != 0, F.col("props")).alias("ce"),
        F.when(F.col("event_id") % 3 == 0, "dead_letter").otherwise("handled").alias("outcome"), F.lit("retries").alias("reason"), (F.col("event_id") % 6).alias("delivery_count"),
    )
    return streaming.dead_letters(rows, "cg.media")


_LETTERS = "l AS (SELECT event_type || '.dlq' AS stream, event_type AS source, event_id AS entry_id, CASE WHEN event_id % 11 <> 0 THEN props END AS ce, event_id % 6 AS deliveries FROM events WHERE event_id % 3 = 0)"


@query(f"WITH {_LETTERS} SELECT stream, source AS source_stream, entry_id AS source_id, 'cg.media' AS consumer_group, ce, 'retries' AS reason, deliveries FROM l")
def j7_dead_letters(spark: SparkSession, folder: str) -> DataFrame:
    return _letters(spark, folder)


@query(f"""
WITH {_LETTERS} SELECT 'peeked' AS what, entry_id AS n FROM l QUALIFY row_number() OVER (PARTITION BY stream ORDER BY entry_id) <= 10
UNION ALL SELECT 'requeued', count(*) FROM l WHERE entry_id % 5 = 0 AND ce IS NOT NULL UNION ALL SELECT 'refused', count(*) FROM l WHERE entry_id % 5 = 0 AND ce IS NULL
UNION ALL SELECT 'purged', count(*) FROM l WHERE entry_id % 5 = 0 UNION ALL SELECT 'left', count(*) FROM l WHERE entry_id % 5 <> 0
""")
def j8_dead_letter_tools(spark: SparkSession, folder: str) -> DataFrame:
    letters = _letters(spark, folder).withColumnRenamed("source_id", "entry_id")
    wanted = letters.where("entry_id % 5 = 0").select("stream", "entry_id")
    back, refused = streaming.requeued(letters, wanted)
    left, gone = streaming.purged(letters, wanted)
    out = streaming.peeked(letters, 10).select(F.lit("peeked").alias("what"), F.col("entry_id").alias("n"))
    for name, frame in (("requeued", back), ("refused", refused), ("left", left)):
        out = out.unionByName(frame.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n"))
    return out.unionByName(gone.select(F.lit("purged").alias("what"), F.col("deleted").alias("n")))


@query("SELECT user_id AS consumer_group, event_type AS entry_id, count(*) AS deliveries, user_id % 4 <> 0 AS pending FROM events GROUP BY ALL")
def j9_delivery_counts(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(F.col("user_id").alias("consumer_group"), F.col("event_type").alias("entry_id"), F.col("ts").alias("at"))
    acks = events.where("consumer_group % 4 = 0")
    return streaming.delivered(events, acks, ["consumer_group", "entry_id"]).drop("last_at")


@query("""
WITH c AS (SELECT c_custkey AS name, c_custkey % 7 AS pending, c_custkey * 1000 AS idle, CASE WHEN c_custkey % 3 = 0 THEN 6 ELSE 2 END AS rec FROM customer)
SELECT name, CASE WHEN name = 1200 OR idle < 900000 THEN 'kept' WHEN pending - rec > 0 THEN 'refused' ELSE 'deleted' END AS outcome FROM c
""")
def j11_swept_consumers(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    consumers = table(spark, folder, "customer").select(
        key.alias("name"), (key % 7).alias("pending"), (key * 1000).alias("idle_ms"), F.when(key % 3 == 0, 6).otherwise(2).alias("reclaimed")
    )
    return streaming.swept_consumers(consumers, 1200, 900_000).select("name", "outcome")


@query("SELECT 's' AS stream, c_custkey AS name FROM customer WHERE c_custkey % 2 = 0 AND c_custkey % 3 = 0 AND c_custkey % 5 <> 0 AND c_custkey % 7 <> 0")
def j12_orphan_groups(spark: SparkSession, folder: str) -> DataFrame:
    key = F.col("c_custkey")
    groups = table(spark, folder, "customer").select(F.lit("s").alias("stream"), key.alias("name"), (key % 2).alias("consumers"), (key % 3).alias("pending"), (key % 5 == 0).alias("alive"))
    return streaming.orphan_groups(groups, groups.withColumn("consumers", F.when(F.col("name") % 7 == 0, 1).otherwise(F.col("consumers"))))


@query("SELECT event_type AS stream, event_id AS entry_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 100")
def j14_trimmed(spark: SparkSession, folder: str) -> DataFrame:
    return streaming.trimmed(table(spark, folder, "events").select(F.col("event_type").alias("stream"), F.col("event_id").alias("entry_id")), 100)


@query("""
SELECT event_id, o_orderkey AS session FROM events JOIN orders ON o_custkey = user_id WHERE event_type = 'error'
""")
def j15_notified(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "error", "media.job.failed.v1").otherwise(F.col("event_type"))
    events = table(spark, folder, "events").select("event_id", kind.alias("type"), F.col("user_id").alias("workspace_id"))
    sessions = table(spark, folder, "orders").select(F.col("o_custkey").alias("workspace_id"), F.col("o_orderkey").alias("session"))
    return streaming.notified(events, sessions).select("event_id", "session")


@query("""
WITH RECURSIVE a AS (SELECT user_id, event_id, epoch_us(ts) AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
f AS (SELECT user_id, event_id, i, true AS admitted, [s] AS held FROM a WHERE i = 1
    UNION ALL SELECT a.user_id, a.event_id, a.i, len(list_filter(held, lambda t: t > a.s - 90000000000)) < 2,
        CASE WHEN len(list_filter(held, lambda t: t > a.s - 90000000000)) < 2 THEN list_append(list_filter(held, lambda t: t > a.s - 90000000000), a.s) ELSE list_filter(held, lambda t: t > a.s - 90000000000) END
    FROM f JOIN a ON a.user_id = f.user_id AND a.i = f.i + 1)
SELECT user_id, event_id, admitted FROM f
""")
def j16_admissions(spark: SparkSession, folder: str) -> DataFrame:
    attempts = table(spark, folder, "events").select("user_id", "event_id", "ts")
    return streaming.admissions(attempts, "user_id", "ts", ["event_id"], 90_000, 2).select("user_id", "event_id", "admitted")


@query("""
WITH n AS (SELECT max(ts) AS now FROM events)
SELECT 'outbox' AS "table", count(*) AS expired FROM events, n WHERE event_id % 4 <> 0 AND ts < now - INTERVAL 10 DAY UNION ALL SELECT 'processed', count(*) FROM events, n WHERE ts < now - INTERVAL 20 DAY
""")
def j19_retention(spark: SparkSession, folder: str) -> DataFrame:
    events = table(spark, folder, "events").select(F.col("ts").cast("timestamp").alias("at"), "event_id")
    now = F.lit(events.agg(F.max("at")).first()[0])
    outbox = events.withColumn("at", F.when(F.col("event_id") % 4 != 0, F.col("at")))
    count = lambda name, rows, days: streaming.expired(rows, "at", days, now).agg(F.count("*").alias("expired")).select(F.lit(name).alias("table"), "expired")
    return count("outbox", outbox, 10).unionByName(count("processed", events, 20))
