"""Changes as pure functions: current state and a delta give the next state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.operators.folds import Fold, folded


def first_of_batch(new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return new.withColumn("__n", rank).where("__n = 1").drop("__n")


def insert_ignore(current: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Current rows, and new ones of keys not there yet, the first of each key."""
    return current.unionByName(first_of_batch(new, keys, order).join(current, keys, "left_anti"))


def add_upsert(current: DataFrame, delta: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Sums grow by the delta's; missing keys are inserted."""
    return current.unionByName(delta).groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def replace_upsert(current: DataFrame, new: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """New rows replace current ones of their keys with the version counted up; new keys begin at 1."""
    c, n = current.alias("c"), new.withColumn("__new", F.lit(True)).alias("n")
    both = c.join(n, [F.col(f"c.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full_outer")
    there = F.col("n.__new").isNotNull()
    columns = [F.when(there, F.col(f"n.{x}")).otherwise(F.col(f"c.{x}")).alias(x) for x in current.columns if x != version]
    count = F.coalesce(F.col(f"c.{version}"), F.lit(0)) + there.cast("int")
    return both.select(*columns, count.alias(version))


def replace_set(current: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the keys in ``new`` are replaced by its rows."""
    return current.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def optimistic_update(current: DataFrame, updates: DataFrame, key: str, order: list[str], version: str = "version") -> tuple[DataFrame, DataFrame]:
    """(next state, conflicts): of the updates that name a row's current version the first in ``order`` applies, all others are conflicts."""
    numbered = updates.withColumn("__n", F.row_number().over(Window.partitionBy(key, version).orderBy(*order)))
    match = [key, version]
    judged = numbered.join(current.select(*match).withColumn("__live", F.lit(True)), match, "left")
    wins = F.coalesce(F.col("__live") & (F.col("__n") == 1), F.lit(False))
    good, conflicts = judged.where(wins), judged.where(~wins).select(*updates.columns)
    changed = good.withColumn(version, F.col(version) + 1).select(*current.columns)
    return current.join(good.select(key), key, "left_anti").unionByName(changed), conflicts


def guarded_update(current: DataFrame, updates: DataFrame, key: str, guard: Column) -> DataFrame:
    """Values of ``updates`` (one row a key) replace those of rows that meet the guard; other rows stay."""
    changed = [c for c in updates.columns if c != key]
    new = updates.select(key, *[F.col(c).alias(f"__{c}") for c in changed], F.lit(True).alias("__there"))
    rows = current.join(new, key, "left")
    there = F.coalesce(F.col("__there") & guard, F.lit(False))
    return rows.select(*[F.when(there, F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in changed else F.col(c) for c in current.columns])


def insert_where_exists(current: DataFrame, new: DataFrame, keys: list[str], owners: DataFrame, owner: list[str], order: list[str]) -> DataFrame:
    """``insert_ignore`` of the new rows whose owner exists."""
    return insert_ignore(current, new.join(owners.select(*owner).distinct(), owner, "left_semi"), keys, order)


def purge(tables: dict[str, DataFrame], doomed: DataFrame, column: str = "workspace_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """What is left of every table without the doomed workspaces, and (table, deleted) counts in the order given; counts alone are a dry run."""
    left, counts = {}, None
    ids = doomed.select(column).distinct()
    for name, frame in tables.items():
        left[name] = frame.join(ids, column, "left_anti")
        one = frame.join(ids, column, "left_semi").agg(F.count("*").alias("deleted")).select(F.lit(name).alias("table"), "deleted")
        counts = one if counts is None else counts.unionByName(one)
    return left, counts


def admitted(requests: DataFrame, group: str, order: list[str], size: str, used: str, ceiling: int, most: int) -> DataFrame:
    """Append ``accepted``: requests of a group are taken in order while what is used and their size fit the ceiling.

    A request that is turned away uses nothing, so later smaller ones may fit: a
    fold over each group's requests.  One of more than ``most`` is another rule's
    to refuse and passes here.  A size or use that is null counts as nothing.
    """

    def start():
        held = None

        def step(before: int, asked: int) -> bool:
            nonlocal held
            held = before if held is None else held
            fits = asked > most or held + asked <= ceiling
            held += asked if fits else 0
            return fits

        return step

    numbers = {"__used": F.max(F.coalesce(F.col(used), F.lit(0))).over(Window.partitionBy(group)).cast("long"), "__size": F.coalesce(F.col(size), F.lit(0)).cast("long")}
    fold = Fold("accepted", T.BooleanType(), ("__used", "__size"), start)
    return folded(requests.withColumns(numbers), [group], order, [fold], together=True).drop(*numbers)


def replace_partitions(rows: DataFrame, path: str, by: list[str]) -> None:
    """Replace the whole sets of the values of ``by`` that rows have, in a table laid out by them; other values' files stay untouched."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def rotate_keys(keys: DataFrame, new: DataFrame, by: str, at: Column, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, audit): a new key (id, ``by``, actor) revokes the active one of its provider, or finds none.

    Of several new keys of a provider the last in order stays active; all leave an audit row.
    """
    line = Window.partitionBy(by).orderBy(*order)
    numbered = new.withColumns({"__n": F.row_number().over(line), "__last": F.lead(F.lit(1)).over(line).isNull()})
    live = keys.where("status = 'active'").select(by).distinct().withColumn("__live", F.lit(True))
    made = numbered.join(live, by, "left")
    before = F.when((F.col("__n") > 1) | F.col("__live"), "active").otherwise("absent")
    audit = made.select(by, F.col("id").alias("credential_id"), F.col("actor").alias("actor_user_id"), F.lit("provider.key_stored").alias("action"),
                        before.alias("previous_status"), F.lit("active").alias("new_status"), at.alias("created_at"))
    hit = keys.join(new.select(by).distinct().withColumn("__new", F.lit(True)), by, "left")
    revoked = F.coalesce(F.col("__new") & (F.col("status") == "active"), F.lit(False))
    old = hit.select("id", by, F.when(revoked, "revoked").otherwise(F.col("status")).alias("status"), (F.col("version") + revoked.cast("int")).alias("version"))
    fresh = made.select("id", by, F.when(F.col("__last"), "active").otherwise("revoked").alias("status"), F.when(F.col("__last"), 1).otherwise(2).alias("version"))
    return old.unionByName(fresh), audit


def toggle_roles(assigned: DataFrame, changes: DataFrame) -> DataFrame:
    """Outcome of each change (workspace_id, user_id, role, enabled), one a user and role: changed, unchanged or last_owner.

    A workspace keeps an owner: where all its owners would go, none of these changes applies.
    """
    keys = ["workspace_id", "user_id", "role"]
    now = changes.join(assigned.select(*keys).distinct().withColumn("__has", F.lit(True)), keys, "left").withColumn("__has", F.coalesce("__has", F.lit(False)))
    owners = assigned.where("role = 'owner'").select("workspace_id", "user_id").distinct().groupBy("workspace_id").agg(F.count("*").alias("__owners"))
    owner = F.col("role") == "owner"
    leaving = now.where(owner & F.col("__has") & ~F.col("enabled")).groupBy("workspace_id").agg(F.count("*").alias("__leaving"))
    joining = now.where(owner & ~F.col("__has") & F.col("enabled")).groupBy("workspace_id").agg(F.count("*").alias("__joining"))
    rows = now.join(owners, "workspace_id", "left").join(leaving, "workspace_id", "left").join(joining, "workspace_id", "left")
    left = F.col("__owners") + F.coalesce("__joining", F.lit(0)) - F.coalesce("__leaving", F.lit(0))
    outcome = F.when(F.col("__has") == F.col("enabled"), "unchanged").when(owner & ~F.col("enabled") & (left < 1), "last_owner").otherwise("changed")
    return rows.withColumn("outcome", outcome).select(*changes.columns, "outcome")


def reindexed(chunks: DataFrame, documents: DataFrame, files: DataFrame, key: str = "file_id") -> tuple[DataFrame, DataFrame]:
    """(chunks, documents) after files are registered anew (file_id, document_id): the old documents of a file go with their chunks."""
    old = documents.join(files.select(key).distinct(), key, "left_semi").select("document_id")
    kept = documents.join(files.select(key).distinct(), key, "left_anti")
    fresh = files.select(key, "document_id", F.lit("pending").alias("status"))
    return chunks.join(old, "document_id", "left_anti"), kept.unionByName(fresh)


def delete_cascade(parents: DataFrame, children: dict[str, tuple[DataFrame, str]], doomed: DataFrame, key: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Remaining children and parents by name, and (table, deleted) counts; children go first."""
    left, counts = {}, None
    for name, (frame, foreign) in [*children.items(), ("parents", (parents, key))]:
        ids = doomed.select(F.col(key).alias(foreign))
        left[name] = frame.join(ids, foreign, "left_anti")
        one = frame.join(ids, foreign, "left_semi").agg(F.count("*").alias("deleted")).select(F.lit(name).alias("table"), "deleted")
        counts = one if counts is None else counts.unionByName(one)
    return left, counts


def redacted_email(user_id: Column) -> Column:
    return F.concat(F.lit("deleted+"), user_id.cast("string"), F.lit("@removed.invalid"))


def tombstone(users: DataFrame, doomed: DataFrame, at) -> DataFrame:
    """Doomed users are marked deleted and lose name and address."""
    gone = users.join(doomed.select("id").distinct().withColumn("__gone", F.lit(True)), "id", "left")
    dead = F.coalesce(F.col("__gone"), F.lit(False))
    return gone.withColumns(
        {
            "status": F.when(dead, "deleted").otherwise(F.col("status")),
            "email": F.when(dead, redacted_email(F.col("id"))).otherwise(F.col("email")),
            "name": F.when(~dead, F.col("name")),
            "deleted_at": F.when(dead, F.lit(at)).otherwise(F.col("deleted_at")),
        }
    ).drop("__gone")


def idempotency_outcomes(requests: DataFrame, store: DataFrame, keys: list[str]) -> DataFrame:
    """claimed (unknown key), mismatch (another request's key), replay (finished) or in_progress."""
    known = store.select(*keys, F.col("request_hash").alias("__hash"), F.col("response").alias("__response"))
    joined = requests.join(known, keys, "left")
    outcome = (
        F.when(F.col("__hash").isNull(), "claimed")
        .when(F.col("__hash") != F.col("request_hash"), "mismatch")
        .when(F.col("__response").isNotNull(), "replay")
        .otherwise("in_progress")
    )
    return joined.withColumn("outcome", outcome).drop("__hash", "__response")


#: The states that each move of a job is legal from, and the state that it leads to.
JOB_MOVES = {
    "start": (("queued", "running"), "running"),
    "advance": (("running",), "running"),
    "succeed": (("running",), "succeeded"),
    "fail": (("queued", "running"), "failed"),
    "cancel": (("queued", "running"), "cancelled"),
}


def move_jobs(jobs: DataFrame, moves: DataFrame) -> DataFrame:
    """Jobs (id, status, total_chunks, done_chunks) after moves (id, pos, move, n), each job's in the order of ``pos``.

    ``start`` sets the total to n and begins at 0, ``advance`` sets what is done
    to n within the total, ``succeed`` completes it.  An illegal move changes
    nothing and counts in ``refused``; cancelling a job that has ended is no
    error and counts nowhere.  A job's moves are folded in its own row.
    """
    line = moves.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("pos", "move", "n"))).alias("__moves"))
    start = F.struct(F.col("status"), F.col("total_chunks").cast("long").alias("total"), F.col("done_chunks").cast("long").alias("done"), F.lit(0).cast("long").alias("refused"))

    def step(s: Column, m: Column) -> Column:
        legal = F.lit(False)
        after = s["status"]
        for name, (states, to) in JOB_MOVES.items():
            hit = (m["move"] == name) & s["status"].isin(*states)
            legal, after = legal | hit, F.when(hit, to).otherwise(after)
        is_move = lambda name: legal & (m["move"] == name)
        total = F.when(is_move("start"), m["n"]).otherwise(s["total"])
        done = (
            F.when(is_move("start"), 0)
            .when(is_move("advance"), F.greatest(F.lit(0), F.least(m["n"], s["total"])))
            .when(is_move("succeed"), s["total"])
            .otherwise(s["done"])
        )
        refused = s["refused"] + (~legal & (m["move"] != "cancel")).cast("long")
        return F.struct(after.alias("status"), total.cast("long").alias("total"), done.cast("long").alias("done"), refused.alias("refused"))

    none = F.array().cast("array<struct<pos:long,move:string,n:long>>")
    moved = jobs.join(line, "id", "left").withColumn("__s", F.aggregate(F.coalesce(F.col("__moves").cast("array<struct<pos:long,move:string,n:long>>"), none), start, step))
    kept = [c for c in jobs.columns if c not in ("status", "total_chunks", "done_chunks")]
    return moved.select(*kept, F.col("__s.status").alias("status"), F.col("__s.total").alias("total_chunks"), F.col("__s.done").alias("done_chunks"), F.col("__s.refused").alias("refused"))


def percent(status: Column, done: Column, total: Column) -> Column:
    """Whole percents of a job: 100 only when it has succeeded, 0 while its total isn't known."""
    return F.when(status == "succeeded", 100).when(total <= 0, 0).otherwise(F.least(F.floor(done * 100 / total), F.lit(99))).cast("long")


def finished_percent(finished: Column, items: Column) -> Column:
    """Whole percents of items that have ended; 100 for a job without items."""
    return F.when(items == 0, 100).otherwise(F.floor(finished * 100 / items)).cast("long")
