"""Tenant-scoped relational building blocks."""

from __future__ import annotations

import base64
import binascii
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_LIMIT, MAX_LIMIT = 20, 100


def scoped(df: DataFrame, workspace, column: str = "workspace_id") -> DataFrame:
    """The rows of one tenant; no tenant sees no rows."""
    return df.where(F.lit(False)) if workspace is None else df.where(F.col(column) == workspace)


#: Values up to which a list is a predicate; a longer one is joined.
LISTED = 1000


def any_of(df: DataFrame, column: str, values) -> DataFrame:
    """Rows whose column is one of the values: a pushed-down predicate for short lists, a semi join for long ones."""
    values = list(values)
    if not values:
        return df.where(F.lit(False))
    if len(values) <= LISTED:
        return df.where(F.col(column).isin(*values))
    wanted = df.sparkSession.createDataFrame([(v,) for v in values], df.select(column).schema)
    return df.join(wanted.distinct(), column, "left_semi")


def get(df: DataFrame, workspace, key, column: str = "id", tenant: str = "workspace_id") -> DataFrame:
    """The row of a key in a tenant, or none."""
    return scoped(df, workspace, tenant).where(F.col(column) == key)


def within(df: DataFrame, column: str, inner: DataFrame) -> DataFrame:
    """Rows whose column is among the first column of another frame."""
    return df.join(inner.select(F.col(inner.columns[0]).alias(column)), column, "left_semi")


def permitted(assignments: DataFrame, grants: DataFrame, permission: str) -> DataFrame:
    """(workspace_id, user_id) of users any of whose roles grants a permission; ``grants`` is (role, permission)."""
    roles = grants.where(F.col("permission") == permission).select("role").distinct()
    return assignments.join(F.broadcast(roles), "role", "left_semi").select("workspace_id", "user_id").distinct()


def complete_pairs(df: DataFrame, *columns: str) -> DataFrame:
    """Rows in which none of the columns is null or empty."""
    return df.where(reduce(lambda a, b: a & b, [F.coalesce(F.col(c).cast("string"), F.lit("")) != "" for c in columns]))


def same_tenant(left: DataFrame, right: DataFrame, on: str, tenant: str = "workspace_id") -> DataFrame:
    """Inner join on a key and the tenant, so that no row of another tenant ever meets."""
    return left.join(right, [tenant, on])


def overlapping(blocks: DataFrame, areas: DataFrame, page: str, least: float = 0.5) -> DataFrame:
    """Append ``covered`` to blocks (page, x0, y0, x1, y1): whether at least a share of a block's own area lies in one area of its page.

    A page has few areas, so they go to its blocks as one array.
    """
    rects = areas.groupBy(page).agg(F.collect_list(F.struct("x0", "y0", "x1", "y1")).alias("__areas"))
    own = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))

    def enough(a: Column) -> Column:
        wide = F.least(F.col("x1"), a["x1"]) - F.greatest(F.col("x0"), a["x0"])
        high = F.least(F.col("y1"), a["y1"]) - F.greatest(F.col("y0"), a["y0"])
        return (wide > 0) & (high > 0) & (wide * high >= least * own)

    covered = F.coalesce((own > 0) & F.exists("__areas", enough), F.lit(False))
    return blocks.join(rects, page, "left").withColumn("covered", covered).drop("__areas")


def offset_page(df: DataFrame, limit: int, offset: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def narrowed(df: DataFrame, **wanted) -> DataFrame:
    """A predicate for each argument given: None adds none, a list means any of it, an empty list nothing."""
    for column, value in wanted.items():
        if value is None:
            continue
        if isinstance(value, (list, tuple, set)):
            df = any_of(df, column, value)
        else:
            df = df.where(F.col(column) == value)
    return df


def payload_filter(wanted: dict, payload: str = "payload") -> Column:
    """All keys equal, or any of a list of one type; a missing key matches nothing.

    Floats, None, dicts and mixed lists raise an error.
    """
    out = F.lit(True)
    for key, value in wanted.items():
        options = list(value) if isinstance(value, (list, tuple)) else [value]
        kinds = {type(v) for v in options}
        if not options or len(kinds) != 1 or not kinds <= {str, int, bool}:
            raise ValueError(f"filter on {key!r} can't be expressed: {value!r}")
        out &= F.coalesce(F.col(f"{payload}.{key}").isin(*options), F.lit(False))
    return out


def contains(term: str, *columns: str) -> Column:
    """Case-insensitive containment in any of the columns, the term taken literally."""
    out = F.lit(False)
    for c in columns:
        out |= F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lower(F.lit(term)))
    return out


def soft_deleted(df: DataFrame, deleted: bool = False, column: str = "deleted_at") -> DataFrame:
    return df.where(F.col(column).isNotNull() if deleted else F.col(column).isNull())


def remapped(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """{new: old} projection; an empty mapping passes everything, a column that is missing is an error."""
    if absent := [old for old in columns.values() if old not in df.columns]:
        raise ValueError(f"no such column: {', '.join(absent)}")
    return df.select(*[F.col(old).alias(new) for new, old in columns.items()]) if columns else df


def seen_recently(column: str, as_of: Column, seconds: int = 120) -> Column:
    return F.coalesce(F.col(column) >= as_of - F.make_dt_interval(secs=F.lit(seconds)), F.lit(False))


@dataclass(frozen=True)
class Page:
    rows: list
    next_cursor: str | None
    limit: int


def encode_cursor(key) -> str:
    return base64.urlsafe_b64encode(str(key).encode()).decode().rstrip("=")


def decode_cursor(cursor: str) -> str:
    try:
        return base64.b64decode(cursor + "=" * (-len(cursor) % 4), altchars=b"-_", validate=True).decode()
    except (binascii.Error, UnicodeDecodeError) as error:
        raise ValueError("not a cursor") from error


def keyset(df: DataFrame, key: str, limit: int, after=None, descending: bool = True) -> DataFrame:
    """One row more than a page: the rows beyond ``after`` in the order of a unique key."""
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"a page has 1 to {MAX_LIMIT} rows")
    if after is not None:
        df = df.where(F.col(key) < after if descending else F.col(key) > after)
    return df.orderBy(F.desc(key) if descending else F.asc(key)).limit(limit + 1)


def page(df: DataFrame, key: str, limit: int = DEFAULT_LIMIT, cursor: str | None = None, descending: bool = True) -> Page:
    """A page of at most ``limit`` rows (101 are read at most) and the cursor of the next one."""
    after = None
    if cursor is not None:
        after = F.lit(decode_cursor(cursor)).cast(df.schema[key].dataType)
    rows = keyset(df, key, limit, after, descending).collect()
    more = len(rows) > limit
    rows = rows[:limit]
    return Page(rows, encode_cursor(rows[-1][key]) if more else None, limit)


def latest(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def totals(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Count and sum of each group; empty groups are absent."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.coalesce(F.sum(value), F.lit(0)).cast("long").alias("total"))


def with_defaults(configured: DataFrame, defaults: DataFrame, keys: list[str]) -> DataFrame:
    """Configured rows, and the defaults of keys that none configures."""
    return configured.unionByName(defaults.join(configured, keys, "left_anti"))


def purge_candidates(workspaces: DataFrame, users: DataFrame, audit: DataFrame) -> DataFrame:
    """Workspaces not yet purged whose users are all deleted, with the last deleted one and who asked for it."""
    live = users.where("status <> 'deleted'").select("workspace_id")
    last = latest(users.where("status = 'deleted'"), ["workspace_id"], F.desc("deleted_at"), F.desc("id"))
    asked = latest(audit.where("action = 'delete'"), ["target_user_id"], F.desc("created_at"))
    return (
        workspaces.where("purged_at IS NULL").select(F.col("id").alias("workspace_id"))
        .join(live, "workspace_id", "left_anti")
        .join(last.select("workspace_id", F.col("id").alias("user_id"), "deleted_at"), "workspace_id")
        .join(asked.select(F.col("target_user_id").alias("user_id"), "actor_user_id"), "user_id", "left")
        .select("workspace_id", "user_id", "deleted_at", "actor_user_id")
    )
