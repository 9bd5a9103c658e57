"""Usage metering: idempotent ledger, wildcard rollups, quota decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ANY = "*"
#: Metric, period and limit of a workspace that sets none.
DEFAULT_LIMITS = [("tokens", "month", 5_000_000), ("cost_micros", "month", 50_000_000)]
#: Order in which violated limits bind.
METRICS, SCOPES = ("tokens", "cost_micros"), ("workspace", "agent", "provider")


def deduplicated(ledger: DataFrame) -> DataFrame:
    """The first charge of each operation."""
    order = Window.partitionBy("workspace_id", "operation_id").orderBy("created_at", "tokens", "cost_micros")
    return ledger.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def period_start(at: Column, period: Column) -> Column:
    return F.when(period == "month", F.trunc(at, "MM")).otherwise(F.to_date(at))


def period_reset(start: Column, period: Column) -> Column:
    return F.when(period == "month", F.add_months(start, 1)).otherwise(F.date_add(start, 1))


def reset_at(period: str, at: Column) -> Column:
    """When the bucket that a time falls in ends, as a time."""
    start = period_start(at, F.lit(period))
    return period_reset(start, F.lit(period)).cast("timestamp")


def rollups(ledger: DataFrame) -> DataFrame:
    """Tokens and cost by workspace, period, start, agent and provider; '*' stands for all.

    A charge counts once in each bucket, also where its agent or provider is '*'.
    """
    agent, provider = F.col("agent_key"), F.col("provider")
    pair = lambda a, p: F.struct(a.alias("agent_key"), p.alias("provider"))
    every = F.lit(ANY)
    buckets = F.array_distinct(F.array(pair(every, every), pair(agent, every), pair(every, provider)))
    rows = ledger.select("workspace_id", "created_at", "tokens", "cost_micros", F.explode(buckets).alias("b"))
    rows = rows.withColumn("period", F.explode(F.array(F.lit("day"), F.lit("month"))))
    start = period_start(F.col("created_at"), F.col("period")).alias("period_start")
    keys = ["workspace_id", "period", start, F.col("b.agent_key").alias("agent_key"), F.col("b.provider").alias("provider")]
    return rows.groupBy(*keys).agg(F.sum("tokens").alias("tokens"), F.sum("cost_micros").alias("cost_micros"))


def captured(ledger: DataFrame, rollup: DataFrame, charges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger, rollups) after charges arrive: only those of operations that are new count, each once.

    Both are functions of state and batch, so a stream keeps them by calling this
    for each micro-batch; a batch that is delivered again changes nothing.
    """
    keys = ["workspace_id", "operation_id"]
    fresh = deduplicated(charges).join(ledger.select(*keys), keys, "left_anti").select(*ledger.columns)
    by = [c for c in rollup.columns if c not in ("tokens", "cost_micros")]
    grown = rollup.unionByName(rollups(fresh).select(*rollup.columns)).groupBy(*by).agg(*[F.sum(c).cast("long").alias(c) for c in ("tokens", "cost_micros")])
    return ledger.unionByName(fresh), grown


#: Columns of a ledger's table behind its day, and of a rollup's behind its bucket.
LEDGER = "workspace_id long, operation_id long, agent_key string, provider string, tokens long, cost_micros long, created_at timestamp"
ROLLUP = "workspace_id long, agent_key string, provider string, tokens long, cost_micros long"


def _stored(spark: SparkSession, path: str, kind: str) -> DataFrame:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)
    return spark.read.schema(kind).parquet(path) if there else spark.createDataFrame([], kind)


def read_rollups(spark: SparkSession, root: str) -> DataFrame:
    return _stored(spark, f"{root}/rollups", f"{ROLLUP}, period string, period_start date")


def capture_batch(charges: DataFrame, root: str) -> None:
    """Add charges to a ledger and its rollups, tables under ``root``; only the buckets that the charges fall in are rewritten.

    The ledger lies by day, the rollups by period and start.  New operations
    (each once, whenever they come again) go to the ledger; then the days of the
    batch are summed again from the ledger's own days, and their months from the
    days' rollups, each by an overwrite of just these partitions.  What is written
    follows from the ledger alone, so a batch that fails anywhere and is run again
    leaves the same tables as one that did not.
    """
    spark = charges.sparkSession
    day = F.to_date("created_at").alias("day")
    ledger = _stored(spark, f"{root}/ledger", f"{LEDGER}, day date")
    keys = ["workspace_id", "operation_id"]
    columns = ledger.columns[:-1]
    fresh = deduplicated(charges.withColumn("created_at", F.col("created_at").cast("timestamp"))).join(ledger.select(*keys), keys, "left_anti")
    fresh.select(*columns, day).write.mode("append").partitionBy("day").parquet(f"{root}/ledger")
    # a row for each day of the batch: with it only those days' folders are read
    days = F.broadcast(charges.select(day).distinct())
    ledger = spark.read.schema(f"{LEDGER}, day date").parquet(f"{root}/ledger").join(days, "day", "left_semi")
    put = lambda rows: rows.select(*[c.split()[0] for c in ROLLUP.split(", ")], "period", "period_start").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period", "period_start").parquet(f"{root}/rollups")
    put(rollups(ledger).where("period = 'day'"))
    month = F.trunc("period_start", "MM")
    months = F.broadcast(days.select(F.trunc("day", "MM").alias("month")).distinct())
    of_days = read_rollups(spark, root).where("period = 'day'").withColumn("month", month).join(months, "month", "left_semi")
    by = ["workspace_id", "agent_key", "provider", F.lit("month").alias("period"), F.col("month").alias("period_start")]
    put(of_days.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tokens", "cost_micros")]))


def rollup_stream(charges: DataFrame, root: str, checkpoint: str) -> StreamingQuery:
    """Keep a ledger and its rollups from a stream of charges, over what is there."""
    return charges.writeStream.foreachBatch(lambda batch, _: capture_batch(batch, root)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def summary(rolled: DataFrame, period: str = "month") -> DataFrame:
    """The latest period of each workspace by line: total, agent or provider."""
    rows = rolled.where(F.col("period") == period)
    last = F.max("period_start").over(Window.partitionBy("workspace_id"))
    rows = rows.withColumn("__last", last).where("period_start = __last").drop("__last")
    line = F.when((F.col("agent_key") == ANY) & (F.col("provider") == ANY), "total").when(F.col("provider") == ANY, "agent").otherwise("provider")
    return rows.withColumn("line", line)


def checks(requests: DataFrame, rules: DataFrame, rolled: DataFrame, as_of: Column) -> DataFrame:
    """Every rule that governs a request, with the current use of its bucket (0 if there is none)."""
    governs = (
        (F.col("scope") == "workspace")
        | ((F.col("scope") == "agent") & (F.col("scope_key") == F.col("r_agent")))
        | ((F.col("scope") == "provider") & (F.col("scope_key") == F.col("r_provider")))
    )
    asked = requests.withColumnsRenamed({"agent_key": "r_agent", "provider": "r_provider"})
    rules = rules.withColumnRenamed("workspace_id", "rule_workspace") if "workspace_id" in rules.columns else rules
    own = F.col("rule_workspace") == F.col("workspace_id") if "rule_workspace" in rules.columns else F.lit(True)
    every = asked.join(rules, own & governs)
    every = every.withColumns(
        {
            "agent_key": F.when(F.col("scope") == "agent", F.col("r_agent")).otherwise(ANY),
            "provider": F.when(F.col("scope") == "provider", F.col("r_provider")).otherwise(ANY),
            "period_start": period_start(as_of, F.col("period")),
        }
    )
    used = every.join(rolled, ["workspace_id", "period", "period_start", "agent_key", "provider"], "left")
    current = F.when(F.col("metric") == "tokens", F.col("tokens")).otherwise(F.col("cost_micros"))
    return used.withColumn("current", F.coalesce(current, F.lit(0)))


def decisions(checked: DataFrame) -> DataFrame:
    """allowed, remaining tokens and the binding limit of each request (r_agent, r_provider, estimated)."""
    tokens = F.col("metric") == "tokens"
    over = F.col("current") >= F.col("limit_value")
    violated = over | (tokens & F.coalesce(F.col("current") + F.col("estimated") > F.col("limit_value"), F.lit(False)))

    def place(column: str, names: tuple[str, ...]) -> Column:
        return F.array_position(F.array(*map(F.lit, names)), F.col(column))

    rank = F.struct(place("metric", METRICS).alias("m"), place("scope", SCOPES).alias("s"), F.col("rule_no"))
    bound = F.min_by(F.struct("metric", "scope", "period"), F.when(violated, rank))
    out = checked.groupBy("workspace_id", "r_agent", "r_provider").agg(
        (~F.bool_or(violated)).alias("allowed"),
        F.min(F.when(tokens, F.greatest(F.col("limit_value") - F.col("current"), F.lit(0)))).alias("remaining"),
        bound.alias("binding"),
    )
    reason = F.when(~F.col("allowed"), F.when(F.col("binding.metric") == "tokens", "quota_exceeded").otherwise("budget_exceeded"))
    binding = F.when(~F.col("allowed"), F.concat_ws("/", "binding.metric", "binding.scope", "binding.period"))
    return out.withColumns({"reason": reason, "binding": binding})
