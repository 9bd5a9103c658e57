"""Sources: Parquet tables, text files as documents, file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Extensions that are read as prose; a table in one of them is prose too.
TEXT_EXTENSIONS = ("txt", "md", "csv")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Rows of a table of few pieces dealt out to all cores, for work that costs more than moving them; a table of enough pieces stays as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Pieces for each piece of a table whose rows become many.
FINER = 16


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt out by key into pieces that grow in number with the table, for rows that become many: adaptive execution would join small pieces into one a core."""
    return df.repartition(FINER * df.rdd.getNumPartitions(), *keys)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(table(spark, folder, "documents"))


def text_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, ext, text) of text files, one row for each; other extensions are left out, as are empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    return (
        files.select("path", ext.alias("ext"), F.decode("content", "UTF-8").alias("text"))
        .where(F.col("ext").isin(*TEXT_EXTENSIONS) & (F.length("text") > 0))
    )


def json_documents(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of JSON lines; a line that isn't JSON keeps its text in ``_corrupt_record`` if the schema has it."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path)


def event_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """A stream of Parquet files; NTZ times become timestamps, as watermarks need them."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    ntz = {f.name: F.col(f.name).cast("timestamp") for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"}
    return rows.withColumns(ntz) if ntz else rows
