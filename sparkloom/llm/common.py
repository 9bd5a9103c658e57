"""Shared plumbing of the training-data operators."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from sparkloom.llm.textops import SLICE_BYTES, Slice, slices

#: Rows per Arrow batch: texts differ a lot in length, so batches are kept short.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents; a table of fewer pieces than there are cores is dealt out to all of them."""
    docs, cores = table(spark, sf_dir, "documents"), spark.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder that the session names; a session of one machine may do without."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "sparkloom-checkpoints")


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder in whatever store its path names."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or a longer one if a column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def checkpoint(df: DataFrame) -> DataFrame:
    """Eager reliable checkpoint in the shared folder: cuts lineage and survives lost executors."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}")
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files and broadcasts of frames that are done with.

    The cleaner goes by the driver's garbage collections, which a driver with
    little to do puts off for long; so a job of many steps asks for one between
    them, and neither files nor the driver's heap pile up.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def checkpoint_dealt(df: DataFrame) -> DataFrame:
    """``checkpoint`` of a frame whose last step is ``repartition``, that later joins and groupings on its key know of.

    An adaptive plan doesn't tell how it deals out its rows, so this one plan isn't adaptive.
    """
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return checkpoint(df)
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


def append_columns(
    df: DataFrame,
    text_col: str,
    fields: list[T.StructField],
    make: Callable[[], Callable[[Slice], list]],
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """Add columns computed from a text column, a slice of documents at a time.

    ``make`` runs once per task and returns the function that turns a slice into
    one array per field.  A column of ``df`` that has the name of a new one, in
    whatever case, is replaced.  Null texts reach the function as empty ones.
    """
    names = {f.name.lower() for f in fields}
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in names or c == text_col])
    kept = [f for f in df.schema.fields if f.name.lower() not in names]
    schema = T.StructType(kept + fields)
    arrow = to_arrow_schema(T.StructType(fields))
    keep = [f.name for f in kept]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        for batch in batches:
            for lo in range(0, batch.num_rows, BATCH_ROWS):
                rows = batch.slice(lo, BATCH_ROWS)
                pieces = [step(part) for part in slices(rows[text_col], slice_bytes)]
                new = [
                    pa.concat_arrays([_array(p[k], f.type) for p in pieces])
                    for k, f in enumerate(arrow)
                ]
                yield pa.RecordBatch.from_arrays([rows[c] for c in keep] + new, names=keep + arrow.names)

    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.Array):
        return values.cast(kind)
    return pa.array(values, kind)


def remainder(doc_id: str, modulus: int):
    """crc32 of an id written as text, modulo ``modulus``; the split between learning and held-out rows."""
    return F.crc32(F.col(doc_id).cast("string")) % F.lit(modulus)
