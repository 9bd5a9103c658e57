"""Connected components of an edge list by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkloom.llm.common import checkpoint

_EDGES = T.StructType([T.StructField("u", T.LongType()), T.StructField("v", T.LongType())])


def _contracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as stars: each node once, with the smallest that the task's edges connect it to."""
    up: dict[int, int] = {}

    def find(x: int) -> int:
        while (above := up.get(x, x)) != x:
            up[x] = up.get(above, above)
            x = above
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(a), find(b)
            if a != b:
                up[max(a, b)] = min(a, b)
    nodes = list(up)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(np.array([find(x) for x in nodes], np.int64))], names=_EDGES.names)


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) of every node of ``edges`` (u, v): the smallest node reachable.

    Each step replaces neighbourhoods by stars around their smallest node, with
    partially aggregated minima, and leaves the components unchanged; between
    the steps every task makes stars of the edges that it holds.  It ends when
    every node points at one root and no root points on.
    """
    pairs = checkpoint(edges.where("u <> v").select("u", "v").mapInArrow(_contracted, _EDGES))
    for _ in range(max_rounds):
        ends = pairs.select(F.col("u").alias("n"), F.lit(1).alias("o"), F.lit(0).alias("i"))
        ends = ends.unionByName(pairs.select(F.col("v").alias("n"), F.lit(0).alias("o"), F.lit(1).alias("i")))
        if ends.groupBy("n").agg(F.sum("o").alias("o"), F.max("i").alias("i")).where("o > 1 OR (o > 0 AND i > 0)").isEmpty():
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours go to the least of the neighbourhood
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: smaller neighbours and the node itself go to the least smaller neighbour
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        pairs = checkpoint(small.where("u <> v").mapInArrow(_contracted, _EDGES))
    else:
        raise RuntimeError("components did not settle")
    nodes = pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
