"""Connected components of an edge table, by union-find and alternating stars.

Each batch of edges is first reduced to a spanning forest by union-find where it lies.
Then large-star and small-star rounds (Kiveris et al., 2014) connect every node to the
smallest one of its component; each round is a grouped minimum and a join, and its
edges are written to the shared folder. No component is ever gathered in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

EDGE = "u long, v long"


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over each batch: (node, smallest node that it reaches in the batch)."""
    for b in batches:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            top = x
            while root.setdefault(top, top) != top:
                top = root[top]
            while root[x] != top:
                root[x], x = top, root[x]
            return top
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            a, c = find(u), find(v)
            root[max(a, c)] = min(a, c)
        pairs = [(x, find(x)) for x in root]
        pairs = [p for p in pairs if p[0] != p[1]]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()),
                                          pa.array([p[1] for p in pairs], pa.int64())], ["u", "v"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .filter("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return (down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct())


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node has one edge to a node that has none itself."""
    ends = (edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
            .unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down"))))
    return (ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
            .filter("up > 1 OR (up = 1 AND down = 1)").isEmpty())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``edges(u long, v long)``; the component is
    its smallest node. Loops, repeated edges and rows with a null end are ignored; an
    empty table gives no rows."""
    start = edges.select("u", "v").dropna().filter("u <> v").mapInArrow(_forest, EDGE)
    now = stored(start.distinct(), "edges")
    while not _is_star_forest(now):
        now = stored(_small_star(_large_star(now)), "edges")
    return (now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
