"""Connected components of an edge table by alternating large-star and small-star steps.

Both steps are joins and min() aggregates, so a hub with any number of neighbours is
pre-aggregated before its shuffle; the number of rounds grows with the logarithm of the
longest path. Before the first round every task replaces its edges by a spanning forest.
Each round is a written table (no lineage, survives lost executors).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfold.llm.scratch import Scratch

#: Edges that a task holds at a time.
AT_ONCE = 1 << 20


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each AT_ONCE edges a spanning forest: at most one edge for each node but one."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        u, v = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        nodes, at = np.unique(np.r_[u, v], return_inverse=True)
        top = np.arange(len(nodes))
        a, b = at[: len(u)], at[len(u) :]
        while True:  # hook each root to the least root it meets, then shorten all paths
            x, y = top[a], top[b]
            if (x == y).all():
                break
            np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
            while (top[top] != top).any():
                top = top[top]
        child = np.flatnonzero(top != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[top[child]])], names=["u", "v"])

    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        if sum(len(u) for u, _ in held) >= AT_ONCE:
            yield flush()
    if held:
        yield flush()


def _settled(e: DataFrame) -> bool:
    """Every node has one parent and no parent has a parent."""
    ends = e.selectExpr("u AS x", "1 AS up", "0 AS down").unionByName(e.selectExpr("v AS x", "0 AS up", "1 AS down"))
    odd = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR up > 0 AND down > 0")
    return odd.limit(1).count() == 0


def connected_components(edges: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of an edge, root being the component's least node.

    Self-loops and repeated edges are allowed; an empty table gives an empty table.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    e, path = scratch.write(e.mapInArrow(_forest, "u long, v long").distinct())
    while not _settled(e):
        sym = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # large has u > v: small-star joins all lower neighbours of u to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e_next, path_next = scratch.write(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(path)
        e, path = e_next, path_next
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
