"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014).

A step is aggregations and equi-joins only: a node with very many neighbours is a skewed join that AQE splits,
and its minimum is combined before the shuffle. Each round's edges are a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from loomspark.plans.shared import discard, saved, ship

#: Edges of which a task holds the nodes at once.
PART_EDGES = 1_000_000


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m"))
    return (
        both.join(low, "u")
        .where(F.col("v") > F.col("u"))
        .select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _contracted(edges: DataFrame) -> DataFrame:
    """edges (u, v) with the same components: each task ties what its own edges connect to its smallest node.

    A task holds the nodes of PART_EDGES edges at a time; what it holds is let go when it is full.
    """
    ship(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        rows = 0

        def stars() -> pa.RecordBatch:
            u, v = (np.concatenate(x) for x in zip(*held, strict=True))
            nodes, index = np.unique(np.concatenate([u, v]), return_inverse=True)
            low = np.arange(len(nodes))
            a, b = index[: len(u)], index[len(u) :]
            while len(a):  # hook roots to smaller roots, then halve paths
                x, y = low[a], low[b]
                np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
                while not np.array_equal(low, low[low]):
                    low = low[low]
                open_ = low[a] != low[b]
                a, b = a[open_], b[open_]
            own = np.flatnonzero(low != np.arange(len(nodes)))
            return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[low[own]])], ["u", "v"])

        for b in batches:
            held.append((b["u"].to_numpy(), b["v"].to_numpy()))
            rows += b.num_rows
            if rows >= PART_EDGES:
                yield stars()
                held, rows = [], 0
        if rows:
            yield stars()

    return edges.mapInArrow(run, "u long, v long")


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, one_task: int = PART_EDGES) -> DataFrame:
    """(node, component) for every node of an edge that is no loop; component is the smallest node of its component.

    Nulls and loops count as no edge; repeated and mirrored edges count once; no edges give no rows.
    Tasks first connect what their own edges do, which leaves an edge by node. If that leaves at most one_task edges (16
    bytes each), one task connects them; else rounds go on. Two halves of a round leave the edges as they were exactly
    when every component is a star around its smallest node.
    """
    directed = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))

    def written(df: DataFrame) -> tuple[DataFrame, tuple]:
        """The edges, and their number and checksum, taken while they are written."""
        seen = Observation()
        out = saved(df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")), "edges")
        got = seen.get
        return out, (got["n"], got["sum"])

    now, mark = written(_contracted(directed).distinct())
    if 0 < mark[0] <= one_task:
        last, now = now, saved(_contracted(now.coalesce(1)), "edges")
        discard(last)
        max_rounds, mark = 1, (0,)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        last, before = now, mark
        now, mark = written(_small_star(_large_star(now)))
        discard(last)
        if before == mark:
            break
    else:
        raise RuntimeError(f"connected components did not settle within {max_rounds} rounds")
    roots = now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
