"""Epsilon-joins of many coordinates, or by any metric, in blocks of points.

Cells are made of the distances from PIVOTS points: by the triangle inequality two points within eps have distances from
any point that differ by eps at most. Points of a cell are dealt into blocks of about BLOCK_ROWS, and blocks whose
intervals of pivot distances are within eps meet by equi-joins on the cell. Two blocks are compared at once, by a matrix
product for the Euclidean metric (what it leaves within rounding of eps is computed again from differences), and only
what is asked for leaves the task: pairs, counts, the edges that connect what is connected, or smallest clusters.
Where distances concentrate, as between random vectors, every pair is a candidate, and nothing exact avoids it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.functions.metrics import Metric
from loomspark.plans.shared import saved, ship

BLOCK_ROWS = 512
PIVOTS = 3
_NONE = np.iinfo(np.int64).max


def _distances(a: np.ndarray, b: np.ndarray, name: str, rows: Callable) -> np.ndarray:
    if name == "euclidean":
        square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
        return np.sqrt(np.maximum(square, 0))
    return rows(np.repeat(a, len(b), axis=0), np.tile(b, (len(a), 1))).reshape(len(a), len(b))


def within(a: np.ndarray, b: np.ndarray, eps: float, name: str, rows: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of rows are at most eps apart, and distances."""
    d = _distances(a, b, name, rows)
    if name == "euclidean":
        slack = 1e-12 * ((a * a).sum(1).max(initial=0) + (b * b).sum(1).max(initial=0) + eps * eps) + 1e-300
        i, j = np.nonzero(np.abs(d * d - eps * eps) <= slack)
        for k in range(0, len(i), 100_000):
            x, y = i[k : k + 100_000], j[k : k + 100_000]
            d[x, y] = rows(a[x], b[y])
    return d <= eps, d


def forest(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest that it is connected with through near (rows: a, columns: b)."""
    left, right = a.copy(), b.copy()
    while True:
        right_low = np.minimum(right, np.where(near, left[:, None], _NONE).min(0, initial=_NONE))
        left_low = np.minimum(left, np.where(near, right_low[None, :], _NONE).min(1, initial=_NONE))
        if np.array_equal(left, left_low) and np.array_equal(right, right_low):
            break
        left, right = left_low, right_low
    own, low = np.concatenate([a, b]), np.concatenate([left, right])
    return own[own != low], low[own != low]


@dataclass(frozen=True)
class BlockSearch:
    """The same questions as GridSearch answers."""

    eps: float
    metric: Metric
    dims: int
    pivots: tuple[tuple[float, ...], ...]

    @staticmethod
    def plan(eps: float, m: Metric, points: DataFrame) -> BlockSearch:
        some = points.orderBy(F.xxhash64("point_id"), "point_id").limit(PIVOTS).collect()
        return BlockSearch(eps, m, len(some[0]["coords"]), tuple(tuple(r["coords"]) for r in some))

    def _blocks(self, df: DataFrame, value: str | None = None) -> DataFrame:
        """block, c* (its cell), lo, hi (of pivot distances), ids, rows (float64 bytes), values."""
        ship(df.sparkSession)
        pivots, rows, width = np.array(self.pivots), self.metric.rows, self.eps * (1 + 1e-6) or 1.0
        keys = [f"c{k}" for k in range(len(pivots))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                x = b["coords"].flatten().to_numpy().reshape(b.num_rows, -1)
                d = np.stack([rows(x, np.tile(p, (len(x), 1))) for p in pivots], axis=1)
                cell = np.floor(d / width).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b["loc"], b["value"], pa.array([r.tobytes() for r in x], pa.binary()), pa.array([r.tobytes() for r in d], pa.binary()), *[pa.array(cell[:, k]) for k in range(len(pivots))]], ["loc", "value", "row", "d", *keys])

        some = df.select(F.col("loc").cast("long").alias("loc"), (F.col(value) if value else F.lit(0)).cast("long").alias("value"), F.col("coords").cast("array<double>").alias("coords"))
        flat = saved(some.mapInArrow(run, "loc long, value long, row binary, d binary, " + ", ".join(f"{c} long" for c in keys)), "rows")
        parts = flat.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK_ROWS).alias("parts"))
        dealt = flat.join(parts, keys).withColumn("part", F.pmod(F.xxhash64("loc"), "parts"))
        grouped = dealt.groupBy(*keys, "part").agg(F.sort_array(F.collect_list(F.struct("loc", "value", "row", "d"))).alias("all"))

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out = []
                for each in b["all"].to_pylist():
                    d = np.frombuffer(b"".join(r["d"] for r in each)).reshape(len(each), -1)
                    out.append((np.array([r["loc"] for r in each]).tobytes(), np.array([r["value"] for r in each]).tobytes(), b"".join(r["row"] for r in each), d.min(0).tolist(), d.max(0).tolist()))
                cols = list(zip(*out, strict=True)) if out else [()] * 5
                types = [pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.float64()), pa.list_(pa.float64())]
                yield pa.RecordBatch.from_arrays([*[b[c] for c in keys], *[pa.array(list(c), t) for c, t in zip(cols, types, strict=True)]], [*keys, "ids", "vals", "rows", "lo", "hi"])

        packed = grouped.select(*keys, "all").mapInArrow(pack, ", ".join(f"{c} long" for c in keys) + ", ids binary, vals binary, rows binary, lo array<double>, hi array<double>")
        return saved(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")

    def _run(self, left: DataFrame, right: DataFrame, one: bool, fn: Callable, schema: str) -> DataFrame:
        """fn over every two blocks that may hold pairs; one: left and right are one set, and a block meets itself and each other once."""
        n = len(self.pivots)
        offsets = list(product((-1, 0, 1), repeat=n))
        by = F.explode(F.array(*[F.struct(*[F.lit(x).cast("long").alias(f"o{k}") for k, x in enumerate(o)]) for o in offsets if not one or o >= (0,) * n]))
        heads = lambda df, s: df.select(F.col("block").alias(f"{s}_block"), F.col("lo").alias(f"{s}_lo"), F.col("hi").alias(f"{s}_hi"), *[F.col(f"c{k}").alias(f"{s}_c{k}") for k in range(n)])
        b = heads(right, "b").withColumn("by", by)
        same = F.lit(True)
        for k in range(n):
            same = same & (F.col(f"by.o{k}") == 0)
        b = b.select("b_block", "b_lo", "b_hi", *[(F.col(f"b_c{k}") + F.col(f"by.o{k}")).alias(f"a_c{k}") for k in range(n)], same.alias("same"))
        met = heads(left, "a").join(b, [f"a_c{k}" for k in range(n)])
        if one:
            met = met.where("not same or a_block <= b_block")
        reach = self.eps * (1 + 1e-9) + 1e-300
        for k in range(n):
            met = met.where((F.col("a_lo")[k] - F.col("b_hi")[k] <= reach) & (F.col("b_lo")[k] - F.col("a_hi")[k] <= reach))
        named = lambda df, s: df.select(F.col("block").alias(f"{s}_block"), *[F.col(c).alias(f"{s}_{c}") for c in ("ids", "vals", "rows")])
        # each comparison is work: pairs of blocks are dealt evenly, then fetch what they hold
        met = met.select("a_block", "b_block").join(named(left, "a"), "a_block").join(named(right, "b"), "b_block").repartition("a_block", "b_block")
        eps, name, rows, dims = self.eps, self.metric.name, self.metric.rows, self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in range(batch.num_rows):
                    row = {c: batch[c][r].as_py() for c in batch.schema.names}
                    ids, vals, x = ([np.frombuffer(row[f"{s}_{c}"], t) for s in "ab"] for c, t in (("ids", np.int64), ("vals", np.int64), ("rows", np.float64)))
                    near, d = within(x[0].reshape(-1, dims), x[1].reshape(-1, dims), eps, name, rows)
                    yield fn(ids, vals, near, d, one and row["a_block"] == row["b_block"])

        return met.mapInArrow(run, schema)

    def pairs(self, points: DataFrame) -> DataFrame:
        def fn(ids, vals, near, d, own):
            i, j = np.nonzero(np.triu(near, 1) if own else near)
            a, b = ids[0][i], ids[1][j]
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(d[i, j])], ["id_a", "id_b", "distance"])

        blocks = self._blocks(points)
        return self._run(blocks, blocks, True, fn, "id_a long, id_b long, distance double")

    def counts(self, places: DataFrame) -> DataFrame:
        def fn(ids, vals, near, d, own):
            n = near.astype(np.float64)
            if own:
                np.fill_diagonal(n, 1)
                return pa.RecordBatch.from_arrays([pa.array(ids[0]), pa.array((n @ vals[1]).astype(np.int64))], ["loc", "n"])
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate([n @ vals[1], vals[0] @ n]).astype(np.int64))], ["loc", "n"])

        blocks = self._blocks(places, "weight")
        return self._run(blocks, blocks, True, fn, "loc long, n long").groupBy("loc").agg(F.sum("n").alias("n_neighbors"))

    def links(self, core: DataFrame) -> tuple[DataFrame, DataFrame]:
        def fn(ids, vals, near, d, own):
            a, b = forest(near, ids[0], ids[1])
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        blocks = self._blocks(core)
        return core.select("loc", F.col("loc").alias("node")), self._run(blocks, blocks, True, fn, "a long, b long")

    def nearest(self, thin: DataFrame, core: DataFrame) -> DataFrame:
        def fn(ids, vals, near, d, own):
            low = np.where(near, vals[1][None, :], _NONE).min(1, initial=_NONE)
            return pa.RecordBatch.from_arrays([pa.array(ids[0][low < _NONE]), pa.array(low[low < _NONE])], ["loc", "near"])

        found = self._run(self._blocks(thin), self._blocks(core, "cluster"), False, fn, "loc long, near long")
        return found.groupBy("loc").agg(F.min("near").alias("near"))

    def votes(self, queries: DataFrame, labelled: DataFrame) -> DataFrame:
        def fn(ids, vals, near, d, own):
            i, j = np.nonzero(near)
            pair, n = np.unique(np.stack([ids[0][i], vals[1][j]]), axis=1, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1]), pa.array(n.astype(np.int64))], ["id", "cluster", "n"])

        found = self._run(self._blocks(queries), self._blocks(labelled, "cluster"), False, fn, "id long, cluster long, n long")
        return found.groupBy("id", "cluster").agg(F.sum("n").alias("n"))
