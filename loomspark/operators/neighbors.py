"""Epsilon-joins by grid cells, neighbour counts, core points.

Points of equal coordinates are one place. Places lie in cells on at most GRID_DIMS coordinates (those that vary most),
whose diagonal is eps. Cells, not places, are joined with the cells around them, by an equi-join on the cell's numbers.
The boxes that really hold two cells' places then decide: if their farthest corners are within eps, so are all pairs,
and if their nearest sides are not, no pair is. Floating-point differences, norms and comparisons are monotone, so this
is exact. Only places of the cells in between are compared one by one. So a dense cell costs nothing by the square of
its places: it counts as a whole, and is one piece of one cluster. What is compared is counted and linked by combining
aggregations; pairs are rows only where they are the result.

Points of more than GRID_LIMIT coordinates, and metrics without axis_bound, go by loomspark.operators.blocks.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.functions.metrics import Metric, metric
from loomspark.plans.shared import saved
from loomspark.sources.points import Profile, profile

GRID_DIMS = 3
#: Coordinates up to which a grid on three of them prunes.
GRID_LIMIT = 8


def _widths(eps: float, m: Metric, dims: int, on: int) -> float:
    # a little over eps / diagonal: what rounding puts into the next cell is still within the reach below
    return eps / (min(m.diameter(on), 2.0) if m.diameter and dims == on else 1.0) * (1 + 1e-6)


@dataclass(frozen=True)
class GridSearch:
    """Who is within eps of whom. Frames have loc and coords; counts wants weight, nearest and votes want cluster."""

    eps: float
    metric: Metric
    dims: int
    on: tuple[int, ...]
    width: float
    reach: int

    @staticmethod
    def plan(eps: float, m: Metric, p: Profile) -> GridSearch:
        on = tuple(sorted(sorted(range(p.dims), key=lambda i: -p.variance[i])[:GRID_DIMS]))
        largest = max(map(abs, (*p.lower, *p.upper)))
        width = max(_widths(eps, m, p.dims, len(on)), largest * 1e-15, 1e-300)  # cell numbers stay exact integers
        return GridSearch(eps, m, p.dims, on, width, int(eps / width) + 1 + (largest / width > 1e9))

    @property
    def keys(self) -> list[str]:
        return [f"c{k}" for k in range(len(self.on))]

    def _flat(self, df: DataFrame, *more: str) -> DataFrame:
        xs = [F.col("coords")[i].alias(f"x{i}") for i in range(self.dims)]
        cells = [F.floor(F.col("coords")[i] / self.width).cast("long").alias(f"c{k}") for k, i in enumerate(self.on)]
        return df.select("loc", *more, *xs, *cells)

    def _cells(self, flat: DataFrame, *more: Column) -> DataFrame:
        """Each cell with the box that holds its places."""
        box = [f(f"x{i}").alias(f"{n}{i}") for n, f in (("lo", F.min), ("hi", F.max)) for i in range(self.dims)]
        return flat.groupBy(*self.keys).agg(*box, *more)

    def _box_distances(self, a: str, b: str) -> tuple[Column, Column]:
        """Least and largest distance of two boxes whose columns begin with a and b; a metric without norm may have any."""
        if not self.metric.norm:
            return F.lit(0.0), F.lit(float("inf"))
        up = [F.col(f"{b}hi{i}") - F.col(f"{a}lo{i}") for i in range(self.dims)]
        down = [F.col(f"{a}hi{i}") - F.col(f"{b}lo{i}") for i in range(self.dims)]
        far = [F.greatest(u, d) for u, d in zip(up, down, strict=True)]
        near = [F.greatest(-u, -d, F.lit(0.0)) for u, d in zip(up, down, strict=True)]
        return self.metric.norm(near), self.metric.norm(far)

    def _offsets(self, half: bool) -> list[tuple[int, ...]]:
        each = list(product(range(-self.reach, self.reach + 1), repeat=len(self.on)))
        return [o for o in each if o > (0,) * len(self.on)] if half else each

    def _near(self, left: DataFrame, right: DataFrame, half: bool, keep: tuple[str, ...] = ()) -> DataFrame:
        """Cells of left and right (a: a_c*, b: b_c*, and what else the frames have, as a_* and b_*) that may hold pairs; all: all their pairs are within eps."""
        named = lambda df, by: df.select(*[F.col(c).alias(by + c) for c in df.columns])
        by = F.explode(F.array(*[F.struct(*[F.lit(x).cast("long").alias(f"o{k}") for k, x in enumerate(o)]) for o in self._offsets(half)]))
        b = named(right, "b_").withColumn("by", by)
        b = b.withColumns({f"a_c{k}": F.col(f"b_c{k}") + F.col(f"by.o{k}") for k in range(len(self.on))}).drop("by")
        both = named(left, "a_").join(b, [f"a_c{k}" for k in range(len(self.on))])
        near, far = self._box_distances("a_", "b_")
        return both.where(near <= self.eps).withColumn("all", far <= self.eps)

    def _own(self, cells: DataFrame) -> DataFrame:
        """all: the places of this cell are all within eps."""
        return cells.withColumn("all", self._box_distances("", "")[1] <= self.eps)

    def _distance(self, a: str = "a_", b: str = "b_") -> Column:
        return self.metric.of([F.col(f"{a}x{i}") for i in range(self.dims)], [F.col(f"{b}x{i}") for i in range(self.dims)])

    def _compared(self, cells: DataFrame, left: DataFrame, right: DataFrame, once: bool = False) -> DataFrame:
        """Pairs within eps of the places of the given cells (a_c*, b_c*), with what the frames have as a_* and b_*. once: in one cell, of each two only a_loc < b_loc."""
        named = lambda df, by: df.select(*[F.col(c).alias(by + c) for c in df.columns])
        sides = [[f"{s}c{k}" for k in range(len(self.on))] for s in ("a_", "b_")]
        both = cells.select(*sides[0], *sides[1]).join(named(left, "a_"), sides[0]).join(named(right, "b_"), sides[1])
        if once:
            same = F.lit(True)
            for a, b in zip(*sides, strict=True):
                same = same & (F.col(a) == F.col(b))
            both = both.where(~same | (F.col("a_loc") < F.col("b_loc")))
        return both.withColumn("distance", self._distance()).where(F.col("distance") <= self.eps)

    def _doubled(self, cells: DataFrame) -> DataFrame:
        return cells.select(*[F.col(c).alias(f"{s}{c}") for s in ("a_", "b_") for c in self.keys])

    def _keys_of(self, pairs: DataFrame) -> DataFrame:
        return pairs.select(*[f"{s}{c}" for s in ("a_", "b_") for c in self.keys])

    def counts(self, places: DataFrame) -> DataFrame:
        """loc, n_neighbors (by weight, its own included) of every place."""
        flat = self._flat(places, "weight")
        cells = saved(self._own(self._cells(flat, F.sum("weight").alias("w"))), "cells")
        pairs = saved(self._near(cells.drop("all"), cells.drop("all"), half=True), "near")
        whole = pairs.where("all")
        sides = [whole.select(*[F.col(f"{s}{c}").alias(c) for c in self.keys], F.col(f"{o}w").alias("w")) for s, o in (("a_", "b_"), ("b_", "a_"))]
        bulk = sides[0].unionByName(sides[1]).unionByName(cells.where("all").select(*self.keys, "w")).groupBy(*self.keys).agg(F.sum("w").alias("bulk"))
        info = cells.select(*self.keys, "all").join(bulk, self.keys, "left")
        met = self._compared(self._keys_of(pairs.where("not all")).unionByName(self._doubled(cells.where("not all"))), flat, flat, once=True)
        both = F.explode(F.array(F.struct(F.col("a_loc").alias("loc"), F.col("b_weight").alias("w")), F.struct(F.col("b_loc").alias("loc"), F.col("a_weight").alias("w")))).alias("x")
        single = met.select(both).groupBy("x.loc").agg(F.sum("x.w").alias("single"))
        out = flat.select("loc", "weight", *self.keys).join(info, self.keys).join(single, "loc", "left")
        n = F.coalesce("bulk", F.lit(0)) + F.when(F.col("all"), 0).otherwise(F.col("weight")) + F.coalesce("single", F.lit(0))
        return out.select("loc", n.alias("n_neighbors"))

    def links(self, core: DataFrame) -> tuple[DataFrame, DataFrame]:
        """loc, node (its cell's smallest loc where the cell is one piece, else its own) of core places, and edges (a, b) between nodes that make the clusters."""
        flat = self._flat(core)
        cells = saved(self._own(self._cells(flat, F.min("loc").alias("root"))), "cells")
        flat = flat.join(cells.select(*self.keys, "all", "root"), self.keys).withColumn("node", F.when(F.col("all"), F.col("root")).otherwise(F.col("loc")))
        flat = saved(flat.drop("all", "root"), "core")
        pairs = saved(self._near(cells, cells, half=True).withColumn("sure", F.col("all") & F.col("a_all") & F.col("b_all")), "near")
        met = self._compared(self._keys_of(pairs.where("not sure")).unionByName(self._doubled(cells.where("not all"))), flat, flat, once=True)
        edges = pairs.where("sure").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).unionByName(met.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")).distinct())
        return flat.select("loc", "node"), edges

    def nearest(self, thin: DataFrame, core: DataFrame) -> DataFrame:
        """loc, near: the smallest cluster of the core places within eps of a place of thin."""
        a, b = self._flat(thin), self._flat(core, "cluster")
        pairs = self._near(self._cells(a), self._cells(b), half=False)
        return self._compared(pairs, a, b).groupBy(F.col("a_loc").alias("loc")).agg(F.min("b_cluster").alias("near"))

    def pairs(self, points: DataFrame) -> DataFrame:
        """id_a, id_b, distance, id_a < id_b, of the locs within eps."""
        flat = self._flat(points)
        cells = saved(self._cells(flat), "cells")
        met = self._compared(self._keys_of(self._near(cells, cells, half=True)).unionByName(self._doubled(cells)), flat, flat, once=True)
        return met.select(F.least("a_loc", "b_loc").alias("id_a"), F.greatest("a_loc", "b_loc").alias("id_b"), "distance")

    def votes(self, queries: DataFrame, labelled: DataFrame) -> DataFrame:
        """id, cluster, n: how many points of each cluster are within eps of a query (loc, coords)."""
        a, b = self._flat(queries), self._flat(labelled, "cluster")
        pairs = saved(self._near(self._cells(a), self._cells(b), half=False), "near")
        sides = [[f"{s}{c}" for c in self.keys] for s in ("a_", "b_")]
        by_cell = b.groupBy(*[F.col(c).alias(f"b_{c}") for c in self.keys], "cluster").agg(F.count("*").alias("n"))
        whole = pairs.where("all").select(*sides[0], *sides[1]).join(by_cell, sides[1]).groupBy(*sides[0], "cluster").agg(F.sum("n").alias("n"))
        bulk = a.select("loc", *[F.col(c).alias(f"a_{c}") for c in self.keys]).join(whole, sides[0]).select(F.col("loc").alias("id"), "cluster", "n")
        single = self._compared(pairs.where("not all"), a, b).groupBy(F.col("a_loc").alias("id"), F.col("b_cluster").alias("cluster")).agg(F.count("*").alias("n"))
        return bulk.unionByName(single).groupBy("id", "cluster").agg(F.sum("n").alias("n"))


def search(points: DataFrame, eps: float, name: str = "euclidean"):
    """The way to find neighbours of points: GridSearch or BlockSearch; None without points."""
    from loomspark.operators.blocks import BlockSearch

    p, m = profile(points), metric(name)
    if not p.dims:
        return None
    if m.axis_bound and p.dims <= GRID_LIMIT:
        return GridSearch.plan(eps, m, p)
    return BlockSearch.plan(eps, m, points)


def _as_locs(points: DataFrame) -> DataFrame:
    return points.select(F.col("point_id").alias("loc"), "coords")


def neighbor_pairs(points: DataFrame, eps: float, name: str = "euclidean") -> DataFrame:
    """(id_a, id_b, distance), id_a < id_b, of points at most eps apart. Points of equal coordinates are pairs too."""
    s = search(points, eps, name)
    if not s:
        return points.select(F.col("point_id").alias("id_a"), F.col("point_id").alias("id_b"), F.lit(0.0).alias("distance")).where("false")
    return s.pairs(_as_locs(points))


def eps_ball(points: DataFrame, center: list[float], eps: float, name: str = "euclidean") -> DataFrame:
    """The points at most eps from center, with their distance: a filter on one scan."""
    at = F.array(*[F.lit(float(x)) for x in center])
    return points.withColumn("distance", metric(name).between(F.col("coords"), at, len(center))).where(F.col("distance") <= eps)


def cells(points: DataFrame, eps: float) -> DataFrame:
    """(cell, n_points): how many points each grid cell of side eps holds, on all coordinates."""
    return points.groupBy(F.transform("coords", lambda x: F.floor(x / eps).cast("long")).alias("cell")).agg(F.count("*").alias("n_points"))


def neighbor_counts(points: DataFrame, eps: float, name: str = "euclidean", min_points: int | None = None) -> DataFrame:
    """(point_id, n_neighbors) with the point itself counted; is_core too if min_points is given."""
    s = search(points, eps, name)
    if not s:
        out = points.select("point_id", F.lit(0).cast("long").alias("n_neighbors"))
    else:
        places = places_of(points, s.dims)
        out = at_places(points, places.join(s.counts(places), "loc"), s.dims).select("point_id", "n_neighbors")
    return out if min_points is None else out.withColumn("is_core", F.col("n_neighbors") >= min_points)


def _coordinates(dims: int) -> list[Column]:
    return [F.col("coords")[i].alias(f"__x{i}") for i in range(dims)]


def places_of(points: DataFrame, dims: int) -> DataFrame:
    """loc, weight, coords: points of equal coordinates are one place, named by its smallest id; written."""
    if dims > GRID_LIMIT:
        return saved(points.groupBy("coords").agg(F.min("point_id").alias("loc"), F.count("*").alias("weight")), "places")
    xs = [f"__x{i}" for i in range(dims)]
    found = points.select("point_id", *_coordinates(dims)).groupBy(*xs).agg(F.min("point_id").alias("loc"), F.count("*").alias("weight"))
    return saved(found.select("loc", "weight", F.array(*xs).alias("coords")), "places")


def at_places(points: DataFrame, places: DataFrame, dims: int) -> DataFrame:
    """Each point with the columns of its place (coords and others). Keys are the coordinates, as numbers where they are few."""
    if dims > GRID_LIMIT:
        return points.join(places.drop("loc", "weight"), "coords")
    xs = [f"__x{i}" for i in range(dims)]
    own = places.select(*_coordinates(dims), *[c for c in places.columns if c not in ("coords", "loc", "weight")])
    return points.select("*", *_coordinates(dims)).join(own, xs).drop(*xs)
