"""Intervals and boxes, density boxes and what is made of them.

A tree of boxes parts the longest side (the first of equal ones) of each box. All boxes of a level have equal sides, so
each level has one axis, and the edges on an axis are the same for all boxes: a point's way down the tree is its place
among each axis's edges, plain arithmetic on its coordinates. Counting all boxes is one aggregation over the points, and
the tree, whose size the settings bound, is on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.settings import BoxSettings
from loomspark.sources.points import Profile, profile

SCHEMA = "path string, lvl int, lo array<double>, hi array<double>, n_points long"
#: Leaves of a tree that may be broadcast (about 100 bytes each).
BROADCAST_LEAVES = 1 << 16
Box = tuple[list[float], list[float]]


# intervals [lower, upper], as Columns


def length(lower: Column, upper: Column) -> Column:
    return upper - lower


def extended(lower: Column, upper: Column, by: Column) -> tuple[Column, Column]:
    """The interval grown by half of `by` on each side."""
    return lower - by / 2, upper + by / 2


def hull(a: tuple[Column, Column], b: tuple[Column, Column]) -> tuple[Column, Column]:
    """The least interval that holds both."""
    return F.least(a[0], b[0]), F.greatest(a[1], b[1])


def interval_contains(x: Column, lower: Column, upper: Column, upper_inclusive: Column | bool = False) -> Column:
    closed = F.lit(upper_inclusive) if isinstance(upper_inclusive, bool) else upper_inclusive
    return (x >= lower) & ((x < upper) | (closed & (x == upper)))


def split_interval(lower: Column, upper: Column, n: int, min_length: float | None = None) -> Column:
    """An array of n equal pieces (lower, upper, upper_inclusive: of the last only); at most as many as have about min_length, one at least."""
    most = F.lit(n) if not min_length else F.greatest(F.lit(1), F.least(F.lit(n), F.floor((upper - lower) / min_length + 0.5).cast("int")))
    edge = lambda k: lower + k * (upper - lower) / most
    return F.transform(F.sequence(F.lit(0), most - 1), lambda k: F.struct(edge(k).alias("lower"), F.when(k == most - 1, upper).otherwise(edge(k + 1)).alias("upper"), (k == most - 1).alias("upper_inclusive")))


# boxes with arrays lo and hi


def box_contains(coords: Column, lo: Column, hi: Column, dims: int, upper_inclusive: bool = True) -> Column:
    return reduce(lambda a, b: a & b, [interval_contains(coords[i], lo[i], hi[i], upper_inclusive) for i in range(dims)])


def around(points: DataFrame, size: float) -> DataFrame:
    """points with lo and hi of the box of the given side around each."""
    return points.withColumns({"lo": F.transform("coords", lambda x: x - size / 2), "hi": F.transform("coords", lambda x: x + size / 2)})


def embracing(boxes: DataFrame, dims: int) -> DataFrame:
    """One row, lo and hi: the least box that holds all boxes; null without any."""
    side = lambda f, c: F.array(*[f(F.col(c)[i]) for i in range(dims)])
    return boxes.agg(side(F.min, "lo").alias("lo"), side(F.max, "hi").alias("hi"))


def centre(dims: int) -> Column:
    return F.array(*[F.col("lo")[i] + (F.col("hi")[i] - F.col("lo")[i]) / 2 for i in range(dims)])


def by_centre(boxes: DataFrame, dims: int) -> DataFrame:
    """Boxes and their centre, in order of it."""
    return boxes.withColumn("centre", centre(dims)).orderBy("centre")


def bounding_box(points: DataFrame) -> DataFrame:
    """(dim from 0, lower, upper, n_points), a row by coordinate; no rows without points."""
    each = points.select(F.posexplode("coords").alias("dim", "x"))
    return each.groupBy("dim").agg(F.min("x").alias("lower"), F.max("x").alias("upper"), F.count("*").alias("n_points"))


def equal_grid(lo: list[float], hi: list[float], most: int, min_side: float) -> list[Box]:
    """A box in equal parts: each side in at most `most`, none shorter than min_side (at least one part)."""
    out: list[Box] = [([], [])]
    for a, b in zip(lo, hi, strict=True):
        n = max(1, min(most, int((b - a) / min_side + 0.5) if min_side > 0 else most))
        edges = [a + k * (b - a) / n for k in range(n)] + [b]
        out = [([*x, c], [*y, d]) for x, y in out for c, d in zip(edges[:-1], edges[1:], strict=True)]
    return out


# the tree


@dataclass(frozen=True)
class Tree:
    """axes: the axis that each level parts. edges: of each axis, after all levels."""

    axes: tuple[int, ...]
    edges: tuple[tuple[float, ...], ...]
    splits: int

    @staticmethod
    def grow(lo: list[float], hi: list[float], eps: float, s: BoxSettings) -> Tree:
        """Levels go on while every side of the parts is 2 * eps at least."""
        edges, axes = [[a, b] for a, b in zip(lo, hi, strict=True)], []
        for _ in range(s.levels):
            sizes = [e[1] - e[0] for e in edges]
            axis = sizes.index(max(sizes))
            if min(x / s.splits if i == axis else x for i, x in enumerate(sizes)) < 2 * eps:
                break
            parted = [[a + k * ((b - a) / s.splits) for k in range(s.splits)] for a, b in zip(edges[axis][:-1], edges[axis][1:], strict=True)]
            edges[axis] = [x for part in parted for x in part] + [edges[axis][-1]]
            axes.append(axis)
        return Tree(tuple(axes), tuple(map(tuple, edges)), s.splits)

    def _turn(self, level: int) -> int:
        """By how much a leaf's place on the level's axis is divided to give its part of the level."""
        return self.splits ** self.axes[level + 1 :].count(self.axes[level])

    def box(self, path: tuple[int, ...]) -> Box:
        lo, hi = [], []
        for axis, edges in enumerate(self.edges):
            own = [p for p, a in zip(path, self.axes, strict=False) if a == axis]
            width = self.splits ** (self.axes.count(axis) - len(own))
            first = reduce(lambda n, p: n * self.splits + p, own, 0) * width
            lo.append(edges[first])
            hi.append(edges[first + width])
        return lo, hi

    def place(self, axis: int, x: Column) -> Column:
        """The number of x's interval on an axis: a guess by division, put right by the edges beside it."""
        edges, n = self.edges[axis], len(self.edges[axis]) - 1
        if n == 1 or edges[0] == edges[-1]:
            return F.lit(0)
        all_ = F.array(*[F.lit(float(e)) for e in edges])
        guess = F.least(F.greatest(F.floor((x - edges[0]) * (n / (edges[-1] - edges[0]))).cast("int"), F.lit(0)), F.lit(n - 1))
        moved = guess + F.when((x >= F.get(all_, guess + 1)) & (guess < n - 1), 1).when((x < F.get(all_, guess)) & (guess > 0), -1).otherwise(0)
        return moved

    def leaf(self, points: DataFrame) -> DataFrame:
        """points with leaf, the number of the last box on their way down."""
        out = points.withColumns({f"__k{a}": self.place(a, F.col("coords")[a]) for a in range(len(self.edges))})
        code = reduce(lambda n, level: n * self.splits + F.floor(F.col(f"__k{self.axes[level]}") / self._turn(level)) % self.splits, range(len(self.axes)), F.lit(0).cast("long"))
        return out.withColumn("leaf", code.cast("long")).drop(*[f"__k{a}" for a in range(len(self.edges))])

    def path(self, leaf: int) -> tuple[int, ...]:
        return tuple(leaf // self.splits ** (len(self.axes) - 1 - k) % self.splits for k in range(len(self.axes)))


def _name(path: tuple[int, ...]) -> str:
    return "0" + "".join(map(str, path))


def density_boxes(points: DataFrame, eps: float, settings: BoxSettings = BoxSettings(), of: Profile | None = None) -> DataFrame:
    """path, lvl, lo, hi, n_points of boxes that hold all points: a box is parted while one of its parts has points_per_box points."""
    spark: SparkSession = points.sparkSession
    p = of or profile(points)
    if not p.dims:
        return spark.createDataFrame([], SCHEMA)
    tree = Tree.grow(list(p.lower), list(p.upper), eps, settings)
    counts: dict[tuple[int, ...], int] = {}
    for r in tree.leaf(points).groupBy("leaf").agg(F.count("*").alias("n")).collect():  # at most a row by leaf
        path = tree.path(r["leaf"])
        for k in range(len(path) + 1):
            counts[path[:k]] = counts.get(path[:k], 0) + r["n"]
    rows, todo = [], [()]
    while todo:
        path = todo.pop()
        parts = [(*path, k) for k in range(settings.splits)] if len(path) < len(tree.axes) else []
        if any(counts.get(x, 0) >= settings.points_per_box for x in parts):
            todo += parts
        else:
            rows.append((_name(path), len(path), *tree.box(path), counts.get(path, 0)))
    return spark.createDataFrame(sorted(rows), SCHEMA)


def assign(points: DataFrame, boxes: DataFrame, eps: float, settings: BoxSettings = BoxSettings()) -> DataFrame:
    """(point_id, coords, path, lo, hi): each point with its density box, by its leaf; a point outside all boxes is an error.

    Leaves and their boxes are a table of at most splits ** levels rows, broadcast if these are few.
    """
    rows = boxes.collect()  # as many as the settings allow
    if not rows:
        return points.select("point_id", "coords", *[F.lit(None).cast(t).alias(c) for c, t in (("path", "string"), ("lo", "array<double>"), ("hi", "array<double>"))]).where("false")
    dims = len(rows[0]["lo"])
    lo, hi = [min(r["lo"][i] for r in rows) for i in range(dims)], [max(r["hi"][i] for r in rows) for i in range(dims)]
    tree = Tree.grow(lo, hi, eps, settings)
    leaves = []
    for r in rows:
        rest = tree.splits ** (len(tree.axes) - r["lvl"])
        first = int(r["path"][1:] or "0", tree.splits) * rest if tree.splits <= 10 else reduce(lambda n, d: n * tree.splits + int(d), r["path"][1:], 0) * rest
        leaves += [(first + k, r["path"], r["lo"], r["hi"]) for k in range(rest)]
    of = points.sparkSession.createDataFrame(leaves, "leaf long, path string, lo array<double>, hi array<double>")
    inside = reduce(lambda a, b: a & b, [(F.col("coords")[i] >= lo[i]) & (F.col("coords")[i] <= hi[i]) for i in range(dims)])
    said = F.raise_error(F.concat(F.lit("no box holds point "), F.col("point_id").cast("string")))
    placed = tree.leaf(points.select("point_id", "coords")).withColumn("leaf", F.when(inside, F.col("leaf")).otherwise(said.cast("long")))
    return placed.join(F.broadcast(of) if len(leaves) <= BROADCAST_LEAVES else of, "leaf").select("point_id", "coords", "path", "lo", "hi")


def adjacent(boxes: DataFrame) -> DataFrame:
    """(path_a, path_b), path_a < path_b, of boxes that have a bound in common on one axis at least, and one's interval
    holds the other's on each axis where they have none. Faces meet by an equi-join on (axis, bound)."""
    face = boxes.select("path", "lo", "hi", F.posexplode(F.arrays_zip("lo", "hi")).alias("axis", "b"))
    face = face.select("path", "lo", "hi", "axis", F.explode(F.array_distinct(F.array("b.lo", "b.hi"))).alias("bound"))
    other = face.select(F.col("path").alias("path_b"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), "axis", "bound")
    both = face.withColumnRenamed("path", "path_a").join(other, ["axis", "bound"]).where("path_a < path_b")
    touch = lambda x: (x["lo"] == x["lo_b"]) | (x["lo"] == x["hi_b"]) | (x["hi"] == x["hi_b"]) | (x["hi"] == x["lo_b"])
    each = F.transform(F.arrays_zip("lo", "hi", "lo_b", "hi_b"), lambda x: touch(x) | ((x["lo"] >= x["lo_b"]) & (x["hi"] <= x["hi_b"])) | ((x["lo_b"] >= x["lo"]) & (x["hi_b"] <= x["hi"])))
    return both.where(F.forall(each, lambda x: x)).select("path_a", "path_b").distinct()


def near_bounds(assigned: DataFrame, threshold: float) -> DataFrame:
    """Rows of assign() that are at most threshold from a bound of their box on some axis."""
    return assigned.where(F.exists(F.arrays_zip("coords", "lo", "hi"), lambda x: (F.abs(x["coords"] - x["lo"]) <= threshold) | (F.abs(x["coords"] - x["hi"]) <= threshold)))


def near_pairs(assigned: DataFrame, boxes: DataFrame, threshold: float) -> DataFrame:
    """(path_a, path_b, point_id, coords, path): each point near a bound of its box, once for each adjacent pair that the box is of."""
    pairs = adjacent(boxes)
    sides = pairs.select("path_a", "path_b", F.explode(F.array("path_a", "path_b")).alias("path"))
    return near_bounds(assigned, threshold).select("point_id", "coords", "path").join(sides, "path").select("path_a", "path_b", "point_id", "coords", "path")


def partition_by_box(assigned: DataFrame, partitions: int | None = None) -> DataFrame:
    """Rows of assign() laid out by box, and within a partition in order of box and id."""
    dealt = assigned.repartition(partitions, "path") if partitions else assigned.repartition("path")
    return dealt.sortWithinPartitions("path", "point_id")
