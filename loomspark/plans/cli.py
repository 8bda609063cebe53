"""python -m loomspark.plans.cli --input points.csv --output out --eps 1.5 --min-points 4"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from loomspark.plans.model import DensityClusterer
from loomspark.settings import BoxSettings
from loomspark.sources.points import points, read_csv


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description="Density clustering of numeric points")
    p.add_argument("--input", required=True, help="CSV without header, or Parquet with --coords")
    p.add_argument("--output", required=True)
    p.add_argument("--eps", type=float, required=True)
    p.add_argument("--min-points", type=int, required=True)
    p.add_argument("--metric", default="euclidean")
    p.add_argument("--border-as-noise", action="store_true")
    p.add_argument("--mode", choices=("fail", "drop"), default="fail", help="what to do with rows that are no points")
    p.add_argument("--coords", nargs="+", help="columns of Parquet input")
    p.add_argument("--id", help="id column of Parquet input")
    p.add_argument("--master")
    p.add_argument("--splits", type=int, default=BoxSettings.splits, help="parts of a box's longest side")
    p.add_argument("--levels", type=int, default=BoxSettings.levels, help="how many times boxes are parted at most")
    p.add_argument("--points-per-box", type=int, default=BoxSettings.points_per_box)
    p.add_argument("--debug-output", help="folder for boxes, placed points, partial labels, mappings, points near bounds and cluster sizes")
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    builder = SparkSession.builder.appName("loomspark")
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    if a.coords:
        data = points(spark.read.parquet(a.input), a.coords[0] if len(a.coords) == 1 and dict(spark.read.parquet(a.input).dtypes)[a.coords[0]].startswith("array") else a.coords, a.id, a.mode)
    else:
        data = read_csv(spark, a.input, a.mode)
    boxes = BoxSettings(a.splits, a.levels, a.points_per_box)
    model = DensityClusterer(eps=a.eps, min_points=a.min_points, metric=a.metric, border_as_noise=a.border_as_noise, boxes=boxes, debug=a.debug_output).fit(data)
    model.save_csv(a.output)


if __name__ == "__main__":
    main()
