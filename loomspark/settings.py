"""Settings of a clustering and of density boxes."""

from __future__ import annotations

from dataclasses import dataclass

#: Labels that are no cluster.
NOISE, NEW_CLUSTER = 0, -1


@dataclass(frozen=True)
class ClusterSettings:
    """eps: radius, inclusive; min_points: neighbours that make a core point, itself included."""

    eps: float = 1e-4
    min_points: int = 3
    metric: str = "euclidean"
    border_as_noise: bool = False

    def __post_init__(self) -> None:
        if not self.eps >= 0 or self.eps == float("inf"):
            raise ValueError("eps must be a finite number, 0 at least")
        if self.min_points < 1:
            raise ValueError("min_points must be 1 at least")


@dataclass(frozen=True)
class BoxSettings:
    """Boxes are halved (splits: into how many parts) along their longest side, levels times at most, where points_per_box ask for it."""

    splits: int = 2
    levels: int = 10
    points_per_box: int = 50_000

    def __post_init__(self) -> None:
        if self.splits < 2 or self.levels < 0 or self.points_per_box < 1:
            raise ValueError("splits must be 2, levels 0 and points_per_box 1 at least")
        if self.splits**self.levels > 1 << 20:
            raise ValueError("splits ** levels must be at most 2 ** 20: the tree of boxes is held by the driver")
