"""Axis-aligned regions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Box = tuple[float, float, float, float]

# The two regions watched by default, as (min x, max x, min y, max y).
REGIONS: dict[str, Box] = {
    "goldman": (-74.0144185, -74.013777, 40.7138745, 40.7152275),
    "citigroup": (-74.012083, -74.009867, 40.720053, 40.7217236),
}


def bounding_box(vertices: Sequence[tuple[float, float]]) -> Box:
    """The smallest box around the vertices."""
    xs, ys = zip(*vertices, strict=True)
    return min(xs), max(xs), min(ys), max(ys)


def in_box(x: Column, y: Column, box: Box) -> Column:
    """Whether the point lies in the box, its edges included."""
    return x.between(box[0], box[1]) & y.between(box[2], box[3])


def region_label(x: Column, y: Column, regions: Mapping[str, Box] = REGIONS) -> Column:
    """Name of the first region that holds the point, else null."""
    return F.coalesce(*[F.when(in_box(x, y, box), F.lit(name)) for name, box in regions.items()], F.lit(None).cast("string"))
