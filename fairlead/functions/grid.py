"""Fractional grid positions and interpolation from the four corners of a cell."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from fairlead.functions.units import num

CORNERS = ("00", "10", "01", "11")  # y then x


def fraction(value: Column, first: Column | float, step: Column | float, count: Column | int) -> Column:
    """Position along an axis, clamped to [0, count - 1.001], so the last cell's far edge is never reached."""
    top = (count if isinstance(count, Column) else F.lit(count)) - F.lit(1.001).cast("double")
    return F.greatest(F.lit(0.0), F.least(top, (value - num(first)) / num(step)))


def weights(fy: Column, fx: Column) -> dict[str, Column]:
    wy, wx = fy - F.floor(fy), fx - F.floor(fx)
    return {"00": (1.0 - wy) * (1.0 - wx), "10": wy * (1.0 - wx), "01": (1.0 - wy) * wx, "11": wy * wx}


def bilinear(corner: dict[str, Column], weight: dict[str, Column]) -> Column:
    """Weighted sum; one NaN corner makes it NaN."""
    return reduce(add, (corner[k] * weight[k] for k in CORNERS))


def bilinear_masked(corner: dict[str, Column], weight: dict[str, Column]) -> Column:
    """Mean over the corners that are not NaN, by their weights; if these vanish, the first such corner; else NaN."""
    valid = {k: ~F.isnan(corner[k]) for k in CORNERS}
    total = reduce(add, (F.when(valid[k], weight[k]).otherwise(0.0) for k in CORNERS))
    part = reduce(add, (F.when(valid[k], corner[k] * weight[k]).otherwise(0.0) for k in CORNERS))
    first = F.coalesce(*[F.when(valid[k], corner[k]) for k in CORNERS], F.lit(float("nan")))
    return F.when(total > 1e-12, part / F.when(total > 1e-12, total)).otherwise(first)


def nearest_index(f: Column, count: Column | int) -> Column:
    """Index of the nearest grid line; halves go to the even one."""
    return F.least(F.rint(f), (count if isinstance(count, Column) else F.lit(count)) - F.lit(1)).cast("int")
