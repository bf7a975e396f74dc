"""Focal functions of a 3x3 neighbourhood as Column expressions, and their registry."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from reliefspark.meta import RasterMeta

#: Fixed value: degrees in a radian, in the precision that results depend on.
DEGREES = 57.29578


@dataclass(frozen=True)
class Neighbourhood:
    """The centre ``e`` and its neighbours from north-west (``a``) to south-east (``i``), after filling."""

    a: Column
    b: Column
    c: Column
    d: Column
    e: Column
    f: Column
    g: Column
    h: Column
    i: Column


#: From neighbourhood, dz/dx, dz/dy and header to the cell's value; null becomes NODATA.
Builder = Callable[[Neighbourhood, Column, Column, RasterMeta], Column]


def gradient_dx(n: Neighbourhood, cellsize: float) -> Column:
    return ((n.c + 2 * n.f + n.i) - (n.a + 2 * n.d + n.g)) / F.lit(8 * float(cellsize))


def gradient_dy(n: Neighbourhood, cellsize: float) -> Column:
    """South minus north."""
    return ((n.g + 2 * n.h + n.i) - (n.a + 2 * n.b + n.c)) / F.lit(8 * float(cellsize))


def slope(n: Neighbourhood, dx: Column, dy: Column, meta: RasterMeta) -> Column:
    """Steepest descent in radians."""
    return F.atan(F.sqrt(dx * dx + dy * dy))


def aspect(n: Neighbourhood, dx: Column, dy: Column, meta: RasterMeta) -> Column:
    """Compass direction of the descent in radians (0 north, pi/2 east); flat cells have none.

    Degrees are rounded to single precision before they are turned, so that exact north is 0.
    """
    degrees = (F.lit(DEGREES) * F.atan2(dy, -dx)).cast("float").cast("double")
    compass = F.when(degrees > 90.0, F.lit(360.0) - degrees + F.lit(90.0)).otherwise(F.lit(90.0) - degrees)
    none = (dx == 0) & (dy == 0)
    if meta.stored_nodata is not None:
        none = none | (dx == F.lit(meta.stored_nodata)) | (dy == F.lit(meta.stored_nodata))
    return F.when(~none, compass * F.lit(math.pi / 180.0))


def sun_aspect(dx: Column, dy: Column) -> Column:
    """Direction of the descent as an angle from east, in [0, 2 pi), as hillshade uses it."""
    angle = F.atan2(dy, -dx)
    turned = F.when(angle < 0, F.lit(2 * math.pi) + angle).otherwise(angle)
    return F.when(dx != 0, turned).when(dy > 0, F.lit(math.pi / 2)).when(dy < 0, F.lit(2 * math.pi - math.pi / 2)).otherwise(angle)


def hillshade(altitude: float = 45.0, azimuth: float = 315.0) -> Builder:
    """Light from a sun at ``altitude`` and ``azimuth`` (degrees), from 0 to 255, not rounded."""
    zenith = math.radians(90.0 - altitude)
    turned = 360.0 - azimuth + 90.0
    direction = math.radians(turned - 360.0 if turned >= 360.0 else turned)

    def build(n: Neighbourhood, dx: Column, dy: Column, meta: RasterMeta) -> Column:
        tilt = slope(n, dx, dy, meta)
        light = F.lit(math.cos(zenith)) * F.cos(tilt) + F.lit(math.sin(zenith)) * F.sin(tilt) * F.cos(F.lit(direction) - sun_aspect(dx, dy))
        return F.greatest(F.lit(0.0), F.lit(255.0) * light)

    return build


def hillshade_aspect(n: Neighbourhood, dx: Column, dy: Column, meta: RasterMeta) -> Column:
    """The angle that hillshade uses, for cells that aren't flat."""
    return F.when((dx != 0) | (dy != 0), sun_aspect(dx, dy))


def mean(n: Neighbourhood, dx: Column, dy: Column, meta: RasterMeta) -> Column:
    return (n.a + n.b + n.c + n.d + n.e + n.f + n.g + n.h + n.i) / F.lit(9.0)


def laplacian(n: Neighbourhood, dx: Column, dy: Column, meta: RasterMeta) -> Column:
    return n.b + n.d + n.f + n.h - F.lit(4.0) * n.e


_REGISTRY: dict[str, Builder] = {}


def register_focal(name: str, builder: Builder) -> None:
    """Makes a function known by name, without regard to case."""
    _REGISTRY[name.lower()] = builder


def focal_function(name: str) -> Builder:
    try:
        return _REGISTRY[name.lower()]
    except KeyError:
        raise ValueError(f"unknown function {name!r}; known are {', '.join(sorted(_REGISTRY))}") from None


for _name, _builder in {"slope": slope, "aspect": aspect, "hillshade": hillshade(), "hillshade_aspect": hillshade_aspect, "dz_dx": lambda n, dx, dy, m: dx, "dz_dy": lambda n, dx, dy, m: dy, "mean": mean, "laplacian": laplacian}.items():
    register_focal(_name, _builder)
