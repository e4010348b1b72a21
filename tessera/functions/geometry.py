"""Cubes of any dimension, and distances on the earth."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the earth's radius in metres.
EARTH_RADIUS = 6378168.0


def cube(low: Column, high: Column | None = None) -> Column:
    """A cube between two corners, in any order, or a point."""
    high = low if high is None else high
    corner = lambda f: F.zip_with(low.cast("array<double>"), high.cast("array<double>"), lambda x, y: f(F.coalesce(x, F.lit(0.0)), F.coalesce(y, F.lit(0.0))))
    return F.struct(corner(F.least).alias("ll"), corner(F.greatest).alias("ur"))


def cube_dim(c: Column) -> Column:
    return F.size(c["ll"])


def cube_ll_coord(c: Column, n: int) -> Column:
    """The n-th lower coordinate; 0 for a dimension it hasn't."""
    return F.coalesce(F.try_element_at(c["ll"], F.lit(n)), F.lit(0.0))


def cube_ur_coord(c: Column, n: int) -> Column:
    return F.coalesce(F.try_element_at(c["ur"], F.lit(n)), F.lit(0.0))


def cube_is_point(c: Column) -> Column:
    return c["ll"] == c["ur"]


def _sides(a: Column, b: Column) -> Column:
    """Both cubes side by side, missing dimensions read as 0."""
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    one = F.zip_with(a["ll"], a["ur"], lambda x, y: F.struct(x.alias("l"), y.alias("u")))
    two = F.zip_with(b["ll"], b["ur"], lambda x, y: F.struct(x.alias("l"), y.alias("u")))
    return F.zip_with(one, two, lambda p, q: F.struct(zero(p["l"]).alias("al"), zero(p["u"]).alias("au"), zero(q["l"]).alias("bl"), zero(q["u"]).alias("bu")))


def cube_distance(a: Column, b: Column) -> Column:
    gap = lambda s: F.greatest(s["bl"] - s["au"], s["al"] - s["bu"], F.lit(0.0))
    return F.sqrt(F.aggregate(_sides(a, b), F.lit(0.0), lambda t, s: t + gap(s) * gap(s)))


def cube_overlaps(a: Column, b: Column) -> Column:
    return F.forall(_sides(a, b), lambda s: (s["al"] <= s["bu"]) & (s["bl"] <= s["au"]))


def cube_contains(a: Column, b: Column) -> Column:
    return F.forall(_sides(a, b), lambda s: (s["al"] <= s["bl"]) & (s["bu"] <= s["au"]))


def cube_union(a: Column, b: Column) -> Column:
    return F.struct(F.transform(_sides(a, b), lambda s: F.least(s["al"], s["bl"])).alias("ll"), F.transform(_sides(a, b), lambda s: F.greatest(s["au"], s["bu"])).alias("ur"))


def cube_inter(a: Column, b: Column) -> Column:
    return F.struct(F.transform(_sides(a, b), lambda s: F.greatest(s["al"], s["bl"])).alias("ll"), F.transform(_sides(a, b), lambda s: F.least(s["au"], s["bu"])).alias("ur"))


def cube_enlarge(c: Column, by: float, dims: int = 0) -> Column:
    """Every side moved outwards; a side that would turn over shrinks to its middle."""
    pad = F.array_repeat(F.lit(0.0), F.greatest(F.lit(dims) - F.size(c["ll"]), F.lit(0)))
    ll, ur = F.concat(c["ll"], pad), F.concat(c["ur"], pad)
    low = F.zip_with(ll, ur, lambda x, y: F.when(x - by > y + by, (x + y) / 2).otherwise(x - by))
    high = F.zip_with(ll, ur, lambda x, y: F.when(x - by > y + by, (x + y) / 2).otherwise(y + by))
    return F.struct(low.alias("ll"), high.alias("ur"))


def sec_to_gc(d: Column) -> Column:
    """The length along the surface of a straight distance."""
    return F.when(d < 0, 0.0).when(d / (2 * EARTH_RADIUS) > 1, math.pi * EARTH_RADIUS).otherwise(2 * EARTH_RADIUS * F.asin(F.least(d / (2 * EARTH_RADIUS), F.lit(1.0))))


def gc_to_sec(d: Column) -> Column:
    return F.when(d < 0, 0.0).when(d / EARTH_RADIUS > math.pi, 2 * EARTH_RADIUS).otherwise(2 * EARTH_RADIUS * F.sin(d / (2 * EARTH_RADIUS)))


def ll_to_earth(lat: Column, lon: Column) -> Column:
    """A point on the surface."""
    a, b = F.radians(lat), F.radians(lon)
    point = F.array(EARTH_RADIUS * F.cos(a) * F.cos(b), EARTH_RADIUS * F.cos(a) * F.sin(b), EARTH_RADIUS * F.sin(a))
    return F.struct(point.alias("ll"), point.alias("ur"))


def latitude(p: Column) -> Column:
    return F.degrees(F.asin(F.greatest(F.least(p["ll"][2] / EARTH_RADIUS, F.lit(1.0)), F.lit(-1.0))))


def longitude(p: Column) -> Column:
    return F.degrees(F.atan2(p["ll"][1], p["ll"][0]))


def earth_distance(a: Column, b: Column) -> Column:
    return sec_to_gc(cube_distance(a, b))


def earth_box(p: Column, distance: Column) -> Column:
    """A cube that holds all points within a distance along the surface."""
    d = gc_to_sec(distance)
    return F.struct(F.transform(p["ll"], lambda x: x - d).alias("ll"), F.transform(p["ur"], lambda x: x + d).alias("ur"))
