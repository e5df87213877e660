"""Projections and map/pixel coordinates as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid: semi-major axis in metres and eccentricity (fixed values)
A = 6378137.0
E = 0.0818191908426215


def authalic(s: Column) -> Column:
    """The ellipsoid's q of a latitude's sine: the area from the equator up to it, as a share."""
    return (1 - E * E) * (s / (1 - E * E * s * s) - F.ln((1 - E * s) / (1 + E * s)) / (2 * E))


def cea(lon: Column, lat: Column, lon0: Column | float = 0.0, standard_parallel: float = 30.0) -> tuple[Column, Column]:
    """Cylindrical equal area on the ellipsoid; with a standard parallel of 30 degrees EPSG:6933."""
    s0 = math.sin(math.radians(standard_parallel))
    k0 = math.cos(math.radians(standard_parallel)) / math.sqrt(1 - E * E * s0 * s0)
    lon0 = lon0 if isinstance(lon0, Column) else F.lit(float(lon0))
    return A * k0 * F.radians(lon - lon0), A * authalic(F.sin(F.radians(lat))) / (2 * k0)


def local_cea(lon: Column, lat: Column, corner_lon: Column | float) -> tuple[Column, Column]:
    """Equal area around an extent's corner; the corner's latitude plays no part, the standard parallel is 0."""
    return cea(lon, lat, corner_lon, 0.0)


def mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    """EPSG:3857."""
    return A * F.radians(lon), A * F.ln(F.tan(F.radians(45 + lat / 2)))


def unmercator(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of EPSG:3857."""
    return F.degrees(x / A), F.degrees(2 * F.atan(F.exp(y / A))) - 90


def uncea(x: Column, y: Column, lon0: Column | float = 0.0, standard_parallel: float = 30.0) -> tuple[Column, Column]:
    """Longitude and latitude of cea(), by the series of the authalic latitude and a step of Newton's method."""
    s0, e2 = math.sin(math.radians(standard_parallel)), E * E
    k0 = math.cos(math.radians(standard_parallel)) / math.sqrt(1 - e2 * s0 * s0)
    pole = 1 - (1 - e2) / (2 * E) * math.log((1 - E) / (1 + E))
    lon0 = lon0 if isinstance(lon0, Column) else F.lit(float(lon0))
    q = y * (2 * k0 / A)
    b = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), q / pole)))
    lat = b + (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040) * F.sin(2 * b) + (23 * e2**2 / 360 + 251 * e2**3 / 3780) * F.sin(4 * b) + 761 * e2**3 / 45360 * F.sin(6 * b)
    s = F.sin(lat)
    # beside the poles, where the step has no meaning, the series stands
    step = F.when(F.cos(lat) > 1e-6, (1 - e2 * s * s) * (1 - e2 * s * s) / (2 * F.cos(lat) * (1 - e2)) * (q - authalic(s))).otherwise(0.0)
    return lon0 + F.degrees(x / (A * k0)), F.degrees(lat + step)


def _by_crs(epsg: Column | int, ways: dict[int, tuple[Column, Column]]) -> tuple[Column, Column]:
    if isinstance(epsg, int):
        if epsg not in ways:
            raise ValueError(f"EPSG:{epsg} is none of {sorted(ways)}")
        return ways[epsg]
    out = [F.lit(None).cast("double"), F.lit(None).cast("double")]
    for number, xy in ways.items():
        out = [F.when(epsg == number, c).otherwise(o) for c, o in zip(xy, out, strict=True)]
    return out[0], out[1]


def to_lonlat(x: Column, y: Column, epsg: Column | int) -> tuple[Column, Column]:
    """Longitude and latitude of a point in EPSG:4326, 3857 or 6933; null for any other number in a column."""
    return _by_crs(epsg, {4326: (x, y), 3857: unmercator(x, y), 6933: uncea(x, y)})


def to_local(x: Column, y: Column, epsg: Column, lon0: Column) -> tuple[Column, Column]:
    """local_cea() around lon0 of a point in EPSG:4326, 3857 or 6933; null for any other number.

    6933 is an equal-area system itself and only scaled, so that places beyond its poles have measures as well.
    """
    lx, ly = local_cea(*to_lonlat(x, y, epsg), lon0)
    s0 = math.sin(math.radians(30.0))
    return lx, F.when(epsg == 6933, y * (math.cos(math.radians(30.0)) / math.sqrt(1 - E * E * s0 * s0))).otherwise(ly)


def from_lonlat(lon: Column, lat: Column, epsg: Column | int) -> tuple[Column, Column]:
    """A longitude and latitude in EPSG:4326, 3857 or 6933."""
    return _by_crs(epsg, {4326: (lon, lat), 3857: mercator(lon, lat), 6933: cea(lon, lat)})


def reproject(x: Column, y: Column, source: Column | int, target: Column | int) -> tuple[Column, Column]:
    """A point of one coordinate system in another."""
    return from_lonlat(*to_lonlat(x, y, source), target)


def reproject_box(box: list[Column], source: Column | int, target: Column | int) -> list[Column]:
    """xmin, ymin, xmax, ymax in another system: all known ones are cylindrical, so two corners tell all."""
    a, b = reproject(box[0], box[1], source, target), reproject(box[2], box[3], source, target)
    return [F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[0], b[0]), F.greatest(a[1], b[1])]


def to_map(col: Column, row: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """Map coordinates of a pixel position; rows count downwards."""
    return xmin + col / width * (xmax - xmin), ymin + (1 - row / height) * (ymax - ymin)


def to_pixel(x: Column, y: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column, width: Column, height: Column) -> tuple[Column, Column]:
    """The pixel position of map coordinates; null where the extent has no width or height."""
    return F.try_divide(x - xmin, F.abs(xmax - xmin)) * width, (1 - F.try_divide(y - ymin, F.abs(ymax - ymin))) * height


def resolution(extent: Column, pixels: Column) -> Column:
    """Map units a pixel."""
    return extent / pixels


def equivalent_diameter(area: Column) -> Column:
    """Diameter of the circle of equal area."""
    return F.sqrt(area * 4 / F.pi())
