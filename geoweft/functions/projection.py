"""Map projections as column expressions, by EPSG code.

Geographic coordinates are longitude and latitude in degrees, in this order.
Transverse Mercator takes Krueger's series to the fourth order of the third
flattening, which is good to a thousandth of a millimetre within some 3,000 km of
the central meridian; all inverses take its series from conformal to geodetic
latitude. Datums that differ by less than two metres (WGS 84, ETRS89, NAD83, RGF93)
count as one; others aren't known.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Ellipsoid:
    a: float
    inverse_flattening: float

    @property
    def f(self) -> float:
        return 1 / self.inverse_flattening if self.inverse_flattening else 0.0

    @property
    def e(self) -> float:
        return math.sqrt(self.f * (2 - self.f))

    @property
    def n(self) -> float:
        return self.f / (2 - self.f)

    def _series(self, rows: tuple) -> list[float]:
        """Coefficients from rows of those of n, n**2, ..."""
        return [sum(c * self.n ** (k + i) for i, c in enumerate(row)) for k, row in enumerate(rows, 1)]

    def conformal_tangent(self, lat: Column) -> Column:
        """The tangent of the conformal latitude of a latitude in radians."""
        s = F.sin(lat)
        return F.sinh(F.atanh(s) - F.lit(self.e) * F.atanh(F.lit(self.e) * s))

    def geodetic(self, chi: Column) -> Column:
        """The latitude of a conformal latitude, in radians."""
        return sum((F.lit(d) * F.sin(2 * k * chi) for k, d in enumerate(self._series(DELTA), 1)), chi)


# The coefficients of n, n**2, ... (from the row's own power on) of Krueger's series, as published.
ALPHA = ((1 / 2, -2 / 3, 5 / 16, 41 / 180), (13 / 48, -3 / 5, 557 / 1440), (61 / 240, -103 / 140), (49561 / 161280,))
BETA = ((1 / 2, -2 / 3, 37 / 96, -1 / 360), (1 / 48, 1 / 15, -437 / 1440), (17 / 480, -37 / 840), (4397 / 161280,))
DELTA = ((2, -2 / 3, -2, 116 / 45), (7 / 3, -8 / 5, -227 / 45), (56 / 15, -136 / 35), (4279 / 630,))
WGS84, GRS80 = Ellipsoid(6378137.0, 298.257223563), Ellipsoid(6378137.0, 298.257222101)


def _atan2(y: Column, x: Column) -> Column:
    return F.atan2(y, x)


@dataclass(frozen=True)
class Geographic:
    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        return lon, lat

    inverse = forward


@dataclass(frozen=True)
class Mercator:
    """On an ellipsoid; on the sphere of its axis if ``sphere``, as web maps are drawn."""

    ellipsoid: Ellipsoid = WGS84
    lon0: float = 0.0
    k: float = 1.0
    east: float = 0.0
    north: float = 0.0
    sphere: bool = False

    @property
    def form(self) -> Ellipsoid:
        return Ellipsoid(self.ellipsoid.a, 0) if self.sphere else self.ellipsoid

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        r = F.lit(self.ellipsoid.a * self.k)
        return self.east + r * F.radians(lon - self.lon0), self.north + r * F.asinh(self.form.conformal_tangent(F.radians(lat)))

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        r = F.lit(self.ellipsoid.a * self.k)
        chi = F.atan(F.sinh((y - self.north) / r))
        return F.degrees((x - self.east) / r) + self.lon0, F.degrees(self.form.geodetic(chi))


@dataclass(frozen=True)
class TransverseMercator:
    ellipsoid: Ellipsoid = WGS84
    lon0: float = 0.0
    lat0: float = 0.0
    k: float = 0.9996
    east: float = 500000.0
    north: float = 0.0

    @property
    def radius(self) -> float:
        n = self.ellipsoid.n
        return self.k * self.ellipsoid.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)

    @property
    def start(self) -> float:
        """The northing of the natural origin, before the false one."""
        e, phi = self.ellipsoid, math.radians(self.lat0)
        chi = math.atan(math.sinh(math.atanh(math.sin(phi)) - e.e * math.atanh(e.e * math.sin(phi))))
        return self.radius * (chi + sum(a * math.sin(2 * k * chi) for k, a in enumerate(e._series(ALPHA), 1)))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        t, d = self.ellipsoid.conformal_tangent(F.radians(lat)), F.radians(lon - self.lon0)
        xi, eta = _atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
        x, y = eta, xi
        for k, a in enumerate(self.ellipsoid._series(ALPHA), 1):
            x = x + F.lit(a) * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
            y = y + F.lit(a) * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        return self.east + self.radius * x, F.lit(self.north - self.start) + self.radius * y

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        xi, eta = (y - (self.north - self.start)) / self.radius, (x - self.east) / self.radius
        u, v = xi, eta
        for k, b in enumerate(self.ellipsoid._series(BETA), 1):
            u = u - F.lit(b) * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
            v = v - F.lit(b) * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
        chi = F.asin(F.sin(u) / F.cosh(v))
        return F.degrees(_atan2(F.sinh(v), F.cos(u))) + self.lon0, F.degrees(self.ellipsoid.geodetic(chi))


@dataclass(frozen=True)
class Lambert:
    """The conformal conic with two standard parallels."""

    ellipsoid: Ellipsoid
    lat0: float
    lon0: float
    lat1: float
    lat2: float
    east: float
    north: float

    @property
    def cone(self) -> tuple[float, float, float]:
        """The cone's constant, its scale, and the radius of the origin's parallel."""
        e = self.ellipsoid
        m = lambda p: math.cos(p) / math.sqrt(1 - (e.e * math.sin(p)) ** 2)
        iso = lambda p: math.atanh(math.sin(p)) - e.e * math.atanh(e.e * math.sin(p))
        p0, p1, p2 = map(math.radians, (self.lat0, self.lat1, self.lat2))
        n = math.sin(p1) if p1 == p2 else (math.log(m(p1)) - math.log(m(p2))) / (iso(p2) - iso(p1))
        scale = e.a * m(p1) * math.exp(n * iso(p1)) / n
        return n, scale, scale * math.exp(-n * iso(p0))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        n, scale, r0 = self.cone
        r = F.lit(scale) * F.exp(-F.lit(n) * F.asinh(self.ellipsoid.conformal_tangent(F.radians(lat))))
        turn = F.lit(n) * F.radians(lon - self.lon0)
        return self.east + r * F.sin(turn), self.north + F.lit(r0) - r * F.cos(turn)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        n, scale, r0 = self.cone
        sign = math.copysign(1, n)
        u, v = sign * (x - self.east), sign * (F.lit(r0) - (y - self.north))
        chi = F.atan(F.sinh(-F.log(sign * F.sqrt(u * u + v * v) / scale * sign) / n))
        return F.degrees(_atan2(u, v) / n) + self.lon0, F.degrees(self.ellipsoid.geodetic(chi))


# Parameters of systems of the EPSG register.
SYSTEMS = {
    4326: Geographic(), 4258: Geographic(), 4269: Geographic(), 4171: Geographic(),
    3857: Mercator(sphere=True), 3395: Mercator(),
    2154: Lambert(GRS80, 46.5, 3.0, 49.0, 44.0, 700000.0, 6600000.0),
    3034: Lambert(GRS80, 52.0, 10.0, 35.0, 65.0, 4000000.0, 2800000.0),
    3347: Lambert(GRS80, 63.390675, -91.86666666666666, 49.0, 77.0, 6200000.0, 3000000.0),
    9377: TransverseMercator(GRS80, -73.0, 4.0, 0.9992, 5000000.0, 2000000.0),
}


def system(crs: object) -> Geographic | Mercator | TransverseMercator | Lambert:
    """The projection of an EPSG code, as a number, "EPSG:..." or a URN, or of OGC:CRS84."""
    if isinstance(crs, (Geographic, Mercator, TransverseMercator, Lambert)):
        return crs
    text = str(crs).strip()
    if re.fullmatch(r"(?i)(?:urn:ogc:def:crs:)?OGC:(?:[0-9.]*:)?CRS84", text):
        return Geographic()
    m = re.fullmatch(r"(?i)(?:(?:urn:ogc:def:crs:)?EPSG:(?:[0-9.]*:)?)?([0-9]+)", text)
    code = int(m[1]) if m else -1
    if code in SYSTEMS:
        return SYSTEMS[code]
    for low, high, zone, ellipsoid, north in ((32601, 32660, 1, WGS84, 0.0), (32701, 32760, 1, WGS84, 1e7), (25828, 25838, 28, GRS80, 0.0), (26901, 26923, 1, GRS80, 0.0)):
        if low <= code <= high:
            return TransverseMercator(ellipsoid, 6.0 * (code - low + zone) - 183, north=north)
    raise ValueError(f"No projection is known for this coordinate reference system: {crs!r}")


def transformed(point: Column, source: object, target: object) -> Column:
    """struct<x,y> of a struct<x,y> in another system."""
    a, b = system(source), system(target)
    x, y = point["x"].cast("double"), point["y"].cast("double")
    if a != b:
        x, y = b.forward(*a.inverse(x, y))
    return F.struct(x.alias("x"), y.alias("y"))
