"""Geometry and projections as column expressions. Points are struct<x,y>; rings are arrays of points."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TransverseMercator:
    """Snyder's series for an ellipsoid (a, f) with origin (lat0, lon0), scale k0 and false offsets."""

    a: float
    f: float
    lat0: float
    lon0: float
    k0: float
    fe: float
    fn: float

    @property
    def e2(self) -> float:
        return self.f * (2 - self.f)

    def _arc(self) -> tuple[float, float, float, float]:
        e2 = self.e2
        return (1 - e2 / 4 - 3 * e2**2 / 64 - 5 * e2**3 / 256, 3 * e2 / 8 + 3 * e2**2 / 32 + 45 * e2**3 / 1024, 15 * e2**2 / 256 + 45 * e2**3 / 1024, 35 * e2**3 / 3072)

    def _meridian(self, phi, sin):
        c0, c2, c4, c6 = self._arc()
        return (phi * c0 - sin(phi * 2) * c2 + sin(phi * 4) * c4 - sin(phi * 6) * c6) * self.a

    def forward(self, lon: Column, lat: Column) -> Column:
        """x, y in metres from degrees."""
        ep2, origin = self.e2 / (1 - self.e2), self._meridian(math.radians(self.lat0), math.sin)

        def placed(p: Column) -> Column:
            phi, d, nu, t, c, tan = (p[k] for k in ("phi", "d", "nu", "t", "c", "tan"))
            x = self.fe + self.k0 * nu * (d + (1 - t + c) * F.pow(d, 3) / 6 + (5 - 18 * t + t * t + 72 * c - 58 * ep2) * F.pow(d, 5) / 120)
            rise = d * d / 2 + (5 - t + 9 * c + 4 * c * c) * F.pow(d, 4) / 24 + (61 - 58 * t + t * t + 600 * c - 330 * ep2) * F.pow(d, 6) / 720
            return _pair(x, self.fn + self.k0 * (self._meridian(phi, F.sin) - origin + nu * tan * rise))

        def turned(p: Column) -> Column:
            sin, cos, tan = p["sin"], p["cos"], p["tan"]
            return _let(placed, phi=p["phi"], d=(F.radians(p["lon"]) - math.radians(self.lon0)) * cos, nu=self.a / F.sqrt(1 - self.e2 * sin * sin), t=tan * tan, c=ep2 * cos * cos, tan=tan)

        return _let(lambda p: _let(turned, phi=p["phi"], lon=p["lon"], sin=F.sin(p["phi"]), cos=F.cos(p["phi"]), tan=F.tan(p["phi"])), phi=F.radians(lat), lon=lon)

    def inverse(self, x: Column, y: Column) -> Column:
        """x, y: longitude and latitude in degrees from metres."""
        e2, ep2 = self.e2, self.e2 / (1 - self.e2)
        e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
        mu = (self._meridian(math.radians(self.lat0), math.sin) + (y - self.fn) / self.k0) / (self.a * self._arc()[0])

        def placed(p: Column) -> Column:
            phi, d, nu, rho, t, c, tan, cos = (p[k] for k in ("phi", "d", "nu", "rho", "t", "c", "tan", "cos"))
            lat = phi - nu * tan / rho * (d * d / 2 - (5 + 3 * t + 10 * c - 4 * c * c - 9 * ep2) * F.pow(d, 4) / 24 + (61 + 90 * t + 298 * c + 45 * t * t - 252 * ep2 - 3 * c * c) * F.pow(d, 6) / 720)
            lon = (d - (1 + 2 * t + c) * F.pow(d, 3) / 6 + (5 - 2 * c + 28 * t - 3 * c * c + 8 * ep2 + 24 * t * t) * F.pow(d, 5) / 120) / cos
            return _pair(self.lon0 + F.degrees(lon), F.degrees(lat))

        def scaled(p: Column) -> Column:
            nu, rho = self.a / F.sqrt(p["root"]), self.a * (1 - e2) / F.pow(p["root"], 1.5)
            return _let(placed, phi=p["phi"], d=(p["x"] - self.fe) / (nu * self.k0), nu=nu, rho=rho, t=p["tan"] * p["tan"], c=ep2 * p["cos"] * p["cos"], tan=p["tan"], cos=p["cos"])

        def turned(p: Column) -> Column:
            sin = F.sin(p["phi"])
            return _let(scaled, phi=p["phi"], x=p["x"], root=1 - e2 * sin * sin, cos=F.cos(p["phi"]), tan=F.tan(p["phi"]))

        def footed(p: Column) -> Column:
            mu = p["mu"]
            phi = mu + (3 * e1 / 2 - 27 * e1**3 / 32) * F.sin(2 * mu) + (21 * e1**2 / 16 - 55 * e1**4 / 32) * F.sin(4 * mu) + 151 * e1**3 / 96 * F.sin(6 * mu) + 1097 * e1**4 / 512 * F.sin(8 * mu)
            return _let(turned, phi=phi, x=p["x"])

        return _let(footed, mu=mu, x=x)


# Projections by their public code.
_GRS80, _BESSEL = (6378137.0, 1 / 298.257222101), (6377397.155, 1 / 299.1528128)
PROJECTIONS = {
    5186: TransverseMercator(*_GRS80, 38.0, 127.0, 1.0, 200000.0, 600000.0),
    5181: TransverseMercator(*_GRS80, 38.0, 127.0, 1.0, 200000.0, 500000.0),
    5179: TransverseMercator(*_GRS80, 38.0, 127.5, 0.9996, 1000000.0, 2000000.0),
    2097: TransverseMercator(*_BESSEL, 38.0, 127.0, 1.0, 200000.0, 500000.0),
    5174: TransverseMercator(*_BESSEL, 38.0, 127.0028902777778, 1.0, 200000.0, 500000.0),
}
WORKING = 5186
#: Shift from the Bessel datum: translations (m), rotations (arc seconds), scale (ppm).
BESSEL_SHIFT = (-115.80, 474.99, 674.11, 1.16, -2.31, -1.63, 6.43)


def projected(x: Column, y: Column, source: int, target: int = WORKING, datum_shift: bool = True) -> Column:
    """A struct of x and y: coordinates of one public code in another; 4326 stands for degrees."""
    at = _pair(x, y)
    if source == target:
        return at
    if source != 4326:
        at = _bound(at, PROJECTIONS[source].inverse)
    if source in (2097, 5174) and datum_shift:
        at = _bound(at, _helmert)
    if target != 4326:
        at = _bound(at, PROJECTIONS[target].forward)
    return at


def project(x: Column, y: Column, source: int, target: int = WORKING, datum_shift: bool = True) -> tuple[Column, Column]:
    """projected as two columns; where both are taken, a struct that is kept first is computed once."""
    at = projected(x, y, source, target, datum_shift)
    return (x, y) if source == target else (at["x"], at["y"])


def _pair(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def _let(body, **values: Column) -> Column:
    """body over a struct of values, each computed once; written out, a formula would repeat them wherever it names them."""
    return F.element_at(F.transform(F.array(F.struct(*[c.alias(n) for n, c in values.items()])), body), 1)


def _bound(at: Column, step) -> Column:
    """A step over a point that is computed once; written out, each step would repeat the one before it many times."""
    return F.element_at(F.transform(F.array(at), lambda p: step(p["x"], p["y"])), 1)


def helmert(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Bessel degrees to GRS80 degrees by seven parameters, at height 0."""
    at = _helmert(lon, lat)
    return at["x"], at["y"]


def _helmert(lon: Column, lat: Column) -> Column:
    a0, f0 = _BESSEL
    e0, (dx, dy, dz, rx, ry, rz, ppm) = f0 * (2 - f0), BESSEL_SHIFT
    rx, ry, rz = (math.radians(r / 3600) for r in (rx, ry, rz))
    k = 1 + ppm * 1e-6
    a, f = _GRS80
    e2, b = f * (2 - f), a * (1 - f)

    def solid(p: Column) -> Column:
        phi, lam = p["phi"], p["lam"]
        nu = a0 / F.sqrt(1 - e0 * F.sin(phi) * F.sin(phi))
        return _let(moved, x=nu * F.cos(phi) * F.cos(lam), y=nu * F.cos(phi) * F.sin(lam), z=nu * (1 - e0) * F.sin(phi))

    def moved(p: Column) -> Column:
        x, y, z = p["x"], p["y"], p["z"]
        return _let(degrees, x=dx + k * (x - rz * y + ry * z), y=dy + k * (rz * x + y - rx * z), z=dz + k * (-ry * x + rx * y + z))

    def degrees(q: Column) -> Column:
        p = F.sqrt(q["x"] * q["x"] + q["y"] * q["y"])
        theta = F.atan2(q["z"] * a, p * b)
        lat = F.atan2(q["z"] + e2 / (1 - e2) * b * F.pow(F.sin(theta), 3), p - e2 * a * F.pow(F.cos(theta), 3))
        return _pair(F.degrees(F.atan2(q["y"], q["x"])), F.degrees(lat))

    return _let(solid, phi=F.radians(lat), lam=F.radians(lon))


def guess_code(x: Column, default: int = WORKING) -> Column:
    """The public code that a coordinate's magnitude suggests."""
    return F.when(x.between(1e5, 4e5), 5186).when(x.between(8e5, 1.2e6), 5179).when(x.between(120, 135), 4326).otherwise(default)


def mercator_pixel(lon: Column, lat: Column, zoom: int = 15) -> tuple[Column, Column]:
    """Global pixel of a web map with 256-pixel tiles."""
    n = float(2**zoom * 256)
    return (lon + 180) / 360 * n, (1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * n


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    half = lambda d: F.pow(F.sin(F.radians(d) / 2), 2)
    return 2 * 6371000.0 * F.asin(F.sqrt(half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon2 - lon1)))


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return F.hypot(x1 - x2, y1 - y2)


def cell(v: Column, size: float) -> Column:
    return F.floor(v / size).cast("long")


def cell_centre(g: Column, size: float) -> Column:
    return (g + 0.5) * size


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is worked out once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _sides(ring: Column) -> Column:
    """The ring's sides, its closing one included whether or not the first point is repeated."""
    return F.transform(ring, lambda p, i: F.struct(p.alias("p"), F.coalesce(F.get(ring, i - 1), F.element_at(ring, -1)).alias("q")))


def in_rings(x: Column, y: Column, rings: Column) -> Column:
    """Even-odd rule over all rings, so holes count themselves out. A point on a ring is as its crossings say."""

    def crossed(s: Column) -> Column:
        p, q = s["p"], s["q"]
        at = (q["x"] - p["x"]) * (y - p["y"]) / F.when(q["y"] == p["y"], 1.0).otherwise(q["y"] - p["y"]) + p["x"]
        return ((p["y"] > y) != (q["y"] > y)) & (x < at)

    return F.size(F.filter(F.flatten(F.transform(rings, _sides)), crossed)) % 2 == 1


def ring_area(ring: Column) -> Column:
    cross = lambda s: s["q"]["x"] * s["p"]["y"] - s["p"]["x"] * s["q"]["y"]
    return _once(ring, lambda r: F.abs(F.aggregate(F.transform(_sides(r), cross), F.lit(0.0), lambda a, v: a + v)) / 2)


def polygon_area(rings: Column) -> Column:
    """Area of the first ring less that of its holes."""
    holes = F.aggregate(F.transform(F.slice(rings, F.lit(2), F.greatest(F.size(rings) - 1, F.lit(0))), ring_area), F.lit(0.0), lambda a, v: a + v)
    return ring_area(rings[0]) - holes


def interior_point(ring: Column) -> Column:
    """A point inside a ring: the middle of the widest inner span at mid height; exact for boxes."""

    def crossed(r: Column, mid: Column) -> Column:
        level = lambda s: (s["p"]["y"] > mid) != (s["q"]["y"] > mid)
        at = lambda s: s["p"]["x"] + (mid - s["p"]["y"]) * (s["q"]["x"] - s["p"]["x"]) / (s["q"]["y"] - s["p"]["y"])
        return F.array_sort(F.transform(F.filter(_sides(r), level), at))

    def widest(xs: Column) -> Column:
        spans = F.transform(F.filter(F.transform(xs, lambda v, i: F.struct((F.get(xs, i + 1) - v).alias("wide"), v.alias("from"), i.alias("i"))), lambda s: s["i"] % 2 == 0), lambda s: F.struct(s["wide"], s["from"]))
        return F.array_max(F.filter(spans, lambda s: s["wide"].isNotNull()))

    def inside(r: Column, mid: Column) -> Column:
        best = _once(crossed(r, mid), widest)
        return _once(best, lambda b: F.struct((b["from"] + b["wide"] / 2).alias("x"), mid.alias("y")))

    level_of = lambda ys: (F.array_min(ys) + F.array_max(ys)) / 2
    return _once(ring, lambda r: _once(_once(F.transform(r, lambda p: p["y"]), level_of), lambda mid: inside(r, mid)))


def principal_axis(points: Column) -> Column:
    """Ends of the points' extent along their main axis, the mean included: struct<ax,ay,bx,by,cx,cy>.

    The mean runs over all points given, a repeated closing point too."""
    total = lambda f: F.aggregate(F.transform(points, f), F.lit(0.0), lambda a, v: a + v)

    def turned(c: Column) -> Column:
        cx, cy = c["cx"], c["cy"]
        sxx, syy = total(lambda p: (p["x"] - cx) * (p["x"] - cx)), total(lambda p: (p["y"] - cy) * (p["y"] - cy))
        return _once(0.5 * F.atan2(2 * total(lambda p: (p["x"] - cx) * (p["y"] - cy)), sxx - syy), lambda angle: extent(cx, cy, angle))

    def extent(cx: Column, cy: Column, angle: Column) -> Column:
        along = F.transform(points, lambda p: (p["x"] - cx) * F.cos(angle) + (p["y"] - cy) * F.sin(angle))
        at = lambda far: (cx + far * F.cos(angle), cy + far * F.sin(angle))
        ends = lambda v: F.struct(*[c.alias(n) for c, n in zip((*at(F.array_min(v)), *at(F.array_max(v)), cx, cy), ("ax", "ay", "bx", "by", "cx", "cy"), strict=True)])
        return _once(along, ends)

    return _once(F.struct((total(lambda p: p["x"]) / F.size(points)).alias("cx"), (total(lambda p: p["y"]) / F.size(points)).alias("cy")), turned)


def box_axis(points: Column) -> Column:
    """Middles of the short sides of the least rectangle around the points, in any rotation: struct<ax,ay,bx,by>.

    Such a rectangle has a side along two of the hull's points, so the direction of every pair of points is tried."""
    pair = lambda p, q: F.struct(F.atan2(q["y"] - p["y"], q["x"] - p["x"]).alias("t"))
    turns = F.array_distinct(F.flatten(F.transform(points, lambda p: F.transform(F.filter(points, lambda q: (q["x"] > p["x"]) | ((q["x"] == p["x"]) & (q["y"] > p["y"]))), lambda q: pair(p, q)["t"]))))

    def box(t: Column) -> Column:
        u = F.transform(points, lambda p: p["x"] * F.cos(t) + p["y"] * F.sin(t))
        v = F.transform(points, lambda p: p["y"] * F.cos(t) - p["x"] * F.sin(t))
        wide, high = F.array_max(u) - F.array_min(u), F.array_max(v) - F.array_min(v)
        return F.struct(F.round(wide * high, 6).alias("area"), t.alias("t"), F.array_min(u).alias("u0"), F.array_max(u).alias("u1"), F.array_min(v).alias("v0"), F.array_max(v).alias("v1"))

    b = F.array_min(F.transform(turns, box))
    lying = b["u1"] - b["u0"] >= b["v1"] - b["v0"]
    um, vm = (b["u0"] + b["u1"]) / 2, (b["v0"] + b["v1"]) / 2
    au, av = F.when(lying, b["u0"]).otherwise(um), F.when(lying, vm).otherwise(b["v0"])
    bu, bv = F.when(lying, b["u1"]).otherwise(um), F.when(lying, vm).otherwise(b["v1"])
    x, y = (lambda u, v: u * F.cos(b["t"]) - v * F.sin(b["t"])), (lambda u, v: u * F.sin(b["t"]) + v * F.cos(b["t"]))
    return F.struct(x(au, av).alias("ax"), y(au, av).alias("ay"), x(bu, bv).alias("bx"), y(bu, bv).alias("by"))


def compass(dx: Column, dy: Column) -> Column:
    """One of eight directions of a vector, north up."""
    names = F.array(*[F.lit(d) for d in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return F.element_at(names, (F.floor((F.degrees(F.atan2(dx, dy)) + 382.5) / 45).cast("int") % 8) + 1)


def parse_points(wkt: Column) -> Column:
    """Arrays of points, one for each bracket of numbers in a WKT text."""
    parts = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), 1)
    number = lambda p, k: F.split(F.trim(p), r"\s+")[k].try_cast("double")
    point = lambda p: F.struct(number(p, 0).alias("x"), number(p, 1).alias("y"))
    return F.transform(parts, lambda t: F.transform(F.filter(F.split(t, ","), lambda p: F.trim(p) != ""), point))
