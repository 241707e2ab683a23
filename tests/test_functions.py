"""Column functions against closed forms and plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from gradewalk.config import CODES, DEFAULT
from gradewalk.functions import cost, geo, text


def value(spark, *columns, **inputs):
    frame = spark.createDataFrame([tuple(inputs.values())], [*inputs]) if inputs else spark.range(1)
    return tuple(frame.select(*columns).first())


def elder(length, s, stair, m=DEFAULT):
    if stair:
        s = math.copysign(max(abs(s), 0.25), s + 1e-9)
    tobler = lambda v: 6 * math.exp(-3.5 * abs(v + 0.05))
    if s >= 0:
        factor = tobler(0) / tobler(s)
    elif m.downhill_weight == 0:
        factor = tobler(0) / tobler(s)
    else:
        factor = 1 + m.downhill_weight * (tobler(0) / tobler(-s) - 1)
    return length / m.elder_speed * factor * (m.stair_factor if stair else 1)


def test_uphill_factors(spark):
    got = [value(spark, cost.slow_down(F.lit(s / 100)))[0] for s in range(0, 21, 2)]
    assert [round(v, 2) for v in got] == [1.00, 1.07, 1.15, 1.23, 1.32, 1.42, 1.52, 1.63, 1.75, 1.88, 2.01]


@pytest.mark.parametrize("changes", [{}, {"downhill_weight": 0.0}, {"downhill_weight": 1.0}, {"elder_speed": 0.7, "stair_factor": 1.5}])
def test_elder_time(spark, changes):
    m = DEFAULT.but(**changes)
    rnd = random.Random(1)
    rows = [(rnd.uniform(0.1, 30), rnd.choice([0.0, rnd.uniform(-0.4, 0.4)]), rnd.random() < 0.5) for _ in range(200)]
    got = spark.createDataFrame(rows, "l double, s double, st boolean").select("l", "s", "st", cost.elder_seconds(F.col("l"), F.col("s"), F.col("st"), m).alias("t")).collect()
    for r in got:
        assert r["t"] == pytest.approx(elder(r["l"], r["s"], r["st"], m))
        if m.downhill_weight:
            assert r["t"] >= r["l"] / m.elder_speed - 1e-9


def test_level_stairs_are_uphill_both_ways(spark):
    up, down = value(spark, cost.elder_seconds(F.lit(8.0), F.lit(0.0), F.lit(True)), cost.elder_seconds(F.lit(8.0), F.lit(-0.0), F.lit(True)))
    assert up == down == pytest.approx(10 * math.exp(3.5 * 0.25) * 1.2)


def test_wheel_time(spark):
    t = lambda s, stair=False, free=False: value(spark, cost.wheel_seconds(F.lit(10.0), F.lit(s), F.lit(stair), stairs_passable=free))[0]
    assert t(0.0) == 10 and t(-0.05) == 10 and t(0.05) == pytest.approx(10 / 0.75)
    assert t(0.1) == pytest.approx(10 / 0.5 * 10) and t(-0.1) == 100 and t(0.3) == pytest.approx(10 / 0.4 * 10)
    assert t(0.0, True) is None and t(0.0, True, True) == 10


def test_slope(spark):
    s = lambda a, b, n, flat=False: value(spark, *cost.slope(F.lit(a).cast("double"), F.lit(b).cast("double"), F.lit(n), F.lit(flat)))
    assert s(10.0, 11.0, 10.0) == (pytest.approx(0.1), False)
    assert s(10.0, 30.0, 10.0) == (0.4, True) and s(30.0, 10.0, 10.0) == (-0.4, True)
    assert s(None, 30.0, 10.0)[0] == 0 and s(10.0, 30.0, 10.0, True) == (0.0, False) and s(0.0, 0.1, 0.1)[0] == pytest.approx(0.2)


def test_projections(spark):
    x, y = value(spark, *geo.project(F.lit(126.978), F.lit(37.5665), 4326))
    assert abs(x - 198056) < 5 and abs(y - 551885) < 5
    for code in geo.PROJECTIONS:
        a, b = geo.project(F.lit(127.123), F.lit(37.456), 4326, code)
        lon, lat = geo.project(a, b, code, 4326, datum_shift=False)
        got = value(spark, lon, lat)
        assert got == (pytest.approx(127.123, abs=1e-9), pytest.approx(37.456, abs=1e-9))
    lon, lat = value(spark, *geo.helmert(F.lit(127.0), F.lit(37.5)))
    assert 100 < math.hypot((lon - 127) * 88000, (lat - 37.5) * 111000) < 500  # the datums lie a few hundred metres apart


def points(ring):
    return F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ring])


def test_rings(spark):
    outer, hole = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)], [(4, 4), (6, 4), (6, 6), (4, 6)]
    rings = F.array(points(outer), points(hole))
    inside = lambda a, b: value(spark, geo.in_rings(F.lit(float(a)), F.lit(float(b)), rings))[0]
    assert inside(1, 1) and inside(9, 5) and not inside(5, 5) and not inside(-1, 5) and not inside(11, 5)
    assert value(spark, geo.polygon_area(rings), geo.polygon_area(F.array(points(outer)))) == (96.0, 100.0)
    p = value(spark, geo.interior_point(points([(0, 0), (8, 0), (8, 2), (2, 2), (2, 6), (0, 6)])))[0]
    assert value(spark, geo.in_rings(F.lit(p["x"]), F.lit(p["y"]), F.array(points([(0, 0), (8, 0), (8, 2), (2, 2), (2, 6), (0, 6)]))))[0]
    assert tuple(value(spark, geo.interior_point(points(outer)))[0]) == (5.0, 5.0)


def test_random_points_in_a_star(spark):
    rnd = random.Random(4)
    star = [(math.cos(k * math.pi / 5) * (10 if k % 2 == 0 else 4), math.sin(k * math.pi / 5) * (10 if k % 2 == 0 else 4)) for k in range(10)]
    pts = [(rnd.uniform(-11, 11), rnd.uniform(-11, 11)) for _ in range(300)]

    def inside(x, y):
        odd = False
        for (ax, ay), (bx, by) in zip(star, star[1:] + star[:1], strict=True):
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                odd = not odd
        return odd

    got = spark.createDataFrame(pts, "x double, y double").select("x", "y", geo.in_rings(F.col("x"), F.col("y"), F.array(points(star))).alias("i")).collect()
    assert all(r["i"] == inside(r["x"], r["y"]) for r in got)


def test_principal_axis(spark):
    a = value(spark, geo.principal_axis(points([(0, 0), (4, 90), (8, 90), (4, 0)])))[0]
    assert math.hypot(a["ax"] - a["bx"], a["ay"] - a["by"]) == pytest.approx(90.2, abs=0.3) and a["cx"] == 4


def test_small_geometry(spark):
    assert value(spark, geo.compass(F.lit(0.0), F.lit(1.0)), geo.compass(F.lit(1.0), F.lit(0.0)), geo.compass(F.lit(-1.0), F.lit(-1.0))) == ("N", "E", "SW")
    assert value(spark, geo.guess_code(F.lit(2e5)), geo.guess_code(F.lit(9e5)), geo.guess_code(F.lit(127.0)), geo.guess_code(F.lit(5.0))) == (5186, 5179, 4326, 5186)
    got = value(spark, geo.parse_points(F.lit("MULTILINESTRING((1 2, 3 4),(5 6 7,8 9 1))")))[0]
    assert [[tuple(p) for p in part] for part in got] == [[(1, 2), (3, 4)], [(5, 6), (8, 9)]]


def test_texts(spark):
    one = lambda c: value(spark, c)[0]
    assert one(text.place_name(F.lit(" 종로1·2가 제3 동　"))) == "종로1.2가3동" and one(text.place_name(F.lit(None))) == ""
    assert [one(text.station_key(F.lit(s))) for s in ("서울역(1호선)", "역", "강남 역", "종각")] == ["서울", "역", "강남", "종각"]
    assert one(text.district_of_address(F.lit("서울특별시 중구 세종대로"))) == "중구" and one(text.district_of_address(F.lit("부산 중구"))) is None
    assert [one(text.number(F.lit(s), text.NO_NUMBER)) for s in ("1,234.5", "-", "…", "x", "", "NaN", " 7 ")] == [1234.5, None, None, None, None, None, 7.0]
    assert one(text.minutes(F.lit("5; 7,9 11"))) == [5, 7, 9, 11] and one(text.minutes(F.lit(None).cast("string"))) == [5, 10, 15]
    assert one(text.file_name(F.lit(' a/b: c"d '))) == "a_b_c_d_" or one(text.file_name(F.lit(' a/b: c"d '))) == "a_b_c_d"
    assert [one(text.three_digits(F.lit(v))) for v in (123456.0, 1250.0, 999.5, 12.4)] == [123000, 1250, 1000, 12]
    assert one(text.day_label(F.lit("2026-10-15").cast("date"))) == "2026.10.15 (목)"
    assert [one(text.is_home(F.lit(u), F.lit(k), CODES.residential_use, CODES.residential_kind)) for u, k in (("bdu001", None), ("BDU003", "BDC001"), (None, "bdc001"), ("", "x"))] == [True, False, True, False]
    assert [one(text.floors(F.lit(v))) for v in ("3", None, "x", "0", "99")] == [3, 1, 1, 1, 60]
