import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.functions import angles, dates, geo, text


@pytest.fixture(scope="module")
def angle(spark):
    return spark.createDataFrame([(float(a),) for a in (0, 45, 90, 180, 270, 359.5, -10, 720)] + [(None,)], "a double")


def test_angular_distance(spark):
    rows = spark.createDataFrame([(10.0, 350.0), (350.0, 10.0), (180.0, 0.0), (0.0, 180.0), (None, 1.0)], "x double, y double")
    assert [r[0] for r in rows.select(angles.angular_distance(F.col("x"), F.col("y"))).collect()] == [20, -20, -180, -180, None]


def test_circular_mean(spark):
    rows = spark.createDataFrame([(350.0,), (10.0,), (None,)], "x double")
    m, s = rows.agg(angles.circular_mean(F.col("x")), angles.circular_std(F.col("x"))).first()
    assert min(m, 360 - m) < 1e-9 and s == pytest.approx(math.degrees(math.sqrt(-2 * math.log(math.cos(math.radians(10))))))
    assert spark.createDataFrame([(1.0,), (2.0,)], "x double").agg(angles.circular_mean(F.col("x"), "radians")).first()[0] == pytest.approx(1.5)


def test_triangular(angle):
    s, c = angles.triangular_s(F.col("a")), angles.triangular_c(F.col("a"))
    rows = angle.select("a", s.alias("s"), c.alias("c"), angles.from_triangular(s, c).alias("back")).collect()
    for r in rows:
        if r.a is None:
            assert r.s is None
        else:
            assert abs(r.s) + abs(r.c) == pytest.approx(1) and (r.back - r.a) % 360 == pytest.approx(0, abs=1e-9)


def test_wind(angle):
    for kind in ("trigonometric", "triangular"):
        u, v = angles.wind_vector(F.col("a"), F.lit(3.0), kind)
        d, s = angles.direction_speed(u, v, kind)
        for r in angle.where("a is not null").select("a", d.alias("d"), s.alias("s")).collect():
            assert r.s == pytest.approx(3) and min((r.d - r.a) % 360, (r.a - r.d) % 360) < 1e-5
    d, s = angles.direction_speed(F.lit(0.0), F.lit(0.0))
    assert angle.select(d, s).first() == (None, 0.0)


def test_rotation_and_slope(spark):
    one = spark.range(1)
    x, y = angles.rotated(F.lit(1.0), F.lit(0.0), 90)
    r = one.select(x, y).first()
    assert r[0] == pytest.approx(0) and r[1] == pytest.approx(1)
    s, a = angles.slope_angle(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(2.0))
    assert one.select(s, a).first() == (math.inf, 90.0)
    assert one.select(*angles.slope_angle(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))).first()[1] == pytest.approx(45)


def test_geo(spark):
    rows = spark.createDataFrame([(50.0, 4.0, 51.0, 4.0), (0.0, 179.5, 0.0, -179.5), (50.0, 4.0, 50.0, 4.0), (90.0, 0.0, -90.0, 0.0)], "a double, b double, c double, d double")
    p = [F.col(x) for x in "abcd"]
    out = rows.select(geo.haversine(*p), geo.bearing(*p), geo.geodesic(*p)).collect()
    assert out[0][0] == pytest.approx(111.1949, abs=1e-3) and out[0][1] == 360
    assert out[1][0] == pytest.approx(111.1949, abs=1e-3) and out[1][1] == pytest.approx(90)
    assert out[2][0] == 0 and out[3][0] == pytest.approx(math.pi * 6371)
    assert out[0][2].km == pytest.approx(111.2380, abs=2e-2) and out[1][2].km == pytest.approx(111.3195, abs=1e-3)
    km, az = geo.vincenty(np.array([50.0]), np.array([4.0]), np.array([48.0]), np.array([2.0]))
    assert km[0] == pytest.approx(265.9, abs=1) and 210 < az[0] < 220


def test_dates(spark):
    ts = spark.createDataFrame([(dt.datetime(2024, 1, 6, 9, 30),)], "ts timestamp_ntz")
    r = ts.select(*(c.alias(n) for n, c in dates.parts(F.col("ts")).items()), dates.day_type(F.col("ts")).alias("type"), dates.epoch_seconds(F.col("ts")).alias("s")).first()
    assert (r.hour, r.weekday, r.month, r.day_name, r.month_name, r.hour_text, r.weekend, r.type, r.s) == (9, 5, 1, "Sat", "Jan", "09", True, "Saturday", 1704533400)
    assert ts.select(dates.duration(F.col("ts"), F.col("ts") + F.expr("INTERVAL 90 MINUTES"), "hours")).first()[0] == 1.5
    assert dates.truncated(F.col("ts"), "hour") is not None and ts.select(dates.truncated(F.col("ts"), "hour")).dtypes[0][1] == "timestamp_ntz"


def test_holidays(spark):
    fr = {r.date: r.holiday for r in dates.holidays(spark, range(2024, 2025)).collect()}
    assert len(fr) == 11 and fr[dt.date(2024, 4, 1)] == "Easter Monday" and fr[dt.date(2024, 5, 9)] == "Ascension"
    us = {r.holiday: r.date for r in dates.holidays(spark, range(2015, 2016), "us").collect()}
    assert us["Thanksgiving"] == dt.date(2015, 11, 26) and us["Memorial Day"] == dt.date(2015, 5, 25) and us["Independence Day"] == dt.date(2015, 7, 3)


def test_text(spark):
    rows = spark.createDataFrame([("a_wide  name",), ("5 min",), ("On Time",), ("None",), (None,), ("run12_007x",)], "s string")
    assert [r[0] for r in rows.select(text.prettify(F.col("s"))).collect()] == ["A Wide Name", "5 Min", "On Time", "None", None, "Run12 007x"]
    assert [r[0] for r in rows.select(text.status_minutes(F.col("s"))).collect()] == [None, 5, 0, None, None, None]
    assert rows.select(text.digit_template(F.col("s"))).collect()[5][0] == r"run\d{2}_\d{3}x"
