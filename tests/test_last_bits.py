"""Results that hang on the last bit of a sine or an angle."""

import math

import pytest
from pyspark.sql import functions as F

from fairlead.functions import units
from fairlead.operators import segments, tracks


def test_sines_of_whole_degrees(spark):
    """Of 183 and 297 degrees the JVM's sines differ from correctly rounded ones."""
    d = F.col("id").cast("double")
    for r in spark.range(-10, 370).select("id", units.sine(d).alias("s"), units.cosine(d).alias("c")).collect():
        if 0 <= r.id < 360:
            assert (r.s, r.c) == (math.sin(math.radians(r.id)), math.cos(math.radians(r.id)))
        assert (r.s, r.c) == pytest.approx((math.sin(math.radians(r.id)), math.cos(math.radians(r.id))), abs=1e-15)
    odd = spark.createDataFrame([(None,), (math.nan,), (10.5,)], "x double").select(units.sine(F.col("x"))).collect()
    assert odd[0][0] is None and math.isnan(odd[1][0]) and odd[2][0] == pytest.approx(math.sin(math.radians(10.5)))


def test_mean_of_opposite_directions(spark):
    rows = spark.createDataFrame([(a, x) for a in range(180) for x in (float(a), a + 180.0)], "a int, x double")
    for r in rows.groupBy("a").agg(segments.circular_mean(F.col("x")).alias("m")).collect():
        s, c = ([f(math.radians(r.a + t)) for t in (0, 180)] for f in (math.sin, math.cos))
        assert math.cos(math.radians(r.m)) == pytest.approx(math.cos(math.atan2(sum(s) / 2, sum(c) / 2)), abs=1e-9)


def test_a_way_straight_back(spark):
    """A turn of -180 degrees, which the JVM's angles make one of 180."""
    track = [(1, 1, 43.004, 8.964), (1, 2, 42.269, 8.079), (1, 3, 43.445, 9.495000000000001), (2, 1, 42.0, 8.0), (2, 2, 42.5, 8.0), (3, 1, 41.0, 8.0)]
    points = spark.createDataFrame(track, "v int, n int, lat_deg double, lon_deg double")
    found = {(r.v, r.n): r for r in tracks.alterations(points, "v", "n").collect()}
    assert found[1, 2].turn_deg == -180.0 and set(found) == {(1, 2)}
    assert found[1, 2].course_deg == pytest.approx(221.6875, abs=1e-4) and found[1, 2].next_course_deg == pytest.approx(41.6875, abs=1e-4)
