"""Waters kept as tables: rings by strips, clipping to a box, charts from files, and plans on them."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairlead.operators import clipping, lattice, legs, spatial
from fairlead.sources import geography


def star(rng, n, lat, lon, size):
    """A ring without crossings around a place."""
    turn = np.sort(rng.random(n)) * 2 * math.pi
    reach = size * (0.3 + rng.random(n))
    return [(lat + r * math.sin(a), lon + r * math.cos(a)) for a, r in zip(turn, reach, strict=True)]


def inside(lat, lon, ring):
    odd = False
    for (yi, xi), (yj, xj) in zip(ring, [ring[-1], *ring[:-1]], strict=True):
        odd ^= (yi > lat) != (yj > lat) and lon < (xj - xi) * (lat - yi) / (yj - yi) + xi
    return odd


def rings_frame(spark, rings):
    rows = [(i, [(float(a), float(b)) for a, b in r] if r is not None else None) for i, r in enumerate(rings)]
    return spark.createDataFrame(rows, "ring long, points array<struct<lat: double, lon: double>>")


def test_clipped_rings_hold_the_same_points(spark):
    rng, box = np.random.default_rng(4), (7.2, 41.1, 8.1, 41.9)
    rings = [star(rng, int(rng.integers(3, 40)), 41 + rng.random(), 7 + 1.2 * rng.random(), 0.4) for _ in range(40)]
    rings += [[(41.2, 7.3), (41.2, 7.9), (41.6, 7.9), (41.6, 7.3)], [(40.0, 6.0), (40.0, 9.0), (43.0, 9.0), (43.0, 6.0)], [(50.0, 7.5), (51.0, 7.5), (51.0, 8.0)], [], None,
              [(41.1, 7.0), (41.1, 7.6), (41.0, 7.6)], [(41.2, 7.0), (41.2, 7.6), (41.0, 7.6), (41.0, 7.0)]]
    kept = {r.ring: [tuple(p) for p in r.points] for r in clipping.clip_rings(rings_frame(spark, rings), box).collect()}
    assert {42, 43, 44, 45}.isdisjoint(kept) and kept[40] == rings[40]
    area = {r.ring: r.a for r in clipping.clip_rings(rings_frame(spark, rings), box).select("ring", clipping.ring_area(F.col("points")).alias("a")).collect()}
    assert area[41] == pytest.approx(0.9 * 0.8) and area[46] == pytest.approx(0.4 * 0.1)
    for lat, lon in zip(41.1 + 0.8 * rng.random(150), 7.2 + 0.9 * rng.random(150), strict=True):
        for i, r in enumerate(rings):
            if r:
                assert inside(lat, lon, r) == (i in kept and inside(lat, lon, kept[i]))
    for ring in kept.values():
        assert all(box[1] - 1e-9 <= a <= box[3] + 1e-9 and box[0] - 1e-9 <= b <= box[2] + 1e-9 for a, b in ring)


def test_strips_of_a_long_ring(spark):
    """The rows and the edges that a point meets do not grow with the number of a ring's edges."""
    rng = np.random.default_rng(1)
    met = {}
    points = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(40.9 + 0.4 * rng.random(60), 6.9 + 0.4 * rng.random(60), strict=True))]
    spots = spark.createDataFrame(points, "point_id int, lat_deg double, lon_deg double")
    for n in (1_000, 100_000):
        turn = np.arange(n) * 2 * math.pi / n
        ring = list(zip((41.1 + 0.15 * np.sin(turn)).tolist(), (7.1 + 0.15 * np.cos(turn)).tolist(), strict=True))
        edges = clipping.ring_edges(rings_frame(spark, [ring])).cache()
        cut_up = spatial.strips(edges).cache()
        assert cut_up.count() < 4 * n
        met[n] = cut_up.groupBy("strip").count().agg(F.avg("count")).first()[0]
        got = {r.point_id for r in spatial.rings_at(spots, edges).collect()}
        assert got == {i for i, a, b in points if math.hypot(a - 41.1, b - 7.1) < 0.15}
    assert met[100_000] < 1.5 * met[1_000] and met[100_000] < 12


def test_rings_with_level_edges_and_several_keys(spark):
    square = [(41.0, 7.0), (41.0, 7.5), (41.0, 8.0), (41.5, 8.0), (41.5, 7.0)]
    points = spark.createDataFrame([(1, "a", 41.2, 7.2), (2, "b", 41.0, 7.2), (3, "c", 41.49, 7.99), (4, "d", 41.6, 7.5), (5, None, 41.2, 7.2)], "a int, b string, lat_deg double, lon_deg double")
    rows = spatial.rings_at(points, spatial.edge_table(spark, {5: square}), ["a", "lat_deg"])
    assert sorted(r.a for r in rows.collect()) == [i for i, a, b in ((1, 41.2, 7.2), (2, 41.0, 7.2), (3, 41.49, 7.99), (4, 41.6, 7.5), (5, 41.2, 7.2)) if inside(a, b, square)]
    assert spatial.rings_at(points, spatial.edge_table(spark, {5: square}).limit(0), "a").count() == 0


LAND = [[(42.75, 7.25), (42.75, 7.4), (42.6, 7.4), (42.6, 7.25)], [(42.4, 7.9), (42.5, 8.1), (42.3, 8.1)]]
ZONE = [(42.5, 7.2), (42.5, 7.3), (42.42, 7.3), (42.42, 7.2)]


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    """The same waters as literal rings and as files, deep everywhere."""
    d = tmp_path_factory.mktemp("chart")
    (d / "c.json").write_text(json.dumps({"polygons": LAND}))
    (d / "z.json").write_text(json.dumps({"zones": [{"name": "z", "polygon": ZONE}]}))
    deep = np.full((41, 61), -500.0)
    np.savez(d / "d.npz", lat0=40.75, dlat=0.1, lon0=5.5, dlon=0.1, nlat=41, nlon=61, elevation_m=deep)
    return str(d / "c.json"), str(d / "z.json"), str(d / "d.npz")


def chart_of(spark, files, **more):
    return geography.Chart.read(spark, [files[0]], [files[1]], files[2], **more)


LITERAL = spatial.Waters(LAND, nogo_rings=[ZONE])


def test_edges_on_a_chart_are_the_literal_ones(spark, files):
    rng = np.random.default_rng(8)
    rows = [tuple(float(x) for x in (42.3 + 0.5 * a, 7.1 + 0.9 * b, 42.3 + 0.5 * c, 7.1 + 0.9 * e)) for a, b, c, e in rng.random((60, 4))]
    edges = spark.createDataFrame([*rows, rows[0]], "p_lat double, p_lon double, q_lat double, q_lon double")
    one, two = (sorted(map(tuple, legs.edge_limits(edges, w, 3.0).collect())) for w in (LITERAL, chart_of(spark, files)))
    assert one == two and len(one) == 60 and len({r[4] for r in one}) == 2
    shallow = legs.edge_limits(edges, chart_of(spark, files), 600.0, [rows[0][:2]]).where("depth_ok").count()
    assert shallow < 60


def test_lattice_on_a_chart_is_the_literal_one(spark, files):
    made = [lattice.build(spark, (42.9, 7.2), (42.2, 7.6), w, along_nm=8.0, half_width_nm=15.0) for w in (LITERAL, chart_of(spark, files))]
    assert made[0] == made[1]


def test_plan_on_a_chart_is_the_literal_one(spark, files):
    from fairlead.plans import voyage

    grid = lattice.Lattice([(42.9 - 0.2 * i, 7.2 + 0.15 * i) for i in range(4)], [0, 2, 2, 0], [5.0] * 4, 15.0, 42.3)
    request = voyage.Request((42.9, 7.2), (42.3, 7.65), 40, 50, speeds_kn=[10.0, 13.0])
    plans = [voyage.plan_voyage(spark, request, legs.scenario("calm"), w, grid=grid) for w in (LITERAL, chart_of(spark, files, box=(5.45, 40.7, 11.55, 44.8)))]
    for part in ("candidates", "picks", "legs", "baseline", "pruned", "diagnostics"):
        one, two = (sorted(map(repr, p[part].drop("candidate_id").collect())) for p in plans)
        assert one == two
    assert plans[0]["candidates"].count() >= 1 and plans[0]["pruned"].first().not_navigable == 0
    with pytest.raises(ValueError, match="destination is not navigable"):
        voyage.check_endpoints(spark, voyage.Request((42.9, 7.2), (42.7, 7.3), 1, 1), chart_of(spark, files))
    with pytest.raises(ValueError, match="is not what the grid covers"):
        chart_of(spark, files, box=(5.45, 40.7, 11.55, 45.8))
    with pytest.raises(Exception, match="no geography covers"):
        voyage.check_endpoints(spark, voyage.Request((52.9, 7.2), (42.7, 7.3), 1, 1), chart_of(spark, files))


def test_edges_of_boxes_are_in_them(spark):
    from fairlead.operators.interp import Axes

    depths = spark.range(12).selectExpr("cast(id div 4 as int) iy", "cast(id % 4 as int) ix", "-50D elevation_m", "cast(null as boolean) is_land")
    land = clipping.ring_edges(rings_frame(spark, [LAND[0]]).withColumn("kind", F.lit("land")), "kind")
    chart = geography.Chart.of(land, depths, Axes((41.0, 1.0, 3), (7.0, 1.0, 4)), False, nogo_boxes=[(9.21, 41.29, 9.31, 41.36)])
    points = spark.createDataFrame([(41.36, 9.25), (41.29, 9.31), (41.3601, 9.25), (42.7, 7.3)], "lat_deg double, lon_deg double")
    found = {r.lat_deg: (r.is_land, r.is_nogo, r.is_navigable) for r in chart.features(points).collect()}
    assert found == {41.36: (False, True, False), 41.29: (False, True, False), 41.3601: (False, False, True), 42.7: (True, False, False)}


def test_equal_rings_and_places_are_tested_once(spark, monkeypatch):
    """Every point and ring is found, and the strips are made of different rings only and meet different places only."""
    rng = np.random.default_rng(3)
    rings = [star(rng, 9, 41.5, 7.5, 0.4) for _ in range(4)] * 5 + [None, []]
    places = [(float(a), float(b)) for a, b in zip(41.1 + 0.8 * rng.random(12), 7.1 + 0.8 * rng.random(12), strict=True)]
    points = spark.createDataFrame([(i, *places[i % 12]) for i in range(36)] + [(36, None, 7.5)], "event_id int, lat_deg double, lon_deg double")
    met, was = [], spatial.rings_at
    monkeypatch.setattr(spatial, "rings_at", lambda p, e, key: met.append((p.count(), e.count())) or was(p, e, key))
    got = {tuple(r) for r in spatial.rings_of_places(points, rings_frame(spark, rings), "event_id").collect()}
    assert got == {(i, k) for i in range(36) for k, r in enumerate(rings) if r and inside(*places[i % 12], r)} and len(got) > 60
    assert met == [(13, 36)]
