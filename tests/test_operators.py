"""Operators against small cases worked by hand or by plain loops."""

import math

import pytest
from pyspark.sql import functions as F

from fairlead.functions import clock, geo, n2k, twin, units
from fairlead.operators import fitting, imports, interp, lattice, legs, search, spatial, tracks
from fairlead.operators.distill import distill
from fairlead.plans import projection as P
from fairlead.sources import geography, specs
from fairlead.sources import telemetry as store
from fairlead.sources.specs import DEFAULT, Vessel, vessels
from fairlead.streaming import capture

SHIP = Vessel.of()
WATERS = spatial.Waters([], [], ref_lat=42.3)
def weights():
    return {"fuel_eur_per_kg": F.lit(0.8), "time_eur_per_min": F.lit(10.0), "comfort_eur_per_point": F.lit(15.0), "wear_eur_per_point": F.lit(9.0)}


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_units_wrap_and_triangle(spark):
    tri = units.current_triangle(F.lit(5.0), F.lit(90.0), F.lit(0.0), F.lit(3.0))
    too_much = units.current_triangle(F.lit(2.0), F.lit(90.0), F.lit(0.0), F.lit(3.0))
    r = one(spark, a=units.wrap_longitude(F.lit(190.0)), b=units.wrap_bearing(F.lit(-10.0)), g=tri["ground_speed"], s=tri["course_to_steer"],
            x=too_much["exceeded"], n=too_much["ground_speed"])
    assert (r.a, r.b, r.x, r.n) == (-170.0, 350.0, True, None)
    assert math.isclose(r.g, 4.0) and r.s > 90.0


def test_vessel_column_equals_literals(spark):
    fleet = vessels(spark, [DEFAULT]).withColumn("v", F.lit(6.0))
    by_row = fleet.select(twin.calm_power(F.col("v"), Vessel.column("ship")).alias("p")).first().p
    assert math.isclose(by_row, one(spark, p=twin.calm_power(F.lit(6.0), SHIP)).p)
    assert one(spark, f=twin.fuel_rate(F.lit(100.0), F.lit(3), SHIP)).f is None


def test_missing_key_of_a_spec_fails():
    with pytest.raises(KeyError):
        Vessel.of({**DEFAULT, "hull": {}})


def test_dms_and_ring(spark):
    square = [(0.0, 0.0), (0.0, 2.0), (2.0, 2.0), (2.0, 0.0)]
    r = one(spark, a=geo.parse_dms(F.lit("43°30'00\"S")), b=geo.parse_dms(F.lit("north")), c=geo.in_any_ring(F.lit(1.0), F.lit(1.0), [square]),
            d=geo.in_any_ring(F.lit(3.0), F.lit(1.0), [square]))
    assert (r.a, r.b, r.c, r.d) == (-43.5, None, True, False)


def test_can_id_roundtrip(spark):
    ids = spark.createDataFrame([(2, 129025, 5), (6, 127488, 255), (3, 59904, 17)], "p int, pgn int, s int")
    joined = ids.withColumn("id", n2k.join_id(F.col("p"), F.col("pgn"), F.col("s")))
    back = n2k.split_id(F.col("id"))
    assert joined.where((back["priority"] != F.col("p")) | (back["pgn"] != F.col("pgn")) | (back["source_address"] != F.col("s"))).count() == 0


def test_lines_parse_or_go(spark):
    lines = spark.createDataFrame([("t R 09F8011A 50 C3 B8 13 47 D8 2B C6", 1.0), ("bad", 2.0), ("t X 09F8011A 00", 3.0), ("t R zz 00", 4.0)], "value string, timestamp double")
    rows = capture.samples(capture.parse_lines(lines), "tier").collect()
    assert len(rows) == 1 and rows[0].source_pgn == 129025 and math.isclose(rows[0].lat_deg, 33.0875728)


def test_serial_frames_across_pieces():
    payload = bytes([2, 0x01, 0xF8, 0x01, 0xFF, 5, 0, 0, 0, 0, 3, 0x10, 1, 2])
    body = bytes([0x93, len(payload)]) + payload
    body += bytes([-sum(body) & 0xFF])
    wire = b"\x10\x02" + body.replace(b"\x10", b"\x10\x10") + b"\x10\x03"
    whole, _ = capture.serial_frames(b"noise" + wire + wire)
    first, state = capture.serial_frames(wire[:9])
    rest, _ = capture.serial_frames(wire[9:], state)
    assert whole == [(129025, 2, 5, None, b"\x10\x01\x02")] * 2 and first + rest == whole[:1]
    assert capture.serial_frames(wire[:-3] + b"\x00\x10\x03")[0] == []


def test_stream_keeps_last(spark, tmp_path):
    schema = "timestamp double, source_pgn int, arrival long, sensor_tier string"
    for i in range(2):
        spark.createDataFrame([(1.0, 5, i, f"t{i}"), (2.0 + i, 5, i, "x")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    capture.write_latest(stream, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = capture.read_latest(spark, str(tmp_path / "out"))
    assert got.count() == 3


def test_upsert_and_status(spark):
    old = spark.createDataFrame([(1.0, None, 1, "a"), (2.0, 3, 1, "b")], "timestamp double, source_pgn int, arrival long, sensor_tier string")
    new = spark.createDataFrame([(1.0, 0, 2, "c")], old.schema)
    rows = store.upsert(old, new)
    assert {(r.timestamp, r.source_pgn): r.sensor_tier for r in rows.collect()} == {(1.0, 0): "c", (2.0, 3): "b"}
    s = store.status(rows, F.lit(5.0)).first()
    assert (s.sample_count, s.last_sample_at, s.sensor_tier, s.gap_s) == (2, 2.0, "b", 3.0)


def test_cycles(spark):
    at = lambda x: F.to_timestamp(F.lit(x))
    r = one(spark, a=clock.latest_cycle(at("2026-01-02 04:00:00")), b=clock.latest_cycle(at("2026-01-02 11:00:00")), c=clock.previous_cycle(at("2026-01-02 00:00:00")))
    assert [x.strftime("%d%H") for x in (r.a, r.b, r.c)] == ["0118", "0206", "0118"]


def test_incomplete_rows_fail_by_name(spark):
    raw = spark.createDataFrame([("2026-01-01", "12:00:00", "Europe/Rome", "41", "8", "240", "24", "5", "2", "v", "p")],
                                "report_date string, local_time string, timezone string, lat_deg string, lon_deg string, distance_run_nm string, hours_run string, fuel_consumed_mt string, active_engines string, vessel_id string, passage_id string")
    rows = imports.noon_report(raw)
    assert rows.first().sog_kn == 10.0 and rows.first().t_epoch_s == 1767265200.0
    with pytest.raises(Exception, match="heading_deg"):
        imports.rows_to_segments(rows).collect()


def test_search_equals_every_path(spark):
    """The layered search against all paths of a small lattice, one hour bucket for all labels."""
    lat = lattice.Lattice([(43.0 - 0.1 * i, 7.0 + 0.1 * i) for i in range(4)], [0, 1, 1, 0], [4.0] * 4, 8.0, 42.3)
    plan = search.Plan(legs.scenario("calm"), WATERS_DEEP, SHIP, weights(), [10.0, 12.0], [1, 2])
    best = search.cheapest(spark, lat, plan, bucket_h=1e9).first()
    edges = [r.asDict() for r in lattice.edges(spark, lat).collect()]
    rows = spark.createDataFrame([(e["stage"], e["lane"], e["next_lane"], e["p_lat"], e["p_lon"], e["q_lat"], e["q_lon"], s * 0.514444, n, 0.0) for e in edges for s in (10.0, 12.0) for n in (1, 2)],
                                 "stage int, lane int, next_lane int, p_lat double, p_lon double, q_lat double, q_lon double, stw_ms double, engines int, t_h double")
    done = legs.evaluate(rows, plan.weather, SHIP).where("not slam and not overload").collect()
    cost = {}
    for r in done:
        k = (r.stage, r.lane, r.next_lane)
        cost[k] = min(cost.get(k, 1e18), 0.8 * r.fuel_kg + 10.0 * r.duration_h * 60 + 15.0 * r.comfort + 9.0 * r.wear)
    total = {0: 0.0}
    for stage in range(3):
        total = {b: min(total[a] + c for (s, a, b2), c in cost.items() if s == stage and b2 == b and a in total) for (s, _, b) in cost if s == stage}
    assert math.isclose(best.cost, total[0], rel_tol=1e-9)
    earliest = search.time_optimal(spark, lat, plan).first()
    assert earliest.duration_h <= best.duration_h + 1e-9


WATERS_DEEP = spatial.Waters([[(30.0, 0.0), (30.1, 0.0), (30.1, 0.1)]])


def test_distill_keeps_ends_and_never_costs_more(spark):
    plan = search.Plan(legs.scenario("calm"), WATERS_DEEP, SHIP, weights(), [10.0], [2])
    track = [(43.0, 7.0), (42.9, 7.1), (42.8, 7.2), (42.7, 7.2)]
    rows = spark.createDataFrame([(1, track, [5.1] * 3, [2] * 3)], "route_id int, track array<struct<lat: double, lon: double>>, stw array<double>, engine array<int>")
    got = distill(rows, plan, [track[0], track[-1]]).first()
    assert tuple(got.track[0]) == track[0] and tuple(got.track[-1]) == track[-1] and len(got.track) < 4


def test_fit_recovers_truth(spark):
    truth = {**DEFAULT, "calm_resistance": {**DEFAULT["calm_resistance"], "linear_coefficient": 6.0}}
    v = F.col("mean_stw_ms")
    grid = spark.range(60).select(
        F.lit(1).alias("vessel_id"), (4.0 + F.col("id") % 10 * 0.3).alias("mean_stw_ms"), F.lit(10.0).alias("mean_heading_deg"), ((F.col("id") % 3) * 0.6).alias("mean_hs_m"),
        F.lit(7.0).alias("mean_period_peak_s"), F.lit(0.0).alias("mean_wave_from_deg"), (F.col("id") % 2 + 1).cast("int").alias("active_engines"))
    power = twin.total_power(v, F.col("mean_hs_m"), F.col("mean_period_peak_s"), F.col("mean_wave_from_deg"), F.col("mean_heading_deg"), Vessel.of(truth))
    segments = grid.withColumn("mean_fuel_kg_per_h", twin.fuel_rate(power, F.col("active_engines"), Vessel.of(truth)))
    fitted = fitting.fitted_spec({r.param: r.value for r in fitting.fit_vessels(segments).collect()})
    report = fitting.validation(segments.withColumn("measured", F.col("mean_fuel_kg_per_h")), Vessel.of(fitted)).first()
    assert report.rmse_kg_per_h < 0.05 * segments.agg(F.avg("mean_fuel_kg_per_h")).first()[0]


def test_holdout_errors(spark):
    rows = spark.createDataFrame([(1,), (None,)], "passage_id int")
    with pytest.raises(ValueError, match="no passage_id"):
        fitting.holdout_groups(rows, "passage_id")
    with pytest.raises(ValueError, match="two groups"):
        fitting.holdout_groups(rows.where("passage_id = 1"), "passage_id")


def test_lattice_refines_where_blocked(spark):
    wall = [(42.95, 6.9), (42.95, 7.4), (42.85, 7.4), (42.85, 6.9)]
    free = lattice.build(spark, (43.0, 7.2), (42.8, 7.2), None, along_nm=6.0)
    shut = lattice.build(spark, (43.0, 7.2), (42.8, 7.2), spatial.Waters([wall]), along_nm=6.0, half_width_nm=10.0)
    assert len(free.centres) == 3 and min(shut.steps) < 5.0


def test_thin_and_box(spark):
    pts = spark.createDataFrame([(1, i, 42.0 + 0.1 * i, 7.0, float(i)) for i in range(4)] + [(1, 4, 42.3, 7.5, 4.0)], "k int, s int, lat_deg double, lon_deg double, t_epoch_s double")
    assert sorted(r.s for r in tracks.thin(pts, "k", "s").collect()) == [0, 3, 4]
    wide = pts.withColumn("lon_deg", F.when(F.col("s") == 0, -170.0).otherwise(170.0))
    with pytest.raises(Exception, match="180 degrees"):
        tracks.covering_box(wide, "k").collect()


def test_track_file_roundtrip(spark, tmp_path):
    rows = spark.createDataFrame([(1.0, 2.0, 3.0, None, 5.0, None, 7.0, None, None)], store.TRACK)
    store.write_track(rows, str(tmp_path / "t"))
    assert store.read_track(spark, str(tmp_path / "t")).collect() == rows.collect()


def test_empty_inputs(spark, data):
    empty = P.telemetry(spark, data).limit(0)
    from fairlead.operators.segments import steady_segments

    assert steady_segments(empty, ["vessel_id"], "event_id").count() == 0
    assert tracks.track_distance(empty, "vessel_id", "event_id").count() == 0


def test_plan_voyage(spark):
    from fairlead.plans import voyage

    grid = lattice.Lattice([(42.9 - 0.2 * i, 7.2 + 0.15 * i) for i in range(4)], [0, 2, 2, 0], [5.0] * 4, 15.0, 42.3)
    way = lattice.corridor([(42.9, 7.2), (42.6, 7.4), (42.3, 7.65)], [0, 1, 0], 5.0)
    request = voyage.Request((42.9, 7.2), (42.3, 7.65), 40, 50, latest_arrival_h=9.0, speeds_kn=[10.0, 13.0])
    got = voyage.plan_voyage(spark, request, legs.scenario("calm"), WATERS_DEEP, corridors={"east": (way, "E")}, grid=grid)
    every = {r.candidate_id: r for r in got["candidates"].collect()}
    picks = got["picks"].orderBy("place").collect()
    assert every[picks[0].candidate_id].score_eur == min(r.score_eur for r in every.values()) and len(every) >= 3
    assert got["baseline"].first().speed_kn == pytest.approx(14.0, rel=0.02)
    assert "route_side_unreachable:E" in [r.code for r in got["diagnostics"].collect()]
    with pytest.raises(ValueError, match="origin is not navigable"):
        voyage.check_endpoints(spark, voyage.Request((30.05, 0.04), (42.0, 8.0), 1, 1), spatial.Waters([[(30.0, 0.0), (30.1, 0.0), (30.1, 0.1), (30.0, 0.1)]]))


def test_region_packs(spark, tmp_path):
    text = """pack_id: p\nname: P\nbbox: [6.7, 40.75, 10.15, 44.0]\nref_lat_deg: 42.3\ncoastline_path: c\nbathymetry_path: b\nnogo_path: n\ntss_path: t
weather_npz_path: w\nports:\n  a: [43.5, 7.1]\ndefault_origin: [43.55, 7.17]\nlegacy_corridors:\n  - origin: [43.55, 7.17]\n    destination: [41.13, 9.55]\n    corridor: corridor_west\n"""
    (tmp_path / "p.yaml").write_text(text)
    packs = specs.region_packs(spark, [str(tmp_path / "p.yaml")])
    r = packs.first()
    assert tuple(r.default_origin) == (43.55, 7.17) and r.default_destination is None and r.corridors[0].corridor == "corridor_west"
    assert (r.min_navigable_edge_fraction, r.min_refinement_step_nm, r.lane_turn_rate_nm, tuple(r.ports["a"])) == (0.75, 0.5, None, (43.5, 7.1))
    (tmp_path / "q.yaml").write_text(text.replace("corridor_west", "west"))
    with pytest.raises(ValueError, match="unknown corridors"):
        specs.region_packs(spark, [str(tmp_path / "q.yaml")])
    asked = spark.createDataFrame([("p", None, (1.0, 2.0))], f"pack_id string, origin {specs.PLACE}, destination {specs.PLACE}")
    assert tuple(specs.with_endpoints(asked, packs).first().origin) == (43.55, 7.17)
    with pytest.raises(Exception, match="no default destination"):
        specs.with_endpoints(asked.withColumn("destination", F.lit(None).cast(specs.PLACE)), packs).collect()
    with pytest.raises(Exception, match="unknown region pack"):
        specs.with_endpoints(asked.withColumn("pack_id", F.lit("x")), packs).collect()
    assert specs.manifest_packs(spark, None).first().ports["antibes"].lat_deg == 43.55
    assert [len(lattice.built_in(n)[0].centres) for n in specs.CORRIDORS] == [14, 15]


def test_geography_files(spark, tmp_path):
    import json

    import numpy as np

    (tmp_path / "c.json").write_text(json.dumps({"source": "s", "polygons": [[[41.0, 7.0], [41.0, 7.4], [41.4, 7.4], [41.4, 7.0]]]}))
    (tmp_path / "z.json").write_text(json.dumps({"zones": [{"name": "z", "polygon": [[41.6, 7.6], [41.6, 7.9], [41.9, 7.9], [41.9, 7.6]]}]}))
    heights = np.add.outer(np.arange(11.0), np.arange(11.0)) * -10.0 + 15.0
    np.savez(tmp_path / "d.npz", lat0=41.0, dlat=0.1, lon0=7.0, dlon=0.1, nlat=11, nlon=11, elevation_m=heights)
    np.savez(tmp_path / "m.npz", lat0=41.0, dlat=0.1, lon0=7.0, dlon=0.1, nlat=11, nlon=11, elevation_m=heights, land_mask=heights > 0)
    edges = geography.read_rings(spark, [str(tmp_path / "c.json")], [str(tmp_path / "z.json")])
    assert edges.groupBy("kind").count().where("count = 4").count() == 2
    points = spark.createDataFrame([(1, 41.2, 7.2), (2, 41.75, 7.75), (3, 41.55, 7.25), (4, 41.0, 7.0)], "point_id int, lat_deg double, lon_deg double")
    depths, axes, raster = geography.read_depths(spark, str(tmp_path / "d.npz"))
    got = {r.point_id: r for r in geography.describe(points, edges, depths, axes, raster).collect()}
    assert [(got[i].is_land, got[i].is_nogo, got[i].is_navigable) for i in (1, 2, 3)] == [(True, False, False), (False, True, False), (False, False, True)]
    assert got[3].depth_m == pytest.approx(65.0) and got[4].depth_m == 0.0
    depths, axes, raster = geography.read_depths(spark, str(tmp_path / "m.npz"))
    got = {r.point_id: r.is_land for r in geography.describe(points, edges, depths, axes, raster).collect()}
    assert got == {1: False, 2: False, 3: False, 4: True}
    geography.check_box(axes, (6.95, 40.95, 8.05, 42.05))
    with pytest.raises(ValueError, match="is not what the grid covers"):
        geography.check_box(axes, (6.95, 40.95, 8.05, 42.2))
    with pytest.raises(Exception, match="no geography covers"):
        geography.describe(points.withColumn("lat_deg", F.lit(50.0)), edges, depths, axes, raster).collect()


def test_currents_merge(spark):
    here = interp.Axes((41.0, 0.5, 2), (7.0, 0.5, 2))
    there = interp.Axes((41.0, 1.0, 2), (7.0, 1.0, 2), (0.0, 3.0, 2))
    weather = spark.createDataFrame([(t, y, x, float(t * 3)) for t in range(3) for y in range(2) for x in range(2)], "it int, iy int, ix int, t_h double")
    currents = spark.createDataFrame([(t, y, x, float(10 * t + y), float(x)) for t in range(2) for y in range(2) for x in range(2)], "it int, iy int, ix int, current_u_ms double, current_v_ms double")
    got = {(r.it, r.iy, r.ix): (round(r.current_u_ms, 2), round(r.current_v_ms, 2)) for r in interp.merge_currents(weather, here, currents, there, 0.0, 0.0).collect()}
    assert got[0, 0, 0] == (0.0, 0.0) and got[0, 1, 1] == (0.5, 0.5) and got[1, 0, 0][0] == pytest.approx(10.0, abs=0.02) and got[2, 0, 0] == got[1, 0, 0]
    with pytest.raises(Exception, match="permitted hours"):
        interp.merge_currents(weather, here, currents, there, 7 * 3600.0, 0.0).collect()


def test_sorted_axes_and_flat_holdout(spark):
    grid = spark.createDataFrame([(42.0, 8.0, 3.0), (41.0, 7.0, 0.0)], "lat_deg double, lon_deg double, t_h double")
    assert sorted(tuple(r[c] for c in ("it", "iy", "ix")) for r in interp.sorted_axes(grid).collect()) == [(0, 0, 0), (1, 1, 1)]
    rows = spark.range(50)
    held = fitting.holdout_rows(rows, ["id"], 0.1)
    assert held.where("is_holdout").count() == 5 and held.count() == 50 and fitting.holdout_rows(rows.limit(2), ["id"], 0.1).where("is_holdout").count() == 1


def test_side_filter_keeps_the_centre(spark):
    edges = spark.createDataFrame([(1, n) for n in (-1, 0, 1)], "stage int, next_lane int")
    assert [sorted(r.next_lane for r in lattice.side_only(edges, (2, 2), s).collect()) for s in "WE"] == [[-1, 0], [0, 1]]


def test_weather_gap_is_told(spark):
    """Missing weather prunes every leg, is counted, and reaches the diagnostics."""
    lat = lattice.Lattice([(43.0, 7.0), (42.9, 7.1), (42.8, 7.2)], [0, 1, 0], [4.0] * 3, 8.0, 42.3)
    gone = lambda rows: legs.scenario("calm")(rows).withColumn("hs_m", F.lit(float("nan")))
    plan = search.Plan(gone, WATERS_DEEP, SHIP, weights(), [10.0], [2])
    pruned = []
    assert search.cheapest(spark, lat, plan, pruned=pruned).count() == 0
    counts = search.prune_counts(pruned).first()
    assert counts.missing_weather == 3 and counts.slam == 0
    from fairlead.operators import ranking

    none = spark.createDataFrame([], "request_id int, duration_h double, latest_arrival_h double")
    gaps = spark.createDataFrame([(0, counts.missing_weather)], "request_id int, n long")
    assert [r.code for r in ranking.diagnostics(none, gaps).collect()] == ["weather_data_gap"]


def test_dearer_sweep_is_undone(spark):
    """A current that turns with the hour makes the whole track dearer though each removal was cheaper; such a sweep is undone."""
    from fairlead.operators import distill as d

    plan = search.Plan(legs.scenario("calm"), WATERS_DEEP, SHIP, weights(), [10.0], [2])
    track = [(43.0, 7.0), (42.9, 7.1), (42.8, 7.2), (42.7, 7.2)]
    rows = spark.createDataFrame([(1, track, [5.1] * 3, [2] * 3)], "route_id int, track array<struct<lat: double, lon: double>>, stw array<double>, engine array<int>")
    before = d.track_totals(rows, plan).first()
    assert len(before.eta_h) == 4 and math.isclose(before.eta_h[-1], before.duration_h) and math.isclose(sum(x.duration_h for x in before.legs), before.duration_h)
    dearer = d.sweep
    try:  # a sweep whose proposal goes a long way round
        d.sweep = lambda r, *a: r.withColumn("track", F.expr("transform(array(0, 1), i -> named_struct('lat', 43.0D - i * 5, 'lon', 7.0D))")).withColumn("stw", F.expr("slice(stw, 1, 1)")).withColumn("engine", F.expr("slice(engine, 1, 1)"))
        kept = d.distill(rows, plan, [])
    finally:
        d.sweep = dearer
    assert [tuple(p) for p in kept.first().track] == track and math.isclose(kept.first().cost, before.cost)
