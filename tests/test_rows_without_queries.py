"""Operators that no registered query covers, against values worked by hand or by plain loops."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fairlead.functions import clock, sql, units
from fairlead.operators import fitting, imports, interp, legs, spatial
from fairlead.sources import checks, specs
from fairlead.sources import telemetry as store
from fairlead.streaming import capture


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_directions_hours_and_tags(spark):
    r = one(spark, a=units.coming_from(F.lit(350.0), F.lit(True)), b=units.coming_from(F.lit(-10.0), F.lit(False)), c=clock.quantised_hour(F.lit(2.5)),
            d=clock.quantised_hour(F.lit(3.5)), e=clock.etag(F.lit("gfs"), F.lit("20240101"), F.lit("06")))
    assert (r.a, r.b, r.c, r.d, r.e) == (170.0, 350.0, 2.0, 4.0, hashlib.sha256(b"gfs|20240101|06").hexdigest()[:16])


def test_annotated_track_and_daily_rows(spark):
    raw = spark.createDataFrame([("10", "41", "8", "1.5", "", "200", "v", "p")], "t_epoch_s string, lat_deg string, lon_deg string, hs_m string, wind_u_ms string, wave_from_deg string, vessel_id string, passage_id string")
    r = imports.annotated_track(raw).first()
    assert (r.t_epoch_s, r.lat_deg, r.hs_m, r.wind_u_ms, r.wave_from_deg, r.stw_kn, r.source, r.is_low_frequency) == (10.0, 41.0, 1.5, None, 200.0, None, "annotated_track", False)
    day = spark.createDataFrame([("2026-01-01", "12:00:00", "UTC", "41", "8", "240", "24", "4.8", "2", "v", "p")],
                                "report_date string, local_time string, timezone string, lat_deg string, lon_deg string, distance_run_nm string, hours_run string, fuel_consumed_mt string, active_engines string, vessel_id string, passage_id string")
    full = imports.noon_report(day).withColumns({"heading_deg": F.lit(90.0), "hs_m": F.lit(1.0), "period_peak_s": F.lit(6.0), "wave_from_deg": F.lit(10.0)})
    s = imports.rows_to_segments(full).first()
    assert (s.duration_h, s.n_samples, s.t_end_s - s.t_start_s, s.mean_fuel_kg_per_h) == (24.0, 1, 86400.0, 200.0)
    assert math.isclose(s.mean_stw_ms, 10 * 0.514444, rel_tol=1e-4) and s.fuel_noise_multiplier == pytest.approx(0.15 / 0.03 * 2 * 5)


def test_vessel_file_round_trip(spark, tmp_path):
    ship = specs.Vessel.of()
    ship.to_yaml(str(tmp_path / "v.yaml"))
    again = specs.Vessel.from_yaml(str(tmp_path / "v.yaml"))
    assert again.data == ship.data
    assert one(spark, a=again["hull.length_wl_m"]).a == one(spark, a=ship["hull.length_wl_m"]).a


def test_samples_file_and_motion(spark, tmp_path):
    (tmp_path / "s.csv").write_text("t_h,stw_ms,heading_deg,active_engines,fuel_kg_per_h,hs_m,period_peak_s,wave_from_deg\n0.0,6.1,90,2,100.5,,7,180\n")
    r = store.read_samples(spark, str(tmp_path / "s.csv")).first()
    assert (r.t_h, r.stw_ms, r.active_engines, r.hs_m) == (0.0, 6.1, 2, None)
    rows = spark.createDataFrame([(2.0, None, None, None, None), (1.0, None, 3.0, None, None)], "timestamp double, motion_heave_m double, motion_roll_deg double, motion_pitch_deg double, motion_accel_vertical_ms2 double")
    got = store.with_motion(rows).collect()
    assert [r.timestamp for r in got] == [1.0, 2.0] and got[0].motion.motion_roll_deg == 3.0 and got[1].motion is None


def test_synthetic_samples(spark):
    rows = store.synthetic_samples(spark, [10.0, 12.0], [1, 2], [0.5], F.lit(100.0), per=200, noise=0.03)
    r = rows.agg(F.count("*").alias("n"), F.avg("fuel_kg_per_h").alias("m"), F.stddev("fuel_kg_per_h").alias("s")).first()
    assert r.n == 800 and abs(r.m - 100) < 0.5 and 2.5 < r.s < 3.5
    assert rows.groupBy("block").agg((F.max("t_s") - F.min("t_s")).alias("d")).where("d <> 199 * 60").count() == 0


def test_spoilt_blocks(spark):
    """No manoeuvre gives a segment; a tank transfer is left out of those around it; other blocks give one each."""
    from fairlead.operators.segments import steady_segments

    rows = store.synthetic_samples(spark, [8.0 + 0.5 * i for i in range(12)], [1, 2], [0.5, 1.0], F.lit(100.0), noise=0.005, speed_noise_ms=0.01, wave_noise_m=0.05, junk=0.4).cache()
    kinds = {r.block: r.junk for r in rows.select("block", "junk").distinct().collect()}
    assert {None, *store.JUNK} == set(kinds.values()) and 5 < sum(k is not None for k in kinds.values()) < 35
    assert rows.agg(F.min("hs_m")).first()[0] >= 0 and rows.groupBy("block").agg(F.stddev("hs_m").alias("s")).agg(F.avg("s")).first()[0] == pytest.approx(0.05, rel=0.2)
    found = steady_segments(rows.withColumns({"vessel_id": F.lit(1), "tie": F.lit(0)}), ["vessel_id"], "tie").collect()
    spans = {r.block: (r.a, r.b) for r in rows.groupBy("block").agg(F.min("t_s").alias("a"), F.max("t_s").alias("b")).collect()}
    held = {b: sorted((s.t_start_s, s.t_end_s, s.n_samples) for s in found if x <= s.t_start_s and s.t_end_s <= y) for b, (x, y) in spans.items()}
    for b, kind in kinds.items():
        if kind is None:
            assert held[b] == [(*spans[b], 15)]
        elif kind == "tank_transfer":
            assert sum(n for _, _, n in held[b]) == 14
        else:
            assert sum(n for _, _, n in held[b]) < 8


SQUARE = [(41.0, 7.0), (41.0, 7.5), (41.5, 7.5), (41.5, 7.0)]


def test_raster_of_land(spark):
    grid = interp.target_grid(spark, (40.9, 0.2, 5), (6.9, 0.2, 5), [0.0])
    got = {(r.iy, r.ix): r.is_land for r in spatial.rasterise(grid, spatial.Waters([SQUARE])).collect()}
    assert got == {(y, x): 41.0 < 40.9 + 0.2 * y < 41.5 and 7.0 < 6.9 + 0.2 * x < 7.5 for y in range(5) for x in range(5)}


def test_points_near_a_port_need_no_depth(spark):
    """Two edges over the same shoal: the one that ends at an exempt point passes."""
    waters = spatial.Waters([SQUARE])
    shallow = spark.createDataFrame([(40.99, 7.2, 40.985, 7.21), (40.99, 7.45, 40.985, 7.46)], "p_lat double, p_lon double, q_lat double, q_lon double")
    ok = {r.p_lon: r.depth_ok for r in legs.edge_limits(shallow, waters, 200.0, [(40.99, 7.2)]).collect()}
    assert ok == {7.2: True, 7.45: False}
    assert legs.edge_limits(shallow, waters, 200.0).where("depth_ok").count() == 0


AXES = interp.Axes((41.0, 0.5, 3), (7.0, 0.5, 3), (0.0, 6.0, 2))


def weather_rows(spark):
    rows = [(t, y, x, float(t + y), 5.0, 4.0, 0.0, 1.0, float(x), 2.0, 0.0, 0.0) for t in range(2) for y in range(3) for x in range(3)]
    return spark.createDataFrame(rows, "it int, iy int, ix int, hs_m double, period_peak_s double, period_mean_s double, wave_u double, wave_v double, wind_u_ms double, wind_v_ms double, current_u_ms double, current_v_ms double")


def test_track_with_its_weather(spark):
    table = interp.cells(weather_rows(spark), [*interp.MASKED, *interp.PLAIN], AXES)
    track = spark.createDataFrame([(1000.0 + 3 * 3600, 41.25, 7.75), (1000.0 - 5e5, 41.0, 7.0), (1000.0 + 1e6, 60.0, 7.5)], "t_epoch_s double, lat_deg double, lon_deg double")
    got = {r.t_epoch_s: (r.hs_m, r.wind_u_ms, r.wave_from_deg) for r in interp.annotate(track, table, AXES, 1000.0).collect()}
    assert got[11800.0] == pytest.approx((1.0, 1.5, 180.0)) and got[1000.0 - 5e5] == pytest.approx((0.0, 0.0, 180.0))
    assert got[1000.0 + 1e6] == pytest.approx((3.0, 1.0, 180.0), abs=0.005)  # outside the grid its edge, to within a thousandth of a step


def test_regrid(spark):
    table = interp.cells(weather_rows(spark), [*interp.MASKED, *interp.PLAIN], AXES)
    got = {(r.it, r.iy, r.ix): (r.hs_m, r.wind_u_ms) for r in interp.regrid(spark, table, AXES, (41.0, 0.25, 5), (7.0, 0.25, 5), [0.0, 3.0]).collect()}
    assert len(got) == 50
    for (t, y, x), v in got.items():
        assert v == pytest.approx((y * 0.5 + t * 0.5, x * 0.5), abs=0.003)  # the last line is a thousandth of a step away


def test_weather_of_default_ends(spark):
    packs = specs.manifest_packs(spark, None)
    table = interp.cells(weather_rows(spark).withColumn("wind_v_ms", F.when(F.col("ix") == 2, float("nan")).otherwise(F.col("wind_v_ms"))), ["hs_m", "wind_u_ms", "wind_v_ms"], AXES)
    assert checks.check_weather(packs, {"med": (interp.cells(weather_rows(spark), ["hs_m", "wind_u_ms", "wind_v_ms"], AXES), AXES)}) == []
    found = checks.check_weather(packs, {"med": (table, AXES)})
    assert len(found) == 1 and "no wind_v_ms at its default destination" in found[0] and "'med'" in found[0]
    assert len(checks.check_weather(packs, {})) == 2
    with pytest.raises(ValueError, match="pack 'med'"):
        checks.check_weather(packs, {"med": (table, AXES)}, strict=True)
    with pytest.raises(ValueError, match="no pack has a default end"):
        checks.check_weather(packs.limit(0), {}, strict=True)


def test_every_sql_function_is_its_column(spark):
    names = sql.register(spark, prefix="fl_")
    assert len(names) == len(sql.FUNCTIONS) + len(sql.SHIP_FUNCTIONS)
    given = {"double": [0.5, 3.25, 170.0], "int": [1, 2, 130310], "long": [233829638, 166921735, 5], "string": ["43°33'00\"N", "2026-01-02 03:04:05", "Europe/Rome"], "boolean": [True, False, None]}
    ship = specs.Vessel.of()
    every = {**sql.FUNCTIONS, **{k: (p, lambda *x, f=f: f(*x, ship)) for k, (p, f) in sql.SHIP_FUNCTIONS.items()}}
    for name, (parameters, build) in every.items():
        pairs = [p.split() for p in parameters.split(", ")]
        values = [("Europe/Rome" if n == "zone" else "2026-01-02 03:04:05" if name == "local_to_epoch" else "2026-01-02T03:04:05Z" if name == "utc_to_epoch" else given[t][k % 3]) for k, (n, t) in enumerate(pairs)]
        row = spark.createDataFrame([tuple(values)], parameters)
        mine = row.select(build(*[F.col(n) for n, _ in pairs]).alias("x")).first().x
        assert row.selectExpr(f"fl_{name}({', '.join(n for n, _ in pairs)}) AS x").first().x == mine, name


def frame(device, n):
    payload = bytes([2, n % 250, 0xF8, 0x01, 0xFF, device, 0, 0, 0, 0, 3, 0x10, n % 256, 2])
    body = bytes([0x93, len(payload)]) + payload
    body += bytes([-sum(body) & 0xFF])
    return b"\x10\x02" + body.replace(b"\x10", b"\x10\x10") + b"\x10\x03"


def test_serial_stream_in_pieces(spark, tmp_path):
    """Bytes of two devices, cut anywhere and spread over micro-batches, give the frames of the uncut bytes."""
    rng, schema = np.random.default_rng(0), "device string, seq long, data binary, timestamp double"
    wires = {str(d): b"".join(frame(d, n) for n in range(12)) for d in (1, 2)}
    pieces = {}
    for d, wire in wires.items():
        cuts = [0, *sorted(rng.choice(np.arange(1, len(wire)), 8, replace=False).tolist()), len(wire)]
        pieces[d] = [(d, k, wire[a:b], float(k)) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    got = []
    for batch in range(3):
        rows = [p for d in pieces for p in pieces[d][3 * batch : 3 * batch + 3]]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = capture.read_serial(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        stream.writeStream.foreachBatch(lambda df, n: got.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    for d, wire in wires.items():
        want = [f[0:1] + (bytes(f[4]),) for f in capture.serial_frames(wire)[0]]
        assert sorted((r.pgn, bytes(r.data)) for r in got if r.device == d) == sorted(want) and len(want) == 12


def test_holdout_thresholds(spark):
    rows = spark.range(1000).withColumn("g", F.col("id") % 37)
    assert fitting.holdout_rows(rows, ["id"], 0.2).where("is_holdout").count() == 200
    held = fitting.holdout_groups(rows, "g", 0.3)
    assert held.where("is_holdout").select("g").distinct().count() == 11 and held.groupBy("g").agg(F.count_distinct("is_holdout").alias("n")).where("n > 1").count() == 0
