"""The registered queries: each applies an operator to the driver's tables; ``SQL`` has the same as plain SQL."""

from __future__ import annotations

from collections.abc import Callable
from itertools import pairwise

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fairlead.functions import clock, fields, geo, mission, n2k, sql, twin, units
from fairlead.functions import grid as g
from fairlead.operators import clipping, fitting, fleet, imports, interp, lattice, legs, ranking, search, segments, spatial, tracks
from fairlead.plans import projection as P
from fairlead.sources import geography
from fairlead.sources import telemetry as store
from fairlead.sources.specs import Vessel
from fairlead.streaming import capture

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
C = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r4(x: Column | str) -> Column:
    return F.round(C(x) if isinstance(x, str) else x, 4) + 0.0  # no negative zero


def mod360(x: str) -> str:
    return f"(({x}) - 360e0 * floor(({x}) / 360e0))"


SHIP = Vessel.of()
# the default vessel's physics as SQL text
V = "(stw_ms / 2e0)"
ENC = f"abs({mod360(mod360('heading_deg - wave_from_deg') + ' + 540e0')} - 180e0)"
CALM = f"((5e0 * {V} * {V} + {V} * {V} * {V}) * (1e0 + 1.5e0 * pow({V} / sqrt(9.81e0 * 45e0) / 0.4e0, 4e0)))"
RESPONSE = "(pow(period_peak_s / {0}, 2) / (1e0 + pow(pow(period_peak_s / {0}, 2) - 1e0, 2)))"
ADDED = f"(0.4e0 * 1025e0 * 9.81e0 * hs_m * hs_m * (81e0 / 45e0) * {RESPONSE.format('7.5e0')} * (0.25e0 + 0.75e0 * pow(({ENC}) / 180e0, 1.6e0)) * {V} / 1000e0)"
SHARE = f"(({CALM} + {ADDED}) / active_engines)"
FUEL = f"(36e0 + active_engines * {SHARE} * 195e0 * (1e0 + 2e0 * pow({SHARE} / 1350e0 - 0.75e0, 2)) / 1000e0)"


def _half(spark: SparkSession, d: str) -> DataFrame:
    return P.telemetry(spark, d).withColumn("v", C("stw_ms") / 2.0)


def _power(rows: DataFrame) -> Column:
    return twin.total_power(C("v"), C("hs_m"), C("period_peak_s"), C("wave_from_deg"), C("heading_deg"), SHIP)


RUNS = P.TELEMETRY + """, lagged AS (SELECT *, lag(t_s) OVER w AS pt, lag(active_engines) OVER w AS pe, lag(stw_ms) OVER w AS pv,
    lag(heading_deg) OVER w AS ph, lag(fuel_kg_per_h) OVER w AS pf FROM tele WINDOW w AS (PARTITION BY vessel_id ORDER BY t_s, event_id)),
  marked AS (SELECT *, CASE WHEN pt IS NULL OR t_s - pt > 86400e0 OR active_engines <> pe OR abs(stw_ms - pv) * 1.943844e0 > 0.5e0
      OR abs(""" + mod360("heading_deg - ph + 180e0") + """ - 180e0) > 5e0
      OR abs(fuel_kg_per_h - pf) / greatest(1e-6, (fuel_kg_per_h + pf) / 2e0) > 0.25e0 THEN 1 ELSE 0 END AS brk FROM lagged),
  runs AS (SELECT *, sum(brk) OVER (PARTITION BY vessel_id ORDER BY t_s, event_id ROWS UNBOUNDED PRECEDING) AS run FROM marked),
  seg AS (SELECT vessel_id, run, min(t_s) AS t_start_s, max(t_s) AS t_end_s, avg(stw_ms) AS mean_stw_ms,
      """ + mod360("degrees(atan2(avg(sin(radians(heading_deg))), avg(cos(radians(heading_deg)))))") + """ AS mean_heading_deg,
      min(active_engines) AS active_engines, avg(fuel_kg_per_h) AS mean_fuel_kg_per_h, avg(hs_m) AS mean_hs_m,
      avg(period_peak_s) AS mean_period_peak_s,
      """ + mod360("degrees(atan2(avg(sin(radians(wave_from_deg))), avg(cos(radians(wave_from_deg)))))") + """ AS mean_wave_from_deg,
      count(*) AS n_samples FROM runs GROUP BY vessel_id, run HAVING max(t_s) - min(t_s) >= 300e0)"""


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return segments.steady_segments(P.telemetry(spark, d), ["vessel_id"], "event_id", segments.Limits(max_gap_s=P.GAP_S))


@query("WITH " + RUNS + """ SELECT vessel_id, round(t_start_s, 3) AS t_start_s, round(t_end_s - t_start_s, 3) AS duration_s, n_samples, active_engines,
  round(mean_stw_ms, 4) AS mean_stw_ms, round(mean_fuel_kg_per_h, 4) AS mean_fuel_kg_per_h, round(mean_hs_m, 4) AS mean_hs_m FROM seg""")
def steady_state_segments(spark, d):
    s = _segments(spark, d)
    return s.select("vessel_id", F.round("t_start_s", 3).alias("t_start_s"), F.round(C("t_end_s") - C("t_start_s"), 3).alias("duration_s"), "n_samples",
                    "active_engines", *[r4(c).alias(c) for c in ("mean_stw_ms", "mean_fuel_kg_per_h", "mean_hs_m")])


@query("WITH " + RUNS + """ SELECT vessel_id, round(t_start_s, 3) AS t_start_s, round(cos(radians(mean_heading_deg)), 4) + 0e0 AS heading_cos,
  round(sin(radians(mean_heading_deg)), 4) + 0e0 AS heading_sin, round(cos(radians(mean_wave_from_deg)), 4) + 0e0 AS wave_cos FROM seg""")
def segment_circular_means(spark, d):
    rad = lambda c: F.radians(C(c))
    return _segments(spark, d).select(
        "vessel_id", F.round("t_start_s", 3).alias("t_start_s"), r4(F.cos(rad("mean_heading_deg"))).alias("heading_cos"),
        r4(F.sin(rad("mean_heading_deg"))).alias("heading_sin"), r4(F.cos(rad("mean_wave_from_deg"))).alias("wave_cos"))


_SEG_FUEL = FUEL.replace("stw_ms / 2e0", "mean_stw_ms / 2e0").replace("heading_deg - wave_from_deg", "mean_heading_deg - mean_wave_from_deg").replace(
    "period_peak_s", "mean_period_peak_s").replace("hs_m * hs_m", "mean_hs_m * mean_hs_m")


@query("WITH " + RUNS + f""", res AS (SELECT vessel_id, {_SEG_FUEL} - mean_fuel_kg_per_h AS r FROM seg)
  SELECT vessel_id, count(*) AS n_holdout, round(sqrt(avg(r * r)), 3) AS rmse_kg_per_h, round(avg(r), 3) AS mean_bias_kg_per_h,
  round(1.645e0 * stddev_pop(r), 3) AS error_band_kg_per_h FROM res GROUP BY vessel_id""")
def fit_validation_metrics(spark, d):
    halved = _segments(spark, d).withColumn("mean_stw_ms", C("mean_stw_ms") / 2.0)
    v = fitting.validation(halved, SHIP, ["vessel_id"])
    return v.select("vessel_id", "n_holdout", *[F.round(c, 3).alias(c) for c in ("rmse_kg_per_h", "mean_bias_kg_per_h", "error_band_kg_per_h")])


@query("WITH " + P.TELEMETRY + """ SELECT event_id, round(stw_ms / 0.514444e0, 4) AS knots, round(stw_ms * 3.6e0 * 1000e0 / 1852e0, 4) AS nm_per_h,
  round(""" + mod360("lon_deg * 100e0 + 180e0") + """ - 180e0, 4) AS lon_wrapped, round(""" + mod360("heading_deg - 500e0") + ", 4) AS bearing FROM tele")
def unit_conversions(spark, d):
    return P.telemetry(spark, d).select(
        "event_id", r4(units.ms_to_kn(C("stw_ms"))).alias("knots"), r4(units.m_to_nm(C("stw_ms") * 3600.0)).alias("nm_per_h"),
        r4(units.wrap_longitude(C("lon_deg") * 100.0)).alias("lon_wrapped"), r4(units.wrap_bearing(C("heading_deg") - 500.0)).alias("bearing"))


@query("WITH " + P.TELEMETRY + """, uv AS (SELECT event_id, stw_ms * sin(radians(wave_from_deg + 180e0)) AS u, stw_ms * cos(radians(wave_from_deg + 180e0)) AS v FROM tele)
  SELECT event_id, round(u, 4) + 0e0 AS u, round(v, 4) + 0e0 AS v, round(sqrt(u * u + v * v), 4) + 0e0 AS speed,
  round(cos(radians(degrees(atan2(u, v)) + 180e0)), 4) + 0e0 AS from_cos FROM uv""")
def wind_components_roundtrip(spark, d):
    u, v = units.components(C("stw_ms"), C("wave_from_deg"))
    rows = P.telemetry(spark, d).select("event_id", u.alias("u"), v.alias("v"))
    speed, origin = units.speed_and_origin(C("u"), C("v"))
    return rows.select("event_id", r4("u").alias("u"), r4("v").alias("v"), r4(speed).alias("speed"), r4(F.cos(F.radians(origin))).alias("from_cos"))


@query("WITH " + P.TELEMETRY + """, tri AS (SELECT event_id, stw_ms, radians(heading_deg) AS b, (event_id % 25) - 12e0 AS u, (event_id % 17) - 8e0 AS v FROM tele),
  parts AS (SELECT *, u * sin(b) + v * cos(b) AS along, u * cos(b) - v * sin(b) AS across FROM tri)
  SELECT event_id, stw_ms * stw_ms - across * across < 0 AS exceeded,
  round(CASE WHEN stw_ms * stw_ms - across * across >= 0 THEN sqrt(stw_ms * stw_ms - across * across) + along END, 4) + 0e0 AS ground_speed FROM parts""")
def current_triangle(spark, d):
    rows = P.telemetry(spark, d)
    t = units.current_triangle(C("stw_ms"), C("heading_deg"), C("event_id") % 25 - 12.0, C("event_id") % 17 - 8.0)
    return rows.select("event_id", t["exceeded"].alias("exceeded"), r4(t["ground_speed"]).alias("ground_speed"))


@query("WITH " + P.TELEMETRY + " SELECT event_id, round(abs(" + mod360("heading_deg - wave_from_deg + 180e0") + f" - 180e0), 4) AS diff, round({ENC}, 4) AS encounter FROM tele")
def circular_difference(spark, d):
    return P.telemetry(spark, d).select(
        "event_id", r4(units.angle_between(C("heading_deg"), C("wave_from_deg"))).alias("diff"),
        r4(twin.encounter_angle(C("heading_deg"), C("wave_from_deg"))).alias("encounter"))


@query("WITH " + P.TELEMETRY + f" SELECT event_id, round({CALM}, 4) AS calm_kw, round({ADDED}, 4) AS added_kw FROM tele")
def calm_and_added_power(spark, d):
    rows = _half(spark, d)
    enc = twin.encounter_angle(C("heading_deg"), C("wave_from_deg"))
    return rows.select("event_id", r4(twin.calm_power(C("v"), SHIP)).alias("calm_kw"), r4(twin.added_power(C("v"), C("hs_m"), C("period_peak_s"), enc, SHIP)).alias("added_kw"))


@query("WITH " + P.TELEMETRY + f" SELECT event_id, round({FUEL}, 4) AS fuel_kg_per_h, round({SHARE} / 1350e0, 4) AS load FROM tele")
def fuel_rate(spark, d):
    rows = _half(spark, d).withColumn("p", _power(_half(spark, d)))
    return rows.select("event_id", r4(twin.fuel_rate(C("p"), C("active_engines"), SHIP)).alias("fuel_kg_per_h"),
                       r4(F.array_max(twin.engine_loads(C("p"), C("active_engines"), SHIP))).alias("load"))


@query("WITH " + P.TELEMETRY + f""" SELECT event_id, round(pow(hs_m, 1.7e0) * (0.35e0 + 0.91e0 * pow(sin(radians({ENC})), 2) + CASE WHEN {ENC} > 150e0 THEN 0.25e0 ELSE 0e0 END)
  * {RESPONSE.format('6.5e0')} * (0.5e0 + {V} / 0.514444e0 / 22e0), 4) AS motion FROM tele""")
def motion_index(spark, d):
    return _half(spark, d).select("event_id", r4(twin.motion_index(C("v"), C("hs_m"), C("period_peak_s"), C("wave_from_deg"), C("heading_deg"), SHIP)).alias("motion"))


_SLAM = f"({ENC} > 140e0 AND hs_m > 1.8e0 AND {V} > 5e0)"


@query("WITH " + P.TELEMETRY + f""", w AS (SELECT event_id, active_engines, hs_m, {V} AS v, {SHARE} / 1350e0 AS ld, {_SLAM.replace('5e0', '6.69e0')} AS slam FROM tele)
  SELECT event_id, slam, ld > 0.85e0 AS overload, round(pow(greatest(ld, 0e0), 3) * 1.2e0 + CASE WHEN slam THEN 3e0 * (hs_m - 1.8e0) * (v - 6.69e0) ELSE 0e0 END
    + CASE WHEN active_engines = 1 THEN 0.15e0 ELSE 0e0 END, 4) AS rate FROM w""")
def wear_flags(spark, d):
    rows = _half(spark, d).withColumn("p", _power(_half(spark, d)))
    rows = rows.withColumn("ld", F.array_max(twin.engine_loads(C("p"), C("active_engines"), SHIP)))
    w = twin.wear(C("v"), C("hs_m"), C("wave_from_deg"), C("heading_deg"), C("ld"), C("active_engines"), SHIP)
    return rows.select("event_id", w["slam"].alias("slam"), w["overload"].alias("overload"), r4(w["rate"]).alias("rate"))


@query("""WITH s AS (SELECT event_id, CAST(event_id % 101 AS DOUBLE) AS pace, CAST((event_id * 7) % 101 AS DOUBLE) AS comfort FROM events)
  SELECT event_id, round(((100e0 - pace) / 100e0 + 0.15e0) / 0.85e0, 4) AS fuel_eur_per_kg, round(pace / 100e0 * 25e0 + 0.5e0, 4) AS time_eur_per_min,
  round(comfort / 100e0 * 36e0, 4) AS comfort_eur_per_point FROM s""")
def mission_weights(spark, d):
    rows = P.table(spark, d, "events").select("event_id", (C("event_id") % 101).cast("double").alias("pace"), ((C("event_id") * 7) % 101).cast("double").alias("comfort"))
    return rows.select("event_id", *[r4(w).alias(k) for k, w in mission.weights(C("pace"), C("comfort")).items()])


def _gauss(x: str, c: str, w: str) -> str:
    return f"exp(-pow(({x} - {c}) / {w}, 2))"


_EAST = f"({_gauss('lon_deg', '9.8e0', '1.2e0')} * {_gauss('lat_deg', '42.2e0', '1.6e0')} * least(1e0, 0.4e0 + t / 24e0))"
_WEST = f"{_gauss('lon_deg', '7.9e0', '1.5e0')} * {_gauss('lat_deg', '41.9e0', '1.6e0')}"
_STRAIT = f"0.85e0 * {_gauss('lon_deg', '9.05e0', '0.45e0')} * {_gauss('lat_deg', '41.32e0', '0.22e0')}"
_NORTH = f"0.45e0 * {_gauss('lon_deg', '8.6e0', '1.6e0')} * {_gauss('lat_deg', '43.2e0', '0.9e0')}"
_DECAY = "(0.45e0 + 0.55e0 / (1e0 + exp((t - 20e0) / 5e0)))"


@query("WITH " + P.TELEMETRY + f""", s AS (SELECT *, CAST(event_id % 48 AS DOUBLE) AS t FROM tele)
  SELECT event_id, round(least(4.2e0, (0.5e0 + 3.4e0 * greatest({_WEST}, {_NORTH}, {_STRAIT}) * {_DECAY})
    * CASE WHEN lon_deg > 9.15e0 AND lat_deg > 41.4e0 AND lat_deg < 43.05e0 THEN 0.3e0 ELSE 1e0 END), 4) AS mistral_hs,
  round(least(3.2e0, (0.5e0 + 2.6e0 * {_EAST}) * CASE WHEN lon_deg < 8.9e0 AND lat_deg > 41.5e0 AND lat_deg < 43e0 THEN 0.35e0 ELSE 1e0 END), 4) AS easterly_hs FROM s""")
def synthetic_weather(spark, d):
    rows = P.telemetry(spark, d)
    at = C("lat_deg"), C("lon_deg"), (C("event_id") % 48).cast("double")
    return rows.select("event_id", r4(fields.synthetic_weather("mistral", *at)["hs_m"]).alias("mistral_hs"),
                       r4(fields.synthetic_weather("easterly", *at)["hs_m"]).alias("easterly_hs"))


@query("""WITH s AS (SELECT event_id, ['monitoring_csv', 'e_logbook', 'noon_report', 'other'][1 + event_id % 4] AS source, event_id % 3 = 0 AS ground FROM events)
  SELECT event_id, round((CASE source WHEN 'e_logbook' THEN 0.08e0 WHEN 'noon_report' THEN 0.15e0 ELSE 0.03e0 END) / 0.03e0 * CASE WHEN ground THEN 2e0 ELSE 1e0 END, 4) AS multiplier FROM s""")
def source_noise_weights(spark, d):
    source = F.element_at(F.array(*[F.lit(x) for x in ("monitoring_csv", "e_logbook", "noon_report", "other")]), (C("event_id") % 4 + 1).cast("int"))
    return P.table(spark, d, "events").select("event_id", r4(mission.noise_multiplier(source, C("event_id") % 3 == 0)).alias("multiplier"))


def _raw_logs(spark: SparkSession, d: str) -> DataFrame:
    t = P.telemetry(spark, d)
    stamp = F.date_format(F.timestamp_micros("t_us"), "yyyy-MM-dd HH:mm:ss")
    text = lambda c: C(c).cast("string")
    return t.select(
        C("vessel_id").cast("string").alias("vessel_id"), F.lit("p").alias("passage_id"), "event_id", stamp.alias("local_datetime"),
        F.concat(F.replace(stamp, F.lit(" "), F.lit("T")), F.lit("Z")).alias("timestamp_utc"), F.lit("Europe/Rome").alias("timezone"), text("lat_deg").alias("lat_deg"), text("lon_deg").alias("lon_deg"),
        text("stw_ms").alias("stw_kn"), text("stw_ms").alias("sog_kn"), text("heading_deg").alias("heading_deg"), text("active_engines").alias("active_engines"),
        text("fuel_kg_per_h").alias("fuel_kg_per_h"), text("fuel_kg_per_h").alias("fuel_l_per_h"),
        F.when(C("event_id") % 5 == 0, "").otherwise(text("hs_m")).alias("hs_m"), text("period_peak_s").alias("period_peak_s"), text("wave_from_deg").alias("wave_from_deg"))


@query("WITH " + P.TELEMETRY + """ SELECT 'monitoring_csv' AS source, CAST(vessel_id AS VARCHAR) AS vessel_id, CAST(t_us // 1000000 AS DOUBLE) AS t_epoch_s,
    round(stw_ms, 4) AS speed_kn, round(fuel_kg_per_h, 4) AS fuel_kg_per_h, round(CASE WHEN event_id % 5 = 0 THEN NULL ELSE hs_m END, 4) AS hs_m FROM tele
  UNION ALL SELECT 'e_logbook', CAST(vessel_id AS VARCHAR), epoch_us(timezone('Europe/Rome', make_timestamp(t_us // 1000000 * 1000000))) / 1e6, round(stw_ms, 4), round(fuel_kg_per_h * 0.85e0, 4),
    round(CASE WHEN event_id % 5 = 0 THEN NULL ELSE hs_m END, 4) FROM tele""")
def csv_adapter_normalise(spark, d):
    raw = _raw_logs(spark, d)
    rows = imports.with_speed(imports.union_sources([imports.monitoring(raw), imports.e_logbook(raw)]))
    return rows.select("source", "vessel_id", "t_epoch_s", *[r4(c).alias(c) for c in ("speed_kn", "fuel_kg_per_h", "hs_m")])


@query("WITH " + P.TELEMETRY + """ SELECT count(*) AS n, CAST(sum(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS incomplete FROM tele""")
def import_completeness(spark, d):
    rows = imports.with_speed(imports.monitoring(_raw_logs(spark, d)))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.size("missing") > 0).alias("incomplete"))


_LOG = P.TELEMETRY + f""", log AS (SELECT * REPLACE (CAST(t_us // 1000000 AS DOUBLE) AS t_s, stw_ms * {units.IMPORT_KN_TO_MS}e0 AS stw_ms) FROM tele WHERE event_id % 5 <> 0)"""


@query("WITH " + _LOG + RUNS[len(P.TELEMETRY):].replace("FROM tele WINDOW", "FROM log WINDOW") + """ SELECT CAST(vessel_id AS VARCHAR) AS vessel_id, t_start_s, t_end_s, active_engines, n_samples,
  round(mean_stw_ms, 4) AS mean_stw_ms, round(mean_fuel_kg_per_h, 4) AS mean_fuel_kg_per_h, round(mean_hs_m, 4) AS mean_hs_m, round(mean_period_peak_s, 4) AS mean_period_peak_s,
  round(cos(radians(mean_heading_deg)), 4) + 0e0 AS heading_cos, round((t_end_s - t_start_s) / 3600e0, 4) AS duration_h, 1e0 AS fuel_noise_multiplier FROM seg""")
def rows_to_segments(spark, d):
    """Rows of monitoring logs; those that lack a needed value, every fifth, go as the operator has it when not strict."""
    raw = _raw_logs(spark, d)
    found = imports.rows_to_segments(imports.monitoring(raw), segments.Limits(max_gap_s=P.GAP_S), strict=False)
    means = ["mean_stw_ms", "mean_fuel_kg_per_h", "mean_hs_m", "mean_period_peak_s", "duration_h", "fuel_noise_multiplier"]
    return found.select("vessel_id", "t_start_s", "t_end_s", "active_engines", "n_samples", *[r4(c).alias(c) for c in means],
                        r4(F.cos(F.radians("mean_heading_deg"))).alias("heading_cos"))


def _axes() -> interp.Axes:
    return interp.Axes(P.GRID_LAT, P.GRID_LON, P.GRID_T)


def _cell_sql(points: str) -> str:
    """What ``met`` reads: the fields at the rows (event_id, lat_deg, lon_deg, t_h) of the table ``points``."""
    return ", " + P.GRID + f""", pos AS (SELECT event_id, greatest(0e0, least(7.999e0, (lat_deg - 41e0) / 0.3e0)) AS fy, greatest(0e0, least(9.999e0, (lon_deg - 7e0) / 0.3e0)) AS fx,
    greatest(0e0, least(2.999e0, t_h / 6e0)) AS ft FROM {points}),""" + """
  cell AS (SELECT *, CAST(floor(fy) AS INTEGER) AS y0, CAST(floor(fx) AS INTEGER) AS x0, CAST(floor(ft) AS INTEGER) AS t0 FROM pos),
  corner AS (SELECT c.event_id, g.it - c.t0 AS k, ft - t0 AS wt, g.* EXCLUDE (it, iy, ix, lat_deg, lon_deg, t_h), (g.ix - x0) * 2 + g.iy - y0 AS ord,
      (CASE WHEN g.iy = y0 THEN 1e0 - (fy - y0) ELSE fy - y0 END) * (CASE WHEN g.ix = x0 THEN 1e0 - (fx - x0) ELSE fx - x0 END) AS w
    FROM cell c JOIN grid g ON g.it IN (c.t0, c.t0 + 1) AND g.iy IN (y0, y0 + 1) AND g.ix IN (x0, x0 + 1)),
  flat AS (SELECT event_id, k, any_value(wt) AS wt, """ + ", ".join(f"sum({f} * w) AS {f}" for f in interp.PLAIN) + ", " + ", ".join(
    f"""CASE WHEN sum(CASE WHEN isnan({f}) THEN 0e0 ELSE w END) > 1e-12 THEN sum(CASE WHEN isnan({f}) THEN 0e0 ELSE {f} * w END) / sum(CASE WHEN isnan({f}) THEN 0e0 ELSE w END)
      ELSE arg_min({f}, ord) FILTER (NOT isnan({f})) END AS {f}""" for f in interp.MASKED) + """ FROM corner GROUP BY event_id, k),
  met AS (SELECT event_id, """ + ", ".join(f"sum({f} * CASE WHEN k = 0 THEN 1e0 - wt ELSE wt END) AS {f}" for f in [*interp.MASKED, *interp.PLAIN]) + """ FROM flat GROUP BY event_id)"""

_CELL = P.TELEMETRY + ", timed AS (SELECT event_id, lat_deg, lon_deg, CAST(event_id % 24 AS DOUBLE) AS t_h FROM tele)" + _cell_sql("timed")

SAMPLED = [f for f in [*interp.MASKED, *interp.PLAIN] if f not in ("wave_u", "wave_v")]


@query("WITH " + _CELL + " SELECT event_id, " + ", ".join(f"round({f}, 4) + 0e0 AS {f}" for f in SAMPLED) + ", round(" + mod360("degrees(atan2(wave_u, wave_v)) + 180e0") + ", 3) AS wave_from_deg FROM met")
def weather_sample(spark, d):
    table = interp.cells(interp.wave_vectors(P.grid(spark)), [*interp.MASKED, *interp.PLAIN], _axes())
    rows = P.telemetry(spark, d).select("event_id", "lat_deg", "lon_deg", ((C("event_id") % 24) * 1.0).alias("t_h"))
    found = interp.sample(rows, table, _axes())
    return found.select("event_id", *[r4(units.null_if_nan(C(f))).alias(f) for f in SAMPLED], F.round(units.null_if_nan(C("wave_from_deg")), 3).alias("wave_from_deg"))


@query("WITH " + P.TELEMETRY + ", " + P.GRID + """, pos AS (SELECT event_id, CAST(least(8e0, round_even(greatest(0e0, least(7.999e0, (lat_deg - 41e0) / 0.3e0)), 0)) AS INTEGER) AS y,
    CAST(least(10e0, round_even(greatest(0e0, least(9.999e0, (lon_deg - 7e0) / 0.3e0)), 0)) AS INTEGER) AS x FROM tele)
  SELECT event_id, round(wind_u_ms, 4) AS wind_u_ms FROM pos JOIN grid ON it = 0 AND iy = y AND ix = x""")
def grid_nearest(spark, d):
    rows = P.telemetry(spark, d).select(
        "event_id", g.nearest_index(g.fraction(C("lat_deg"), *P.GRID_LAT), 9).alias("iy"), g.nearest_index(g.fraction(C("lon_deg"), *P.GRID_LON), 11).alias("ix"))
    return rows.join(P.grid(spark).where("it = 0"), ["iy", "ix"]).select("event_id", r4("wind_u_ms").alias("wind_u_ms"))


@query("WITH raster AS (SELECT y * 100 + x AS event_id, 41.2e0 + y * 2e0 / 29e0 AS lat_deg, 7.2e0 + x * 2.6e0 / 31e0 AS lon_deg, 7e0 AS t_h FROM range(30) a(y), range(32) b(x))"
       + _cell_sql("raster") + " SELECT CAST(event_id // 100 AS INTEGER) AS iy, CAST(event_id % 100 AS INTEGER) AS ix, round(lat_deg, 6) AS lat_deg, round(hs_m, 4) AS hs_m, round("
       + mod360("degrees(atan2(wave_u, wave_v)) + 180e0") + ", 3) AS wave_from_deg FROM met JOIN raster USING (event_id)")
def weather_field_downsample(spark, d):
    table = interp.cells(interp.wave_vectors(P.grid(spark)), [*interp.MASKED, *interp.PLAIN], _axes())
    found = interp.display_field(spark, table, _axes(), (7.2, 41.2, 9.8, 43.2), 7.4)
    cells = found.select("iy", F.round("lat_deg", 6).alias("lat_deg"), F.posexplode(F.arrays_zip("hs_m", "wave_from_deg")).alias("ix", "v"))
    return cells.select("iy", "ix", "lat_deg", F.round("v.hs_m", 4).alias("hs_m"), F.round("v.wave_from_deg", 3).alias("wave_from_deg"))


def _ring_sql(lat: str, lon: str, ring: list[tuple[float, float]]) -> str:
    parts = []
    for (yj, xj), (yi, xi) in pairwise([ring[-1], *ring]):
        if yi != yj:
            parts.append(f"CASE WHEN ({yi}e0 > {lat}) <> ({yj}e0 > {lat}) AND {lon} < ({xj}e0 - {xi}e0) * ({lat} - {yi}e0) / ({yj}e0 - {yi}e0) + {xi}e0 THEN 1 ELSE 0 END")
    return "((" + " + ".join(parts) + ") % 2 = 1)"


def _land_sql(lat: str = "lat_deg", lon: str = "lon_deg") -> str:
    return "(" + " OR ".join(_ring_sql(lat, lon, r) for r in P.ISLANDS) + ")"


def _box_sql(lat: str = "lat_deg", lon: str = "lon_deg") -> str:
    return "(" + " OR ".join(f"({lon} BETWEEN {w}e0 AND {e}e0 AND {lat} BETWEEN {s}e0 AND {n}e0)" for w, s, e, n in P.BOXES) + ")"


WATERS = spatial.Waters(P.ISLANDS, P.BOXES)


@query("WITH " + P.TELEMETRY + f" SELECT event_id, {_land_sql()} AS is_land, {_box_sql()} AS is_nogo, NOT ({_land_sql()} OR {_box_sql()}) AS is_navigable FROM tele")
def point_in_polygon(spark, d):
    at = C("lat_deg"), C("lon_deg")
    return P.telemetry(spark, d).select("event_id", WATERS.is_land(*at).alias("is_land"), WATERS.is_nogo(*at).alias("is_nogo"), WATERS.is_navigable(*at).alias("is_navigable"))


@query("WITH " + P.TELEMETRY + ", rings AS (" + " UNION ALL ".join(f"SELECT event_id, {i} AS ring FROM tele WHERE {_ring_sql('lat_deg', 'lon_deg', r)}" for i, r in enumerate(P.ISLANDS)) + ") SELECT event_id, ring FROM rings")
def rings_by_tiles(spark, d):
    return spatial.rings_at(P.telemetry(spark, d), spatial.edge_table(spark, dict(enumerate(P.ISLANDS))), "event_id")


def _land_nm_sql() -> str:
    parts = []
    for r in P.ISLANDS:
        for (yj, xj), (yi, xi) in pairwise([r[-1], *r]):
            ax, ay, bx, by = f"({xi}e0 * k)", f"({yi}e0 * 60e0)", f"({xj}e0 * k)", f"({yj}e0 * 60e0)"
            u = f"greatest(0e0, least(1e0, ((px - {ax}) * ({bx} - {ax}) + (py - {ay}) * ({by} - {ay})) / (({bx} - {ax}) * ({bx} - {ax}) + ({by} - {ay}) * ({by} - {ay}))))"
            parts.append(f"sqrt(pow(px - ({ax} + ({bx} - {ax}) * {u}), 2) + pow(py - ({ay} + ({by} - {ay}) * {u}), 2))")
    return "least(" + ", ".join(parts) + ")"


@query("WITH " + P.PLACES + f""", s AS (SELECT place_id, lat_deg, lon_deg, 60e0 * cos(radians(42.3e0)) AS k FROM places),
  q AS (SELECT *, lon_deg * k AS px, lat_deg * 60e0 AS py FROM s), n AS (SELECT place_id, lat_deg, lon_deg, {_land_nm_sql()} AS nm FROM q)
  SELECT place_id, round(nm, 4) AS land_nm, round(least(CASE WHEN lat_deg > 41.15e0 AND lat_deg < 41.55e0 AND lon_deg > 8.8e0 AND lon_deg < 9.8e0 THEN 110e0
    WHEN lat_deg > 42.4e0 AND lon_deg > 9.4e0 THEN 480e0 WHEN lat_deg <= 42.4e0 AND lon_deg > 9.6e0 THEN 1250e0 ELSE 2600e0 END, greatest(12e0, pow(nm, 1.25e0) * 95e0)), 4) AS depth_m FROM n""")
def land_distance_and_depth(spark, d):
    nm = geo.land_distance_nm(C("lat_deg"), C("lon_deg"), P.ISLANDS)
    rows = P.places(spark, d).withColumn("nm", nm)
    return rows.select("place_id", r4("nm").alias("land_nm"), r4(geo.shelf_depth_m(C("lat_deg"), C("lon_deg"), C("nm"))).alias("depth_m"))


_LEG = P.PLACES + """, leg AS (SELECT place_id, lat_deg AS p_lat, lon_deg AS p_lon, lat_deg + (place_id % 7 - 3) * 0.02e0 AS q_lat, lon_deg + (place_id % 5 - 2) * 0.03e0 AS q_lon FROM places),
  sized AS (SELECT *, greatest(1, CAST(ceil(sqrt(pow((q_lon - p_lon) * 60e0 * cos(radians(42.3e0)), 2) + pow((q_lat - p_lat) * 60e0, 2)) / 0.25e0) AS BIGINT)) AS n FROM leg),
  spot AS (SELECT place_id, p_lat + (q_lat - p_lat) * (i / CAST(n AS DOUBLE)) AS lat, p_lon + (q_lon - p_lon) * (i / CAST(n AS DOUBLE)) AS lon FROM sized, unnest(range(1, n + 1)) u(i))"""


@query("WITH " + _LEG + f" SELECT place_id, bool_and(NOT ({_land_sql('lat', 'lon')} OR {_box_sql('lat', 'lon')})) AS navigable, count(*) AS n_points FROM spot GROUP BY place_id")
def leg_navigability(spark, d):
    k = C("place_id")
    rows = P.places(spark, d).select("place_id", C("lat_deg").alias("p_lat"), C("lon_deg").alias("p_lon"),
                                     (C("lat_deg") + (k % 7 - 3) * 0.02).alias("q_lat"), (C("lon_deg") + (k % 5 - 2) * 0.03).alias("q_lon"))
    nm = units.distance_nm(C("p_lat"), C("p_lon"), C("q_lat"), C("q_lon"), 42.3)
    ends = ["p_lat", "p_lon", "q_lat", "q_lon"]
    return rows.join(legs.edge_limits(rows, WATERS, 0.0), ends).select(
        "place_id", "navigable", F.greatest(F.lit(1), F.ceil(nm / 0.25)).cast("long").alias("n_points"))


@query("WITH " + P.GRID + f" SELECT it, iy, ix, round(CASE WHEN {_land_sql()} OR isnan(hs_m) THEN NULL ELSE hs_m END, 4) AS hs_m FROM grid")
def land_mask(spark, d):
    masked = spatial.mask_land(P.grid(spark), ["hs_m"], WATERS)
    return masked.select(*[C(c).cast("long").alias(c) for c in ("it", "iy", "ix")], r4(units.null_if_nan(C("hs_m"))).alias("hs_m"))


@query("WITH " + P.GRID + """, st AS (SELECT iy, ix, any_value(lat_deg) AS lat, any_value(lon_deg) AS lon, bool_or(it = 0 AND NOT isnan(hs_m)) AS valid, bool_and(isnan(hs_m)) AS emp FROM grid GROUP BY iy, ix),
  sub AS (SELECT iy, ix, avg(CASE WHEN """ + _land_sql("(lat + (a.i / 8e0 - 0.5e0) * 0.3e0)", "(lon + (b.i / 8e0 - 0.5e0) * 0.3e0)") + """ THEN 0e0 ELSE 1e0 END) AS water FROM st, range(9) a(i), range(9) b(i) GROUP BY iy, ix),
  need AS (SELECT s.* FROM st s JOIN sub USING (iy, ix) WHERE emp AND NOT valid AND water >= 0.5e0),
  d AS (SELECT n.iy, n.ix, v.iy AS jy, v.ix AS jx, sqrt(pow((v.lon - n.lon) * 60e0 * cos(radians(42.3e0)), 2) + pow((v.lat - n.lat) * 60e0, 2)) AS nm FROM need n JOIN st v ON v.valid),
  b AS (SELECT *, row_number() OVER (PARTITION BY iy, ix ORDER BY round(nm, 6), jy, jx) AS rn FROM d WHERE nm <= 60e0)
  SELECT iy, ix, round(nm, 4) AS nm FROM b WHERE rn = 1""")
def coastal_fill(spark, d):
    rows = P.grid(spark)
    cells = rows.where("it = 0").select("iy", "ix", "lat_deg", "lon_deg")
    water = spatial.water_fraction(cells, 0.3, 0.3, WATERS)
    found = spatial.fill_sources(rows, water, "hs_m", 42.3)
    return found.select(C("iy").cast("long").alias("iy"), C("ix").cast("long").alias("ix"), r4("nm").alias("nm"))


def _swell_sql(x: tuple) -> str:
    share, lat0, lat_width, lon0, lon_width = x
    return f"{share}e0 * exp(-pow((mid_lat - {lat0}e0) / {lat_width}e0, 2) - pow((mid_lon - {lon0}e0) / {lon_width}e0, 2))"


def _hs_sql(scenario: str) -> str:
    """Wave height of a scenario at mid_lat, mid_lon, mid_t, from its fixed values."""
    w = fields.SCENARIOS[scenario]
    least, more, most = w["hs_m"]
    growth = {"calm": "1e0", "mistral": "(0.45e0 + 0.55e0 / (1e0 + exp((mid_t - 20e0) / 5e0)))", "easterly": "least(1e0, 0.4e0 + mid_t / 24e0)"}[scenario]
    waves = f"greatest(0e0, {', '.join(_swell_sql(x) for x, _ in w['swells'])})" if w["swells"] else "0e0"
    hs = f"({least}e0 + {more}e0 * {waves} * {growth})"
    if w["lee"]:
        (south, north, west, east), left, _ = w["lee"]
        hs = f"(CASE WHEN mid_lat > {south}e0 AND mid_lat < {north}e0 AND mid_lon > {west}e0 AND mid_lon < {east}e0 THEN {hs} * {left}e0 ELSE {hs} END)"
    return f"least({most}e0, {hs})"


def legs_sql(source: str, scenario: str) -> str:
    """SQL text: the rows of ``source`` with the outcome of their legs in still water, for the default vessel."""
    shrink, kn, v = "cos(radians(42.3e0))", f"{units.KN_TO_MS}e0", "stw_ms"
    wave_from = fields.SCENARIOS[scenario]["wave_from"]
    enc = f"abs({mod360(mod360(f'course_deg - {wave_from}e0') + ' + 540e0')} - 180e0)"
    calm = f"((5e0 * {v} * {v} + {v} * {v} * {v}) * (1e0 + 1.5e0 * pow({v} / sqrt(9.81e0 * 45e0) / 0.4e0, 4e0)))"
    added = f"(0.4e0 * 1025e0 * 9.81e0 * max_hs * max_hs * (81e0 / 45e0) * {RESPONSE.format('7.5e0')} * (0.25e0 + 0.75e0 * pow(enc / 180e0, 1.6e0)) * {v} / 1000e0)"
    beam = "(0.35e0 + 0.91e0 * pow(sin(radians(enc)), 2) + CASE WHEN enc > 150e0 THEN 0.25e0 ELSE 0e0 END)"
    wear = f"(pow(greatest(load, 0e0), 3) * 1.2e0 + CASE WHEN slam THEN 3e0 * (max_hs - 1.8e0) * ({v} - 6.69e0) ELSE 0e0 END + CASE WHEN engines = 1 THEN 0.15e0 ELSE 0e0 END)"
    return f"""(SELECT *, (36e0 + engines * (load * 1350e0) * 195e0 * (1e0 + 2e0 * pow(load - 0.75e0, 2)) / 1000e0) * duration_h AS fuel_kg,
      pow(max_hs, 1.7e0) * {beam} * {RESPONSE.format('6.5e0')} * (0.5e0 + {v} / {kn} / 22e0) * duration_h AS comfort, {wear} * duration_h AS wear, load > 0.85e0 AS overload
    FROM (SELECT *, ({calm} + {added}) / engines / 1350e0 AS load, enc > 140e0 AND max_hs > 1.8e0 AND {v} > 6.69e0 AS slam
    FROM (SELECT *, {enc} AS enc, 4e0 + 3.5e0 * sqrt(max_hs) AS period_peak_s
    FROM (SELECT *, {_hs_sql(scenario)} AS max_hs
    FROM (SELECT *, nm / ({v} / {kn}) AS duration_h, t_h + nm / ({v} / {kn}) / 2e0 AS mid_t, (p_lat + q_lat) / 2e0 AS mid_lat, (p_lon + q_lon) / 2e0 AS mid_lon
    FROM (SELECT *, sqrt(pow((q_lon - p_lon) * 60e0 * {shrink}, 2) + pow((q_lat - p_lat) * 60e0, 2)) AS nm,
      {mod360(f'degrees(atan2((q_lon - p_lon) * {shrink}, q_lat - p_lat))')} AS course_deg FROM {source}))))))"""


LEG_RESULTS = ["course_deg", "duration_h", "fuel_kg", "comfort", "wear", "max_hs"]


@query("WITH " + P.PLACES + """, legs AS (SELECT place_id, lat_deg AS p_lat, lon_deg AS p_lon, lat_deg + 0.1e0 AS q_lat, lon_deg + 0.05e0 AS q_lon,
    5e0 + (place_id % 3) * 0.5e0 AS stw_ms, CAST(place_id % 2 + 1 AS INTEGER) AS engines, CAST(place_id % 24 AS DOUBLE) AS t_h FROM places)
  SELECT place_id, """ + ", ".join(f"round({c}, 4) AS {c}" for c in LEG_RESULTS) + ", slam, overload FROM " + legs_sql("legs", "mistral"))
def leg_evaluation(spark, d):
    k = C("place_id")
    rows = P.places(spark, d).select(
        "place_id", C("lat_deg").alias("p_lat"), C("lon_deg").alias("p_lon"), (C("lat_deg") + 0.1).alias("q_lat"), (C("lon_deg") + 0.05).alias("q_lon"),
        (5.0 + (k % 3) * 0.5).alias("stw_ms"), (k % 2 + 1).cast("int").alias("engines"), (k % 24).cast("double").alias("t_h"))
    done = legs.evaluate(rows, legs.scenario("mistral"), SHIP)
    return done.select("place_id", *[F.round(c, 4).alias(c) for c in LEG_RESULTS], "slam", "overload")


_LAT = lattice.Lattice([(43.5 - 0.2 * i, 7.2 + 0.15 * i) for i in range(6)], [0, 2, 3, 3, 2, 0], [5.0, 5.0, 2.5, 5.0, 5.0, 5.0], 15.0, 42.3)


def _stages_sql(lat: lattice.Lattice = _LAT) -> str:
    rows = ", ".join("(" + ", ".join(f"{x}e0" if isinstance(x, float) else str(x) for x in r) + ")" for r in lat.stage_rows())
    return f"""st(stage, lat0, lon0, a_lat, a_lon, b_lat, b_lon, lanes, step) AS (VALUES {rows}),
  dir AS (SELECT *, (b_lon - a_lon) * cos(radians(42.3e0)) AS dx, b_lat - a_lat AS dy FROM st),
  node AS (SELECT stage, lane, step, lanes, lat0 + dx / sqrt(dx * dx + dy * dy) * lane * step / 60e0 AS lat,
    lon0 - dy / sqrt(dx * dx + dy * dy) * lane * step / (60e0 * cos(radians(42.3e0))) AS lon FROM dir, unnest(range(-lanes, lanes + 1)) u(lane))"""


@query("WITH " + _stages_sql() + " SELECT stage, CAST(lane AS INTEGER) AS lane, round(lat, 6) AS lat, round(lon, 6) AS lon FROM node")
def lattice_nodes(spark, d):
    return lattice.nodes(spark, _LAT).select("stage", "lane", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def _edges_sql(lat: lattice.Lattice = _LAT) -> str:
    turn = f"{lat.turn_nm}e0"
    return _stages_sql(lat) + f""", edge AS (SELECT p.stage, CAST(p.lane AS INTEGER) AS lane, CAST(q.lane AS INTEGER) AS next_lane, p.lat AS p_lat, p.lon AS p_lon, q.lat AS q_lat, q.lon AS q_lon FROM node p JOIN node q
    ON q.stage = p.stage + 1 AND q.lane >= ceil((p.lane * p.step - {turn}) / q.step) AND q.lane <= floor((p.lane * p.step + {turn}) / q.step))"""


@query("WITH " + _edges_sql() + " SELECT stage, lane, next_lane, round(q_lat, 6) AS q_lat, round(q_lon, 6) AS q_lon FROM edge")
def lattice_edges(spark, d):
    return lattice.edges(spark, _LAT).select("stage", "lane", "next_lane", F.round("q_lat", 6).alias("q_lat"), F.round("q_lon", 6).alias("q_lon"))


def _plan(weather: str = "calm", speeds: list[float] = [10.0, 12.0]) -> search.Plan:  # noqa: B006
    w = {"fuel_eur_per_kg": F.lit(0.8), "time_eur_per_min": F.lit(10.0), "comfort_eur_per_point": F.lit(15.0), "wear_eur_per_point": F.lit(9.0)}
    return search.Plan(legs.scenario(weather), WATERS, SHIP, w, speeds, [1, 2])


def _graph_sql(lat: lattice.Lattice) -> str:
    """Edges whose points, a quarter of a mile apart, are all navigable; the shelf is deep enough everywhere."""
    return _edges_sql(lat) + f""", spots AS (SELECT *, greatest(1, ceil(sqrt(pow((q_lon - p_lon) * 60e0 * cos(radians(42.3e0)), 2) + pow((q_lat - p_lat) * 60e0, 2)) / 0.25e0)) AS n FROM edge),
  spot AS (SELECT stage, lane, next_lane, p_lat + (q_lat - p_lat) * i / n AS lat_deg, p_lon + (q_lon - p_lon) * i / n AS lon_deg FROM spots, unnest(range(1, CAST(n AS BIGINT) + 1)) u(i)),
  open AS (SELECT stage, lane, next_lane FROM spot GROUP BY ALL HAVING NOT bool_or({_land_sql()} OR {_box_sql()})),
  graph AS (SELECT edge.* FROM edge JOIN open USING (stage, lane, next_lane))"""


def _options_sql(speeds: list[float], engines: list[int]) -> str:
    return f"(SELECT s AS speed_kn, s * {units.KN_TO_MS}e0 AS stw_ms, CAST(n AS INTEGER) AS engines FROM unnest([{', '.join(f'{x}e0' for x in speeds)}]) a(s), unnest({engines}) b(n))"


def _cheapest_sql(lat: lattice.Lattice, scenario: str, speeds: list[float], engines: list[int], bucket_h: float = 1.0) -> str:
    """One layer after the other; a label for each lane and time bucket; ties go by previous lane, bucket, speed, engines."""
    sql = _graph_sql(lat) + """, l0 AS (SELECT 0 AS lane, 0 AS bucket, 0e0 AS cost, 0e0 AS t_h, 0e0 AS fuel, 0e0 AS discomfort, 0e0 AS worn, 0e0 AS worst, '0' AS lanes, '' AS runs)"""
    for i in range(len(lat.centres) - 1):
        step = f"(SELECT l.*, g.next_lane, g.p_lat, g.p_lon, g.q_lat, g.q_lon, o.speed_kn, o.stw_ms, o.engines FROM l{i} l JOIN graph g USING (lane), {_options_sql(speeds, engines)} o WHERE g.stage = {i})"
        sql += f""", s{i} AS (SELECT *, cost + 0.8e0 * fuel_kg + 10e0 * duration_h * 60e0 + 15e0 * comfort + 9e0 * wear AS total, CAST(floor((t_h + duration_h) / {bucket_h}e0) AS BIGINT) AS next_bucket
    FROM {legs_sql(step, scenario)} WHERE NOT slam AND NOT overload),
  l{i + 1} AS (SELECT next_lane AS lane, next_bucket AS bucket, total AS cost, t_h + duration_h AS t_h, fuel + fuel_kg AS fuel, discomfort + comfort AS discomfort, worn + wear AS worn,
    greatest(worst, max_hs) AS worst, lanes || ',' || next_lane AS lanes, runs || CASE WHEN runs = '' THEN '' ELSE ',' END || CAST(speed_kn AS INTEGER) || '/' || engines AS runs FROM s{i}
    QUALIFY row_number() OVER (PARTITION BY next_lane, next_bucket ORDER BY total, lane, bucket, speed_kn, engines) = 1)"""
    return sql


ROUTE = ["cost", "duration_h", "fuel_kg", "comfort", "wear", "max_hs"]
_ROUTE_SQL = """round(cost, 3) AS cost, round(t_h, 4) AS duration_h, round(fuel, 4) AS fuel_kg, round(discomfort, 4) AS comfort, round(worn, 4) AS wear, round(worst, 4) AS max_hs, lanes, runs"""


def _route(found: DataFrame) -> DataFrame:
    steps = F.slice("path", 2, F.size("path"))
    return found.withColumns({
        **{c: F.round(c, 3 if c == "cost" else 4) for c in ROUTE}, "lanes": F.array_join(F.transform("path", lambda p: p["lane"].cast("string")), ","),
        "runs": F.array_join(F.transform(steps, lambda p: F.concat_ws("/", p["speed_kn"].cast("int").cast("string"), p["engines"].cast("string"))), ",")}).drop("path")


@query("WITH " + _cheapest_sql(_LAT, "calm", [10.0, 12.0], [1, 2]) + f" SELECT {_ROUTE_SQL} FROM l5 WHERE lane = 0 ORDER BY cost, bucket LIMIT 1")
def layered_min_cost(spark, d):
    return _route(search.cheapest(spark, _LAT, _plan()))


def _arrivals_sql(lat: lattice.Lattice, scenario: str, speeds: list[float], engines: list[int], hours: float) -> str:
    sql = _graph_sql(lat) + ", l0 AS (SELECT 0 AS stage, 0 AS lane, 0e0 AS t_h)"
    for i in range(len(lat.centres) - 1):
        step = f"(SELECT l.lane, l.t_h, g.next_lane, g.p_lat, g.p_lon, g.q_lat, g.q_lon, o.stw_ms, o.engines FROM l{i} l JOIN graph g USING (lane), {_options_sql(speeds, engines)} o WHERE g.stage = {i})"
        sql += f""", l{i + 1} AS (SELECT {i + 1} AS stage, next_lane AS lane, min(t_h + duration_h) AS t_h FROM {legs_sql(step, scenario)} WHERE NOT slam AND NOT overload AND t_h + duration_h <= {hours}e0 GROUP BY next_lane)"""
    return sql


@query("WITH " + _arrivals_sql(_LAT, "mistral", [10.0, 12.0], [1, 2], 5.0) + " SELECT stage, lane FROM (" + " UNION ALL ".join(f"SELECT * FROM l{i}" for i in range(6)) + ") WHERE t_h <= 4e0")
def reachable_within(spark, d):
    return search.within(search.arrivals(spark, _LAT, _plan("mistral"), 5.0), 0.0, 4.0)


_WAY = lattice.corridor([(43.5 - 0.15 * i, 7.3 + 0.1 * i) for i in range(5)], [0, 1, 1, 1, 0], 5.0)


def _corridor_sql() -> str:
    runs = [f"SELECT 'west' AS route, 'W' AS side, 11e0 AS speed_kn, {n} AS engines, * FROM (WITH {_cheapest_sql(_WAY, 'calm', [11.0], [n], 1e9)} SELECT {_ROUTE_SQL} FROM l4 ORDER BY lane <> 0, cost LIMIT 1)" for n in (1, 2)]
    return " UNION ALL ".join(runs)


@query(_corridor_sql())
def corridor_dp(spark, d):
    return _route(search.corridor_routes(spark, {"west": (_WAY, "W")}, _plan(speeds=[11.0])))


_CAND = """cand AS (SELECT CAST(o_custkey AS BIGINT) AS request_id, o_orderkey AS candidate_id, CASE o_orderkey % 3 WHEN 0 THEN 'W' WHEN 1 THEN 'E' END AS side,
    10e0 + o_orderkey % 7 AS speed_kn, 8e0 + (o_orderkey * 13) % 17 AS duration_h, round(o_totalprice, 2) AS score_eur,
    CASE WHEN o_custkey % 4 = 0 THEN NULL ELSE 9e0 + o_custkey % 6 END AS latest_arrival_h FROM orders)"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    k, c = C("o_orderkey"), C("o_custkey")
    return P.table(spark, d, "orders").select(
        c.cast("long").alias("request_id"), k.alias("candidate_id"), F.when(k % 3 == 0, "W").when(k % 3 == 1, "E").alias("side"), (10.0 + k % 7).alias("speed_kn"),
        (8.0 + (k * 13) % 17).alias("duration_h"), F.round("o_totalprice", 2).alias("score_eur"), F.when(c % 4 != 0, 9.0 + c % 6).alias("latest_arrival_h"))


_POOL = _CAND + """, seen AS (SELECT *, latest_arrival_h IS NULL OR duration_h <= latest_arrival_h AS inn, row_number() OVER (PARTITION BY request_id ORDER BY duration_h, candidate_id) AS rn FROM cand),
  flag AS (SELECT *, NOT bool_or(inn) OVER (PARTITION BY request_id) AS missed_window FROM seen), pool AS (SELECT * FROM flag WHERE CASE WHEN missed_window THEN rn <= 4 ELSE inn END)"""


@query("WITH " + _POOL + " SELECT request_id, candidate_id, missed_window FROM pool")
def eta_window_pool(spark, d):
    return ranking.eta_pool(_candidates(spark, d)).select("request_id", "candidate_id", "missed_window")


@query("WITH " + _CAND + ", r AS (SELECT *, row_number() OVER (PARTITION BY request_id, speed_kn ORDER BY score_eur, candidate_id) AS n FROM cand) SELECT request_id, speed_kn, candidate_id FROM r WHERE n = 1")
def best_per_key(spark, d):
    return ranking.best_per_key(_candidates(spark, d), ["request_id", "speed_kn"], "score_eur", "candidate_id").select("request_id", "speed_kn", "candidate_id")


def _add_pick(n: int) -> str:
    """One more pick of every request that lacks one: the first that differs from all picks in side or by two knots."""
    return f"""add{n} AS (SELECT request_id, min(k) AS k FROM ordered r WHERE (SELECT count(*) FROM pick{n - 1} p WHERE p.request_id = r.request_id) < 3
    AND NOT EXISTS (SELECT 1 FROM pick{n - 1} p WHERE p.request_id = r.request_id AND p.side IS NOT DISTINCT FROM r.side AND abs(p.speed_kn - r.speed_kn) < 2e0) GROUP BY request_id),
  pick{n} AS (SELECT * FROM pick{n - 1} UNION ALL SELECT r.* FROM ordered r JOIN add{n} USING (request_id, k))"""


@query("WITH " + _POOL + """, ordered AS (SELECT request_id, candidate_id, side, speed_kn,
    row_number() OVER (PARTITION BY request_id ORDER BY CASE WHEN missed_window THEN duration_h ELSE score_eur END, candidate_id) AS k FROM pool),
  pick0 AS (SELECT * FROM ordered QUALIFY row_number() OVER (PARTITION BY request_id, side ORDER BY k) = 1),""" + _add_pick(1) + ", " + _add_pick(2) + """
  SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY k) AS INTEGER) AS place, candidate_id, side, speed_kn FROM pick2""")
def diverse_top3(spark, d):
    return ranking.diverse_picks(ranking.eta_pool(_candidates(spark, d)))


@query("WITH " + _CAND + """, s AS (SELECT request_id, min(duration_h) AS f, any_value(latest_arrival_h) AS l FROM cand GROUP BY request_id),
  gap AS (SELECT request_id, count(*) AS n FROM cand WHERE candidate_id % 11 = 0 GROUP BY request_id)
  SELECT request_id, 'eta_window_infeasible' AS code, f AS detail FROM s WHERE f > l
  UNION ALL SELECT g.request_id, 'weather_data_gap', CAST(n AS DOUBLE) FROM gap g JOIN s USING (request_id) WHERE f > l""")
def plan_diagnostics(spark, d):
    c = _candidates(spark, d)
    return ranking.diagnostics(c, c.where("candidate_id % 11 = 0").groupBy("request_id").agg(F.count("*").alias("n")))


_TRACK = P.TELEMETRY + """, pts AS (SELECT vessel_id, event_id, t_s, lat_deg, lon_deg, lag(lat_deg) OVER w AS pla, lag(lon_deg) OVER w AS plo FROM tele WINDOW w AS (PARTITION BY vessel_id ORDER BY event_id)),
  legs AS (SELECT *, sqrt(pow((lon_deg - plo) * 60e0 * cos(radians(42.3e0)), 2) + pow((lat_deg - pla) * 60e0, 2)) AS nm,
    """ + mod360("degrees(atan2((lon_deg - plo) * cos(radians(42.3e0)), lat_deg - pla))") + " AS course FROM pts)"


@query("WITH " + _TRACK + " SELECT vessel_id, round(coalesce(sum(nm), 0e0), 3) AS distance_nm, count(*) AS n_points FROM legs GROUP BY vessel_id")
def track_distance(spark, d):
    return tracks.track_distance(P.telemetry(spark, d), "vessel_id", "event_id").select("vessel_id", F.round("distance_nm", 3).alias("distance_nm"), "n_points")


@query("WITH " + _TRACK + ", nx AS (SELECT *, lead(course) OVER (PARTITION BY vessel_id ORDER BY event_id) AS nc FROM legs), tn AS (SELECT *, " + mod360("nc - course + 540e0") + """ - 180e0 AS turn FROM nx)
  SELECT vessel_id, event_id, round(turn, 4) AS turn_deg FROM tn WHERE abs(turn) > 8e0""")
def alteration_list(spark, d):
    return tracks.alterations(P.telemetry(spark, d), "vessel_id", "event_id").select("vessel_id", "event_id", r4("turn_deg").alias("turn_deg"))


@query("WITH " + P.TELEMETRY + """ SELECT vessel_id, round(min(lon_deg) - 0.25e0, 4) AS lon_min, round(min(lat_deg) - 0.25e0, 4) AS lat_min, round(max(lon_deg) + 0.25e0, 4) AS lon_max,
  round(max(lat_deg) + 0.25e0, 4) AS lat_max FROM tele GROUP BY vessel_id""")
def covering_bbox(spark, d):
    box = tracks.covering_box(P.telemetry(spark, d).withColumn("t_epoch_s", C("t_s")), "vessel_id")
    return box.select("vessel_id", *[r4(c).alias(c) for c in ("lon_min", "lat_min", "lon_max", "lat_max")])


@query("WITH " + P.TELEMETRY + """, m AS (SELECT vessel_id, avg(CASE WHEN lat_deg BETWEEN 41.3e0 AND 43e0 THEN lon_deg END) AS lon FROM tele GROUP BY vessel_id)
  SELECT vessel_id, CASE WHEN lon < 9e0 THEN 'W' WHEN lon IS NOT NULL THEN 'E' END AS side FROM m""")
def route_signature(spark, d):
    return tracks.signature(P.telemetry(spark, d), "vessel_id")


@query("WITH " + P.TELEMETRY + """, h AS (SELECT vessel_id, active_engines, sum(CAST(event_id % 100 AS DOUBLE)) AS hrs FROM tele GROUP BY vessel_id, active_engines),
  r AS (SELECT *, row_number() OVER (PARTITION BY vessel_id ORDER BY hrs DESC, active_engines) AS n FROM h) SELECT vessel_id, active_engines AS engines FROM r WHERE n = 1""")
def majority_engine(spark, d):
    rows = P.telemetry(spark, d).select("vessel_id", C("active_engines").alias("engines"), (C("event_id") % 100).cast("double").alias("duration_h"))
    return search.main_engines(rows, ["vessel_id"])


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, (l_orderkey * 7919 + l_linenumber * 104729) % 536870912 AS id FROM lineitem),
  p AS (SELECT *, id // 65536 % 256 AS form, id // 256 % 256 AS spec, id // 16777216 % 2 AS page FROM x)
  SELECT l_orderkey, l_linenumber, CAST(id // 67108864 % 8 AS INTEGER) AS priority, CAST(page * 65536 + form * 256 + CASE WHEN form >= 240 THEN spec ELSE 0 END AS INTEGER) AS pgn,
  CAST(id % 256 AS INTEGER) AS source_address, CAST(CASE WHEN form < 240 THEN spec END AS INTEGER) AS destination_address FROM p""")
def can_id_decompose(spark, d):
    k = (C("l_orderkey") * 7919 + C("l_linenumber") * 104729) % 536870912
    return P.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *[v.alias(n) for n, v in n2k.split_id(k).items()])


@query("""SELECT c_custkey AS pos, CASE WHEN rn = 1 THEN slug ELSE slug || '_' || pos2 END AS slug FROM (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS pos2, 'port_' || lower(c_mktsegment) AS slug,
  row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn FROM customer) t""")
def port_slug_dedupe(spark, d):
    k = C("c_custkey")
    ports = P.table(spark, d, "customer").select(
        k.alias("pos"), F.concat(F.lit(" Port "), "c_mktsegment", F.lit(" ")).alias("port_name"), k.alias("port_number"),
        F.lit("43°33'00\"N").alias("latitude"), F.lit("7°10'12\"E").alias("longitude"))
    slugs = spatial.ports_within(ports, (7.0, 43.0, 8.0, 44.0))
    number = F.coalesce(F.nullif(F.regexp_extract("slug", r"_(\d+)$", 1), F.lit("")).cast("long"), F.lit(None))
    first = ports.groupBy(F.concat(F.lit("port_"), F.lower(F.substring_index(F.trim("port_name"), " ", -1))).alias("slug")).agg(F.min("pos").alias("first"))
    return slugs.join(first, "slug", "left").select(F.coalesce(number, "first").alias("pos"), "slug")


@query("WITH " + P.TELEMETRY + """, c AS (SELECT event_id % 5 AS grp, CASE WHEN event_id % 6 = 0 THEN 'NaN'::DOUBLE ELSE hs_m END AS a, hs_m + 0.1e0 AS b,
    abs(""" + mod360("heading_deg - wave_from_deg + 180e0") + """ - 180e0) AS dd FROM tele)
  SELECT grp, count(*) AS n, round(avg(abs(a - b)), 4) AS mean_hs_diff_m, round(avg(dd), 4) AS mean_dir_diff_deg,
  CASE WHEN avg(dd) >= 120e0 THEN 'flipped' WHEN avg(dd) <= 60e0 THEN 'consistent' ELSE 'inconclusive' END AS verdict FROM c WHERE NOT isnan(a) GROUP BY grp""")
def model_consistency_summary(spark, d):
    t = P.telemetry(spark, d)
    one = t.select("event_id", (C("event_id") % 5).alias("grp"), F.when(C("event_id") % 6 == 0, float("nan")).otherwise(C("hs_m")).alias("a"), C("heading_deg").alias("da"))
    two = t.select("event_id", (C("hs_m") + 0.1).alias("b"), C("wave_from_deg").alias("db"))
    both = one.join(two, "event_id").where(~F.isnan("a") & ~F.isnan("b")).withColumn("dd", units.angle_between(C("da"), C("db")))
    mean = F.avg("dd")
    return both.groupBy("grp").agg(
        F.count("*").alias("n"), r4(F.avg(F.abs(C("a") - C("b")))).alias("mean_hs_diff_m"), r4(mean).alias("mean_dir_diff_deg"),
        F.when(mean >= 120.0, "flipped").when(mean <= 60.0, "consistent").otherwise("inconclusive").alias("verdict"))


@query("""WITH a AS (SELECT event_id, ts - INTERVAL 5 HOUR AS k FROM events) SELECT event_id, strftime(date_trunc('day', k) + to_hours(CAST(6 * floor(hour(k) / 6) AS INTEGER)), '%Y%m%d%H') AS cycle FROM a""")
def cycle_selection(spark, d):
    cycle = clock.latest_cycle(C("ts").cast("timestamp"))
    day, hour = clock.cycle_text(cycle)
    return P.table(spark, d, "events").select("event_id", F.concat(day, hour).alias("cycle"))


_KEYED = """keyed AS (SELECT CAST(epoch_us(ts) // 600000000 * 600 AS DOUBLE) AS timestamp, CAST(event_id % 3 AS INTEGER) AS source_pgn, event_id,
    CASE WHEN event_id % 2 = 0 THEN 'full_integration' ELSE 'nmea_manual_fuel' END AS sensor_tier, value FROM events)"""


def _keyed(spark: SparkSession, d: str) -> DataFrame:
    e = C("event_id")
    t = F.floor(F.unix_micros(C("ts").cast("timestamp")) / 600000000) * 600
    return P.table(spark, d, "events").select(
        t.cast("double").alias("timestamp"), (e % 3).cast("int").alias("source_pgn"), "event_id",
        F.when(e % 2 == 0, "full_integration").otherwise("nmea_manual_fuel").alias("sensor_tier"), "value")


@query("WITH " + _KEYED + ", r AS (SELECT *, row_number() OVER (PARTITION BY timestamp, source_pgn ORDER BY event_id DESC) AS n FROM keyed) SELECT timestamp, source_pgn, event_id, sensor_tier FROM r WHERE n = 1")
def telemetry_upsert_latest(spark, d):
    return store.keep_last(_keyed(spark, d), ["timestamp", "source_pgn"], C("event_id")).select("timestamp", "source_pgn", "event_id", "sensor_tier")


@query("WITH " + _KEYED + " SELECT source_pgn, count(*) AS sample_count, max(timestamp) AS last_sample_at, 2e9 - max(timestamp) AS gap_s FROM keyed GROUP BY source_pgn")
def telemetry_status(spark, d):
    return store.status(_keyed(spark, d), F.lit(2e9), ["source_pgn"]).select("source_pgn", "sample_count", "last_sample_at", "gap_s")


@query("WITH " + RUNS + """, g AS (SELECT vessel_id, row_number() OVER (ORDER BY md5('7|' || vessel_id), vessel_id) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT vessel_id FROM seg))
  SELECT k <= floor(n * 0.2e0) AS is_holdout, count(DISTINCT s.vessel_id) AS n_groups, count(*) AS n_segments FROM seg s JOIN g USING (vessel_id) GROUP BY 1""")
def holdout_group_split(spark, d):
    held = fitting.holdout_groups(_segments(spark, d), "vessel_id")
    return held.groupBy("is_holdout").agg(F.count_distinct("vessel_id").alias("n_groups"), F.count("*").alias("n_segments"))


@query()
def fit_vessels(spark, d):
    s = _segments(spark, d).withColumn("mean_stw_ms", C("mean_stw_ms") / 2.0)
    calmest = F.min("mean_hs_m").over(Window.partitionBy("vessel_id"))
    return fitting.fit_vessels(s.withColumn("calmest", calmest).where(C("calmest") <= fitting.NEAR_CALM_M))


def _le(start: int, size: int) -> str:
    """Little-endian bytes of the hexadecimal text h as a number."""
    return "CAST('0x' || " + " || ".join(f"substr(h, {2 * (start + size - i) - 1}, 2)" for i in range(size)) + " AS BIGINT)"


def _signed_sql(start: int, size: int) -> str:
    x, half = _le(start, size), 1 << 8 * size - 1
    return f"(CASE WHEN {x} = {half - 1} THEN NULL WHEN {x} >= {half} THEN {x} - {2 * half} ELSE {x} END)"


def _unsigned_sql(start: int, size: int) -> str:
    return f"nullif({_le(start, size)}, {(1 << 8 * size) - 1})"


@query(f"""WITH f AS (SELECT CAST(event_id AS DOUBLE) AS timestamp, event_id % 4 AS m, substr(md5(CAST(event_id AS VARCHAR)), 1, 16) AS h FROM events)
  SELECT timestamp, CAST([129025, 129026, 127488][m + 1] AS INTEGER) AS source_pgn, 'full_integration' AS sensor_tier,
    CASE WHEN m = 0 THEN round({_signed_sql(0, 4)} * 1e-7, 7) END AS lat_deg, CASE WHEN m = 0 THEN round({_signed_sql(4, 4)} * 1e-7, 7) END AS lon_deg,
    CASE WHEN m = 1 THEN round({_unsigned_sql(4, 2)} * 0.01e0 / {units.KN_TO_MS}e0, 6) END AS sog_kn, CASE WHEN m = 1 THEN round(degrees({_unsigned_sql(2, 2)} * 1e-4), 6) END AS cog_deg,
    CAST(NULL AS DOUBLE) AS engine_fuel_rate_l_per_h, CASE WHEN m = 2 THEN {_unsigned_sql(1, 2)} * 0.25e0 END AS engine_rpm FROM f WHERE m < 3""")
def capture_decode(spark, d):
    e = C("event_id")
    can = n2k.join_id(F.lit(2), F.element_at(F.array(F.lit(129025), F.lit(129026), F.lit(127488), F.lit(130306)), (e % 4 + 1).cast("int")), F.lit(16))
    line = F.concat(F.lit("12:00:00.000 R "), F.lpad(F.hex(can), 8, "0"), F.lit(" "), F.regexp_replace(F.substring(F.md5(e.cast("string")), 1, 16), "(..)", "$1 "))
    frames = capture.parse_lines(P.table(spark, d, "events").select(e.cast("double").alias("timestamp"), line.alias("value")))
    rounded = {"lat_deg": 7, "lon_deg": 7, "sog_kn": 6, "cog_deg": 6}
    return capture.samples(frames, "full_integration").withColumns({c: F.round(c, n) for c, n in rounded.items()})


_KN = f"(x * {units.KN_TO_MS}e0)"


@query(f"""WITH RECURSIVE b(engines, i, lo, hi) AS (SELECT CAST(n AS INTEGER), 0, 0e0, 40e0 FROM range(1, 3) t(n)
  UNION ALL SELECT engines, i + 1, CASE WHEN over THEN lo ELSE x END, CASE WHEN over THEN x ELSE hi END FROM (
    SELECT *, (5e0 * {_KN} * {_KN} + {_KN} * {_KN} * {_KN}) * (1e0 + 1.5e0 * pow({_KN} / sqrt(9.81e0 * 45e0) / 0.4e0, 4e0)) / engines / 1350e0 > 0.85e0 AS over
    FROM (SELECT *, (lo + hi) / 2e0 AS x FROM b WHERE i < 30))),
  top AS (SELECT engines, lo AS c FROM b WHERE i = 30)
  SELECT engines, round(c, 6) AS ceiling_kn, round(least(c, 6e0) + k, 6) AS speed_kn FROM top, unnest(range(0, CAST(floor(c - least(c, 6e0)) AS BIGINT) + 1)) u(k)""")
def speed_envelope(spark, d):
    n = spark.range(1, 3).select(C("id").cast("int").alias("engines"))
    top = n.withColumn("ceiling_kn", twin.fastest_continuous(C("engines"), SHIP))
    speeds = top.withColumn("s", F.explode(twin.speed_grid(C("ceiling_kn"))))
    return speeds.select("engines", F.round("ceiling_kn", 6).alias("ceiling_kn"), F.round("s", 6).alias("speed_kn"))


@query("WITH " + P.TELEMETRY + " SELECT event_id, round((t_s - min(t_s) OVER (PARTITION BY vessel_id)) / 3600e0, 4) + 0e0 AS t_h FROM tele")
def relative_hours(spark, d):
    return segments.relative_hours(P.telemetry(spark, d), ["vessel_id"]).select("event_id", r4("t_h").alias("t_h"))


@query("WITH " + RUNS + " SELECT vessel_id, active_engines, count(*) AS n_segments FROM seg GROUP BY ALL")
def engine_configurations(spark, d):
    return fitting.engine_configurations(_segments(spark, d), ["vessel_id"])


@query("WITH " + P.TELEMETRY + " SELECT event_id FROM tele WHERE lat_deg BETWEEN 41e0 - 0.15e0 AND 41e0 + 5e0 * 0.3e0 + 0.15e0 AND lon_deg BETWEEN 7e0 - 0.15e0 AND 7e0 + 6e0 * 0.3e0 + 0.15e0")
def in_bounds(spark, d):
    axes = interp.Axes((41.0, 0.3, 6), (7.0, 0.3, 7))
    return P.telemetry(spark, d).where(geography.in_bounds(C("lat_deg"), C("lon_deg"), axes)).select("event_id")


def _odd(points: str, source: str, by: str, lat: str = "lat_deg", lon: str = "lon_deg") -> str:
    """SQL: ``by`` of the rows of ``points`` that a ring of ``source`` holds, once for each ring."""
    return f"""(SELECT {by}, ring FROM {points}, {source} WHERE (yi > {lat}) <> (yj > {lat}) AND {lon} < (xj - xi) * ({lat} - yi) / (yj - yi) + xi GROUP BY ALL HAVING count(*) % 2 = 1)"""


@query("WITH " + P.TELEMETRY + ", " + P.VERTICES + " SELECT event_id, ring FROM " + _odd("tele", "ring_edge", "event_id"))
def rings_by_strips(spark, d):
    """Whole telemetry against rings whose number grows with the customers."""
    return spatial.rings_of_places(P.telemetry(spark, d), P.rings(spark, d), "event_id")


_CLIP = (7.4, 41.3, 9.2, 42.9)


def _clip_sql(n: int, axis: str, limit: float, keep: str) -> str:
    """One pass over v{n}(ring, k, lat, lon): the kept points, and one wherever a ring crosses the limit."""
    other = "lat" if axis == "lon" else "lon"
    made = {axis: f"{limit}e0", other: f"p_{other} + ({other} - p_{other}) * (({limit}e0 - p_{axis}) / ({axis} - p_{axis}))"}
    return f""", b{n} AS (SELECT *, coalesce(lag(lat) OVER w, last_value(lat) OVER f) AS p_lat, coalesce(lag(lon) OVER w, last_value(lon) OVER f) AS p_lon FROM v{n}
    WINDOW w AS (PARTITION BY ring ORDER BY k), f AS (PARTITION BY ring ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
  v{n + 1} AS (SELECT ring, 2 * k AS k, {made["lat"]} AS lat, {made["lon"]} AS lon FROM b{n} WHERE ({axis} {keep} {limit}e0) <> (p_{axis} {keep} {limit}e0)
    UNION ALL SELECT ring, 2 * k + 1, lat, lon FROM b{n} WHERE {axis} {keep} {limit}e0)"""


@query("WITH " + P.VERTICES + ", v0 AS (SELECT ring, k, lat, lon FROM vertex)" + _clip_sql(0, "lon", _CLIP[0], ">=") + _clip_sql(1, "lon", _CLIP[2], "<=")
       + _clip_sql(2, "lat", _CLIP[1], ">=") + _clip_sql(3, "lat", _CLIP[3], "<=") + """,
  e AS (SELECT *, coalesce(lag(lat) OVER w, last_value(lat) OVER f) AS p_lat, coalesce(lag(lon) OVER w, last_value(lon) OVER f) AS p_lon FROM v4
    WINDOW w AS (PARTITION BY ring ORDER BY k), f AS (PARTITION BY ring ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
  SELECT ring, CAST(count(*) AS INTEGER) AS n_points, round(abs(sum(p_lon * lat - lon * p_lat)) / 2e0, 6) AS area FROM e WHERE ring IN (SELECT ring FROM ring_edge)
  GROUP BY ring HAVING abs(sum(p_lon * lat - lon * p_lat)) > 0e0""")
def clipped_rings(spark, d):
    kept = clipping.clip_rings(P.rings(spark, d), _CLIP)
    return kept.select("ring", F.size("points").alias("n_points"), F.round(clipping.ring_area(C("points")), 6).alias("area"))


def _chart(spark: SparkSession, d: str) -> geography.Chart:
    """Land from the customers, each shape once, the boxes, and a depth grid without a land raster."""
    land = clipping.ring_edges(clipping.shapes(P.rings(spark, d)).withColumn("kind", F.lit("land")), "kind")
    return geography.Chart.of(land, P.depths(spark), interp.Axes(P.DEPTH_LAT, P.DEPTH_LON), False, nogo_boxes=P.BOXES)


def _depth_sql(lat: str, lon: str, source: str, by: str) -> str:
    """SQL: ``by`` and depth_m, interpolated between the grid's lines, of the rows of ``source``."""
    fy, fx = (f"(({x} - {first}e0) / {step}e0)" for x, (first, step, _) in ((lat, P.DEPTH_LAT), (lon, P.DEPTH_LON)))
    return f"""(SELECT {by}, greatest(0e0, -sum(elevation * (1e0 - abs({fy} - iy)) * (1e0 - abs({fx} - ix)))) AS depth_m
    FROM {source} JOIN depth ON iy BETWEEN CAST(floor({fy}) AS BIGINT) AND CAST(floor({fy}) AS BIGINT) + 1 AND ix BETWEEN CAST(floor({fx}) AS BIGINT) AND CAST(floor({fx}) AS BIGINT) + 1 GROUP BY {by})"""


@query("WITH " + P.PLACES + ", " + P.VERTICES + ", " + P.DEPTHS + f""", land AS (SELECT DISTINCT place_id FROM {_odd("places", "ring_edge", "place_id")}),
  d AS {_depth_sql("lat_deg", "lon_deg", "places", "place_id")}
  SELECT place_id, l.place_id IS NOT NULL AS is_land, {_box_sql()} AS is_nogo, l.place_id IS NULL AND NOT {_box_sql()} AS is_navigable, round(depth_m, 4) + 0e0 AS depth_m
  FROM places JOIN d USING (place_id) LEFT JOIN land l USING (place_id)""")
def charted_places(spark, d):
    rows = P.places(spark, d)
    found = rows.join(_chart(spark, d).features(rows), ["lat_deg", "lon_deg"])
    return found.select("place_id", "is_land", "is_nogo", "is_navigable", r4("depth_m").alias("depth_m"))


@query("WITH " + _LEG + ", " + P.VERTICES + ", " + P.DEPTHS + f""", id AS (SELECT *, row_number() OVER () AS i FROM spot), land AS (SELECT DISTINCT i FROM {_odd("id", "ring_edge", "i", "lat", "lon")}),
  d AS {_depth_sql("lat", "lon", "id", "i")}
  SELECT place_id, bool_and(l.i IS NULL AND NOT {_box_sql("lat", "lon")}) AS navigable, bool_and(depth_m >= 5e0) AS depth_ok, count(*) AS n_points
  FROM id JOIN d USING (i) LEFT JOIN land l USING (i) GROUP BY place_id""")
def charted_legs(spark, d):
    """Legs tested against waters that are tables: every leg of the supplier places."""
    k = C("place_id")
    rows = P.places(spark, d).select("place_id", C("lat_deg").alias("p_lat"), C("lon_deg").alias("p_lon"),
                                     (C("lat_deg") + (k % 7 - 3) * 0.02).alias("q_lat"), (C("lon_deg") + (k % 5 - 2) * 0.03).alias("q_lon"))
    nm = units.distance_nm(C("p_lat"), C("p_lon"), C("q_lat"), C("q_lon"), 42.3)
    known = legs.edge_limits(rows, _chart(spark, d), 5.0)
    return rows.join(known, ["p_lat", "p_lon", "q_lat", "q_lon"]).select(
        "place_id", "navigable", "depth_ok", F.greatest(F.lit(1), F.ceil(nm / 0.25)).cast("long").alias("n_points"))


_HOME = "41.13e0", "9.55e0"


@query("WITH " + P.TELEMETRY + f""" SELECT event_id, round(sqrt(pow(({_HOME[1]} - lon_deg) * 60e0 * cos(radians(42.3e0)), 2) + pow(({_HOME[0]} - lat_deg) * 60e0, 2)), 4) AS nm,
    round({mod360(f"degrees(atan2(({_HOME[1]} - lon_deg) * cos(radians(42.3e0)), {_HOME[0]} - lat_deg))")}, 4) AS bearing, round({ENC}, 4) AS encounter,
    round({CALM} + {ADDED}, 4) AS power_kw, round(stw_ms / {units.KN_TO_MS}e0, 6) AS stw_kn, CAST(((event_id * 7919) % 536870912) // 67108864 % 8 AS INTEGER) AS priority FROM tele""")
def sql_functions(spark, d):
    """The scalar functions called from SQL text over the telemetry."""
    sql.register(spark)
    P.telemetry(spark, d).createOrReplaceTempView("fairlead_telemetry")
    return spark.sql("""
      SELECT event_id, round(distance_nm(lat_deg, lon_deg, 41.13D, 9.55D, 42.3D), 4) AS nm, round(bearing_deg(lat_deg, lon_deg, 41.13D, 9.55D, 42.3D), 4) AS bearing,
        round(encounter_angle(heading_deg, wave_from_deg), 4) AS encounter, round(total_power_kw(stw_ms / 2, hs_m, period_peak_s, wave_from_deg, heading_deg), 4) AS power_kw,
        round(ms_to_kn(stw_ms), 6) AS stw_kn, can_priority((event_id * 7919) % 536870912) AS priority
      FROM fairlead_telemetry""")


#: Requests of the fleet query: stages 6 nm apart, a lane 3 nm to either side, turns of a lane; at most so many stages.
_ALONG, _ACROSS, _SIDE, _STAGES = 6.0, 3.0, 1, 4
_REQ = P.PLACES + """, req AS (SELECT *, sqrt(pow((d_lon - o_lon) * 60e0 * cos(radians(42.3e0)), 2) + pow((d_lat - o_lat) * 60e0, 2)) AS total FROM (SELECT place_id AS request_id, lat_deg AS o_lat, lon_deg AS o_lon,
    lat_deg + (place_id % 7 - 3) * 0.08e0 AS d_lat, lon_deg + (place_id % 5 - 2) * 0.1e0 AS d_lon FROM places))"""


def _fleet_sql(scenario: str, speeds: list[float], engines: list[int]) -> str:
    """Layer after layer for all requests; a label for each request, lane and hour; ties go by previous lane, bucket, speed, engines."""
    side = lambda stage: f"(CASE WHEN {stage} = 0 OR {stage} = last THEN 0 ELSE {_SIDE} END)"
    at = lambda stage, lane: (
        f"o_lat + (d_lat - o_lat) * ({stage}) / last + dx / size * ({lane} * {_ACROSS}e0) / 60e0",
        f"o_lon + (d_lon - o_lon) * ({stage}) / last - dy / size * ({lane} * {_ACROSS}e0) / (60e0 * cos(radians(42.3e0)))")
    (p_lat, p_lon), (q_lat, q_lon) = at("stage", "lane"), at("stage + 1", "next_lane")
    sql = _REQ + f""", way AS (SELECT *, greatest(1, CAST(round(total / {_ALONG}e0) AS INTEGER)) AS last, (d_lon - o_lon) * cos(radians(42.3e0)) AS dx, d_lat - o_lat AS dy,
    sqrt(pow((d_lon - o_lon) * cos(radians(42.3e0)), 2) + pow(d_lat - o_lat, 2)) AS size FROM req WHERE total > 0e0),
  edge AS (SELECT request_id, last, stage, lane, next_lane, {p_lat} AS p_lat, {p_lon} AS p_lon, {q_lat} AS q_lat, {q_lon} AS q_lon
    FROM way, unnest(range(last)) a(stage), unnest(range(-{_SIDE}, {_SIDE + 1})) b(lane), unnest(range(-{_SIDE}, {_SIDE + 1})) c(next_lane)
    WHERE abs(lane) <= {side("stage")} AND abs(next_lane) <= {side("(stage + 1)")} AND abs(lane - next_lane) <= 1),
  spots AS (SELECT *, greatest(1, ceil(sqrt(pow((q_lon - p_lon) * 60e0 * cos(radians(42.3e0)), 2) + pow((q_lat - p_lat) * 60e0, 2)) / 0.25e0)) AS n FROM edge),
  spot AS (SELECT request_id, stage, lane, next_lane, p_lat + (q_lat - p_lat) * (i / n) AS lat_deg, p_lon + (q_lon - p_lon) * (i / n) AS lon_deg FROM spots, unnest(range(1, CAST(n AS BIGINT) + 1)) u(i)),
  open AS (SELECT request_id, stage, lane, next_lane FROM spot GROUP BY ALL HAVING NOT bool_or({_land_sql()} OR {_box_sql()})),
  graph AS (SELECT edge.* FROM edge JOIN open USING (request_id, stage, lane, next_lane)),
  l0 AS (SELECT DISTINCT request_id, 0 AS lane, 0 AS bucket, 0e0 AS cost, 0e0 AS t_h, 0e0 AS fuel, 0e0 AS discomfort, 0e0 AS worn, 0e0 AS worst, '0' AS lanes, '' AS runs, 99 AS last FROM graph WHERE stage = 0)"""
    for i in range(_STAGES):
        step = f"(SELECT l.* EXCLUDE (last), g.last, g.next_lane, g.p_lat, g.p_lon, g.q_lat, g.q_lon, o.speed_kn, o.stw_ms, o.engines FROM l{i} l JOIN graph g USING (request_id, lane), {_options_sql(speeds, engines)} o WHERE g.stage = {i} AND l.last > {i})"
        sql += f""", s{i} AS (SELECT *, cost + 0.8e0 * fuel_kg + 10e0 * duration_h * 60e0 + 15e0 * comfort + 9e0 * wear AS total, CAST(floor(t_h + duration_h) AS BIGINT) AS next_bucket
    FROM {legs_sql(step, scenario)} WHERE NOT slam AND NOT overload),
  l{i + 1} AS (SELECT request_id, next_lane AS lane, next_bucket AS bucket, total AS cost, t_h + duration_h AS t_h, fuel + fuel_kg AS fuel, discomfort + comfort AS discomfort, worn + wear AS worn,
    greatest(worst, max_hs) AS worst, lanes || ',' || next_lane AS lanes, runs || CASE WHEN runs = '' THEN '' ELSE ',' END || CAST(speed_kn AS INTEGER) || '/' || engines AS runs, last FROM s{i}
    QUALIFY row_number() OVER (PARTITION BY request_id, next_lane, next_bucket ORDER BY total, lane, bucket, speed_kn, engines) = 1)"""
    ends = " UNION ALL ".join(f"SELECT * FROM l{i} WHERE last = {i} AND lane = 0" for i in range(1, _STAGES + 1))
    return sql + f", done AS ({ends}) SELECT request_id, {_ROUTE_SQL} FROM done QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY cost, bucket) = 1"


def _requests(spark: SparkSession, d: str) -> DataFrame:
    k = C("place_id")
    return P.places(spark, d).select(
        k.alias("request_id"), C("lat_deg").alias("o_lat"), C("lon_deg").alias("o_lon"), (C("lat_deg") + (k % 7 - 3) * 0.08).alias("d_lat"),
        (C("lon_deg") + (k % 5 - 2) * 0.1).alias("d_lon"))


@query("WITH " + _fleet_sql("mistral", [10.0, 12.0], [1, 2]))
def fleet_min_cost(spark, d):
    """The cheapest route of a request from every supplier place, all at once and with bounds."""
    plan = _plan("mistral")
    edges = fleet.open_edges(fleet.graph(_requests(spark, d), _ALONG, _ACROSS, _SIDE, _ACROSS, 42.3), plan)
    return _route(fleet.bounded_routes(edges, plan))


@query("WITH " + _fleet_sql("mistral", [10.0], [1]).partition(",\n  spots AS")[0] + " SELECT request_id, stage, lane, next_lane, round(q_lat, 6) AS q_lat, round(q_lon, 6) AS q_lon FROM edge")
def fleet_graph(spark, d):
    rows = fleet.graph(_requests(spark, d), _ALONG, _ACROSS, _SIDE, _ACROSS, 42.3)
    return rows.select("request_id", *[C(c).cast("long").alias(c) for c in ("stage", "lane", "next_lane")], F.round("q_lat", 6).alias("q_lat"), F.round("q_lon", 6).alias("q_lon"))
