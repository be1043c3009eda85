"""The scalar functions as SQL functions, for queries written as text (section 2.13).

Each is made from its column expression: a temporary SQL function whose body is the expression's own text, so there is one
definition of each.  SQL functions are inlined when a query is analysed, and cost what the expressions cost.  Functions over arrays
with lambdas (fuel over engines, the fastest continuous speed, model cycles) have no text that can be parsed again and
stay with the column form.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from fairlead.functions import clock, geo, grid, mission, n2k, twin, units
from fairlead.sources.specs import Vessel

#: Name: parameters with their types, and the function of their columns (and of a vessel where the first word of the name is ship).
Build = Callable[..., Column]
FUNCTIONS: dict[str, tuple[str, Build]] = {
    "kn_to_ms": ("x double", units.kn_to_ms), "ms_to_kn": ("x double", units.ms_to_kn), "nm_to_m": ("x double", units.nm_to_m), "m_to_nm": ("x double", units.m_to_nm),
    "wrap_longitude": ("x double", units.wrap_longitude), "wrap_bearing": ("x double", units.wrap_bearing),
    "component_u": ("speed double, from_deg double", lambda s, d: units.components(s, d)[0]), "component_v": ("speed double, from_deg double", lambda s, d: units.components(s, d)[1]),
    "speed_of": ("u double, v double", lambda u, v: units.speed_and_origin(u, v)[0]), "origin_of": ("u double, v double", lambda u, v: units.speed_and_origin(u, v)[1]),
    "distance_nm": ("lat1 double, lon1 double, lat2 double, lon2 double, ref_lat double", units.distance_nm),
    "bearing_deg": ("lat1 double, lon1 double, lat2 double, lon2 double, ref_lat double", units.bearing), "between_at": ("a double, b double, share double", units.between),
    "ground_speed_ms": ("stw double, track_deg double, u double, v double", lambda *x: units.current_triangle(*x)["ground_speed"]),
    "course_to_steer_deg": ("stw double, track_deg double, u double, v double", lambda *x: units.current_triangle(*x)["course_to_steer"]),
    "current_exceeds": ("stw double, track_deg double, u double, v double", lambda *x: units.current_triangle(*x)["exceeded"]),
    "angle_between": ("a double, b double", units.angle_between), "signed_turn": ("before double, after double", units.signed_turn),
    "coming_from": ("direction double, is_to boolean", units.coming_from), "null_if_nan": ("x double", units.null_if_nan),
    "encounter_angle": ("heading double, wave_from double", twin.encounter_angle), "period_response": ("peak double, reference double", twin.period_response),
    "grid_fraction": ("value double, first double, step double, count int", grid.fraction), "nearest_index": ("fraction double, count int", grid.nearest_index),
    "parse_dms": ("text string", geo.parse_dms), "local_to_epoch": ("text string, zone string", clock.local_to_epoch), "utc_to_epoch": ("text string", clock.utc_to_epoch),
    "quantised_hour": ("h double", clock.quantised_hour),
    "noise_multiplier": ("source string, over_ground boolean", mission.noise_multiplier), "join_can_id": ("priority int, pgn int, source int", n2k.join_id),
    **{f"can_{k}": ("can_id long", lambda c, k=k: n2k.split_id(c)[k]) for k in ("priority", "pgn", "source_address", "destination_address")},
}
SHIP_FUNCTIONS: dict[str, tuple[str, Build]] = {
    "calm_power_kw": ("v double", twin.calm_power), "added_power_kw": ("v double, hs double, peak double, encounter double", twin.added_power),
    "total_power_kw": ("v double, hs double, peak double, wave_from double, heading double", twin.total_power),
    "motion_index": ("v double, hs double, peak double, wave_from double, heading double", twin.motion_index),
    "wear_rate": ("v double, hs double, wave_from double, heading double, load double, engines int", lambda *x: twin.wear(*x)["rate"]),
}


def expression(spark: SparkSession, parameters: str, build: Build) -> tuple[str, str]:
    """The text and the type of a column expression over ``parameters``."""
    names = [p.split()[0] for p in parameters.split(", ")]
    made = spark.createDataFrame([], parameters).select(build(*[F.col(n) for n in names]).alias("out"))
    return made._jdf.queryExecution().analyzed().expressions().head().child().sql(), made.schema["out"].dataType.simpleString()


def register(spark: SparkSession, ship: Vessel | None = None, prefix: str = "") -> list[str]:
    """Create all functions in the session, those of a vessel for ``ship`` (the default vessel); their names."""
    ship = ship or Vessel.of()
    every = FUNCTIONS | {k: (p, lambda *x, f=f: f(*x, ship)) for k, (p, f) in SHIP_FUNCTIONS.items()}
    for name, (parameters, build) in every.items():
        body, kind = expression(spark, parameters, build)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")
    return [prefix + n for n in every]
