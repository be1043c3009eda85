"""Legs between two points: weather, duration, cost and hard limits for tables of edges."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairlead.functions import twin
from fairlead.functions.fields import synthetic_weather
from fairlead.functions.units import between, bearing, current_triangle, distance_nm, kn_to_ms, ms_to_kn
from fairlead.operators.cut import computed
from fairlead.operators.interp import Axes, sample
from fairlead.operators.spatial import Waters
from fairlead.sources.specs import Vessel

SPACING_NM, EXEMPT_NM = 0.25, 1.5
WEATHER = ["hs_m", "period_peak_s", "period_mean_s", "wave_from_deg", "wind_u_ms", "wind_v_ms", "current_u_ms", "current_v_ms"]
#: Adds the WEATHER columns to rows with mid_lat, mid_lon and mid_t.
Weather = Callable[[DataFrame], DataFrame]


def scenario(name: str) -> Weather:
    w = synthetic_weather(name, F.col("mid_lat"), F.col("mid_lon"), F.col("mid_t"))
    return lambda rows: computed(rows, {"_w": w}).select(*rows.columns, "_w.*")


def gridded(table: DataFrame, axes: Axes) -> Weather:
    return lambda rows: sample(rows, table, axes, "mid_lat", "mid_lon", "mid_t")


def edge_limits(edges: DataFrame, waters: Waters, least_depth: float, exempt: list[tuple[float, float]] = ()) -> DataFrame:
    """Distinct ``edges(p_lat, p_lon, q_lat, q_lon)`` with navigable and depth_ok.

    Points every SPACING_NM or less are tested, the first end left out and the second taken; those within EXEMPT_NM
    of an exempt point need no depth.  Each edge is tested once, however many speeds and times use it.
    """
    ends = ["p_lat", "p_lon", "q_lat", "q_lon"]
    p, q = (F.col("p_lat"), F.col("p_lon")), (F.col("q_lat"), F.col("q_lon"))
    n = F.greatest(F.lit(1), F.ceil(distance_nm(*p, *q, waters.ref_lat) / SPACING_NM)).cast("int")
    spots = edges.select(*ends).distinct().withColumn("_n", n).withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("_n"))))
    spots = spots.withColumns({"_lat": between(p[0], q[0], F.col("_i") / F.col("_n")), "_lon": between(p[1], q[1], F.col("_i") / F.col("_n"))})
    lat, lon = F.col("_lat"), F.col("_lon")
    free = F.lit(False)
    for a, b in exempt:
        free = free | (distance_nm(lat, lon, F.lit(float(a)), F.lit(float(b)), waters.ref_lat) <= EXEMPT_NM)
    known = waters.described(spots.withColumn("_free", free), "_lat", "_lon")
    return known.groupBy(*ends).agg(
        F.bool_and("is_navigable").alias("navigable"), F.bool_and(F.col("_free") | (F.col("depth_m") >= least_depth)).alias("depth_ok"))


def evaluate(rows: DataFrame, weather: Weather, ship: Vessel, ref_lat: float = 42.3) -> DataFrame:
    """``rows(p_lat, p_lon, q_lat, q_lon, stw_ms, engines, t_h, ...)`` with course_deg, course_to_steer_deg, duration_h,
    fuel_kg, comfort, wear, max_hs, slam, overload, current_exceeds, non_finite.

    Weather is that of the middle of the leg, half its duration through still water after ``t_h``.  A current that
    cannot be held, or that leaves no way ahead, makes the duration infinite.
    """
    c = F.col
    p, q = (c("p_lat"), c("p_lon")), (c("q_lat"), c("q_lon"))
    v = c("stw_ms")
    first = computed(rows, {
        "_nm": distance_nm(*p, *q, ref_lat), "course_deg": bearing(*p, *q, ref_lat), "mid_lat": between(p[0], q[0], 0.5), "mid_lon": between(p[1], q[1], 0.5)})
    first = first.withColumn("mid_t", c("t_h") + c("_nm") / F.greatest(ms_to_kn(v), F.lit(1e-6)) / 2.0)
    w = weather(first)
    tri = current_triangle(v, c("course_deg"), c("current_u_ms"), c("current_v_ms"))
    power = twin.total_power(v, c("hs_m"), c("period_peak_s"), c("wave_from_deg"), c("course_deg"), ship)
    w = computed(w, {"_tri": _struct(tri), "_power": power})
    inf, ground = F.lit(float("inf")), c("_tri.ground_speed")
    hours = F.when(c("_tri.exceeded") | (~F.isnan(ground) & (ground <= 0)), inf).otherwise(c("_nm") / ms_to_kn(F.when(ground != 0, ground)))
    w = computed(w, {"duration_h": hours, "_load": F.array_max(twin.engine_loads(c("_power"), c("engines"), ship))})
    worn = twin.wear(v, c("hs_m"), c("wave_from_deg"), c("course_deg"), c("_load"), c("engines"), ship)
    w = computed(w, {
        "course_to_steer_deg": F.coalesce("_tri.course_to_steer", "course_deg"),
        "fuel_kg": twin.fuel_rate(c("_power"), c("engines"), ship) * c("duration_h"),
        "comfort": twin.motion_index(v, c("hs_m"), c("period_peak_s"), c("wave_from_deg"), c("course_deg"), ship) * c("duration_h"),
        "_worn": _struct(worn), "max_hs": c("hs_m")})
    w = w.withColumns({
        "wear": c("_worn.rate") * c("duration_h"), "slam": c("_worn.slam"), "overload": c("_worn.overload"), "current_exceeds": c("_tri.exceeded")})
    bad = F.lit(False)
    for x in ("duration_h", "fuel_kg", "comfort", "wear", "max_hs"):
        bad = bad | F.isnan(x)
    results = ["course_deg", "course_to_steer_deg", "duration_h", "fuel_kg", "comfort", "wear", "max_hs", "slam", "overload", "current_exceeds"]
    return w.withColumn("non_finite", bad).select(*rows.columns, *results, "non_finite")


def _struct(parts: dict[str, Column]) -> Column:
    return F.struct(*[c.alias(k) for k, c in parts.items()])


def feasible(rows: DataFrame) -> DataFrame:
    """Legs within every hard limit; those with missing weather go first, as NaN compares as the largest number."""
    return rows.where("not non_finite and navigable and depth_ok and not slam and not overload and not current_exceeds")


def speeds_ms(kn: list[float]) -> Column:
    return F.array(*[kn_to_ms(F.lit(float(x))) for x in kn])
